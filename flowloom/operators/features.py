"""The 77 flow features, as expressions over the exact moments of ``flow_moments``."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.operators.flows import FLOW_KEY

# Published feature names of the labelled data set, in contract order.
FEATURE_NAMES = (
    "Destination Port", "Flow Duration", "Total Fwd Packets", "Total Backward Packets",
    "Total Length of Fwd Packets", "Total Length of Bwd Packets", "Fwd Packet Length Max",
    "Fwd Packet Length Min", "Fwd Packet Length Mean", "Fwd Packet Length Std",
    "Bwd Packet Length Max", "Bwd Packet Length Min", "Bwd Packet Length Mean",
    "Bwd Packet Length Std", "Flow Bytes/s", "Flow Packets/s", "Flow IAT Mean", "Flow IAT Std",
    "Flow IAT Max", "Flow IAT Min", "Fwd IAT Total", "Fwd IAT Mean", "Fwd IAT Std",
    "Fwd IAT Max", "Fwd IAT Min", "Bwd IAT Total", "Bwd IAT Mean", "Bwd IAT Std",
    "Bwd IAT Max", "Bwd IAT Min", "Fwd PSH Flags", "Bwd PSH Flags", "Fwd URG Flags",
    "Bwd URG Flags", "Fwd Header Length", "Bwd Header Length", "Fwd Packets/s",
    "Bwd Packets/s", "Min Packet Length", "Max Packet Length", "Packet Length Mean",
    "Packet Length Std", "Packet Length Variance", "FIN Flag Count", "SYN Flag Count",
    "RST Flag Count", "PSH Flag Count", "ACK Flag Count", "URG Flag Count", "CWE Flag Count",
    "ECE Flag Count", "Down/Up Ratio", "Average Packet Size", "Avg Fwd Segment Size",
    "Avg Bwd Segment Size", "Fwd Avg Bytes/Bulk", "Fwd Avg Packets/Bulk", "Fwd Avg Bulk Rate",
    "Bwd Avg Bytes/Bulk", "Bwd Avg Packets/Bulk", "Bwd Avg Bulk Rate", "Subflow Fwd Packets",
    "Subflow Fwd Bytes", "Subflow Bwd Packets", "Subflow Bwd Bytes", "Init_Win_bytes_forward",
    "Init_Win_bytes_backward", "act_data_pkt_fwd", "min_seg_size_forward", "Active Mean",
    "Active Std", "Active Max", "Active Min", "Idle Mean", "Idle Std", "Idle Max", "Idle Min",
)
# Shortest duration used as a divisor, in seconds.
EPS = 1e-10
_WIDE = "decimal(38,0)"


def snake(name: str) -> str:
    """Column name of a feature: lower case, ``/s`` spelled out, other marks to underscores."""
    return (
        name.lower().replace("/s", "_per_s").replace("/", "_").replace(" ", "_").replace(".", "_")
    )


FEATURES = tuple(snake(n) for n in FEATURE_NAMES)


def _f(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, _f(a) / _f(b)).otherwise(F.lit(0.0))


def _variances(moments: Mapping[str, tuple[Column, Column, Column]]) -> dict[str, Column]:
    """Population variances from exact integer (count, sum, sum of squares); 0 below two values.

    Squares are taken around the whole part of the mean, so nothing cancels. Sums that could
    leave the long range take the same steps in decimals. The array function keeps the wide
    feature projection out of one huge generated method, which the JVM would not compile.
    """

    def around_mean(m: Column, kind: str) -> Column:
        n, total, squares = (m[c].cast(kind) for c in ("n", "total", "squares"))
        whole = F.call_function("div", total, n).cast(kind)
        spread = squares - (F.lit(2).cast(kind) * whole * total).cast(kind) + (n * whole * whole).cast(kind)
        rest = _f(total - n * whole) / _f(n)
        return F.greatest(_f(spread) / _f(n) - rest * rest, F.lit(0.0))

    def variance(m: Column) -> Column:
        exact = F.when(m["squares"] < F.lit(10**18), around_mean(m, "long")).otherwise(around_mean(m, _WIDE))
        return F.when(m["n"] > 1, exact).otherwise(F.lit(0.0))

    rows = [
        F.struct(n.cast("long").alias("n"), total.cast("long").alias("total"), squares.cast(_WIDE).alias("squares"))
        for n, total, squares in moments.values()
    ]
    every = F.transform(F.array(*rows), variance)
    return {name: F.get(every, F.lit(i)) for i, name in enumerate(moments)}


def _zero(c: Column) -> Column:
    return F.coalesce(_f(c), F.lit(0.0))


def feature_columns() -> dict[str, Column]:
    """Expression per feature over the columns of ``flow_moments``."""
    c = F.col
    zero = F.lit(0.0)
    seconds = F.greatest((c("end_us") - c("start_us")) / F.lit(1_000_000.0), F.lit(EPS))
    n, size = c("fwd_n") + c("bwd_n"), c("fwd_bytes") + c("bwd_bytes")
    sums = {d: F.coalesce(c(f"{d}_gap_sum"), F.lit(0)) for d in ("fwd", "bwd")}
    gap_n, gap_sum = c("fwd_gap_n") + c("bwd_gap_n"), sums["fwd"] + sums["bwd"]
    var = _variances({
        "len": (n, size, c("fwd_len_sq") + c("bwd_len_sq")),
        "gap": (gap_n, gap_sum, c("fwd_gap_sq") + c("bwd_gap_sq")),
        **{f"{d}_len": (c(f"{d}_n"), c(f"{d}_bytes"), c(f"{d}_len_sq")) for d in sums},
        **{f"{d}_gap": (c(f"{d}_gap_n"), total, c(f"{d}_gap_sq")) for d, total in sums.items()},
    })
    out: dict[str, Column] = {
        "Destination Port": _f("dst_port"),
        "Flow Duration": seconds * F.lit(1e6),
        "Total Fwd Packets": _f("fwd_n"),
        "Total Backward Packets": _f("bwd_n"),
        "Total Length of Fwd Packets": _f("fwd_bytes"),
        "Total Length of Bwd Packets": _f("bwd_bytes"),
        "Flow Bytes/s": _f(size) / seconds,
        "Flow Packets/s": _f(n) / seconds,
        "Flow IAT Mean": _ratio(gap_sum, gap_n),
        "Flow IAT Std": F.sqrt(var["gap"]),
        "Flow IAT Max": _zero(F.greatest("fwd_gap_max", "bwd_gap_max")),
        "Flow IAT Min": _zero(F.least("fwd_gap_min", "bwd_gap_min")),
        "Min Packet Length": _zero(F.least("fwd_len_min", "bwd_len_min")),
        "Max Packet Length": _zero(F.greatest("fwd_len_max", "bwd_len_max")),
        "Packet Length Mean": _ratio(size, n),
        "Packet Length Std": F.sqrt(var["len"]),
        "Packet Length Variance": var["len"],
        "CWE Flag Count": _f("cwr_count"),
        "Down/Up Ratio": _ratio(c("bwd_n"), c("fwd_n")),
        "Average Packet Size": _ratio(size, n),
        "Init_Win_bytes_forward": zero,
        "Init_Win_bytes_backward": zero,
        "act_data_pkt_fwd": F.when(c("fwd_payload") > 0, F.lit(1.0)).otherwise(zero),
        "min_seg_size_forward": _zero(c("fwd_len_min")),
    }
    for f in ("FIN", "SYN", "RST", "PSH", "ACK", "URG", "ECE"):
        out[f"{f} Flag Count"] = _f(f"{f.lower()}_count")
    for d, label in (("fwd", "Fwd"), ("bwd", "Bwd")):
        dn, db = c(f"{d}_n"), c(f"{d}_bytes")
        gn, gs = c(f"{d}_gap_n"), sums[d]
        out |= {
            f"{label} Packet Length Max": _zero(c(f"{d}_len_max")),
            f"{label} Packet Length Min": _zero(c(f"{d}_len_min")),
            f"{label} Packet Length Mean": _ratio(db, dn),
            f"{label} Packet Length Std": F.sqrt(var[f"{d}_len"]),
            f"{label} IAT Total": _f(gs),
            f"{label} IAT Mean": _ratio(gs, gn),
            f"{label} IAT Std": F.sqrt(var[f"{d}_gap"]),
            f"{label} IAT Max": _zero(c(f"{d}_gap_max")),
            f"{label} IAT Min": _zero(c(f"{d}_gap_min")),
            f"{label} PSH Flags": _f(f"{d}_psh"),
            f"{label} URG Flags": _f(f"{d}_urg"),
            f"{label} Header Length": _f(c(f"{d}_bytes") - c(f"{d}_payload")),
            f"{label} Packets/s": _f(dn) / seconds,
            f"Avg {label} Segment Size": _ratio(db, dn),
            f"Subflow {label} Packets": _f(dn),
            f"Subflow {label} Bytes": _f(db),
            # Not observable from these packets; the contract fixes them at zero.
            f"{label} Avg Bytes/Bulk": zero,
            f"{label} Avg Packets/Bulk": zero,
            f"{label} Avg Bulk Rate": zero,
        }
    for state in ("Active", "Idle"):
        out |= {f"{state} {m}": zero for m in ("Mean", "Std", "Max", "Min")}
    return {name: out[name] for name in FEATURE_NAMES}


def flow_features(moments: DataFrame, names: tuple[str, ...] = FEATURE_NAMES) -> DataFrame:
    """Flow key plus the requested features under their snake-case names."""
    exprs = feature_columns()
    return moments.select(
        *FLOW_KEY, "session", *[exprs[name].alias(snake(name)) for name in names]
    )


def feature_vector(df: DataFrame, contract: list[str], out: str = "features") -> DataFrame:
    """Array of the contract columns in order; a missing or null feature counts as 0."""
    cells = [F.coalesce(_f(c), F.lit(0.0)) if c in df.columns else F.lit(0.0) for c in contract]
    return df.withColumn(out, F.array(*cells))


def safe_stats(values: Column | str) -> dict[str, Column]:
    """Statistics of an array column that stay 0 when there are too few values."""
    arr = F.col(values) if isinstance(values, str) else values
    arr = F.transform(arr, lambda x: x.cast("double"))
    n = F.size(arr)
    total = F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)
    mean = F.when(n > 0, total / n).otherwise(F.lit(0.0))
    dev = F.aggregate(arr, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    var = F.when(n > 1, dev / n).otherwise(F.lit(0.0))
    return {
        "mean": mean,
        "std": F.sqrt(var),
        "var": var,
        "max": F.coalesce(F.array_max(arr), F.lit(0.0)),
        "min": F.coalesce(F.array_min(arr), F.lit(0.0)),
        "sum": total,
    }
