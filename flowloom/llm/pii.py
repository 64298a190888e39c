"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds spans of other shapes.

1. ``base_spans`` finds emails, IP addresses, card numbers and phone numbers by fixed patterns in whole texts. No scan goes
   back over what it has read, so a long text costs its length.
2. The field scores whole spans of up to ``LONGEST`` tokens: counts of digits, letters and marks, shapes of the digit groups, Luhn
   and octet checks of the span as a whole, and what stands around it (``FIELDS``). A segmentation's score is the sum over its
   spans; tokens outside have none. Dynamic programming over the bounded span lengths chooses borders and kinds jointly.
3. Only stretches with a digit, an ``@`` or the word "dot" can hold a span, so the program runs over these alone (``stretches``). Base spans
   stay and are borders that no added span crosses.
4. The field is trained here: ``learn`` takes at most ``FIT`` stretches a kind, by a hash of their text from all documents, with the
   base spans as labels, rewritten copies of them (spelled-out marks, other groupings) and broken ones (a wrong check digit,
   an octet above 255) as counter-examples, and climbs the conditional likelihood by forward and backward sums.

Nulls and edges: a null text is empty; empty texts have no span. Offsets are code points, the end is exclusive. Rows are independent of
each other, so repeated rows, missing ids and ties need no rule. Without a base span in the whole table nothing is learned and
nothing is added. Columns named like the new ones give way to them.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.llm.columns import add_columns

KINDS = ("email", "ip", "card", "phone")
#: Tokens of the longest span, and stretches per kind (and as many without a span) that the field is fitted on.
LONGEST, FIT = 24, 120
#: Characters around a trigger that belong to its stretch, and the longest stretch that is learned from.
AROUND, FIT_CHARS = 48, 240
STEPS, RATE, RIDGE = 30, 0.5, 1e-3
#: How much likelier (natural logarithm) a span must be than none. High, since clean texts are many.
MARGIN = 1.5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9]+|@|(?<![a-z])dot(?![a-z])")
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|.", re.DOTALL)

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (2 if k % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the fixed patterns, by kind and start; leftmost, and without overlaps inside a kind."""
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            out.append((0, start, done))
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "") if m.end() - m.start() >= 16 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((3, *m.span()))
    return out


def stretches(text: str) -> Iterator[tuple[int, int]]:
    """Parts of a text that can hold a span, in order and apart from each other."""
    start = end = -1
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        if a > end:
            if end >= 0:
                yield start, end
            start = a
        end = b
    if end >= 0:
        yield start, end


# ---- features of whole spans ----

#: Upper ends of the classes into which a count falls.
_STEPS = {
    "digits": (0, 3, 6, 7, 9, 10, 11, 12, 15, 16, 19), "letters": (0, 2, 6, 12, 24), "chars": (6, 9, 12, 16, 20, 28, 40), "groups": (0, 1, 2, 3, 4, 5), "longest": (0, 2, 3, 4, 6, 9),
    "ats": (0, 1), "at_words": (0, 1), "dots": (0, 1, 2, 3), "dot_words": (0, 1, 2), "spaces": (0, 1, 2, 3, 5, 8), "dashes": (0, 1, 2, 3), "opened": (0, 1), "closed": (0, 1), "plusses": (0, 1), "others": (0, 1, 2),
}
FIELDS = (*_STEPS, "ends", "around", "inner ends", "plus first", "luhn", "octets", "bias")
_WIDTH = 64
#: Types of a token: digits, letters, white space, each mark of its own, any other.
_MARKS = {c: 3 + i for i, c in enumerate("@.-()+_%,:;/=\"'#")}
_NONE = 3 + len(_MARKS) + 1
_COARSE = np.array([0, 1, 2, 3, 4, 4, 4, 4, 4, 4, 4, *[5] * (_NONE - 10)], np.int64)  # for the ends and the neighbours


class Tokens:
    """Tokens of a stretch and the counts that features are differences of."""

    def __init__(self, text: str):
        found = list(_TOKEN.finditer(text))
        self.starts = np.array([m.start() for m in found], np.int64)
        self.ends = np.array([m.end() for m in found], np.int64)
        words = [m.group() for m in found]
        self.type = np.array([0 if "0" <= w[0] <= "9" else 1 if w[0].isalpha() else 2 if w.isspace() else _MARKS.get(w, _NONE - 1) for w in words], np.int64)
        size = np.diff(np.append(self.starts, len(text))) if len(found) else np.zeros(0, np.int64)
        digit, letter = self.type == 0, self.type == 1
        lower = [w.lower() for w in words]
        counts = {
            "digits": size * digit, "letters": size * letter, "chars": size, "groups": digit, "ats": self.type == _MARKS["@"], "at_words": np.array([w == "at" for w in lower], bool), "dots": self.type == _MARKS["."],
            "dot_words": np.array([w == "dot" for w in lower], bool), "spaces": self.type == 2, "dashes": self.type == _MARKS["-"], "opened": self.type == _MARKS["("], "closed": self.type == _MARKS[")"], "plusses": self.type == _MARKS["+"],
            "others": self.type > _MARKS["+"], "lines": np.array(["\n" in w or "\r" in w for w in words], bool), "high": np.array([d and (len(w) > 3 or int(w) > 255) for d, w in zip(digit.tolist(), words, strict=True)], bool),
        }
        self.size = size * digit
        self.sums = {k: np.append(0, np.cumsum(v)) for k, v in counts.items()}
        # Digit sums with every second digit doubled, for either parity, at token borders.
        digits = np.array([int(c) for w, d in zip(words, digit.tolist(), strict=True) if d for c in w], np.int64)
        odd = np.arange(len(digits)) % 2 == 1
        twice = np.where(digits > 4, 2 * digits - 9, 2 * digits)
        borders = self.sums["digits"]
        self.luhn = [np.append(0, np.cumsum(np.where(odd == p, digits, twice)))[borders] for p in (False, True)]

    def __len__(self) -> int:
        return len(self.starts)

    def codes(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Feature classes (field, start, length - 1) of the spans that begin at tokens ``first`` to ``last``, and which may be spans."""
        n = len(self)
        i = np.arange(first, last)[:, None]
        j = i + np.arange(1, LONGEST + 1)
        inside = j <= n
        j = np.minimum(j, n)
        count = {k: v[j] - v[i] for k, v in self.sums.items()}
        padded = np.append(self.size, np.zeros(LONGEST, np.int64))
        count["longest"] = np.maximum.accumulate(padded[i + np.arange(LONGEST)], axis=1)
        out = np.zeros((len(FIELDS), last - first, LONGEST), np.uint8)
        for k, (name, steps) in enumerate(_STEPS.items()):
            out[k] = np.searchsorted(steps, count[name], side="left")
        kind = np.append(_COARSE[self.type], [2, 2])
        begin, end, before, after = kind[i], kind[j - 1], np.where(i > 0, kind[i - 1], 2), np.where(j < n, kind[np.minimum(j, n)], 2)
        # The last digit of a span is not doubled.
        parity = (self.sums["digits"][j] - 1) % 2 == 1
        check = np.where(parity, self.luhn[1][j] - self.luhn[1][i], self.luhn[0][j] - self.luhn[0][i])
        long = (count["digits"] >= 16) & (count["digits"] <= 19)
        whole = {
            "ends": begin * 6 + end,
            "around": before * 6 + after,
            "inner ends": np.where(j - i > 1, kind[np.minimum(i + 1, n)] * 6 + kind[j - 2], 36),
            "plus first": np.append(self.type, _NONE)[i] == _MARKS["+"],
            "luhn": np.where(long, 1 + (check % 10 == 0), 0),
            "octets": np.where(count["groups"] == 4, 1 + (count["high"] == 0) + (count["high"] == 0) * (count["letters"] == 0), 0),
        }
        for name, classes in whole.items():
            out[FIELDS.index(name)] = classes
        held = (count["digits"] > 0) | (count["ats"] > 0) | (count["dot_words"] > 0)
        may = inside & held & (count["lines"] == 0) & (begin != 2) & (end != 2)
        return out, may


def scores(codes: np.ndarray, may: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """(start, length - 1, kind): scores of spans; minus infinity where no span may be."""
    out = np.zeros((*may.shape, len(KINDS)))
    for field, table in zip(codes, weights, strict=True):
        out += table[field]
    out[~may] = -np.inf
    return out


def decode(text: str, weights: np.ndarray, barriers: list[tuple[int, int]], chunk: int = 2048) -> list[Span]:
    """Spans of the likeliest segmentation of a stretch; none touches a barrier."""
    tokens = Tokens(text)
    n = len(tokens)
    covered = np.zeros(n + 1, np.int64)
    if barriers:
        a, b = np.array(barriers, np.int64).T
        np.add.at(covered, np.searchsorted(tokens.ends, a, side="right"), 1)
        np.add.at(covered, np.searchsorted(tokens.starts, b, side="left"), -1)
    barred = np.append(0, np.cumsum(np.cumsum(covered)[:n] > 0))
    best = np.zeros(n + 1)
    back: list[tuple[int, int] | None] = [None] * (n + 1)
    ending: dict[int, list[tuple[int, int, float]]] = {}
    for first in range(0, n, chunk):
        last = min(n, first + chunk)
        score = scores(*tokens.codes(first, last), weights) - MARGIN
        kind, top = score.argmax(axis=2), score.max(axis=2)
        # A span that is worse than none never helps.
        for i, size in zip(*np.nonzero(top > 0), strict=True):
            start, end = first + int(i), first + int(i) + int(size) + 1
            if barred[end] == barred[start]:
                ending.setdefault(end, []).append((start, int(kind[i, size]), float(top[i, size])))
        # Spans that end here have begun in this chunk or before it.
        for end in range(first + 1, last + 1):
            best[end] = best[end - 1]
            for start, k, s in ending.pop(end, ()):
                if best[start] + s > best[end]:
                    best[end], back[end] = best[start] + s, (start, k)
    out, at = [], n
    while at > 0:
        if back[at] is None:
            at -= 1
        else:
            start, k = back[at]
            out.append((k, int(tokens.starts[start]), int(tokens.ends[at - 1])))
            at = start
    return out[::-1]


def find_spans(text: str, weights: np.ndarray | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and those that the field adds."""
    base, added = base_spans(text), []
    if weights is not None:
        ordered = sorted((a, b) for _, a, b in base)
        low = 0
        for start, end in stretches(text):
            while low < len(ordered) and ordered[low][1] <= start:
                low += 1
            near = []
            for a, b in ordered[low:]:
                if a >= end:
                    break
                near.append((a - start, b - start))
            added += [(k, a + start, b + start) for k, a, b in decode(text[start:end], weights, near)]
    return base, added


# ---- training ----


def _rewritten(kind: int, span: str, rnd: random.Random) -> tuple[str, bool]:
    """Another way to write a span, or a broken one that is none any more."""
    digits = "".join(c for c in span if c.isdigit())
    way = rnd.randrange(4)
    if kind == 0:
        local, domain = span.rsplit("@", 1)
        at, dot = ((" at ", " dot "), (" (at) ", " (dot) "), ("(at)", "."), (" @ ", "."))[way]
        return local + at + domain.replace(".", dot), True
    if kind == 1:
        parts = span.split(".")
        if way < 2:
            parts[rnd.randrange(4)] = str(rnd.randrange(256, 1000))
            return ".".join(parts), False
        return (" . " if way == 2 else "[.]").join(parts), True
    if kind == 2:
        if way < 2:
            at = rnd.randrange(len(digits))
            return span[: -len(span)] + digits[:at] + str((int(digits[at]) + rnd.randrange(1, 9)) % 10) + digits[at + 1 :], False
        return (". "[way - 2] * (way - 1)).join(digits[k : k + 4] for k in range(0, len(digits), 4)), True
    tail = digits[-10:]
    if len(tail) < 10:
        return span[1:], True
    a, b, c = tail[:3], tail[3:6], tail[6:]
    return (f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{digits[:-10]} {a} {b} {c}")[way], True


def _examples(rows: list[tuple[str, list[Span]]]) -> list[tuple[str, list[Span]]]:
    """The stretches and, for each with spans, a copy whose spans are rewritten."""
    out = []
    for text, spans in rows:
        out.append((text, spans))
        rnd = random.Random(text)
        at, parts, moved, size = 0, [], [], 0
        for kind, a, b in sorted(spans, key=lambda s: s[1]):
            new, real = _rewritten(kind, text[a:b], rnd)
            parts += [text[at:a], new]
            size += a - at
            if real:
                moved.append((kind, size, size + len(new)))
            size, at = size + len(new), b
        if spans:
            out.append(("".join(parts) + text[at:], moved))
    return out


def fit(rows: list[tuple[str, list[Span]]], steps: int = STEPS) -> np.ndarray | None:
    """Weights (field, class, kind) of the field, by the conditional likelihood of the labelled stretches."""
    coded = []
    for text, spans in _examples(rows):
        tokens = Tokens(text)
        first, last = ({int(v): k for k, v in enumerate(x)} for x in (tokens.starts, tokens.ends))
        places = [(first.get(a), last.get(b), kind) for kind, a, b in spans]
        if len(tokens) and all(a is not None and b is not None and b - a < LONGEST for a, b, _ in places):
            coded.append((*tokens.codes(0, len(tokens)), [(a, b - a, kind) for a, b, kind in places]))
    if not any(places for _, _, places in coded):
        return None
    kinds, longest = len(KINDS), max(len(may) for _, may, _ in coded)
    # Stretches of unequal length side by side: what lies behind the end may not be a span.
    codes = np.zeros((len(FIELDS), len(coded), longest, LONGEST), np.uint8)
    may = np.zeros((len(coded), longest, LONGEST), bool)
    gold = np.zeros((len(coded), longest, LONGEST, kinds), bool)
    for r, (c, m, places) in enumerate(coded):
        codes[:, r, : len(m)], may[r, : len(m)] = c, m
        for a, size, kind in places:
            may[r, a, size] = True
            gold[r, a, size, kind] = True
    spots = np.nonzero(may)
    rows_, starts, sizes = spots
    order = np.argsort(starts, kind="stable")
    rows_, starts, sizes = rows_[order], starts[order], sizes[order]
    cells = codes[:, rows_, starts, sizes]
    target = gold[rows_, starts, sizes]
    ends = starts + sizes + 1
    by_start = np.searchsorted(starts, np.arange(longest + 1))
    by_end = np.argsort(ends, kind="stable")
    at_end = np.searchsorted(ends[by_end], np.arange(longest + 2))
    weights, pace = np.zeros((len(FIELDS), _WIDTH, kinds)), np.full((len(FIELDS), _WIDTH, kinds), 1e-8)
    weights[-1, 0] = -2.0
    for _ in range(steps):
        score = sum(table[cell] for table, cell in zip(weights, cells, strict=True))
        peak = np.maximum(score.max(axis=1), -60)
        whole = np.exp(np.clip(score - peak[:, None], -60, 0)).sum(axis=1)
        total = peak + np.log(whole)  # of a place, over the kinds
        ahead, behind = np.zeros((longest + 1, len(coded))), np.zeros((longest + 1, len(coded)))
        for j in range(1, longest + 1):
            here = by_end[at_end[j] : at_end[j + 1]]
            sums = np.zeros(len(coded))
            np.add.at(sums, rows_[here], np.exp(np.minimum(ahead[starts[here], rows_[here]] + total[here] - ahead[j - 1, rows_[here]], 60)))
            ahead[j] = ahead[j - 1] + np.log1p(sums)
        for i in range(longest - 1, -1, -1):
            here = slice(by_start[i], by_start[i + 1])
            sums = np.zeros(len(coded))
            np.add.at(sums, rows_[here], np.exp(np.minimum(behind[ends[here], rows_[here]] + total[here] - behind[i + 1, rows_[here]], 60)))
            behind[i] = behind[i + 1] + np.log1p(sums)
        chance = np.exp(np.clip((ahead[starts, rows_] + behind[ends, rows_] - ahead[longest, rows_])[:, None] + score, -60, 0))
        slope = target - chance
        gradient = np.stack([np.stack([np.bincount(cell, slope[:, k], minlength=_WIDTH) for k in range(kinds)], axis=1) for cell in cells])
        gradient = gradient / len(coded) - RIDGE * weights
        pace += gradient * gradient
        weights += RATE * gradient / np.sqrt(pace)
    return weights


def learn(docs: DataFrame, fit_rows: int = FIT) -> np.ndarray | None:
    """The field's weights; at most ``fit_rows`` stretches for each kind, and as many without a span, are brought together."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, str, int]] = []
            for text in batch.column(0):
                text = text.as_py() or ""
                base, low = None, 0
                for start, end in stretches(text):
                    if end - start > FIT_CHARS:
                        continue
                    if base is None:
                        base = sorted(base_spans(text), key=lambda s: s[1])
                    while low < len(base) and base[low][2] <= start:
                        low += 1
                    own = []
                    for k, a, b in base[low:]:
                        if a >= end:
                            break
                        if b > start:
                            own.append((k, a - start, b - start))
                    # A span that the border cuts, or two that overlap, tell nothing certain.
                    if any(a < 0 or b > end - start for _, a, b in own) or any(x[2] > y[1] for x, y in zip(own, own[1:], strict=False)):
                        continue
                    out.append((text[start:end], _printed(own), own[0][0] if own else len(KINDS)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ([], [], []), (pa.string(), pa.string(), pa.int32()), strict=True)], names=["part", "spans", "kind"])

    found = docs.select("text").mapInArrow(step, "part string, spans string, kind int").withColumn("h", F.xxhash64("part"))
    # First inside salted groups, so a frequent kind is not one task's.
    for keys in (["kind", F.pmod(F.col("h"), F.lit(64))], ["kind"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("h", "part"))).filter(F.col("rank") <= fit_rows).drop("rank")
    rows = sorted((r["part"], r["spans"]) for r in found.collect())
    number = {k: i for i, k in enumerate(KINDS)}
    read = lambda s: [(number[k], int(a), int(b)) for k, a, b in (x.split(":") for x in s.split(",") if x)]
    return fit([(part, read(spans)) for part, spans in dict.fromkeys(rows)])


def _printed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find(docs: DataFrame, weights: np.ndarray | None, redact: bool = False) -> DataFrame:
    """``docs`` and n_email, n_ip, n_card, n_phone (of the fixed patterns), n_added, base_sha256 and spans (all, in order of kind and start).

    With ``redact`` also ``redacted``: the text with each span, the longest of those that overlap, replaced by its kind.
    """
    fields = [*(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("n_added", T.LongType()), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
    names = {f.name for f in fields} | {"redacted"}
    # The text goes along under a name of its own, whatever the other columns are called.
    rest = [c for c in docs.columns if c.lower() not in names]
    at = len(rest)
    while "_" * at in rest:
        at += 1
    carried = docs.select(*[F.col(f"`{c}`") for c in rest], F.col("text").cast("string").alias("_" * at))

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        counts, added_count, digest, printed, masked = [], [], [], [], []
        for text in batch.column(batch.num_columns - 1):
            text = text.as_py() or ""
            base, added = find_spans(text, weights)
            counts.append([sum(k == kind for k, _, _ in base) for kind in range(len(KINDS))])
            added_count.append(len(added))
            digest.append(hashlib.sha256(_printed(base).encode()).hexdigest())
            printed.append(_printed(base + added))
            if redact:
                masked.append(masked_text(text, base + added))
        out = [pa.array([c[k] for c in counts], pa.int64()) for k in range(len(KINDS))]
        out += [pa.array(added_count, pa.int64()), pa.array(digest, pa.string()), pa.array(printed, pa.string())]
        return out + [pa.array(masked, pa.string())] * redact

    return add_columns(carried, make, fields + [T.StructField("redacted", T.StringType())] * redact).drop("_" * at)


def masked_text(text: str, spans: list[Span]) -> str:
    """The text with spans replaced by their kind; spans that overlap become one, of the longest one's kind."""
    joined: list[list[int]] = []  # kind, start, end, length of the span that named it
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if joined and a < joined[-1][2]:
            last = joined[-1]
            last[2] = max(last[2], b)
            if b - a > last[3]:
                last[0], last[3] = k, b - a
        else:
            joined.append([k, a, b, b - a])
    parts, at = [], 0
    for k, a, b, _ in joined:
        parts += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = b
    return "".join(parts) + text[at:]
