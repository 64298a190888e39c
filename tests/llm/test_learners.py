"""The learned operators next to plain Python versions: the classifier's updates and the language bundles."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.llm import language, quality, queries
from flowloom.llm.words import mix

M = (1 << 64) - 1


def plain_letter(point, dimensions, turns):
    """Signs of a letter: bits of mixed 64-bit words, most significant bit of each byte first, rotated."""
    signs = []
    for k in range(-(-dimensions // 64)):
        word = int(mix(np.array([((point << 32 | k) + 1) & M], np.uint64))[0])
        for byte in word.to_bytes(8, "little"):
            signs += [1 if byte >> (7 - b) & 1 else -1 for b in range(8)]
    signs = signs[:dimensions]
    return [signs[(i - turns) % dimensions] for i in range(dimensions)]


def plain_bundle(text, dimensions, made={}):
    """Sum of bound letter trigrams; runs of other characters are one blank, and a blank stands on either side."""
    line, open_ = [], True
    for c in (text or "").lower():
        if c.isalpha():
            line.append(c)
            open_ = False
        elif not open_:
            line.append(" ")
            open_ = True
    # A blank behind the last letter, where the text goes on, stands beside the closing one, as before the first letter.
    lead = [] if not line else [" "]
    line = lead + line + lead
    total = np.zeros(dimensions)
    for i in range(len(line) - 2):
        key = (dimensions, *line[i : i + 3])
        if key not in made:
            a, b, c = (np.array(plain_letter(ord(x), dimensions, t)) for x, t in zip(key[1:], (2, 1, 0)))
            made[key] = a * b * c
        total += made[key]
    return total


def test_language_as_plain_bundles(spark):
    texts = [("en", "the cat sat on the mat, twice"), ("en", "The dog; the log 99 the fog"), ("de", "Der Hund läuft über die Straße"), ("de", "die Katze schläft"),
             (None, "the dog and the cat"), (None, "die Straße und der Hund"), ("fr", "le chat dort"), (None, "12 34"), (None, None), (None, "x"), ("en", None), (None, "aaaa" * 700)]
    rows = spark.createDataFrame([(i, t, g) for i, (g, t) in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    size = 256
    got = {r.doc_id: r for r in language.identify(rows, language.learn(rows, dimensions=size)).collect()}
    prototypes = {}
    for g, t in texts:
        if g:
            prototypes[g] = prototypes.get(g, 0) + plain_bundle(t, size)
    for i, (_, t) in enumerate(texts):
        own = plain_bundle(t, size)
        if not own.any():
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        cosine = {g: float(own @ v) / (np.linalg.norm(own) * np.linalg.norm(v)) for g, v in prototypes.items()}
        best = max(sorted(cosine), key=cosine.get)
        assert got[i].lang_pred == best and got[i].score == pytest.approx(max(0.0, cosine[best]), abs=1e-9)


def test_language_query_as_plain_bundles(spark, sf_dir):
    """The registered query on its whole table, every text and every prototype bundled anew from counts of trigrams."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()
    signs = {}

    def sign(point, turns):
        if (point, turns) not in signs:
            signs[point, turns] = np.array(plain_letter(point, language.DIMENSIONS, turns))
        return signs[point, turns]

    def bundle(counts):
        total = np.zeros(language.DIMENSIONS)
        for (a, b, c), n in counts.items():
            total += n * (sign(a, 2) * sign(b, 1) * sign(c, 0))
        return total

    def counts_of(text):
        found, line = {}, " " + "".join(c if c.isalpha() else " " for c in (text or "").lower())
        while "  " in line[1:]:
            line = line[0] + line[1:].replace("  ", " ")
        line = " " + line[1:].removeprefix(" ") + " " if line.strip() else ""
        for i in range(len(line) - 2):
            key = tuple(map(ord, line[i : i + 3]))
            found[key] = found.get(key, 0) + 1
        return found

    counted = {d.doc_id: counts_of(d.text) for d in docs}
    learned = {}
    for d in docs:
        if d.lang is not None and zlib.crc32(str(d.doc_id).encode()) % 4 != 2:
            own = learned.setdefault(d.lang, {})
            for k, n in counted[d.doc_id].items():
                own[k] = own.get(k, 0) + n
    names = sorted(learned)
    unit = np.array([v / np.linalg.norm(v) for v in (bundle(learned[g]) for g in names)])
    got = {r.doc_id: r for r in queries.QUERIES["op10_language"](spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for d in docs:
        r = got[d.doc_id]
        assert r.held_out == (zlib.crc32(str(d.doc_id).encode()) % 4 == 2)
        if not counted[d.doc_id]:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        own = bundle(counted[d.doc_id])
        cosines = unit @ own / np.linalg.norm(own)
        assert r.lang_pred == names[int(np.argmax(cosines))] and r.score == pytest.approx(max(0.0, cosines.max()), abs=1e-9)


class PlainLeader:
    """Follow-the-regularised-leader, one coordinate after the other."""

    def __init__(self):
        self.z, self.n = {}, {}

    def weight(self, i):
        z = self.z.get(i, 0.0)
        if abs(z) <= quality.L1:
            return 0.0
        return -(z - math.copysign(quality.L1, z)) / ((quality.BETA + math.sqrt(self.n.get(i, 0.0))) / quality.ALPHA + quality.L2)

    def chance(self, row):
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(self.weight(i) * x for i, x in row)))))

    def update(self, row, label):
        error, old = self.chance(row) - label, {i: self.weight(i) for i, _ in row}
        for i, x in row:
            g, n = error * x, self.n.get(i, 0.0)
            self.z[i] = self.z.get(i, 0.0) + g - (math.sqrt(n + g * g) - math.sqrt(n)) / quality.ALPHA * old[i]
            self.n[i] = n + g * g


def test_quality_query_as_plain_updates(spark, sf_dir):
    """Weights and scores of the registered query from updates written out in plain Python, in the query's order and sharding."""
    import pyarrow as pa

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    marks = {}
    for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect():
        if zlib.crc32(str(r.doc_id).encode()) % 5 and r.quality is not None:
            marks.setdefault(r.doc_id, []).append(r.quality)
    turn = F.xxhash64("doc_id", F.lit(5))
    keyed = docs.select("doc_id", "text", turn.alias("turn"), F.xxhash64("text").alias("t"),
                        F.expr(f"pmod(hash(pmod(xxhash64(doc_id, 5), {quality.SHARDS})), {quality.SHARDS})").alias("shard")).collect()
    rows = {d.doc_id: [(int(i), float(x)) for i, x in zip(*next(iter(quality.features(pa.array([d.text], pa.string()))))
                                                           )] for d in keyed}
    total, sums = 0, {}
    for shard in range(quality.SHARDS):
        own = sorted((d for d in keyed if d.shard == shard and d.doc_id in marks), key=lambda d: (d.turn, d.t))
        model = PlainLeader()
        for turn_no in range(quality.PASSES):
            for d in own:
                row = rows[d.doc_id] if not turn_no else [(i, float(np.float32(x))) for i, x in rows[d.doc_id]]
                model.update(row, int(np.round(np.mean(marks[d.doc_id]))))
        total += len(own)
        for i in model.z:
            sums[i] = sums.get(i, 0.0) + model.weight(i) * len(own)
    got = {r.doc_id: r for r in queries.QUERIES["op4_quality"](spark, sf_dir).collect()}
    assert len(got) == len(keyed) and total == len([d for d in keyed if d.doc_id in marks])
    for d in keyed:
        want = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(sums.get(i, 0.0) / total * x for i, x in rows[d.doc_id])))))
        assert got[d.doc_id].score == pytest.approx(want, abs=1e-4)
        assert got[d.doc_id].predicted == (got[d.doc_id].score >= 0.3)


def test_features_of_a_short_text():
    """Words, pairs, shapes, shape pairs and repeats of a text of three words: values are roots of shares."""
    import pyarrow as pa

    (slots, values), = quality.features(pa.array(["Ab ab Ab"]))
    assert slots[0] == 0 and values[0] == 1.0 and len(set(slots.tolist())) == len(slots)
    assert (values[1:] ** 2 * 3).sum() == pytest.approx(15)  # five kinds, three words
