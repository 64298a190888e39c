"""The pipeline against the same steps in plain Python."""

import random
from collections import defaultdict

import corpus_pipeline as pipeline
import numpy as np
import public_tokenizers
import zlib
from tokenizers import Tokenizer

from flowloom.llm import language, quality
from .test_operators import plain_classes, plain_repeats


def test_pipeline_as_brute_force(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    profiles = language.learn(table)
    docs = {}
    for r in table.select("doc_id", "text").collect():
        lang, score = profiles.predict(r.text)
        if lang != "und" and score >= pipeline.LEAST_COSINE:
            docs[r.doc_id] = r.text
    kept = spark.createDataFrame(sorted(docs.items()), "doc_id long, text string")
    weights = quality.learn(kept, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scores = {r.doc_id: r.score for r in quality.score(kept, weights).collect()}
    assert min(abs(s - pipeline.LEAST_QUALITY) for s in scores.values()) > 1e-4
    docs = {i: t for i, t in docs.items() if scores[i] >= pipeline.LEAST_QUALITY}
    classes = plain_classes(docs.items())
    docs = {i: t for i, t in docs.items() if classes[i][1] == i}
    docs = {i: kept if gone else docs[i] for i, words, gone, _, kept in plain_repeats(docs.items()) if gone < words or not gone}
    assert 0 < len(docs) < table.count()

    got = defaultdict(list)
    for r in pipeline.run(spark, sf_dir).collect():
        got[r.doc_id].append(r)
    assert got.keys() == docs.keys()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, text in docs.items():
        ids, at = np.array([*library.encode(text, add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(got[i], key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_language_stage_rejects_unseen_scripts(spark, sf_dir):
    rnd = random.Random(7)
    known = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*pipeline.COLUMNS)
    texts = []
    for low, high in ((0xE01, 0xE2F), (0x430, 0x450), (0xAC00, 0xD7A4), (0x3B1, 0x3CA), (0x10D0, 0x10F1)):
        letters = [chr(c) for c in range(low, high) if chr(c).isalpha()]
        texts += [" ".join("".join(rnd.choices(letters, k=rnd.randrange(2, 9))) for _ in range(200)) for _ in range(40)]
    planted = [(-1 - i, t, None, "planted", len(t)) for i, t in enumerate(texts)]
    short = [(-1000 - i, t, None, "planted", len(t)) for i, t in enumerate(("the weather is nice today", "where is the station", "this is a short note"))]
    docs = known.unionByName(spark.createDataFrame(planted + short, known.schema))
    got = {r.doc_id for r in pipeline.known_language(spark, docs, sf_dir).select("doc_id").collect()}
    assert not got & {r[0] for r in planted} and got >= {r[0] for r in short}


def test_stages():
    assert [n for n, _ in pipeline.STAGES] == ["language", "quality", "near_duplicates", "substrings", "packing"]
    assert pipeline.ORACLE_SQL is None
