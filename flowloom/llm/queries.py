"""The registered queries of this subpackage and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions.lineage import cut
from flowloom.llm import bpe, chat, language, near, negatives, packing, pii, quality, sampling, search, substrings, warc, whitening
from flowloom.llm.columns import fold_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable:
    def wrap(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"

OP1_SQL = f"""
with recursive
w as (select doc_id, {_WORDS} as ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) = 0 then []::varchar[] when len(ws) < 5 then [array_to_string(ws, ' ')]
      else [array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)] end) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select x.doc_id as a, y.doc_id as b, count(*) as m from s x join s y on x.g = y.g and x.doc_id < y.doc_id group by all),
e as (select a, b from c join n p on p.doc_id = a join n q on q.doc_id = b where 100 * m >= 75 * (p.n + q.n - m)),
both_ways as (select a, b from e union all select b, a from e),
r as (select doc_id as a, doc_id as b from documents union select r.a, t.b from r join both_ways t on t.a = r.b)
select d.doc_id, coalesce(n.n, 0) as n_shingles, k.c as component_id, d.doc_id = k.c as kept
from documents d left join n using (doc_id) join (select a, min(b) as c from r group by a) k on k.a = d.doc_id
"""


@register("op1_near_duplicates", OP1_SQL)
def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP2_SQL = f"""
with w as (select doc_id, {_WORDS} as ws from documents),
l as (select doc_id, len(ws) as n from w where len(ws) > 0),
t as (select doc_id, word, count(*) as tf from (select doc_id, unnest(ws) as word from w) group by all),
s as (select count(*) as docs, avg(n) as mean from l),
f as (select word, count(*) as df from t group by word),
c as (select q.doc_id as query_id, d.doc_id, round(sum(ln(1 + (s.docs - df + 0.5) / (df + 0.5)) * d.tf * 2.2 / (d.tf + 1.2 * (0.25 + 0.75 * l.n / s.mean))), 6) as score
      from t q join t d using (word) join f using (word) join l on l.doc_id = d.doc_id, s
      where q.doc_id % 20 = 0 and q.doc_id <> d.doc_id group by all)
select query_id, rank::int as rank, doc_id, score
from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from c) where rank <= 10
"""


@register("op2_search", OP2_SQL)
def op2_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return search.top_k(docs, docs.filter("doc_id % 20 = 0"))


@register("op3_fingerprints")
def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.fingerprints(table(spark, sf_dir, "documents"))


@register("op4_quality")
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(fold_of(F.col("doc_id"), 5) != 0)
    held_out = F.coalesce(fold_of(F.col("doc_id"), 5) == 0, F.lit(False))
    scored = quality.score(docs, quality.learn(docs, labels))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@register("op5_bpe")
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@register("op6_packing")
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


OP7_SQL = """
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws from documents),
x as (select doc_id, unnest(range(1, len(ws) - 11)) as i, ws from w where len(ws) >= 13),
g as (select doc_id, i, md5(array_to_string(ws[i:i + 12], ' ')) as g from x),
f as (select g, min(doc_id) as d from g group by g),
late as (select g.doc_id, g.i from g join f using (g) where f.d < g.doc_id),
gone as (select distinct doc_id, unnest(range(i, i + 13)) as i from late),
p as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as i from w),
k as (select p.doc_id, string_agg(p.word, ' ' order by p.i) filter (where gone.i is null) as kept, count(gone.i) as n
      from p left join gone on gone.doc_id = p.doc_id and gone.i = p.i group by p.doc_id)
select w.doc_id, len(w.ws) as n_words, coalesce(k.n, 0) as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256
from w left join k using (doc_id)
"""


@register("op7_substring_dedup", OP7_SQL)
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.remove_repeats(docs, keep_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP8_SQL = """
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all select -1, i, r, '<|im_end|><|im_start|>assistant ok' from (values (0, 'user'), (1, 'assistant')) v(i, r)),
e as (select *, regexp_replace(text, '<\\|', '<||', 'g') as et, replace(regexp_replace(role, '<\\|', '<||', 'g'), chr(10), '<|nl|>') as er from t)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       sum(length('<|im_start|>' || er || chr(10) || et || '<|im_end|>' || chr(10)))::bigint as formatted_chars
from e group by conv_id
"""


@register("op8_chat", OP8_SQL)
def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.format_turns(chat.with_control_strings(table(spark, sf_dir, "conversations"))))


OP9_SQL = """
with d as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha1(coalesce(html, '')) as h from pages),
m as (select h, n, max(page_id) as best from d group by h, n)
select page_id, d.n as payload_bytes, list_aggregate(list_transform(range(0, 32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(d.h, ((i // 4) * 5 + 1)::int, 5))::bigint >> (15 - 5 * (i % 4))::int) & 31) + 1)::int, 1)),
         'string_agg', '') as payload_digest,
       case when page_id = best then 'response' else 'revisit' end as record_type,
       case when page_id = best then null else best end as refers_to
from d join m using (h, n)
"""


@register("op9_warc", OP9_SQL)
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(cut(warc.write(warc.kinds(table(spark, sf_dir, "pages")))))


@register("op10_language")
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = fold_of(F.col("doc_id"), 4)
    profiles = language.learn(language.learning_rows(docs, fold, 2))
    found = language.identify(docs.select("doc_id", "text"), profiles)
    return found.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


@register("op11_personal_data")
def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.learn(docs))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "n_added", "base_sha256", "spans")


OP12_SQL = """
with r as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                  list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
           from embeddings where label is not null and embedding is not null
           and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, a.label as own, b.vec_id, b.label,
             coalesce(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])), 0)::bigint as score
      from r a join r b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (select * from (select anchor_id, own, vec_id, score, row_number() over (partition by anchor_id order by score desc, vec_id) as n
                     from s where label = own) where n <= 5),
c as (select p.anchor_id, p.vec_id as positive_id, p.score as positive_score, s.vec_id as negative_id, s.score as negative_score,
             row_number() over (partition by p.anchor_id, p.vec_id order by s.score desc, s.vec_id) as rank
      from p join s on s.anchor_id = p.anchor_id and s.label <> p.own and 100 * s.score between 30 * p.score and 90 * p.score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from c where rank <= 10
"""


@register("op12_hard_negatives", OP12_SQL)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


@register("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
