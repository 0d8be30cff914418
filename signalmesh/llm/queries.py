"""The registered queries of this subpackage, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fingerprints, jaccard_join, katz, language_id, line_dedup, merge_dropout, secrets, token_files, warc

KINDS_BASE = ("assign", "access", "hex")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(col: str, n: int) -> Column:
    """crc32 of an id as text, modulo n; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(col).cast("string")) % n, F.lit(0))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(table(spark, sf_dir, "pages")).where("kind = 'record'")
    number = lambda c: F.expr(f"try_cast({c} as bigint)")
    return records.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_files.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return out.withColumnRenamed("id", "doc_id")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS_BASE))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS_BASE]
    return found.select("doc_id", *counts, F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.against_next(table(spark, sf_dir, "documents"))


def op6_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_dropout.encode_digests(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op8_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"), fold_of("doc_id", 10) == 0)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold_of("doc_id", 5) == 0)
    return language_id.identify(docs, docs.where(~F.col("held_out")), keep=["held_out"])


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.judged(decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", decontaminate.items_digest().alias("items_sha256"), "contaminated")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_warc, op2_line_dedup, op3_token_records, op4_secret_scan, op5_fingerprint, op6_merge_dropout, op7_jaccard_join, op8_katz, op9_language_id, op10_decontaminate]
    return {f.__name__: f for f in own}


_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
q as (select page_id, octet_length(b) as n, sha1(b) as d from p),
k as (select *, max(page_id) over (partition by d) as keep from q)
select page_id, cast(n as bigint) as payload_bytes, d as payload_digest,
       case when n >= 1000 and page_id < keep then 'revisit' else 'response' end as record_type,
       case when n >= 1000 and page_id < keep then keep end as refers_to
from k
"""

OP2_SQL = f"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents),
k as (select *, {_LOWER.format("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} as key from l),
r as (select key, max(doc_id) as keep from k where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
m as (select k.*, r.keep is not null and r.keep <> k.doc_id as gone from k left join r on r.key = k.key)
select doc_id, count(*) as n_lines, cast(sum(gone::int) as bigint) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from m group by doc_id
"""

OP10_SQL = f"""
with w as (select doc_id, list_filter(string_split_regex({_LOWER.format("text")}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w from documents),
b as (select item_id, list_filter(string_split_regex({_LOWER.format("text")}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w from benchmark),
bw as (select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as g from
  (select item_id, w, least(13, len(w)) as n, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i from b where len(w) > 0)),
sizes as (select distinct n from bw),
dw as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as g from
  (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from w, sizes where len(w) >= n)),
h as (select dw.doc_id, dw.i, dw.n, bw.item_id from dw join bw on bw.n = dw.n and bw.g = dw.g),
c as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from h) group by 1),
t as (select doc_id, count(*) as n_items, string_agg(s, ',' order by s) as ids from (select distinct doc_id, cast(item_id as varchar) as s from h) group by 1)
select w.doc_id, len(w.w) as n_words, coalesce(c.n_hit, 0) as n_hit, coalesce(t.n_items, 0) as n_items,
       sha256(coalesce(t.ids, '')) as items_sha256, coalesce(c.n_hit, 0) > 0 and 20 * coalesce(c.n_hit, 0) >= len(w.w) as contaminated
from w left join c using (doc_id) left join t using (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op2_line_dedup": OP2_SQL, "op10_decontaminate": OP10_SQL}
