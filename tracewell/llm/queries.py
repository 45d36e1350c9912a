"""The operators over their whole tables, one query each, and their SQL where SQL can say it."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, language, lines, media, mixing, near, packing, sharding, substrings, surrogates
from .common import written


SURROGATE_KEY = "spark.tracewell.surrogates.key"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compared(table(spark, sf_dir, "documents"))


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law rows: counts of the 40 shards at most one apart, each with the mixture of the sources."""
    docs = table(spark, sf_dir, "documents")
    data = F.encode(F.col("text"), "UTF-8")
    slim = written(docs.select("doc_id", "source", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"), F.coalesce(F.crc32(data), F.lit(0)).alias("text_crc32")), "shard")
    out = sharding.interleaved(slim, slim.count())
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the session's key, else with one that is drawn for this run and not kept."""
    key = spark.conf.get(SURROGATE_KEY, None) or secrets.token_hex(32)
    return surrogates.pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), key)


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.judged(table(spark, sf_dir, "documents"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.probed(media.stored(table(spark, sf_dir, "documents")))


def op7_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.classified(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    slim = written(docs.select("doc_id", "source", mixing.words(F.col("text")).alias("size")), "mix")
    out = mixing.mix(slim, slim.count())
    return out.select("doc_id", "size", "source_size", "target", "taken", "source")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and pages: both have texts and a declared language; sources are the documents' hosts."""
    docs = table(spark, sf_dir, "documents")
    rows = language.document_rows(docs).unionByName(language.page_rows(table(spark, sf_dir, "pages")))
    return language.identified(rows, docs)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_substrings": op2_substrings,
    "op3_sharding": op3_sharding,
    "op4_surrogates": op4_surrogates,
    "op5_lines": op5_lines,
    "op6_media": op6_media,
    "op7_near": op7_near,
    "op8_packing": op8_packing,
    "op9_mixing": op9_mixing,
    "op10_language": op10_language,
}

ORACLE_SQL: dict[str, str] = {
    "op2_substrings": r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
p as (select doc_id, len(w) as n, w, unnest(range(0, len(w) - 19)) as pos from d where len(w) >= 20),
k as (select doc_id, pos, md5(array_to_string(w[pos + 1 : pos + 20], ' ')) as h from p),
r as (select doc_id, pos from k qualify row_number() over (partition by h order by doc_id, pos) > 1),
c as (select distinct doc_id, pos + unnest(range(0, 20)) as i from r),
g as (select doc_id, list(i order by i) as gone from c group by doc_id),
e as (select d.doc_id, d.w, unnest(range(0, len(d.w))) as i from d),
s as (select e.doc_id, string_agg(e.w[e.i + 1], ' ' order by e.i) as kept, count(*) as m from e left join c on c.doc_id = e.doc_id and c.i = e.i where c.i is null group by e.doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(len(d.w) - coalesce(s.m, 0) as bigint) as n_removed, sha256(coalesce(s.kept, '')) as kept_sha256
from d left join s on s.doc_id = d.doc_id
""",
    "op9_mixing": r"""
with d as (select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size from documents),
s as (select source, cast(sum(size) as bigint) as n from d group by source),
w as (select *, [5.0::double, 2.0::double, 1.0::double][cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as int)] as wt, 2.0::double * n as cap from s),
r as (select *, cap / wt as r from w),
l as (select *, (1.5::double * cast(sum(n) over () as double) - coalesce(sum(cap) over b, 0.0::double)) / (sum(wt) over () - coalesce(sum(wt) over b, 0.0::double)) as lev
      from r window b as (order by r, source nulls last rows between unbounded preceding and 1 preceding)),
t as (select *, case when r <= lev then cap else wt * (max(case when r <= lev then null else lev end) over ()) end as target from l),
e as (select *, cast(floor(target + 0.5) as bigint) as budget, case when n > 0 then cast(floor(cast(floor(target + 0.5) as bigint) / n) as bigint) else 0 end as ep from t),
p as (select d.*, coalesce(sum(size) over (partition by source order by md5('mix-1:' || coalesce(cast(doc_id as varchar), '')), size rows between unbounded preceding and 1 preceding), 0) as bef from d)
select p.doc_id, p.size, e.n as source_size, e.target, cast(e.ep * p.size + greatest(0, least(p.size, e.budget - e.ep * e.n - p.bef)) as bigint) as taken, p.source
from p join e on p.source is not distinct from e.source
""",
}
