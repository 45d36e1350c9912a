"""Postings, BM25, salient terms and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The ranking's constants, the weight of the term column among them.
K1, B, COLUMN_WEIGHT, LEAST_IDF = 1.2, 0.75, 2.3, 1e-6


def postings(rows: DataFrame, key: str, terms: Column) -> DataFrame:
    """(key, term, tf, dl): one row for each term of a row; dl counts all its terms."""
    t = rows.select(key, terms.alias("_terms")).withColumn("dl", F.size("_terms"))
    return t.select(key, "dl", F.explode("_terms").alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def corpus(rows: DataFrame, terms: Column) -> DataFrame:
    """One row: the number of rows and their mean length."""
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.avg(F.size(terms)).alias("avg_dl"))


def bm25(posting: DataFrame, wanted: DataFrame, stats: DataFrame, key: str, weight: float = COLUMN_WEIGHT) -> DataFrame:
    """(query_id, key, score) over the postings of the wanted (query_id, term). Higher is better.

    The postings are cut down to wanted terms before anything else moves; document frequencies are counted there."""
    terms = wanted.select("term").distinct()
    hit = posting.join(terms, "term", "left_semi")
    df = hit.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    t = hit.join(df, "term").crossJoin(stats)  # stats is a single row
    idf = F.greatest(F.lit(LEAST_IDF), F.ln((F.col("n_rows") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    f = F.lit(weight) * F.col("tf")
    part = idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("avg_dl")))
    return t.withColumn("_part", part).join(wanted, "term").groupBy("query_id", key).agg(F.sum("_part").alias("score"))


def top(rows: DataFrame, by: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """The k best rows of each group, numbered from 1."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= k)


def salient(rows: DataFrame, group: str, terms: Column, k: int) -> DataFrame:
    """The k terms that occur in most rows of a group; ties by term."""
    t = rows.select(group, F.explode(F.array_distinct(terms)).alias("term")).groupBy(group, "term").agg(F.count(F.lit(1)).alias("df"))
    return top(t, [group], [F.desc("df"), "term"], k)


def covering(rows: DataFrame, wanted: DataFrame, key: str, least: float) -> DataFrame:
    """(query_id, key, coverage): the rows (key, terms) that have at least a share of a query's (query_id, terms).

    Of a query's n terms any row that has enough has one of the n - ceil(least n) + 1 rarest, so only these look for
    candidates; the whole lists are compared once for each candidate."""
    w = wanted.select("query_id", F.array_distinct("terms").alias("own")).withColumn("n", F.size("own"))
    posting = rows.select(key, F.explode(F.array_distinct("terms")).alias("term"))
    by_term = w.select("query_id", "n", F.explode("own").alias("term"))
    df = posting.join(by_term.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    order = Window.partitionBy("query_id").orderBy(F.coalesce("df", F.lit(0)), "term")
    enough = F.ceil(F.lit(least) * F.col("n") - F.lit(1e-6) * F.col("n"))
    rare = by_term.join(df, "term", "left").withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= F.col("n") - enough + 1).filter("df is not null")
    found = posting.join(rare.select("query_id", "term"), "term").select("query_id", key).distinct()
    both = found.join(w, "query_id").join(rows.select(key, "terms"), key)
    share = F.round(F.size(F.array_intersect("own", "terms")) / F.col("n"), 6)
    return both.select("query_id", key, share.alias("coverage")).filter(F.col("coverage") >= least)
