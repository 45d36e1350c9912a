"""Language identification by Bayesian evidence fusion.

For each row the log posterior of a language is the sum of four kinds of evidence: the likelihood of the whole text
under a model of letter triples, the likelihood of the declared language, that of the address suffix, and a prior of the
host. The last three come from grouped counts over all rows, of the languages that the texts alone suggest: declared
values and suffixes with additive smoothing, hosts smoothed towards their domain and domains towards the whole.

The text model is fitted on a bounded sample: at most SAMPLE_ROWS labelled rows a language (chosen by hash), at most
SAMPLE_CHARS characters of each, at most LANGUAGES languages (the most frequent). Everything else covers all rows and
whole texts. Only the model (bounded by these numbers) and the whole's counts, a number a language, pass the driver.

A row is kept if its text has letter triples and its best language has a probability of at least LEAST.

Defined results: null, empty and letterless texts have no text evidence and are rejected; null hosts, suffixes and
declared values are no evidence; without labelled rows no language is known (null) and every text with letters is kept;
rows with the same id are judged one by one; an empty table gives an empty table; other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.shipping import map_arrow

from .common import hash_key, written

SAMPLE_ROWS, SAMPLE_CHARS, LANGUAGES = 400, 4000, 64
BITS = 15
#: Triples overlap and topics repeat: a text counts as so many independent ones at most.
WORTH = 60.0
#: Smoothing: of triples, of declared values and suffixes, and how many rows a parent's share is worth.
TRIPLE, VALUE, PARENT = 0.5, 1.0, 20.0
LEAST = 0.5

#: Bytes to classes: letters in lower case, bytes of longer characters as they are, everything else a blank.
LETTER = np.full(256, 32, np.uint8)
LETTER[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
LETTER[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
LETTER[128:] = np.arange(128, 256)


def triples(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the letter triples of all texts in a row, and the text of each."""
    data = [(t or "").encode("utf-8", "surrogatepass") + b"  " for t in texts]
    raw = LETTER[np.frombuffer(b" " + b"".join(data), np.uint8)]
    if len(raw) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b, c = raw[:-2], raw[1:-1], raw[2:]
    at = np.flatnonzero((b != 32) & ((a != 32) | (c != 32)))
    code = a[at].astype(np.uint32) << np.uint32(16) | b[at].astype(np.uint32) << np.uint32(8) | c[at]
    code = (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    owner = np.searchsorted(np.cumsum([len(x) for x in data]), at, "right")
    return code.astype(np.int64), owner


@dataclass(frozen=True)
class Model:
    names: tuple[str, ...]
    weights: np.ndarray  # log likelihoods, a row a class, a column a language


def fitted(rows: DataFrame, text: str, label: str, id_col: str, seed: str = "lang-1") -> Model:
    """The text model, from the bounded sample."""
    some = rows.select(F.lower(F.trim(label)).alias("label"), F.substring(text, 1, SAMPLE_CHARS).alias("text"), hash_key(F.col(id_col), seed).alias("key")).filter("label <> '' and text is not null")
    counts = {r["label"]: r["count"] for r in some.groupBy("label").count().orderBy(F.desc("count"), "label").limit(LANGUAGES).collect()}
    names = list(counts)
    # The least keys of a language lie below a bound that four times as many rows are expected to pass, so a common
    # language moves no more rows than a rare one.
    bounds = [x for n in names for x in (F.lit(n), F.lit(f"{min(int(4 * SAMPLE_ROWS / counts[n] * 16**8), 16**8):09x}"))]
    near = some.filter(F.col("label").isin(names) & (F.concat(F.lit("0"), F.substring("key", 1, 8)) < F.element_at(F.create_map(*bounds), F.col("label")))) if names else some.limit(0)
    order = Window.partitionBy("label").orderBy("key", "text")
    sample = near.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= SAMPLE_ROWS).select("label", "text").collect()
    counts = np.full((1 << BITS, len(names)), TRIPLE)
    for k, name in enumerate(sorted(names)):
        code, _ = triples([r["text"] for r in sample if r["label"] == name])
        counts[:, k] += np.bincount(code, minlength=1 << BITS)
    return Model(tuple(sorted(names)), np.log(counts / counts.sum(0)).astype(np.float32) if names else np.zeros((1 << BITS, 0), np.float32))


def text_evidence(rows: DataFrame, model: Model, text: str, keep: list[str]) -> DataFrame:
    """The columns to keep, with evidence (a log likelihood for each language) and triples (their count)."""
    shared = rows.sparkSession.sparkContext.broadcast(model.weights)  # of bounded size
    n_lang = len(model.names)
    fields = rows.select(*keep, text).schema
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields[:-1]] + ["evidence array<double>", "triples long"])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in batches:
            step = max(1, int(len(batch) * (4 << 20) // max(1, batch.nbytes)))
            for at in range(0, len(batch), step):
                part = batch.slice(at, step)
                texts = part.column(part.num_columns - 1).to_pylist()
                code, owner = triples(texts)
                counts = np.bincount(owner, minlength=len(texts))
                scale = np.minimum(1.0, WORTH / np.maximum(counts, 1))
                found = np.stack([np.bincount(owner, weights[:, k][code], len(texts)) * scale for k in range(n_lang)], 1) if n_lang else np.zeros((len(texts), 0))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * n_lang), pa.array(found.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists, pa.array(counts.astype(np.int64))], names=[*part.schema.names[:-1], "evidence", "triples"])

    return map_arrow(rows.select(*keep, text), step, schema)


def _counts(rows: DataFrame, by: str, n: int, name: str) -> DataFrame:
    """A row for each value of a column: how many rows suggest each language."""
    sums = [F.sum(F.when(F.col("_best") == k, F.col("_times")).otherwise(0)).cast("double") for k in range(n)]
    return rows.filter(F.col(by).isNotNull()).groupBy(F.col(by).alias(f"{name}_of")).agg(F.array(*sums).alias(name))


def _numbers(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def fused(scored: DataFrame, model: Model, declared: str, suffix: str, host: str, domain: str) -> DataFrame:
    """scored (from text_evidence, written before) with language, probability, text_language and kept."""
    n = len(model.names)
    if not n:
        return scored.withColumns({"language": F.lit(None).cast("string"), "probability": F.lit(None).cast("double"), "text_language": F.lit(None).cast("string"), "kept": F.col("triples") > 0}).drop("evidence")
    best = F.when(F.col("triples") > 0, F.array_position("evidence", F.array_max("evidence")) - 1)
    scored = scored.withColumn("_best", best)
    # Grouped once by all values together, then by each: hot values meet in partial sums only.
    grouped = scored.filter("_best is not null").groupBy(declared, suffix, host, domain, "_best").agg(F.count(F.lit(1)).alias("_times"))
    total = grouped.agg(*[F.sum(F.when(F.col("_best") == k, F.col("_times")).otherwise(0)).alias(str(k)) for k in range(n)]).first()
    total = [float(total[k] or 0) for k in range(n)]
    share = [(t + 1) / (sum(total) + n) for t in total]
    values = {c: max(1, grouped.select(c).distinct().count()) for c in (declared, suffix)}  # numbers of values
    pick = lambda array, k: F.element_at(array, k + 1)
    smooth = lambda own, above: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: (pick(own, k) + PARENT * pick(above, k)) / (F.aggregate(own, F.lit(0.0), lambda a, x: a + x) + PARENT))
    domains = _counts(grouped, domain, n, "_domain").withColumn("_domain", smooth(F.col("_domain"), _numbers(share)))
    hosts = _counts(grouped, host, n, "_host")
    out = scored
    for table, by, name in ((domains, domain, "_domain"), (hosts, host, "_host"), (_counts(grouped, declared, n, "_declared"), declared, "_declared"), (_counts(grouped, suffix, n, "_suffix"), suffix, "_suffix")):
        out = out.join(table, F.col(by) == F.col(f"{name}_of"), "left").drop(f"{name}_of")
    above = F.coalesce("_domain", _numbers(share))
    out = out.withColumn("_prior", F.when(F.col("_host").isNotNull(), smooth(F.col("_host"), above)).otherwise(above))
    given = lambda name, column, k: F.when(F.col(name).isNotNull(), F.ln((pick(F.col(name), k) + VALUE) / (pick(_numbers(total), k) + VALUE * values[column]))).otherwise(F.lit(0.0))
    score = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: pick(F.col("evidence"), k) + F.ln(pick(F.col("_prior"), k)) + given("_declared", declared, k) + given("_suffix", suffix, k))
    out = out.withColumn("_score", score).withColumn("_top", F.array_max("_score"))
    language = F.array(*[F.lit(x) for x in model.names])
    out = out.withColumns({
        "language": F.when(F.col("triples") > 0, F.element_at(language, F.array_position("_score", F.col("_top")).cast("int"))),
        "probability": F.when(F.col("triples") > 0, 1 / F.aggregate("_score", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_top")))),
        "text_language": F.when(F.col("triples") > 0, F.element_at(language, F.array_position("evidence", F.array_max("evidence")).cast("int"))),
    })
    return out.withColumn("kept", F.coalesce(F.col("probability") >= LEAST, F.lit(False))).drop("evidence", "_best", "_domain", "_host", "_declared", "_suffix", "_prior", "_score", "_top")


#: Declared language of a page, and what of it is no text.
HTML_LANG = r'(?is)<html[^>]*?\slang\s*=\s*["\']?([A-Za-z]{2,8})'
NOT_TEXT = r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<[^>]*>"


def page_rows(pages: DataFrame) -> DataFrame:
    """Pages as rows for the operator: text, declared language, host, domain and address suffix.

    The suffix is the last label of the host, with the first part of the path where that is two letters."""
    host = F.lower(F.try_parse_url(F.col("url"), F.lit("HOST")))
    part = F.regexp_extract(F.coalesce(F.try_parse_url(F.col("url"), F.lit("PATH")), F.lit("")), r"^/([A-Za-z]{2})(?:/|$)", 1)
    labels = F.split(host, r"\.")
    declared = F.lower(F.regexp_extract(F.coalesce(F.col("html"), F.lit("")), HTML_LANG, 1))
    return pages.select(
        F.lit(None).cast("long").alias("doc_id"), F.col("page_id").cast("long").alias("page_id"), F.regexp_replace("html", NOT_TEXT, " ").alias("text"),
        F.when(declared != "", declared).alias("declared"), F.concat_ws("/", F.element_at(labels, -1), F.lower(part)).alias("suffix"), host.alias("host"), F.array_join(F.when(F.size(labels) > 2, F.slice(labels, -2, 2)).otherwise(labels), ".").alias("domain"),
    )


def document_rows(docs: DataFrame) -> DataFrame:
    """Documents as rows for the operator: the language column is the declared one, the source the host."""
    none = F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id"), "text", F.lower(F.trim("lang")).alias("declared"), none.alias("suffix"), F.col("source").alias("host"), none.alias("domain"))


def identified(rows: DataFrame, labelled: DataFrame) -> DataFrame:
    """rows (as above) with language, probability, text_language, triples and kept; labelled: doc_id, text, lang."""
    model = fitted(labelled, "text", "lang", "doc_id")
    keep = ["doc_id", "page_id", "declared", "suffix", "host", "domain"]
    return fused(written(text_evidence(rows, model, "text", keep), "languages"), model, "declared", "suffix", "host", "domain")


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that are not rejected, with their columns as they are."""
    model = fitted(docs, "text", "lang", "doc_id")
    # A row's evidence is written without its text, under its id and a hash of what it is judged by. The row itself
    # travels whole in one column, so that no name of its columns can clash.
    mark = F.xxhash64("text", "lang", "source")
    none = F.lit(None).cast("string")
    seen = docs.select(F.col("doc_id").alias("doc_id"), mark.alias("mark"), F.lower(F.trim("lang")).alias("declared"), none.alias("suffix"), F.col("source").alias("host"), none.alias("domain"), F.col("text").alias("text"))
    slim = written(text_evidence(seen, model, "text", ["doc_id", "mark", "declared", "suffix", "host", "domain"]), "languages")
    gone = fused(slim, model, "declared", "suffix", "host", "domain").filter(~F.col("kept"))
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).distinct()
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_own"), mark.alias("_hash"))
    return rows.join(gone, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_mark")), "left_anti").select("_row.*")
