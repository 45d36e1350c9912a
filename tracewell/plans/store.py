"""The index on disk: archives are synchronised one by one, readers see the last version that was committed.

A folder that Spark reads holds, for each version n: data/n (nodes and exchanges of the archives that changed), edges/n
(of all live nodes), and last of all manifest/n, a row an archive: its signature and the version that holds its rows. A
version exists once its manifest is written whole (Spark's _SUCCESS), so a writer that dies leaves the last one valid.
Versions are only added; `vacuum` removes what no manifest that is kept names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import index
from .index import Index

MANIFEST = "archive_path string, lines long, signature string, version long"


def signatures(lines: DataFrame) -> DataFrame:
    """(archive_path, lines, signature): changes with any line of an archive, and with the edition of the features."""
    mark = F.xxhash64(F.lit(index.FEATURES), "line", "role", "text", F.coalesce("timestamp", F.lit(""))).cast("decimal(38,0)")
    return lines.groupBy("archive_path").agg(F.count(F.lit(1)).alias("lines"), F.sum(mark).cast("string").alias("signature"))


@dataclass
class Store:
    """An index in a folder."""

    spark: SparkSession
    root: str

    def _folder(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        """The committed versions, oldest first."""
        files, path = self._folder("manifest")
        if not files.exists(path):
            return []
        jvm = self.spark._jvm.org.apache.hadoop.fs
        return sorted(int(f.getPath().getName()) for f in files.listStatus(path) if f.getPath().getName().isdigit() and files.exists(jvm.Path(f.getPath(), "_SUCCESS")))

    def _next(self) -> int:
        """A number above that of every version, those of writers that died included."""
        found = [0]
        for name in ("data", "edges", "manifest"):
            files, path = self._folder(name)
            found += [int(f.getPath().getName()) for f in (files.listStatus(path) if files.exists(path) else ()) if f.getPath().getName().isdigit()]
        return max(found) + 1

    def manifest(self) -> DataFrame:
        """The last version's archives; none before the first."""
        versions = self.versions()
        if not versions:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/{versions[-1]}")

    def sync(self, lines: DataFrame, events: DataFrame | None = None, sessions: DataFrame | None = None) -> dict[str, int]:
        """Brings the index to the state of all lines: archives that are gone leave, those whose lines are as they were
        stay untouched, the others are built anew. What happened to how many archives."""
        old = self.manifest().select("archive_path", F.col("signature").alias("_was"), "version")
        state = signatures(lines).join(old, "archive_path", "left").withColumn("same", F.coalesce(F.col("signature") == F.col("_was"), F.lit(False)))
        state = index.settled(state, "sync")
        count = state.agg(F.count(F.lit(1)).alias("n"), F.count_if("same").alias("same"), F.count_if(F.col("_was").isNull()).alias("new")).first()
        stale = old.join(state, "archive_path", "left_anti").count()
        report = {"unchanged": count["same"], "new": count["new"], "changed": count["n"] - count["same"] - count["new"], "stale": stale, "version": (self.versions() or [0])[-1]}
        if count["n"] == count["same"] and not stale:
            return report
        version = self._next()
        changed = state.filter("not same").select("archive_path")
        if sessions is not None:
            # A fork is compared with its parent, so it is built anew with it, and its parent's lines are at hand.
            forks = sessions.filter("forked_from_id <> ''").select(F.col("path").alias("archive_path"), "forked_from_id")
            ids = sessions.select(F.col("path").alias("_parent"), F.col("session_id").alias("forked_from_id"))
            family = forks.join(ids, "forked_from_id")
            changed = changed.unionByName(family.join(changed.withColumnRenamed("archive_path", "_parent"), "_parent", "left_semi").select("archive_path")).unionByName(family.join(changed, "archive_path", "left_semi").select(F.col("_parent").alias("archive_path"))).distinct()
            changed = index.settled(changed, "sync")
        of = lambda df, name: df.join(changed.withColumnRenamed("archive_path", name), name, "left_semi")

        def kept(df: DataFrame, name: str) -> DataFrame:
            path = f"{self.root}/data/{version}/{name}"
            df.withColumn("version", F.lit(version).cast("long")).write.option("compression", "zstd").parquet(path)
            return self.spark.read.schema(df.schema).parquet(path)

        node, _ = index.made(of(lines, "archive_path"), None if events is None else of(events, "path"), sessions, kept)
        fresh = changed.withColumn("_fresh", F.lit(True))
        rows = state.join(fresh, "archive_path", "left").select("archive_path", "lines", "signature", F.when(F.col("_fresh") | F.col("version").isNull(), F.lit(version)).otherwise(F.col("version")).cast("long").alias("version"))
        rows = index.settled(rows, "manifest")
        live = node if rows.isEmpty() else self._live("nodes", rows)
        index.edges(live).write.parquet(f"{self.root}/edges/{version}")
        rows.write.parquet(f"{self.root}/manifest/{version}")
        return report | {"version": version}

    def _live(self, name: str, manifest: DataFrame) -> DataFrame:
        """The rows that a manifest names, of all versions that it names."""
        versions = sorted(r["version"] for r in manifest.select("version").distinct().collect())  # a number a sync
        rows = self.spark.read.parquet(*[f"{self.root}/data/{v}/{name}" for v in versions])
        return rows.join(manifest.select("archive_path", "version"), ["archive_path", "version"], "left_semi").drop("version")

    def snapshot(self) -> Index | None:
        """The last committed version, or None before there is one; what is written meanwhile changes nothing in it."""
        versions = self.versions()
        if not versions:
            return None
        manifest = self.manifest()
        if manifest.isEmpty():
            return None
        return Index(self._live("nodes", manifest), self._live("exchanges", manifest), self.spark.read.parquet(f"{self.root}/edges/{versions[-1]}"))

    def vacuum(self, keep: int = 1) -> int:
        """Removes all versions but the last `keep`, and data that these do not name; how many folders went."""
        versions = self.versions()
        kept = versions[-keep:]
        named = {r["version"] for v in kept for r in self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/{v}").select("version").distinct().collect()}
        gone = [f"manifest/{v}" for v in versions if v not in kept] + [f"edges/{v}" for v in versions if v not in kept] + [f"data/{v}" for v in range(1, self._next()) if v not in named and v not in kept]
        return sum(files.delete(path, True) for files, path in map(self._folder, gone))


def status(of: Index) -> DataFrame:
    """(what, rows): nodes by level, tool nodes, facets, bands, anchors, edges by relation, sessions, archives."""
    n = of.nodes
    one = lambda df, what: df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(what).alias("what"), "rows")
    levels = n.groupBy(F.concat(F.lit("nodes:"), "level").alias("what")).agg(F.count(F.lit(1)).alias("rows"))
    relations = of.edges.groupBy(F.concat(F.lit("edges:"), "relation").alias("what")).agg(F.count(F.lit(1)).alias("rows"))
    tools = one(n.filter(F.col("node_id").startswith("exchange:tool:")), "tool nodes")
    facets = n.agg(F.sum(F.size("facets")).cast("long").alias("rows")).select(F.lit("facets").alias("what"), "rows")
    sums = [one(of.bands, "bands"), one(of.anchors, "anchors"), one(of.exchanges, "exchanges"), one(n.select("session_id").distinct(), "sessions"), one(n.select("archive_path").distinct(), "archives")]
    out = levels.unionByName(relations).unionByName(tools).unionByName(facets)
    for part in sums:
        out = out.unionByName(part)
    return out
