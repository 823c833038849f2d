"""Article store in ranges of the content hash (K2, K3, K6, T1-T5 beyond one table).

Layout below the store's path::

    data/range=r<first digits of title_hash>/commit=c<number>-<token>/*.parquet
    stats/commit=c<number>-<token>/*.parquet         counts of the commit by range
    commits/*.json                                   one file per published commit

A commit writes its data and counts first and is published last, by one small
file that names its ranges and whether it replaces them. Readers see published
commits only, as a filter on the partition columns; so a failed job leaves the
store as it was, and what it wrote is never read.

* An insert reads the hash column of the ranges that its rows fall into.
* An update rewrites the ranges that hold its ids, and no others.
* A streamed batch is published under its query and number, once however often
  it is run again.
* Statistics add up the counts of the live commits; no article is read.

One writer at a time. ``prefix`` (hex digits of a range, kept with the store by its
layout) sets the number of ranges: 16 to its power, which bounds what the
driver reads of them. ``compact`` turns the commits of every range into one.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gazette.operators.store import article_hash, new_articles, update_relevance
from gazette.session import ensure_checkpoint_dir, path_exists, scratch_path

PREFIX = 2
COMMIT_DDL = "commit string, number long, replaces boolean, origin string, ranges array<string>"
COUNTED = ["category", "source", "is_relevant"]


class HashStore:
    def __init__(self, spark: SparkSession, path: str, prefix: int = PREFIX):
        if not 1 <= prefix <= 4:
            raise ValueError("a range has 1 to 4 hex digits")
        self.spark, self.path, self.prefix = spark, path.rstrip("/"), prefix
        ensure_checkpoint_dir(spark)

    # ------------------------------------------------------------------ published commits
    def commits(self) -> list:
        """The published commits, oldest first."""
        if not path_exists(self.spark, f"{self.path}/commits"):
            return []
        rows = self.spark.read.schema(COMMIT_DDL).json(f"{self.path}/commits").collect()
        return sorted(rows, key=lambda r: (r.number, r.commit))

    def live(self) -> dict[str, list[str]]:
        """``range -> commits`` whose rows are current: those from the last replacing commit on."""
        out: dict[str, list[str]] = {}
        for c in self.commits():
            for r in c.ranges:
                out[r] = [c.commit] if c.replaces else [*out.get(r, []), c.commit]
        return out

    def published(self, origin: str) -> bool:
        return any(c.origin == origin for c in self.commits())

    def _begin(self) -> tuple[str, int]:
        number = max((c.number for c in self.commits()), default=0) + 1
        return f"c{number:012d}-{uuid.uuid4().hex[:8]}", number

    def _publish(self, commit: str, number: int, replaces: bool, origin: str | None, schema: StructType) -> list[str]:
        """Writes the counts of what the commit has written (``schema``), then the file that makes it current."""
        own = self._written(commit, schema)
        ranges = sorted(r["range"] for r in own.select("range").distinct().collect())        # at most 16 ** prefix
        if ranges or origin is not None:
            for c in COUNTED:
                if c not in own.columns:
                    own = own.withColumn(c, F.lit(None).cast("boolean" if c == "is_relevant" else "string"))
            counts = own.groupBy(F.col("range"), *COUNTED).agg(F.count("*").alias("n"))
            if ranges:
                counts.write.parquet(f"{self.path}/stats/commit={commit}")
            row = self.spark.createDataFrame([(commit, number, replaces, origin, ranges)], COMMIT_DDL)
            row.coalesce(1).write.mode("append").json(f"{self.path}/commits")
        return ranges

    # ------------------------------------------------------------------ reading
    def range_of(self, hash_col: str = "title_hash") -> Column:
        return F.concat(F.lit("r"), F.substring(hash_col, 1, self.prefix))       # with a letter: never read as a number

    def _current(self, live: dict[str, list[str]]) -> Column:
        """A filter on the partition columns alone: the directories of current commits."""
        if not live:
            return F.lit(False)
        by_commits: dict[tuple[str, ...], list[str]] = {}
        for r, commits in live.items():
            by_commits.setdefault(tuple(commits), []).append(r)
        out = None
        for commits, ranges in sorted(by_commits.items()):
            term = F.col("range").isin(sorted(ranges)) & F.col("commit").isin(list(commits))
            out = term if out is None else out | term
        return out

    def read(self, ranges: Sequence[str] | None = None) -> DataFrame | None:
        """The current rows (of some ranges), with ``range`` and ``commit``; None while nothing has been stored."""
        live = self.live()
        if not live:
            return None
        if ranges is not None:
            live = {r: live[r] for r in ranges if r in live}
        path = f"{self.path}/data"
        stored = self.spark.read.option("basePath", path).option("mergeSchema", "true").parquet(path)
        return stored.filter(self._current(live))

    def articles(self) -> DataFrame:
        """The current rows without the layout's columns."""
        stored = self.read()
        if stored is None:
            return self.spark.createDataFrame([], "title_hash string")
        return stored.drop("range", "commit")

    # ------------------------------------------------------------------ writing
    def _write(self, rows: DataFrame, commit: str) -> StructType:
        out = rows.withColumn("range", self.range_of()).withColumn("commit", F.lit(commit))
        # rows of a range come together; a range of more than a task's share of bytes is split among several
        out.hint("rebalance", F.col("range")).sortWithinPartitions("range", "title_hash").write.mode("append").partitionBy(
            "range", "commit").parquet(f"{self.path}/data")
        return out.schema

    def load(self, rows: DataFrame, origin: str | None = None) -> list[str]:
        """Appends rows that have a ``title_hash`` as they are; returns the ranges written."""
        commit, number = self._begin()
        return self._publish(commit, number, False, origin, self._write(rows, commit))

    def insert(self, batch: DataFrame, collected_at, order_col: str = "pos", origin: str | None = None) -> DataFrame:
        """K2: appends the rows of ``batch`` whose hash is not stored; returns these rows, read back.

        Of equal hashes in the batch the first by ``order_col`` counts. Of the store, the hash column of the
        ranges that the batch touches is read.
        """
        path = scratch_path(self.spark, "store-batch")
        article_hash(batch).write.parquet(path)
        kept = self.spark.read.parquet(path)
        touched = sorted(r[0] for r in kept.select(self.range_of()).distinct().collect())     # at most 16 ** prefix
        known = self.read(touched)
        known = self.spark.createDataFrame([], "title_hash string") if known is None else known.select("title_hash")
        commit, number = self._begin()
        schema = self._write(new_articles(kept.drop("title_hash"), known, collected_at, order_col), commit)
        self._publish(commit, number, False, origin, schema)
        return self._written(commit, schema).drop("range", "commit")

    def _written(self, commit: str, schema: StructType) -> DataFrame:
        """The rows of one commit, published or not."""
        path = f"{self.path}/data"
        return self.spark.read.schema(schema).option("basePath", path).parquet(path).filter(F.col("commit") == commit)

    def touched_by(self, updates: DataFrame, id_col: str = "id") -> list[str]:
        """The ranges that hold ids of ``updates`` (from their ``title_hash``, if they bring it, else by the id column)."""
        stored = self.read()
        if stored is None:
            return []
        if "title_hash" in updates.columns:
            found = updates.select(self.range_of().alias("range"))
        else:
            found = stored.select(id_col, "range").join(updates.select(id_col).distinct(), id_col, "left_semi").select("range")
        return sorted(r[0] for r in found.distinct().collect() if r[0] is not None)

    def update_relevance(self, updates: DataFrame, updated_at, id_col: str = "id", order_col: str | None = None) -> list[str]:
        """K6: sets flag, confidence and time of updated ids; rewrites the ranges that hold them and returns these."""
        touched = self.touched_by(updates, id_col)
        stored = self.read(touched) if touched else None
        if stored is None:
            return []
        commit, number = self._begin()
        changed = update_relevance(stored.drop("range", "commit"), updates.drop("title_hash"), updated_at, id_col, order_col)
        return self._publish(commit, number, True, None, self._write(changed, commit))

    def compact(self) -> list[str]:
        """All current rows as one commit."""
        stored = self.read()
        if stored is None:
            return []
        commit, number = self._begin()
        return self._publish(commit, number, True, None, self._write(stored.drop("range", "commit"), commit))

    # ------------------------------------------------------------------ statistics
    def counts(self) -> DataFrame:
        """``category, source, is_relevant, n`` over the current rows, from the counts of the commits."""
        live = self.live()
        ddl = "category string, source string, is_relevant boolean, n long"
        if not live:
            return self.spark.createDataFrame([], ddl)
        path = f"{self.path}/stats"
        rows = self.spark.read.option("basePath", path).parquet(path)
        rows = rows.filter(self._current(live))
        return rows.groupBy(*COUNTED).agg(F.sum("n").alias("n"))

    def totals(self) -> DataFrame:
        """T1 without digests: ``total_articles, relevant_articles, irrelevant_articles``."""
        n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
        return self.counts().agg(n(F.lit(True)).alias("total_articles"), n(F.col("is_relevant")).alias("relevant_articles"),
                                 n(~F.col("is_relevant")).alias("irrelevant_articles"))

    def count_by(self, col: str) -> DataFrame:
        """Rows per value (null is a group), most first."""
        return self.counts().groupBy(col).agg(F.sum("n").alias("count")).orderBy(F.desc("count"), F.asc_nulls_first(col))
