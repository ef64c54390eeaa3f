"""A table of the latest row per key, kept up by micro-batches.

    delta/batch=<n>/bucket=<k>/      what batch n upserted, by hash of the key
    snapshot/generation=<g>/bucket=<k>/  one row per key: all batches up to the pointer's
    pointer/<g>-<n>                  empty file: snapshot g holds the batches up to n

A pointer appears in one step, after its snapshot is complete, so a stop at any
place leaves the last pointer, its snapshot and all later deltas: nothing is lost
and nothing read twice counts twice (the latest row per key wins). A retried batch
overwrites its own delta. A read merges one snapshot and at most ``compact_after``
deltas: it costs the size of the state, not of the history. Snapshots and deltas
are deleted one generation after they were superseded, so a read that began before
a compaction ends well."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


@dataclass
class KeyedSink:
    path: str
    keys: list[str]
    order: list[str]  # the larger row of a key wins
    buckets: int = 16
    compact_after: int = 8
    #: rows that a snapshot needn't keep (nothing older is left for them to hide)
    dispensable: str | None = None
    #: every batch holds a key once, so a lone delta is read as it is
    distinct_batches: bool = False
    _fs: object = field(default=None, repr=False)

    def _files(self, spark: SparkSession, folder: str) -> list[str]:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        return [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []

    def _delete(self, spark: SparkSession, folder: str) -> None:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

    def pointer(self, spark: SparkSession) -> tuple[int, int]:
        """(generation, last batch in it) of the newest complete snapshot; (0, -1) before the first."""
        return max((tuple(int(x) for x in name.split("-")) for name in self._files(spark, "pointer") if name[:1].isdigit()), default=(0, -1))

    def _batches(self, spark: SparkSession) -> list[int]:
        """Batches whose delta is complete."""
        names = [name for name in self._files(spark, "delta") if name.startswith("batch=")]
        return sorted(int(n.split("=")[1]) for n in names if "_SUCCESS" in self._files(spark, f"delta/{n}"))

    def _latest(self, rows: DataFrame) -> DataFrame:
        payload = [c for c in rows.columns if c not in (*self.keys, "bucket")]
        newest = F.max_by(F.struct(*payload), F.struct(*self.order)).alias("_d")
        return rows.groupBy("bucket", *self.keys).agg(newest).select("bucket", *self.keys, *[F.col(f"_d.{c}").alias(c) for c in payload])

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def upsert(self, batch: DataFrame, batch_id: int) -> None:
        """Write a batch; compact when enough deltas have gathered."""
        spark = batch.sparkSession
        rows = batch.withColumn("bucket", self.bucket())
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/delta/batch={batch_id}")
        if len([b for b in self._batches(spark) if b > self.pointer(spark)[1]]) >= self.compact_after:
            self.compact(spark)

    def _merged(self, spark: SparkSession, upto: int | None = None) -> tuple[DataFrame | None, int]:
        generation, last = self.pointer(spark)
        batches = [b for b in self._batches(spark) if b > last and (upto is None or b <= upto)]
        parts = [f"{self.path}/snapshot/generation={generation}"] if generation else []
        parts += [f"{self.path}/delta/batch={b}" for b in batches]
        frames = []
        for part in parts:
            try:
                frames.append(spark.read.parquet(part))
            except AnalysisException:  # a batch or snapshot without rows has no files to take a schema from
                continue
        if not frames:
            return None, batches[-1] if batches else last
        if len(frames) == 1 and (generation and not batches or self.distinct_batches):
            return frames[0], batches[-1] if batches else last
        rows = frames[0]
        for f in frames[1:]:
            rows = rows.unionByName(f)
        return self._latest(rows), batches[-1] if batches else last

    def read(self, spark: SparkSession) -> DataFrame:
        """The latest row per key."""
        rows, _ = self._merged(spark)
        if rows is None:
            raise FileNotFoundError(f"nothing has been written to {self.path}")
        rows = rows.drop("bucket")
        return rows.filter(f"NOT ({self.dispensable})") if self.dispensable else rows

    def compact(self, spark: SparkSession) -> tuple[int, int]:
        """Merge the snapshot and all complete deltas into the next generation."""
        old, old_last = self.pointer(spark)
        rows, last = self._merged(spark)
        if rows is None or last == old_last:
            return old, old_last
        if self.dispensable:
            rows = rows.filter(f"NOT ({self.dispensable})")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/snapshot/generation={old + 1}")
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/pointer/{old + 1}-{last}")
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(at.getParent())
        fs.createNewFile(at)
        # what the generation before this one had superseded
        if old > 1:
            self._delete(spark, f"snapshot/generation={old - 1}")
        for b in self._batches(spark):
            if b <= old_last:
                self._delete(spark, f"delta/batch={b}")
        return old + 1, last
