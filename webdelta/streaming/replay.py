"""Observations as a stream: each micro-batch is diffed against the stored baselines, and only changes move them.

The state is tables, not operator state: a ring of versions, and the seen-set. Revisions count up by arrival order within a
target (offset by the stored maximum), never by clock. Folders carry the batch's number, and a batch replaces its own part,
so a batch that is run again after a failure writes the same rows once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webdelta.operators import store
from webdelta.plans.engine import observe
from webdelta.plans.tables import scratch, settled

OBSERVATION = "tid string, rev long, url string, obs string, html string"


class Replay:
    """State under `folder`: versions and seen, as batch=N/bucket=B folders, a bucket for each hash of targets.

    A batch reads and writes the buckets of its own targets only; of a bucket, the newest batch before it counts. Folders that
    two newer batches have replaced are removed. `buckets` must stay the same for the life of the state.
    """

    def __init__(self, spark: SparkSession, folder: str, sink: Callable[[DataFrame, int], None], buckets: int = 256, **how):
        self.spark, self.folder, self.sink, self.buckets, self.how = spark, folder.rstrip("/"), sink, buckets, how

    def _bucket(self, tid: str = "tid"):
        return F.pmod(F.xxhash64(tid), F.lit(self.buckets)).cast("int")

    def _folders(self, name: str) -> tuple[dict[int, list[int]], object]:
        """The batches that hold each bucket, in order. One that failed half-way is run again, and replaced, before a later one reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/batch=*/bucket=*")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        out: dict[int, list[int]] = {}
        for x in fs.globStatus(path) or ():
            at = x.getPath()
            out.setdefault(int(at.getName().split("=")[1]), []).append(int(at.getParent().getName().split("=")[1]))
        return {k: sorted(v) for k, v in out.items()}, fs

    def _state(self, name: str, schema: str, before: int, touched: list[int]) -> DataFrame:
        have, _ = self._folders(name)
        newest = {k: max((n for n in have.get(k, ()) if n < before), default=None) for k in touched}
        paths = [f"{self.folder}/{name}/batch={n}/bucket={k}" for k, n in newest.items() if n is not None]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, rows: DataFrame, name: str, number: int) -> None:
        held = rows.withColumn("bucket", self._bucket()).repartition("bucket")
        held.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{name}/batch={number}")
        have, fs = self._folders(name)
        for k, numbers in have.items():
            # A batch may run again, so what it read before it stays.
            for n in [n for n in numbers if n <= number][:-2]:
                fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/batch={n}/bucket={k}"), True)

    def batch(self, rows: DataFrame, number: int) -> None:
        with scratch(self.spark):
            self._batch(settled(rows, "rows"), number)

    def _batch(self, rows: DataFrame, number: int) -> None:
        touched = sorted(r[0] for r in rows.select(self._bucket()).distinct().collect())  # at most `buckets` numbers
        versions = self._state("versions", OBSERVATION, number, touched)
        seen = self._state("seen", "tid string, event_key string, seq long", number, touched)
        tids = rows.select("tid").distinct()
        base = store.latest(versions.join(tids, "tid", "left_semi")).select(*versions.columns)
        top = store.next_revs(versions)
        new = rows.join(top, "tid", "left").withColumn("rev", F.coalesce("next_rev", F.lit(1)) + F.row_number().over(Window.partitionBy("tid").orderBy("obs", "url")) - 1).select(*versions.columns)
        new = settled(new, "new")
        both = settled(base.unionByName(new), "batch")
        events = settled(observe(both, **self.how), "events")
        fresh = store.unseen(events, seen)
        self.sink(fresh.dropDuplicates(["tid", "event_key"]), number)
        # A target's first version and versions with events become its baseline; others leave it where it was.
        moved = events.select("tid", F.col("to_rev").alias("rev")).distinct()
        first = new.join(base.select("tid").distinct(), "tid", "left_anti").groupBy("tid").agg(F.min("rev").alias("rev"))
        kept = new.join(moved.unionByName(first).distinct(), ["tid", "rev"], "left_semi")
        self._write(store.ring(versions.unionByName(kept)), "versions", number)
        keys = events.select("tid", "event_key", (F.col("to_rev") * 1000 + F.lit(number)).alias("seq"))
        self._write(store.seen_after(seen, keys), "seen", number)

    def start(self, stream: DataFrame, checkpoint: str):
        """stream: tid, url, obs, html."""
        return stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts of events (columns ts, tid, mat) by window, target and band; usable on streams, where late rows are dropped after `late`."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), "tid", "mat").count().select(F.col("window.start").alias("from"), "tid", "mat", "count")
