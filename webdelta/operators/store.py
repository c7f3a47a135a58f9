"""State across observations as tables: a ring of revisions, a seen-set, politeness, and pages of a feed."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RING, SEEN, PAGE = 8, 1000, 1000


def ring(versions: DataFrame, key: str = "tid", order: str = "rev", keep: int = RING) -> DataFrame:
    """The newest `keep` versions of each target."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return versions.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= keep).drop("_k")


def next_revs(versions: DataFrame) -> DataFrame:
    """The revision that each target's next version gets: revisions only grow."""
    return versions.groupBy("tid").agg((F.max("rev") + 1).alias("next_rev"))


def latest(versions: DataFrame) -> DataFrame:
    return versions.groupBy("tid").agg(F.max_by(F.struct(*[c for c in versions.columns if c != "tid"]), "rev").alias("v")).select("tid", "v.*")


def seen_after(seen: DataFrame, new: DataFrame, keep: int = SEEN, key: str = "tid") -> DataFrame:
    """seen and new (tid, event_key, seq) together: each event once, with its first place; the newest `keep` of each target."""
    both = seen.unionByName(new).groupBy(key, "event_key").agg(F.min("seq").alias("seq"))
    w = Window.partitionBy(key).orderBy(F.col("seq").desc(), "event_key")
    return both.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= keep).drop("_k")


def unseen(events: DataFrame, seen: DataFrame) -> DataFrame:
    return events.join(seen.select("tid", "event_key"), ["tid", "event_key"], "left_anti")


def _seconds(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1e6


def crawl_waits(fetches: DataFrame, delay: float, host: str = "host", ts: str = "ts") -> DataFrame:
    """Fetches with the seconds to wait before them: against the host's fetch just before (a rejected fetch counts as one)."""
    w = Window.partitionBy(host).orderBy(ts)
    gap = _seconds(ts) - F.lag(_seconds(ts)).over(w)
    wait = F.when(gap < delay, F.ceil(F.lit(float(delay)) - gap)).otherwise(0)
    return fetches.withColumns({"wait_s": F.coalesce(wait, F.lit(0)).cast("long")}).withColumn("allowed", F.col("wait_s") == 0)


def gated(fetches: DataFrame, delay: float, host: str = "host", ts: str = "ts", tie: str | None = None) -> DataFrame:
    """crawl_waits by the exact rule of crawl_gate: each fetch with its wait against the host's last fetch that was let through.

    Fetches of one time come in the order of tie. A fetch without a time waits 0 and moves no clock. Hosts lie one after the
    other in a partition, in order of time, and a task holds one host's stamp, so a host may have any number of fetches.
    """
    name = F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit(""))
    rows = fetches.withColumns({"_host": name, "_t": F.unix_micros(F.col(ts).cast("timestamp"))})
    rows = rows.repartition("_host").sortWithinPartitions("_host", "_t", *([tie] if tie else []))
    need, names = round(delay * 1_000_000), fetches.columns

    def fold(batches):
        at, last = None, None
        for b in batches:
            waits = []
            for h, t in zip(b.column("_host").to_pylist(), b.column("_t").to_pylist()):
                if h != at:
                    at, last = h, None
                wait = 0
                if t is not None:
                    if last is None or t - last >= need:
                        last = t
                    else:
                        wait = -((t - last - need) // 1_000_000)
                waits.append(wait)
            kept = b.select(names)
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(waits, pa.int64()), pa.array([w == 0 for w in waits], pa.bool_())], [*names, "wait_s", "allowed"])

    kinds = T.StructType([*fetches.schema.fields, T.StructField("wait_s", T.LongType()), T.StructField("allowed", T.BooleanType())])
    return rows.mapInArrow(fold, kinds)


def crawl_gate(fetches: DataFrame, delay: float, host: str = "host", ts: str = "ts") -> DataFrame:
    """The exact rule: only fetches that were let through move the host's clock. A fold over each host's times in order."""
    times = F.array_sort(F.collect_list(_seconds(ts)))
    step = lambda s, t: F.when(s["last"].isNull() | (t - s["last"] >= delay), F.struct(t.alias("last"), F.concat(s["ok"], F.array(t)).alias("ok"))).otherwise(s)
    start = F.struct(F.lit(None).cast("double").alias("last"), F.array().cast("array<double>").alias("ok"))
    return fetches.groupBy(host).agg(F.aggregate(times, start, step)["ok"].alias("ok")).select(host, F.explode("ok").alias("t")).select(host, F.timestamp_seconds("t").alias(ts))


def feed_page(rows: DataFrame, order: list[Column], cursor: str | None = None, limit: int = PAGE) -> DataFrame:
    """A page of rows in order, after a cursor cfc_<offset>, with the cursor of the next page. The page is the bound of the sort."""
    offset = int(cursor.removeprefix("cfc_")) if cursor else 0
    page = rows.orderBy(*order).offset(offset).limit(limit)
    return page.withColumn("next_cursor", F.lit(f"cfc_{offset + limit}"))
