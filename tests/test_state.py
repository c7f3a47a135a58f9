import datetime as dt
import os

from pyspark.sql import functions as F

from webdelta.operators import store
from webdelta.streaming.replay import Replay, event_windows


def test_ring_seen_and_gate(spark):
    v = spark.createDataFrame([("a", i) for i in range(12)], "tid string, rev long")
    assert sorted(r["rev"] for r in store.ring(v).collect()) == list(range(4, 12)) and store.next_revs(v).first()["next_rev"] == 12
    seen = spark.createDataFrame([("a", f"k{i}", i) for i in range(5)], "tid string, event_key string, seq long")
    new = spark.createDataFrame([("a", "k0", 9), ("a", "n", 10)], "tid string, event_key string, seq long")
    assert {r["event_key"] for r in store.seen_after(seen, new, 3).collect()} == {"n", "k4", "k3"}
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    f = spark.createDataFrame([("h", at(s)) for s in (0, 4, 6, 11, 12)], "host string, ts timestamp")
    assert [r["ts"].second for r in store.crawl_gate(f, 5).orderBy("ts").collect()] == [0, 6, 11]
    assert [r["wait_s"] for r in store.crawl_waits(f, 5).orderBy("ts").collect()] == [0, 1, 3, 0, 4]


def test_stream_gives_each_change_once(spark, tmp_path):
    page = lambda p: f"<html><body><main><h1>P</h1><p>${p}/mo</p></main></body></html>"
    source, out = tmp_path / "in", []
    os.makedirs(source)
    replay = Replay(spark, f"file://{tmp_path}/state", lambda e, n: out.extend((n, r["tid"], r["cat"]) for r in e.collect()), archetype="pricing")
    for k, price in enumerate((5, 5, 7)):
        spark.createDataFrame([("t", "http://e.org", f"2024-01-0{k + 1}", page(price))], "tid string, url string, obs string, html string").coalesce(1).write.mode("append").parquet(str(source / f"p{k}"))
        stream = spark.readStream.schema("tid string, url string, obs string, html string").parquet(str(source / "p*"))
        replay.start(stream, str(tmp_path / "ckpt")).awaitTermination()
    assert [x[1:] for x in out] == [("t", "price_increase")]


def test_a_batch_reads_and_writes_its_own_buckets_only(spark, tmp_path):
    page = lambda p: f"<html><body><main><h1>P</h1><p>${p}/mo</p></main></body></html>"
    rows = lambda *xs: spark.createDataFrame([(t, "http://e.org", o, page(p)) for t, o, p in xs], "tid string, url string, obs string, html string")
    out = []
    replay = Replay(spark, f"file://{tmp_path}/state", lambda e, n: out.extend((n, r["tid"], r["cat"]) for r in e.collect()), buckets=4, archetype="pricing")
    bucket = {r["tid"]: r["b"] for r in spark.createDataFrame([(f"t{i}",) for i in range(8)], "tid string").withColumn("b", replay._bucket()).collect()}
    one = "t0"
    other = next(t for t in bucket if bucket[t] != bucket[one])
    replay.batch(rows((one, "1", 5), (other, "1", 5)), 0)
    # An untouched target's bucket may be unreadable.
    for part in (tmp_path / "state/versions/batch=0" / f"bucket={bucket[other]}").glob("part-*"):
        part.write_bytes(b"no table")
    for n, price in enumerate((7, 9, 11), 1):
        replay.batch(rows((one, str(n + 1), price)), n)
        replay.batch(rows((one, str(n + 1), price)), n)
    held = {k: v for k, v in replay._folders("versions")[0].items()}
    assert held == {bucket[other]: [0], bucket[one]: [2, 3]}
    assert sorted(set(out)) == [(n, one, "price_increase") for n in (1, 2, 3)]
    assert spark.read.parquet(f"file://{tmp_path}/state/versions/batch=3/bucket={bucket[one]}").count() == 4


def test_windows(spark):
    e = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, m), "t", "high") for m in (1, 2, 59)], "ts timestamp, tid string, mat string").withColumn("ts", F.col("ts"))
    assert event_windows(e).first()["count"] == 3
