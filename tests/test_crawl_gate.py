import datetime as dt
import math
import random

from webdelta.plans import queries


def test_crawl_gate_is_a_fold(spark, tmp_path):
    rng, start = random.Random(5), dt.datetime(2024, 1, 1)
    rows = [(i, 1, start + dt.timedelta(minutes=40 * i)) for i in range(6)] + [(10 + i, rng.choice([2, 3, None]), start + dt.timedelta(seconds=rng.randint(0, 90000) / 2)) for i in range(200)]
    rows += [(300, 2, None), (301, 4, start), (302, 4, start)]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp").write.parquet(f"{tmp_path}/events.parquet")
    want, last = {}, {}
    for i, host, t in sorted(rows, key=lambda r: (r[2] or start, r[0])):
        gap = (t - last[host]).total_seconds() if t and host in last else None
        want[i] = math.ceil(3600 - gap) if gap is not None and gap < 3600 else 0
        if t and not want[i]:
            last[host] = t
    got = {r["event_id"]: r["wait_s"] for r in queries.queries()["crawl_delay_gate"](spark, str(tmp_path)).collect()}
    assert got == want and [got[i] for i in range(4)] == [0, 1200, 0, 1200]
