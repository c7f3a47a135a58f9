import http.server
import json
import threading

from pyspark.sql import functions as F

from webdelta.plans import verbs
from webdelta.sources import http as web
from webdelta.sources.observations import exit_code, from_responses, outcome, robots_allowed, robots_rules, target_list


class Handler(http.server.BaseHTTPRequestHandler):
    def do_GET(self):
        if self.path == "/same" and self.headers.get("If-None-Match") == "e1":
            self.send_response(304)
            self.end_headers()
        elif self.path == "/busy":
            self.send_response(429)
            self.send_header("Retry-After", "7")
            self.end_headers()
        else:
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b"<p>hello</p>" * 100)

    def log_message(self, *_):
        pass


def test_fetch_and_outcomes(spark):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    t = spark.createDataFrame([("a", f"{at}/x", None), ("b", f"{at}/same", "e1"), ("c", f"{at}/busy", None), ("d", "http://127.0.0.1:9/none", None)], "tid string, url string, etag string")
    got = web.fetched(t, timeout=5).withColumn("ts", F.current_timestamp())
    rows = {r["tid"]: r for r in from_responses(got).collect()}
    server.shutdown()
    assert [(rows[k]["outcome"], rows[k]["exit_code"], rows[k]["retry_after"]) for k in "abcd"] == [("body", None, None), ("not_modified", 0, None), ("rate_limited", 6, 7), ("error", 3, None)]
    assert web.decoded(b"x" * 10, None, 5) is None


def test_outcome_of_bodies(spark):
    x = spark.createDataFrame([(200, "<p>" + "word " * 80), (200, "<div id=root></div>"), (403, None), (503, None)], "s int, h string")
    assert [(r[0], r[1]) for r in x.select(outcome(F.col("s"), F.col("h")), exit_code(outcome(F.col("s"), F.col("h")))).collect()] == [("body", None), ("needs_render", 3), ("auth", 5), ("error", 3)]


def test_robots(spark):
    rules = robots_rules(spark, [("e.org", "User-agent: *\nDisallow: /\nUser-agent: webdelta\nDisallow: /a\nAllow: /a/b$\n")])
    urls = spark.createDataFrame([("http://e.org/a/b",), ("http://e.org/a/bc",), ("http://e.org/z",), ("http://other.org/a",)], "url string")
    assert {r["url"]: r["allowed"] for r in robots_allowed(urls, rules, "webdelta/1").collect()} == {"http://e.org/a/b": True, "http://e.org/a/bc": False, "http://e.org/z": True, "http://other.org/a": True}


def test_store_verbs(spark, tmp_path):
    path = str(tmp_path / "c.toml")
    verbs.init(path)
    assert verbs.watch(path, "https://e.org/p") == "e-org-p"
    v = spark.createDataFrame([("e-org-p", i, "u", f"t{i}", "h") for i in range(1, 9)], "tid string, rev long, url string, obs string, html string")
    v2 = verbs.snapshot(v, spark.createDataFrame([("e-org-p", None, "u", "t9", "h")], v.schema))
    assert sorted(r["rev"] for r in v2.collect()) == list(range(2, 10))
    row = verbs.listed(verbs.targets(spark, path), v2).first()
    assert (row["rev"], row["obs"], row["kept"]) == (9, "t9", 8) and verbs.shown(v2, "e-org-p").first()["rev"] == 9
    (tmp_path / "list.txt").write_text("a\n\n# no\n b \n")
    assert [r["target"] for r in target_list(spark, str(tmp_path / "list.txt")).collect()] == ["a", "b"]


def test_event_json_comes_back(spark):
    e = spark.createDataFrame([("1", "cfe_0", ("low", 0.2, "content_edit", "s"), ("t",), ("notify",))], "v string, id string, why struct<mat:string,sal:double,cat:string,summary:string>, src struct<tid:string>, followup struct<act:string>").select(F.struct("v", "id", "src", "why", "followup").alias("event"))
    lines = verbs.jsonl(e)
    other = spark.createDataFrame([('{"v":"2","id":"x"}',), ('{"v":"1","id":"y","new":3}',), ("no",)], "value string")
    assert [r["event"]["id"] for r in verbs.read_events(lines.union(other), e.schema["event"].dataType).collect()] == ["cfe_0", "y"]
    assert json.loads(verbs.json_schema(e.schema["event"].dataType))["properties"]["why"]["type"] == "object"
    assert verbs.pretty(e).first()["value"].startswith("LOW")
