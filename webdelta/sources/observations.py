"""Where observations come from: tables of responses, files, piped HTML, target lists; robots rules and their matching."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webdelta.functions.text import derived_tid, host_of, needs_render, path_of

BODY_CAP = 5 * 1024 * 1024
ROBOTS_TTL_S = 24 * 3600


def outcome(status: Column, html: Column, retry_after: Column | None = None, render: str = "auto") -> Column:
    """What a response is: body, not_modified, auth, rate_limited, error, too_large, needs_render."""
    body = F.when(F.octet_length(html) > BODY_CAP, "too_large")
    if render != "never":
        body = body.when(needs_render(F.coalesce(html, F.lit(""))), "needs_render")
    return F.when(status == 304, "not_modified").when(status.isin(401, 403), "auth").when(status == 429, "rate_limited").when((status >= 200) & (status < 300), body.otherwise("body")).otherwise("error")


def exit_code(kind: Column) -> Column:
    """The exit code of an outcome without a body: 0, 3, 5 or 6; null for a body."""
    return F.when(kind == "not_modified", 0).when(kind == "auth", 5).when(kind == "rate_limited", 6).when(kind != "body", 3)


def retry_after_s(headers: Column) -> Column:
    """Whole seconds of Retry-After."""
    value = F.element_at(F.transform_keys(headers, lambda k, v: F.lower(k)), "retry-after")
    return F.when(value.rlike(r"^\s*\d+\s*$"), F.trim(value).cast("long"))


def from_responses(responses: DataFrame) -> DataFrame:
    """responses (tid, url, status, headers, html, ts) to observations, numbered by time within a target, with outcome and exit_code."""
    kind = outcome(F.col("status"), F.col("html"))
    r = responses.withColumns({"outcome": kind, "exit_code": exit_code(kind), "retry_after": retry_after_s(F.col("headers"))})
    rev = F.row_number().over(Window.partitionBy("tid").orderBy("ts")).cast("long")
    return r.withColumns({"rev": rev, "obs": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")})


def from_pages(pages: DataFrame) -> DataFrame:
    """A table (url, html, and page_id for the order) to observations; the target is the URL's slug."""
    from webdelta.functions.text import canonical_url

    w = Window.partitionBy("tid").orderBy("page_id")
    return pages.withColumn("tid", derived_tid(canonical_url(F.col("url")))).select("tid", F.row_number().over(w).cast("long").alias("rev"), "url", F.lit("1970-01-01T00:00:00Z").alias("obs"), "html")


def from_files(spark: SparkSession, paths: list[str], url: str = "file:") -> DataFrame:
    """HTML files as successive observations of one target."""
    found = spark.read.text(paths, wholetext=True).select(F.col("value").alias("html"), F.input_file_name().alias("path"))
    # The paths alone are numbered; the texts stay where they are read.
    found = found.join(found.select("path").withColumn("rev", F.row_number().over(Window.orderBy("path")).cast("long")), "path")
    return found.select(F.lit("files").alias("tid"), "rev", F.lit(url).alias("url"), F.lit("1970-01-01T00:00:00Z").alias("obs"), "html")


def from_text(spark: SparkSession, html: str, url: str, tid: str | None = None) -> DataFrame:
    """Piped HTML that stands for a URL."""
    one = spark.createDataFrame([(tid, 1, url, "1970-01-01T00:00:00Z", html)], "tid string, rev long, url string, obs string, html string")
    return one.withColumn("tid", F.coalesce("tid", derived_tid(F.col("url"))))


def target_list(spark: SparkSession, path: str) -> DataFrame:
    """A list of targets, one on each line; blank lines and comments are skipped."""
    line = F.trim("value")
    return spark.read.text(path).select(line.alias("target")).filter((F.col("target") != "") & ~F.col("target").startswith("#"))


def parsed_robots(text: str) -> list[tuple[str, str, str, int | None]]:
    """(agent, allow or disallow, pattern, crawl delay in whole seconds) of a robots.txt; a group may name several agents."""
    out, agents, open_ = [], [], False
    delays: dict[str, int] = {}
    rules: list[tuple[str, str, str]] = []
    for line in text.splitlines():
        key, _, value = line.split("#", 1)[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            agents = [*agents, value.lower()] if open_ else [value.lower()]
            open_ = True
            continue
        if key in ("allow", "disallow", "crawl-delay"):
            open_ = False
        if key in ("allow", "disallow") and value:
            rules += [(a, key, value) for a in agents]
        elif key == "crawl-delay":
            try:
                delays.update(dict.fromkeys(agents, math.ceil(float(value))))
            except ValueError:
                pass
    for a, k, v in rules:
        out.append((a, k, v, delays.get(a)))
    out += [(a, "allow", "/", d) for a, d in delays.items() if a not in {r[0] for r in rules}]
    return out


def robots_rules(spark: SparkSession, texts: list[tuple[str, str]]) -> DataFrame:
    """(host, robots.txt) to rules: host, agent, kind, pattern, regex, delay."""
    rows = [(host, a, k, p, "^" + "".join(".*" if c == "*" else re.escape(c) for c in p.removesuffix("$")) + ("$" if p.endswith("$") else ""), d) for host, text in texts for a, k, p, d in parsed_robots(text)]
    return spark.createDataFrame(rows, "host string, agent string, kind string, pattern string, regex string, delay int")


def robots_allowed(urls: DataFrame, rules: DataFrame, agent: str, url: str = "url") -> DataFrame:
    """urls with `allowed`: the group whose name is in the agent beats `*`; the longest match wins, allow wins ties; no rule allows.

    Rules are joined by host, and each host and path keeps one best match, so a host's many URLs never meet.
    """
    u = urls.withColumns({"_host": host_of(F.col(url)), "_path": path_of(F.col(url))})
    named = F.contains(F.lit(agent.lower()), F.col("agent")) & (F.col("agent") != "*")
    mine = rules.withColumn("named", named).filter(named | (F.col("agent") == "*"))
    best = mine.groupBy("host").agg(F.bool_or("named").alias("has"))
    mine = mine.join(best, "host").filter(F.col("named") == F.col("has")).withColumnRenamed("host", "_host")
    hit = F.col("regex").isNotNull() & F.expr("_path rlike regex")
    found = u.select("_host", "_path").distinct().join(mine.select("_host", "kind", "pattern", "regex"), "_host").withColumn("hit", F.coalesce(hit, F.lit(False)))
    won = found.groupBy("_host", "_path").agg(F.max_by("kind", F.when(F.col("hit"), F.struct(F.length("pattern"), (F.col("kind") == "allow").cast("int")))).alias("kind"))
    return u.join(won, ["_host", "_path"], "left").select(*urls.columns, F.coalesce(F.col("kind") == "allow", F.lit(True)).alias("allowed"))
