"""The engine's operators as queries over the test tables, each with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webdelta.functions import text, values
from webdelta.operators import diff, events, packs, salience, segment, store
from webdelta.plans import engine
from webdelta.sources import observations

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        _QUERIES[fn.__name__] = fn
        if sql:
            _SQL[fn.__name__] = sql
        return fn

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# Texts ---------------------------------------------------------------------------------------------------------------

_CANON = r"""
WITH u AS (SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS bare FROM pages),
v AS (SELECT page_id, regexp_replace(bare, '\?.*$', '') AS body,
  CASE WHEN contains(bare, '?') THEN regexp_replace(bare, '^[^?]*\?', '') ELSE '' END AS q FROM u),
w AS (SELECT page_id, lower(regexp_extract(body, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme,
  lower(regexp_extract(body, '^[A-Za-z][A-Za-z0-9+.-]*://([^/]*)', 1)) AS host,
  regexp_extract(body, '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*(/.*)?$', 1) AS path,
  array_to_string(list_sort(list_filter(string_split(q, '&'), lambda p: p <> '' AND NOT regexp_matches(split_part(p, '=', 1), '(?i)^(utm_.*|gclid|fbclid|ref|_ga)$')
    AND NOT (regexp_matches(split_part(p, '=', 1), '(?i)^(v|hash)$') AND regexp_matches(regexp_replace(p, '^[^=]*=?', ''), '^([0-9]+(\.[0-9]+)*|[0-9a-fA-F]{4,})$')))), '&') AS query FROM v)
SELECT page_id, scheme || '://' || regexp_replace(host, CASE WHEN scheme = 'https' THEN ':443$' ELSE ':80$' END, '')
  || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN query = '' THEN '' ELSE '?' || query END AS url FROM w
"""


@query(_CANON)
def url_canonicalize(spark, d):
    return _t(spark, d, "pages").select("page_id", text.canonical_url(F.col("url")).alias("url"))


@query(f"SELECT url, count(*) AS versions, min(page_id) AS first_page FROM ({_CANON}) GROUP BY url")
def url_group_versions(spark, d):
    p = _t(spark, d, "pages").select("page_id", text.canonical_url(F.col("url")).alias("url"))
    return p.groupBy("url").agg(F.count(F.lit(1)).alias("versions"), F.min("page_id").alias("first_page"))


@query(r"""SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) AS host,
  CASE WHEN p = '' THEN '/' WHEN p LIKE '?%' THEN '/' || p ELSE p END AS path,
  regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1) || '/robots.txt' AS robots,
  CASE WHEN s = '' THEN 'target' ELSE s END AS tid
FROM (SELECT *, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^#]*)', 1) AS p,
  regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(url, '^https?://', '')), '[^a-z0-9]+', '-', 'g'), '^-+', ''), '-+$', '') AS s FROM pages)""")
def url_parts(spark, d):
    u = F.col("url")
    return _t(spark, d, "pages").select("page_id", text.host_of(u).alias("host"), text.path_of(u).alias("path"), text.robots_url(u).alias("robots"), text.derived_tid(u).alias("tid"))


@query(r"""SELECT page_id, nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')), '') AS title FROM pages""")
def page_title(spark, d):
    return _t(spark, d, "pages").select("page_id", text.page_title(F.col("html")).alias("title"))


@query(r"""WITH s AS (SELECT page_id, html, length(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
  '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[\s]+', ' ', 'g'))) AS n FROM pages)
SELECT page_id, n AS visible, (n < 200 AND n / strlen(html)::DOUBLE < 0.05) OR regexp_matches(html, '(?is)<div[^>]*\bid\s*=\s*["'']?(root|__next|app-root)["'']?[^>]*>\s*</div>') AS needs_render FROM s""")
def needs_render(spark, d):
    h = F.col("html")
    return _t(spark, d, "pages").select("page_id", F.length(text.visible_text(h)).cast("long").alias("visible"), text.needs_render(h).alias("needs_render"))


@query(r"""WITH c AS (SELECT page_id, unnest(regexp_extract_all(html, 'class="([^"]*)"', 1)) AS cls FROM pages)
SELECT page_id, count(*) AS classes, count(*) FILTER (regexp_matches(lower(cls), 'ad|promo|cookie|banner|newsletter|social-share|breadcrumb')) AS boilerplate FROM c GROUP BY page_id""")
def boilerplate_classes(spark, d):
    c = _t(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('class="([^"]*)"'), F.lit(1))).alias("cls"))
    return c.groupBy("page_id").agg(F.count(F.lit(1)).alias("classes"), F.count_if(text.is_boilerplate(F.col("cls"))).alias("boilerplate"))


@query(r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '[\x{200b}\x{200c}\x{200d}\x{feff}]', '', 'g'), '[\t-\r \x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'))) AS digest FROM documents""")
def whitespace_collapse(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(text.collapse(F.col("text"))).alias("digest"))


@query(r"""SELECT event_id, regexp_replace(s, '(?i)\b(?:(?:\d+|an?|a\sfew|several)\s+(?:second|minute|hour|day|week|month|year)s?\s+(?:ago|from\s+now)|in\s+(?:\d+|an?|a\sfew|several)\s+(?:second|minute|hour|day|week|month|year)s?|as\s+of\s+\d{1,2}:\d{2}(?::\d{2})?(?:\s*[A-Za-z]{2,4})?|(?:last\s+)?updated\s+\d{1,2}:\d{2}(?::\d{2})?(?:\s*[A-Za-z]{2,4})?|just\s+now|moments?\s+ago)\b', '⟦TS⟧', 'g') AS s
FROM (SELECT event_id, CASE event_id % 8 WHEN 0 THEN event_type || ' ' || user_id || ' minutes ago by ' || event_id WHEN 1 THEN 'Last updated 10:' || (10 + event_id % 50) || ' CEST, ' || event_type
  WHEN 2 THEN 'due in ' || user_id || ' days' WHEN 3 THEN 'seen just now, not ' || user_id || ' agos' WHEN 4 THEN 'as of noon ' || event_id WHEN 5 THEN 'an hour ago, a few days from now' WHEN 6 THEN user_id || ' min ago' ELSE 'a moment ago, in several weeks' END AS s FROM events)""")
def relative_time_mask(spark, d):
    e, k = _t(spark, d, "events"), F.col("event_id") % 8
    s = F.when(k == 0, F.concat("event_type", F.lit(" "), "user_id", F.lit(" minutes ago by "), "event_id")).when(k == 1, F.concat(F.lit("Last updated 10:"), (10 + F.col("event_id") % 50).cast("string"), F.lit(" CEST, "), "event_type"))
    s = s.when(k == 2, F.concat(F.lit("due in "), "user_id", F.lit(" days"))).when(k == 3, F.concat(F.lit("seen just now, not "), "user_id", F.lit(" agos"))).when(k == 4, F.concat(F.lit("as of noon "), "event_id"))
    s = s.when(k == 5, F.lit("an hour ago, a few days from now")).when(k == 6, F.concat("user_id", F.lit(" min ago"))).otherwise(F.lit("a moment ago, in several weeks"))
    return e.select("event_id", text.mask_times(s).alias("s"))


@query("""WITH b AS (SELECT doc_id, strlen(text) AS n, unnest(regexp_extract_all(hex(encode(text)), '..')) AS x FROM documents),
c AS (SELECT doc_id, x, count(*) / any_value(n)::DOUBLE AS p FROM b GROUP BY doc_id, x),
e AS (SELECT doc_id, sum(-p * log2(p)) AS bits FROM c GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN round(coalesce(bits, 0), 6) END AS bits FROM documents d LEFT JOIN e USING (doc_id)""")
def entropy_tokens(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.round(text.entropy(F.col("text")), 6).alias("bits"))


_TOKENS = r"list_filter(regexp_extract_all({}, '[\p{{L}}\p{{N}}_]+|\s+|[^\p{{L}}\p{{N}}_\s]'), lambda t: NOT regexp_matches(t, '^\s+$'))"


@query(f"""WITH p AS (SELECT a.item_id, d.doc_id, list_distinct({_TOKENS.format('a.text')}) AS x, list_distinct({_TOKENS.format('d.text')}) AS y
  FROM benchmark a CROSS JOIN documents d)
SELECT item_id, doc_id, CASE WHEN len(x) + len(y) = 0 THEN 1.0 ELSE round(len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y)))::DOUBLE, 9) END AS jaccard FROM p""")
def token_jaccard(spark, d):
    """Every item with every document. The items are a query set that is held whole by each task."""
    from webdelta.functions.tokendiff import jaccards_udf

    items = _t(spark, d, "benchmark").select("item_id", F.array_distinct(text.word_tokens(F.col("text"))).alias("x"))
    rows = items.collect()
    names = spark.createDataFrame([(k, r["item_id"]) for k, r in enumerate(rows)], f"k int, item_id {items.schema['item_id'].dataType.simpleString()}")
    scores = jaccards_udf([r["x"] for r in rows])(F.array_distinct(text.word_tokens(F.col("text"))))
    found = _t(spark, d, "documents").select("doc_id", F.posexplode(scores).alias("k", "jaccard")).join(names, "k")
    return found.select("item_id", "doc_id", F.round(F.nullif("jaccard", F.lit(float("nan"))), 9).alias("jaccard"))


# Typed values --------------------------------------------------------------------------------------------------------


@query(r"""WITH s AS (SELECT o_orderkey, o_orderkey % 11 AS k, o_totalprice::DECIMAL(12,2) AS v FROM orders)
SELECT o_orderkey, CASE k WHEN 4 THEN NULL WHEN 5 THEN NULL WHEN 6 THEN '50' ELSE (v * 100)::BIGINT::VARCHAR END AS minor,
  CASE k WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' WHEN 3 THEN 'CHF' WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE 'USD' END AS currency,
  CASE k WHEN 0 THEN 'mo' WHEN 1 THEN 'user' WHEN 3 THEN 'yr' WHEN 7 THEN 'mo' WHEN 8 THEN 'yr' WHEN 9 THEN 'user' END AS period FROM s""")
def price_parse(spark, d):
    k, v = F.col("o_orderkey") % 11, F.col("o_totalprice").cast("decimal(12,2)").cast("string")
    shapes = [("$", "/mo"), ("€", " per user"), ("£ ", ""), ("CHF ", "/yr"), ("x", " per mo"), ("$1.", ".3"), None, ("$", " monthly"), (" $", "/annually now"), ("$", " users"), ("$", "/mo,")]
    s = F.lit("$.50")
    for i, x in enumerate(shapes):
        if x:
            s = F.when(k == i, F.concat(F.lit(x[0]), v, F.lit(x[1]))).otherwise(s)
    return _t(spark, d, "orders").select("o_orderkey", values.price(s).alias("p")).select("o_orderkey", F.col("p.minor").cast("string").alias("minor"), "p.currency", "p.period")


@query(r"""SELECT o_orderkey, CASE WHEN o_orderkey % 8 IN (0, 3, 5, 7) THEN strftime(o_orderdate, '%Y-%m-%d') END AS found FROM orders""")
def date_parse(spark, d):
    day, k = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey") % 8
    shapes = [F.concat(F.lit("due "), day, F.lit(" at noon")), F.concat(F.lit("2024-13-45 then "), day), F.concat(day, F.lit("T10:00:00Z")), F.concat(F.lit("on "), F.date_format("o_orderdate", "yyyy/MM/dd")), F.concat(F.lit("on "), day, F.lit(", late"))]
    shapes += [F.concat(F.lit("on "), F.date_format("o_orderdate", "yyyy-M-d")), F.concat(F.lit("⟦TS⟧ "), day), F.concat(F.lit("1999-01-02, "), day)]
    s = F.lit("")
    for i, x in enumerate(shapes):
        s = F.when(k == i, x).otherwise(s)
    return _t(spark, d, "orders").select("o_orderkey", values.date(s).cast("string").alias("found"))


@query(r"""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_custkey::VARCHAR WHEN 1 THEN regexp_replace(regexp_replace(o_totalprice::DECIMAL(12,2)::VARCHAR, '(\.\d*?)0+$', '\1'), '\.$', '') END AS found FROM orders""")
def number_parse(spark, d):
    k = F.col("o_orderkey") % 3
    s = F.when(k == 0, F.concat(F.lit(" "), F.col("o_custkey").cast("string"))).when(k == 1, F.format_number(F.col("o_totalprice").cast("decimal(12,2)"), 2)).otherwise(F.concat(F.lit("no "), F.col("o_custkey").cast("string")))
    return _t(spark, d, "orders").select("o_orderkey", values.number(s).alias("found"))


# Blocks: the lines of documents, every seventh a heading of level 1 to 3 ----------------------------------------------


def _lines(spark, d: str) -> DataFrame:
    x = _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("tid"), F.posexplode(F.split("text", "\n")).alias("seq", "text")).filter("text <> ''")
    head = F.col("seq") % 7 == 0
    return x.withColumns({"rev": F.lit(1).cast("long"), "ty": F.when(head, "heading").otherwise("paragraph"), "level": F.when(head, F.col("seq") / 7 % 3 + 1).cast("int"), "preorder_idx": F.col("seq"), "anchor": F.lit(None).cast("string")})


_LINES = r"""x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq FROM documents),
l AS (SELECT doc_id, seq, t, seq % 7 = 0 AS head, CASE WHEN seq % 7 = 0 THEN (seq // 7) % 3 + 1 END AS level FROM x WHERE t <> '')"""


@query(f"""WITH {_LINES},
s AS (SELECT *, max(CASE WHEN level = 1 THEN seq END) OVER w AS a1, max(CASE WHEN level = 2 THEN seq END) OVER w AS a2, max(CASE WHEN level = 3 THEN seq END) OVER w AS a3,
  coalesce(count(*) FILTER (head) OVER w, 0) AS section FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT s.*, concat_ws('›', h1.t, CASE WHEN a2 > coalesce(a1, -1) THEN h2.t END, CASE WHEN a3 > greatest(coalesce(a1, -1), coalesce(a2, -1)) THEN h3.t END) AS crumbs
  FROM s LEFT JOIN l h1 ON h1.doc_id = s.doc_id AND h1.seq = a1 LEFT JOIN l h2 ON h2.doc_id = s.doc_id AND h2.seq = a2 LEFT JOIN l h3 ON h3.doc_id = s.doc_id AND h3.seq = a3)
SELECT doc_id, seq, md5(crumbs) AS crumbs, CASE WHEN head THEN 0 ELSE row_number() OVER (PARTITION BY doc_id, section, head ORDER BY seq) - 1 END AS ordinal FROM k""")
def block_segment(spark, d):
    b = segment.keyed(_lines(spark, d))
    return b.select(F.col("tid").cast("long").alias("doc_id"), F.col("seq").cast("long").alias("seq"), F.md5(F.array_join("crumbs", segment.CRUMB)).alias("crumbs"), F.col("ordinal").cast("long").alias("ordinal"))


def _two(spark, d: str) -> tuple[DataFrame, DataFrame]:
    """Lines before, and after an edit: lines 7k+3 go, others of 11k+5 get a suffix. Slots are text-free: the line's number."""
    x = _t(spark, d, "documents").select(F.col("doc_id").alias("tid"), F.posexplode(F.split("text", "\n")).alias("seq", "text")).filter("text <> ''")
    kept = x.filter("seq % 7 <> 3").withColumn("text", F.when(F.col("seq") % 11 == 5, F.concat("text", F.lit(" edited"))).otherwise(F.col("text")))
    extra = x.filter("seq = 1").select("tid", (F.col("seq") + 100000).alias("seq"), "text")
    out = []
    for side, name in ((x, "o"), (kept.unionByName(extra), "n")):
        b = side.select("tid", F.lit(1).cast("long").alias("from_rev"), F.lit(2).cast("long").alias("to_rev"), F.struct(F.col("seq"), F.col("seq").alias("preorder_idx"), F.lit(0).alias("dom_depth"), F.col("seq").cast("string").alias("slot_key"), F.lit("paragraph").alias("ty"), F.lit(None).cast("int").alias("level"), F.col("text"), F.lit("struct").alias("anchored_by"), F.xxhash64("text").alias("norm_hash")).alias(name), F.col("seq").cast("string").alias("slot"))
        out.append(b.withColumn("times", F.count(F.lit(1)).over(Window.partitionBy(*diff.PAIR, "slot"))))
    return out[0], out[1]


_TWO = r"""x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq FROM documents),
o AS (SELECT * FROM x WHERE t <> ''),
n AS (SELECT doc_id, CASE WHEN seq % 11 = 5 THEN t || ' edited' ELSE t END AS t, seq FROM o WHERE seq % 7 <> 3 UNION ALL SELECT doc_id, t, seq + 100000 FROM o WHERE seq = 1)"""


@query(f"""WITH {_TWO}
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, count(*) FILTER (o.t = n.t) AS same, count(*) FILTER (o.t <> n.t) AS modified, count(*) FILTER (n.t IS NULL) AS removed, count(*) FILTER (o.t IS NULL) AS added
FROM o FULL JOIN n ON o.doc_id = n.doc_id AND o.seq = n.seq GROUP BY 1""")
def anchor_align(spark, d):
    anchors, left, right = diff.anchor_align(*_two(spark, d))
    same = F.col("o.text") == F.col("n.text")
    rows = anchors.select("tid", F.when(same, "same").otherwise("modified").alias("k")).unionByName(left.select("tid", F.lit("removed").alias("k"))).unionByName(right.select("tid", F.lit("added").alias("k")))
    return rows.groupBy(F.col("tid").alias("doc_id")).agg(*[F.count_if(F.col("k") == k).alias(k) for k in ("same", "modified", "removed", "added")])


@query(f"""WITH {_TWO},
l AS (SELECT o.*, row_number() OVER (PARTITION BY o.doc_id, o.t ORDER BY o.seq) AS k FROM o LEFT JOIN n ON o.doc_id = n.doc_id AND o.seq = n.seq WHERE n.seq IS NULL),
r AS (SELECT n.*, row_number() OVER (PARTITION BY n.doc_id, n.t ORDER BY n.seq) AS k FROM n LEFT JOIN o ON o.doc_id = n.doc_id AND o.seq = n.seq WHERE o.seq IS NULL)
SELECT l.doc_id, l.seq AS old_seq, r.seq AS new_seq FROM l JOIN r USING (doc_id, t, k)""")
def residual_hash_match(spark, d):
    _, left, right = diff.anchor_align(*_two(spark, d))
    return diff.exact_residual(left, right).select(F.col("tid").alias("doc_id"), F.col("o.seq").cast("long").alias("old_seq"), F.col("n.seq").cast("long").alias("new_seq"))


@query(f"""WITH {_TWO}
SELECT l.doc_id, count(*) AS pairs, sum(abs(l.seq - r.seq))::BIGINT AS distance FROM o l JOIN n r ON l.doc_id = r.doc_id AND abs(l.seq - r.seq) <= 32 GROUP BY 1""")
def window_candidates(spark, d):
    o, n = _two(spark, d)
    c = diff.window_candidates(o.select(*diff.PAIR, "o"), n.select(*diff.PAIR, "n"))
    return c.groupBy(F.col("tid").alias("doc_id")).agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.abs(F.col("o.seq") - F.col("n.seq"))).alias("distance"))


@query()
def minhash_candidates(spark, d):
    o, n = _two(spark, d)
    c = diff.minhash_candidates(o.select(*diff.PAIR, "o"), n.select(*diff.PAIR, "n"))
    return c.groupBy(F.col("tid").alias("doc_id")).agg(F.count_distinct("o.seq", "n.seq").alias("pairs"))


@query()
def greedy_match(spark, d):
    """All lines of both sides, as if no slot key had paired them."""
    o, n = _two(spark, d)
    c = diff.similar_places(o.select(*diff.PAIR, "o"), n.select(*diff.PAIR, "n"))
    return c.select(F.col("tid").alias("doc_id"), F.col("o_seq").alias("old_seq"), F.col("n_seq").alias("new_seq"), "sim")


@query()
def lis_moves(spark, d):
    """Each document's lines with the first six moved to the end."""
    o, n = _two(spark, d)
    a = o.select(*diff.PAIR, "o").withColumn("n", F.struct(F.when(F.col("o.seq") < 6, F.col("o.seq") + 1000000).otherwise(F.col("o.seq")).alias("seq")))
    return diff.moved_anchors(a).groupBy(F.col("tid").alias("doc_id")).agg(F.count(F.lit(1)).alias("moved"), F.max("o_seq").alias("last"))


@query()
def token_diff(spark, d):
    from webdelta.functions.tokendiff import inline_diff_udf

    x = _t(spark, d, "documents").select("doc_id", "text", F.regexp_replace("text", r"\bthe\b", "a").alias("after"))
    return x.select("doc_id", F.to_json(inline_diff_udf(F.col("text"), F.col("after"))).alias("ops"))


# Scores --------------------------------------------------------------------------------------------------------------


@query(r"""WITH s AS (SELECT event_id, event_type, (['modified','added','removed','reordered','restyled'])[1 + event_id % 5] AS ct, (['paragraph','link','price','list_item'])[1 + event_id % 4] AS ty,
  (['stock: ','people viewing ','n ','long words here and there with '])[1 + user_id % 4] AS head, user_id FROM events)
SELECT event_id, CASE WHEN ct = 'reordered' THEN 0.9 WHEN ct = 'restyled' THEN 0.95 WHEN ct IN ('added', 'removed') THEN CASE WHEN ty = 'link' THEN 0.6 ELSE 0.0 END
  WHEN ty = 'price' THEN 0.0 WHEN user_id % 4 = 0 THEN 0.0 WHEN user_id % 4 = 1 THEN 0.85 WHEN user_id % 4 = 2 THEN 0.6 ELSE 0.05 END::DOUBLE AS noise FROM s""")
def noise_score(spark, d):
    pick = lambda xs, c: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col(c) % len(xs) + 1).cast("int"))
    head = pick(["stock: ", "people viewing ", "n ", "long words here and there with "], "user_id")
    before, after = F.concat(head, F.col("event_id").cast("string")), F.concat(head, (F.col("event_id") + 1).cast("string"))
    n = diff.noise(pick(["modified", "added", "removed", "reordered", "restyled"], "event_id"), pick(["paragraph", "link", "price", "list_item"], "event_id"), before, after, (F.col("event_id") + 1).cast("string"))
    return _t(spark, d, "events").select("event_id", F.round(n.cast("double"), 6).alias("noise"))


def _units(spark, d: str) -> DataFrame:
    """Units made of line items: an order is a page, quantity the magnitude, the discount's change a number's."""
    li = _t(spark, d, "lineitem")
    ty = F.element_at(F.array(*[F.lit(x) for x in ("price", "paragraph", "list_item", "heading")]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    q = (F.col("l_quantity") / 100).cast("float")
    return li.select(F.col("l_orderkey").alias("tid"), F.col("l_linenumber").cast("long").alias("slot_key"), ty.alias("block_type"), q.alias("magnitude"), F.col("l_discount").cast("double").alias("num_pct"), F.col("l_tax").cast("float").alias("noise"))


_UNITS = r"""u AS (SELECT l_orderkey, l_linenumber, (['price','paragraph','list_item','heading'])[1 + l_linenumber % 4] AS ty, (l_quantity / 100)::REAL AS mag, least(abs(l_discount), 1.0)::REAL AS num, l_tax::REAL AS noise FROM lineitem),
b AS (SELECT *, 1::REAL - ((1::REAL - 0.6::REAL * (CASE ty WHEN 'price' THEN 1.0 WHEN 'paragraph' THEN 0.45 WHEN 'list_item' THEN 0.55 ELSE 0.8 END)::REAL) * (1::REAL - 0.7::REAL * mag) * (1::REAL - 0.9::REAL * num)) AS base FROM u),
s AS (SELECT *, (base * (1::REAL - noise))::REAL AS score FROM b)"""


def _score(u: DataFrame) -> DataFrame:
    weights = F.create_map(*[F.lit(x) for k, v in packs.TYPE_WEIGHT.items() for x in (k, float(v))])
    s = {"type": weights[F.col("block_type")].cast("float"), "mag": F.col("magnitude"), "num": F.least(F.abs("num_pct"), F.lit(1.0)).cast("float")}
    base = salience.noisy_or([(salience.f(salience.ALPHA[k]) * v).cast("float") for k, v in s.items()])
    return u.withColumn("score", (base * (salience.f(1) - F.col("noise"))).cast("float"))


@query(f"""WITH {_UNITS}
SELECT l_orderkey, l_linenumber, round(score::DOUBLE, 4) AS score, CASE WHEN score >= 0.9::REAL THEN 'critical' WHEN score >= 0.7::REAL THEN 'high' WHEN score >= 0.4::REAL THEN 'medium' WHEN score >= 0.15::REAL THEN 'low' ELSE 'none' END AS mat FROM s""")
def salience_score(spark, d):
    s = _score(_units(spark, d))
    return s.select(F.col("tid").alias("l_orderkey"), F.col("slot_key").alias("l_linenumber"), F.round(F.col("score").cast("double"), 4).alias("score"), salience.band(F.col("score"), packs.Pack()).alias("mat"))


@query(f"""WITH {_UNITS},
r AS (SELECT l_orderkey, score::DOUBLE AS score, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_linenumber) AS k FROM s)
SELECT l_orderkey, round(1 - product(1 - score), 2) AS page_score FROM r WHERE k <= 5 GROUP BY 1""")
def page_topk(spark, d):
    s = _score(_units(spark, d)).withColumns({"from_rev": F.lit(1), "to_rev": F.lit(2)})
    return salience.page_scores(s).select(F.col("tid").alias("l_orderkey"), F.round(F.col("page_score").cast("double"), 2).alias("page_score"))


@query(r"""WITH s AS (SELECT event_id, value, event_id % 6 AS k FROM events)
SELECT event_id, CASE k WHEN 0 THEN 'plan_removed' WHEN 1 THEN 'price_increase' WHEN 2 THEN 'api_deprecation' WHEN 3 THEN 'api_breaking' WHEN 4 THEN 'cosmetic' ELSE 'content_edit' END AS cat,
  CASE WHEN k = 0 THEN 'escalate_human' WHEN m = 'none' THEN 'ignore' WHEN k = 1 THEN 're_run_downstream' WHEN k = 4 THEN 'ignore' WHEN k = 5 THEN 'notify'
    WHEN m IN ('low', 'medium') THEN 'notify' WHEN m = 'high' THEN 're_run_downstream' ELSE 'escalate_human' END AS act
FROM (SELECT *, (['none','low','medium','high','critical'])[1 + event_id % 5] AS m FROM s)""")
def category_action(spark, d):
    pack = packs.load("pricing")
    texts = ["now discontinued", "$5", "this call is deprecated", "removed for good", "same", "other words"]
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("event_id") % len(xs) + 1).cast("int"))
    k = F.col("event_id") % 6
    u = _t(spark, d, "events").select("event_id", pick(texts).alias("present"), F.lit("before").alias("prior"), F.when(k == 4, "restyled").otherwise("modified").alias("ct"), F.when(k == 1, "price").otherwise("paragraph").alias("block_type"), F.when(k == 1, 1.0).alias("num_from"), F.when(k == 1, 2.0).alias("num_to"), pick(salience.MATERIALITY).alias("mat"))
    u = u.withColumn("cat", salience.category(pack))
    return u.select("event_id", "cat", salience.action(pack)[0].alias("act"))


@query("""WITH c AS (SELECT l_suppkey, count(*) AS members, count(*) FILTER (l_linenumber % 3 = 0) AS added, count(*) FILTER (l_linenumber % 3 = 1) AS removed FROM lineitem GROUP BY 1)
SELECT l_suppkey, added, removed, members - added - removed AS modified, members - 8 AS truncated FROM c WHERE members > 32""")
def cascade_cluster(spark, d):
    """Suppliers as tables, line items as their changed rows."""
    li = _t(spark, d, "lineitem")
    ct = F.element_at(F.array(F.lit("added"), F.lit("removed"), F.lit("modified")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    key = F.concat_ws("-", "l_orderkey", "l_linenumber")
    none = lambda t, n: F.lit(None).cast(t).alias(n)
    delta = F.struct(F.lit("block").alias("enc"), key.alias("a"), none("string", "b"), none("boolean", "atrunc"), none("array<array<string>>", "ops"), none("int", "from"), none("int", "to"), none("string", "key"), *[none("int", c) for c in ("added", "removed", "modified", "truncated")], none("array<string>", "sample"))
    u = li.select(F.lit("t").alias("tid"), F.lit(1).alias("from_rev"), F.lit(2).alias("to_rev"), key.alias("slot_key"), ct.alias("ct"), F.lit(1.0).cast("float").alias("sim"), delta.alias("delta"), F.lit(0.0).cast("float").alias("noise"), F.lit(1.0).cast("float").alias("magnitude"), F.lit("table_row").alias("block_type"), F.col("l_suppkey").cast("string").alias("parent_slot"), F.lit("struct").alias("anchored_by"), key.alias("event_key"))
    c = diff.clustered(u).filter("delta.enc = 'struct'")
    return c.select(F.col("slot_key").cast("long").alias("l_suppkey"), *[F.col(f"delta.{x}").cast("long").alias(x) for x in ("added", "removed", "modified", "truncated")])


@query(f"""WITH {_TWO},
p AS (SELECT doc_id, list_distinct(list(seq)) AS a FROM o GROUP BY 1), q AS (SELECT doc_id, list_distinct(list(CASE WHEN doc_id % 3 = 0 THEN seq + 500000 ELSE seq END)) AS b FROM n GROUP BY 1)
SELECT doc_id FROM p JOIN q USING (doc_id) WHERE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))::DOUBLE < 0.3""")
def redesign_guard(spark, d):
    o, n = _two(spark, d)
    old = o.groupBy("tid").agg(F.collect_set("o.seq").alias("old_slots"))
    new = n.groupBy("tid").agg(F.collect_set(F.when(F.col("tid") % 3 == 0, F.col("n.seq") + 500000).otherwise(F.col("n.seq"))).alias("new_slots"))
    pairs = old.join(new, "tid").withColumns({"from_rev": F.lit(1), "to_rev": F.lit(2), "old_hash": F.lit("a"), "new_hash": F.lit("b")})
    return events.redesigned(pairs).select(F.col("tid").alias("doc_id"))


# State ---------------------------------------------------------------------------------------------------------------


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k <= 8")
def ring_keep_8(spark, d):
    return store.ring(_t(spark, d, "events").select("user_id", "event_id"), "user_id", "event_id")


@query("""WITH e AS (SELECT event_type AS tid, user_id::VARCHAR || '/' || (value::INT)::VARCHAR AS event_key, event_id AS seq FROM events),
f AS (SELECT tid, event_key, min(seq) AS seq FROM e GROUP BY 1, 2)
SELECT tid, event_key, seq FROM (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY seq DESC, event_key) AS k FROM f) WHERE k <= 1000""")
def seen_1000(spark, d):
    e = _t(spark, d, "events").select(F.col("event_type").alias("tid"), F.concat_ws("/", "user_id", F.bround("value", 0).cast("int")).alias("event_key"), F.col("event_id").alias("seq"))
    return store.seen_after(e.limit(0), e)


@query("""SELECT e.event_id, e.user_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events s WHERE s.user_id = e.user_id AND s.event_type = e.event_type AND s.event_id < e.event_id)""")
def unseen_events(spark, d):
    """Events whose (user, type) no earlier event had: an anti join on what was seen."""
    e = _t(spark, d, "events").select("event_id", "user_id", "event_type")
    first = e.groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    seen = e.join(first, ["user_id", "event_type"]).filter("event_id > first").select(F.col("user_id").alias("tid"), F.col("event_id").alias("event_key"))
    return store.unseen(e.withColumns({"tid": F.col("user_id"), "event_key": F.col("event_id")}), seen).select("event_id", "user_id")


@query("""WITH RECURSIVE e AS MATERIALIZED (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
g(user_id, k, event_id, last, wait_s) AS (
  SELECT user_id, k, event_id, t, 0::BIGINT FROM e WHERE k = 1
  UNION ALL
  SELECT e.user_id, e.k, e.event_id, CASE WHEN e.t - g.last >= 3600000000 THEN e.t ELSE g.last END, CASE WHEN e.t - g.last >= 3600000000 THEN 0 ELSE (3600000000 - (e.t - g.last) + 999999) // 1000000 END
  FROM g JOIN e ON e.user_id = g.user_id AND e.k = g.k + 1)
SELECT event_id, wait_s FROM g""")
def crawl_delay_gate(spark, d):
    """Only fetches that were let through count."""
    return store.gated(_t(spark, d, "events").select("event_id", "user_id", "ts"), 3600, "user_id", tie="event_id").select("event_id", "wait_s")


@query("SELECT event_id, user_id, 'cfc_1500' AS next_cursor FROM events ORDER BY value DESC, event_id LIMIT 1000 OFFSET 500")
def feed_page(spark, d):
    return store.feed_page(_t(spark, d, "events").select("event_id", "user_id", "value"), [F.col("value").desc(), F.col("event_id")], "cfc_500").drop("value")


@query("""SELECT event_id, k AS outcome, CASE k WHEN 'not_modified' THEN 0 WHEN 'auth' THEN 5 WHEN 'rate_limited' THEN 6 WHEN 'error' THEN 3 ELSE -1 END AS exit_code FROM (
  SELECT event_id, (['body','not_modified','auth','auth','error','rate_limited','error'])[1 + event_id % 7] AS k FROM events)""")
def outcome_codes(spark, d):
    status = F.element_at(F.array(*[F.lit(x) for x in (200, 304, 401, 403, 404, 429, 500)]), (F.col("event_id") % 7 + 1).cast("int"))
    kind = observations.outcome(status, F.lit("<p>text</p>"), render="never")
    return _t(spark, d, "events").select("event_id", kind.alias("outcome"), F.coalesce(observations.exit_code(kind), F.lit(-1)).alias("exit_code"))


@query(r"""SELECT page_id, NOT (regexp_matches(p, '^/fr/') AND NOT regexp_matches(p, '^/fr/.*\.html$')) AND NOT regexp_matches(p, '^/es/.*/$') AS allowed
FROM (SELECT page_id, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^#]*)', 1) AS p FROM pages)""")
def robots_match(spark, d):
    p = _t(spark, d, "pages").select("page_id", "url")
    txt = "User-agent: *\nDisallow: /\n\nUser-agent: webdelta\nDisallow: /fr/\nAllow: /fr/*.html$\nDisallow: /es/*/$\n"
    rules = observations.robots_rules(spark, [("h", txt)]).drop("host")
    hosts = p.select(text.host_of(F.col("url")).alias("host")).distinct()
    return observations.robots_allowed(p, hosts.join(F.broadcast(rules)), "webdelta/1.0").select("page_id", "allowed")


@query("""WITH c AS (SELECT user_id, ([0, 11, 12, 10, 3, 6, 4, 5, 7, 2, 1])[1 + event_id % 11] AS code FROM events), r(code, place) AS (VALUES (0, 0), (11, 1), (12, 2), (10, 3), (3, 4), (6, 5), (4, 6), (5, 7), (7, 8), (2, 9), (1, 10))
SELECT user_id AS run, arg_max(code, place) AS exit_code FROM c JOIN r USING (code) GROUP BY 1""")
def worst_code(spark, d):
    code = F.element_at(F.array(*[F.lit(x) for x in (0, 11, 12, 10, 3, 6, 4, 5, 7, 2, 1)]), (F.col("event_id") % 11 + 1).cast("int"))
    return events.worst_code(_t(spark, d, "events").select(F.col("user_id").alias("run"), code.alias("exit_code")))


# Whole plans ---------------------------------------------------------------------------------------------------------


def revisions(spark: SparkSession, d: str) -> DataFrame:
    """Each page twice: as it is, and with a new price paragraph on every fifth, a changed heading on every seventh."""
    p = _t(spark, d, "pages")
    base = p.select(F.concat(F.lit("page-"), "page_id").alias("tid"), F.lit(1).cast("long").alias("rev"), "url", F.lit("2024-01-01T00:00:00Z").alias("obs"), F.regexp_replace("html", "</article>", F.concat(F.lit("<p>\\$"), (F.col("page_id") % 90 + 10).cast("string"), F.lit("/mo</p></article>"))).alias("html"), F.lit("selector").alias("strategy"), F.lit("article").alias("root_selector"))
    k = F.regexp_extract("tid", r"(\d+)", 1).cast("long")
    after = F.when(k % 5 == 0, F.regexp_replace("html", r"<p>\$\d+/mo</p></article>", F.concat(F.lit("<p>\\$"), (k % 90 + 15).cast("string"), F.lit("/mo</p></article>")))).when(k % 7 == 0, F.regexp_replace("html", "</article>", "<p>No longer available.</p></article>")).otherwise(F.col("html"))
    return base.unionByName(base.withColumns({"rev": F.lit(2).cast("long"), "obs": F.lit("2024-01-02T00:00:00Z"), "html": after}))


@query()
def html_extract(spark, d):
    from webdelta.sources.html import extracted

    p = extracted(observations.from_pages(_t(spark, d, "pages")))
    return p.select("tid", "rev", "title", F.size("nodes").alias("nodes"), "bytes_raw")


@query()
def page_blocks(spark, d):
    _, blocks, _ = engine.canonical(revisions(spark, d))
    return blocks.select("tid", "rev", "seq", "slot_key", "ty", "level", "text", "value.minor", "anchored_by", "parent_slot")


@query("""SELECT 'page-' || page_id AS tid, CASE WHEN page_id % 5 = 0 THEN 'price_increase' ELSE 'plan_removed' END AS cat, CASE WHEN page_id % 5 = 0 THEN 'modified' ELSE 'added' END AS ct,
  CASE WHEN page_id % 5 = 0 THEN 're_run_downstream' ELSE 'escalate_human' END AS act, CASE WHEN page_id % 5 = 0 THEN '$' || (page_id % 90 + 15) || '/mo' ELSE 'No longer available.' END AS a
FROM pages WHERE page_id % 5 = 0 OR page_id % 7 = 0""")
def change_events(spark, d):
    e = engine.observe(revisions(spark, d), "pricing", min_salience="none")
    return e.select("tid", "cat", "ct", "act", F.col("event.delta.a").alias("a"))


@query()
def event_json(spark, d):
    e = engine.observe(revisions(spark, d), "pricing")
    return e.select("tid", "sal", "mat", events.event_json(F.col("event")).alias("event"))


@query()
def explained_units(spark, d):
    return engine.explain(revisions(spark, d), "pricing").withColumn("signals", F.to_json("signals"))


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
