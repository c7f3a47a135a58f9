import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from webdelta.functions import text, values
from webdelta.functions.tokendiff import edit_script, first_unused, increasing, inline_diff, token_distance, tokenize
from webdelta.sources import config
from webdelta.sources.html import rows_of, selector, tree
from webdelta.sources.observations import parsed_robots


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "s string").select(fn(F.col("s")).alias("x")).first()[0]


def test_canonical_url(spark):
    rows = {
        "HTTP://Example.com:80/p?utm_source=x&b=2&a=1#top": "http://example.com/p?a=1&b=2",
        "https://e.org:443": "https://e.org/",
        "https://e.org/app.1a2b3c4d.js?v=1.2.3&hash=beef&vid=7": "https://e.org/app.js?vid=7",
        "mailto:a@b.c#x": "mailto:a@b.c",
        "/rel?gclid=1&z=2": "/rel?z=2",
    }
    got = spark.createDataFrame(list(rows.items()), "s string, want string").select("want", text.canonical_url(F.col("s")).alias("x")).collect()
    assert [r["x"] for r in got] == [r["want"] for r in got]


def test_text(spark):
    assert one(spark, " a​b   c\n", text.collapse) == "ab c"
    assert one(spark, "Updated 10:30, 5 minutes ago, just now", text.mask_times) == "⟦TS⟧, ⟦TS⟧, ⟦TS⟧"
    assert one(spark, "header nav", text.is_boilerplate) is True
    assert abs(one(spark, "aabb", text.entropy) - 1.0) < 1e-9
    assert one(spark, "a_b1, c!", text.tokens) == ["a_b1", ",", " ", "c", "!"]


def test_values(spark):
    assert tuple(one(spark, "$1,234.56 per month", values.price)) == (123456, "USD", "mo")
    assert tuple(one(spark, "CHF 9", values.price)) == (900, "CHF", None)
    assert one(spark, "from $5", values.price) is None
    assert one(spark, "⟦TS⟧ 2024-02-28", values.date) is None
    assert one(spark, "1,200.50", values.number) == "1200.5"
    assert one(spark, "12 kg", values.number) is None


def test_prices_dates_and_times_by_the_rules(spark):
    """Expected values by the rules' text: the whole run of digits is the amount, the first date-shaped word decides."""
    prices = {
        "$5 mo": (500, "USD", "mo"), "$5/monthly": (500, "USD", "mo"), "$9 annually": (900, "USD", "yr"), "$5 users": (500, "USD", "user"), "$.50": (50, "USD", None), "$1.2.3": None, "$5/mo,": (500, "USD", None),
        " € 7 / day": (700, "EUR", "day"), "CHF\t1,000.005": (100000, "CHF", None), "CHF9": None, "$": None, "$,": None, "£3 per seat now": (300, "GBP", "seat"), "$5 monthlyish": (500, "USD", None), "": None,
    }
    got = {r["s"]: r["p"] for r in spark.createDataFrame([(k,) for k in prices], "s string").select("s", values.price(F.col("s")).alias("p")).collect()}
    assert {k: v and tuple(v) for k, v in got.items()} == prices
    dates = {
        "2024/05/06": "2024-05-06", "2024-5-6": "2024-05-06", "2024-05-06T10:00:00Z": None, "2024-05-06,": None, "2024-13-45 then 2024-05-06": None, "on 2024-02-30 or 2024-02-28": None,
        "x 2024-05-06, then 2023/1/2": "2023-01-02", "2024/05-06": None, "12024-05-06": None, "": None,
    }
    got = {r["s"]: r["p"] for r in spark.createDataFrame([(k,) for k in dates], "s string").select("s", values.date(F.col("s")).alias("p")).collect()}
    assert {k: v and str(v) for k, v in got.items()} == dates
    times = {
        "an hour ago": "⟦TS⟧", "a few days from now": "⟦TS⟧", "in several weeks": "⟦TS⟧", "moment ago": "⟦TS⟧", "as of 10:00 CEST": "⟦TS⟧", "5 min ago": "5 min ago", "3 hrs ago": "3 hrs ago", "Last updated 9:05:07 pm": "⟦TS⟧", "in 12 Months.": "⟦TS⟧.",
        "within 3 days": "within 3 days",
    }
    got = {r["s"]: r["p"] for r in spark.createDataFrame([(k,) for k in times], "s string").select("s", text.mask_times(F.col("s")).alias("p")).collect()}
    assert got == times


def test_worst_code_and_ceiling(spark):
    """Each code against each: the order is that of the severities; an event over the ceiling keeps both sides, marked."""
    from webdelta.operators import events

    order = [0, 11, 12, 10, 3, 6, 4, 5, 7, 2, 1]
    rows = [(i * 20 + j, c) for i, a in enumerate(order) for j, b in enumerate(order) for c in (a, b)]
    got = {r["run"]: r["exit_code"] for r in events.worst_code(spark.createDataFrame(rows, "run int, exit_code int")).collect()}
    assert all(got[i * 20 + j] == order[max(i, j)] for i in range(len(order)) for j in range(len(order)))
    kind = "enc string, a string, b string, atrunc boolean, ops array<array<string>>, added int, truncated int, sample array<string>"
    long = [["=", "x"], ["-", "o" * 900], ["+", "n" * 9000]]
    rows = [(0, ("idiff", None, None, None, long, None, None, None)), (1, ("struct", None, None, None, None, 7, 2, ["s" * 9000, "t"])), (2, ("val", "a", "b", None, None, None, None, None))]
    got = {r["k"]: r["event"]["delta"].asDict() for r in events.under_ceiling(spark.createDataFrame(rows, f"k int, delta struct<{kind.replace(' ', ':').replace(',:', ',')}>").select("k", F.struct("delta").alias("event"))).collect()}
    assert (got[0]["enc"], got[0]["a"], got[0]["b"], got[0]["atrunc"], got[0]["ops"]) == ("block", "x" + "n" * 599, "x" + "o" * 599, True, None)
    assert (got[1]["enc"], got[1]["added"], got[1]["truncated"], got[1]["sample"]) == ("struct", 7, 4, [])
    assert (got[2]["enc"], got[2]["a"]) == ("val", "a")


def test_packed_bodies():
    import gzip

    import pytest

    from webdelta.sources.http import decoded

    packed = gzip.compress(b"text" * 100)
    assert decoded(packed, "gzip", 400) == "text" * 100 and decoded(packed, "gzip", 399) is None and decoded(b"12345", None, 4) is None
    with pytest.raises(EOFError):
        decoded(packed[:-12], "gzip", 400)


@given(st.lists(st.sampled_from("abc ")), st.lists(st.sampled_from("abc ")))
@settings(max_examples=200, deadline=None)
def test_edit_script_rebuilds_both_sides_and_is_shortest(a, b):
    s = edit_script(a, b)
    assert [t for op, t in s if op != "+"] == a and [t for op, t in s if op != "-"] == b
    n, m = len(a), len(b)
    lcs = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n):
        for j in range(m):
            lcs[i + 1][j + 1] = lcs[i][j] + 1 if a[i] == b[j] else max(lcs[i][j + 1], lcs[i + 1][j])
    assert sum(op != "=" for op, _ in s) == n + m - 2 * lcs[n][m]


def test_inline_diff():
    assert inline_diff("a b", "a  b") == []
    assert inline_diff("it is slightly faster", "it is slightly quicker") == [["=", "it is slightly "], ["-", "faster"], ["+", "quicker"]]
    long = " ".join(f"w{i}" for i in range(30))
    (first, *_), (op, word) = inline_diff(long, long + "!")[0], inline_diff(long, long + "!")[1]
    assert inline_diff(long, long + "!")[0][1].startswith("…") and (op, word) == ("+", "!")
    assert token_distance("a b c", "a x c") == 1 / 3 and token_distance("", "") == 0
    assert tokenize("é1_x y") == ["é1_x", " ", "y"]


@given(st.lists(st.integers(0, 50), unique=True, max_size=9))
@settings(max_examples=100, deadline=None)
def test_increasing(values_):
    from itertools import combinations

    got = [values_[i] for i in increasing(values_)]
    best = max((len(c) for n in range(len(values_) + 1) for c in combinations(values_, n) if list(c) == sorted(c)), default=0)
    assert got == sorted(got) and len(got) == best


def test_html_tree_and_selectors():
    page = "<html><head><title> A  B </title></head><body><nav><a href='/x'>n</a></nav><div id=m class='Box wide'><p>one<b>two<p>three<script>var t='</p>'</script><ul><li>x<li>y</ul></div><div class=ad>buy</div></body></html>"
    title, nodes = rows_of(page, "selector", "#m")
    assert title == "A B"
    assert [n["text"] for n in nodes if n["text"]] == ["one", "two", "three", "x", "y"]
    assert [n["tag"] for n in nodes if n["tag"]] == ["div", "p", "b", "p", "ul", "li", "li"]
    assert not any("buy" == n["text"] for n in rows_of(page, "full")[1])
    box = next(n for n in tree(page).walk() if n.attrs.get("id") == "m")
    assert selector("body > div.Box[id=m]")(box) and selector("p, div.wide")(box) and not selector("nav div")(box)
    for bad in ("", "a >", "p:::x"):
        try:
            selector(bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_robots_and_config():
    rules = parsed_robots("User-agent: a\nUser-agent: b\nDisallow: /x # no\nCrawl-delay: 1.2\n\nUser-agent: *\nAllow: /\n")
    assert ("a", "disallow", "/x", 2) in rules and ("b", "disallow", "/x", 2) in rules and ("*", "allow", "/", None) in rules
    assert config.seconds("15m") == 900 and config.expanded("${A}-$$-${B", {"A": "1"}) == "1-$-${B"
    t = config.parsed('[defaults]\nrender = "never"\n[[target]]\nurl = "https://E.org/p"\nselect = ".x"\n')
    assert t[0]["id"] == "e-org-p" and t[0]["strategy"] == "selector" and t[0]["render"] == "never"
    try:
        config.parsed('[[target]]\nid="a"\nurl="x"\n[[target]]\nid="a"\nurl="y"\n')
    except ValueError:
        return
    raise AssertionError


def test_first_unused_pairs():
    assert first_unused(["a", "a"], ["a", "a"]) == [(0, 0), (1, 1)]
    # The second old entry finds no equal first unused one; the third takes it.
    assert first_unused(["p", "h", "p"], ["p", "p", "h"]) == [(0, 0), (2, 1)]
    assert first_unused(["h", "p"], ["p"]) == [(1, 0)] and first_unused([], ["p"]) == []


def test_token_diffs_of_long_rewrites_stay_small():
    a, b = [f"x{i}" for i in range(3000)], [f"y{i}" for i in range(2900)]
    script = edit_script(a, [*b, "x2999"])
    assert [t for op, t in script if op != "+"] == a and [t for op, t in script if op != "-"] == [*b, "x2999"] and len(script) == 5900
    assert token_distance(" ".join(a), " ".join(b)) == 1.0
    # Against the plain table of distances.
    rng = random.Random(3)
    for _ in range(300):
        x, y = ([rng.choice("abc") for _ in range(rng.randint(1, 14))] for _ in range(2))
        table = [[i + j if not i * j else 0 for j in range(len(y) + 1)] for i in range(len(x) + 1)]
        for i in range(1, len(x) + 1):
            for j in range(1, len(y) + 1):
                table[i][j] = min(table[i - 1][j] + 1, table[i][j - 1] + 1, table[i - 1][j - 1] + (x[i - 1] != y[j - 1]))
        assert token_distance(" ".join(x), " ".join(y)) == table[-1][-1] / max(len(x), len(y))


def test_links_resolve_against_a_kept_base():
    html = "<html><body><main><base href='https://acme.test/docs/'><p>" + "words, and more words, " * 20 + "</p><a href='../pricing?b=2'>x</a><a href='mailto:a@b.c'>m</a><img src='//cdn.test/i.png'></main></body></html>"
    _, nodes = rows_of(html, "full")
    urls = [dict(n["attrs"]).get("href") or dict(n["attrs"]).get("src") for n in nodes if n["tag"] in ("a", "img")]
    assert urls == ["https://acme.test/pricing?b=2", "mailto:a@b.c", "https://cdn.test/i.png"]
    # A base that is itself relative resolves nothing.
    assert dict([n for n in rows_of("<body><base href='/d/'><a href='p'>x</a></body>", "full")[1] if n["tag"] == "a"][0]["attrs"]) == {"href": "p"}
