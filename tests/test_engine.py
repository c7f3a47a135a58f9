import json
import random

import pytest

from webdelta.plans import engine
from webdelta.operators.diff import exact_residual
from webdelta.operators.events import event_json, segment_index
from webdelta.operators.packs import load

SCHEMA = "tid string, rev long, url string, obs string, html string, strategy string, root_selector string"


def page(price="$49/mo", nonce="a1", count=12, extra="", head="Team plan"):
    return f"<html><head><title>Plans</title></head><body><nav>x</nav><section class='Plans' data-csrf-nonce='{nonce}'><h1>Plans</h1><p class='live'>{count} viewing right now</p><div><h2>{head}</h2><p>{price}</p><ul><li>Ten seats</li><li>Mail help</li></ul></div>{extra}</section></body></html>"


def table(n, f=lambda i: f"v{i}"):
    return "<html><body><main id=t><table>" + "".join(f"<tr><td>row {i}</td><td>{f(i)}</td></tr>" for i in range(n)) + "</table></main></body></html>"


@pytest.fixture(scope="module")
def found(spark):
    """All scenarios in one run: every pair is a target of its own."""
    how = dict(ignore=["attr:data-csrf-nonce", r"regex:\d+ viewing right now"])
    pairs = {
        "price": (page(), page("$59/mo", "b2", 99)), "noop": (page(), page(nonce="zz", count=7)), "added": (page(), page(extra="<p>This plan is no longer available.</p>")),
        "prose": (page(extra="<p>Our service is slightly faster than it was in spring</p>"), page(extra="<p>Our service is slightly quicker than it was in spring</p>")),
        "removed": (page(extra="<p>One more thing to say</p>"), page()), "redesign": (page(), "<html><body><section class='Plans'><h1>Else</h1><h3>All new</h3><p>x</p></section></body></html>"),
        "churn": (table(40), table(40, lambda i: f"new{i}")), "grow": (table(36), table(50, lambda i: f"new{i}")), "small": (table(20), table(20, lambda i: f"new{i}")),
    }
    rows = [(tid, rev, "https://e.org/p", f"2024-01-0{rev}T00:00:00Z", h, "selector", "#t" if "id=t" in h else ".Plans") for tid, both in pairs.items() for rev, h in zip((1, 2), both)]
    e = engine.observe(spark.createDataFrame(rows, SCHEMA), "pricing", min_salience="none", **how)
    out = {}
    for r in e.select("tid", "mat", "sal", event_json(e.event).alias("j")).collect():
        out.setdefault(r["tid"], []).append(json.loads(r["j"]))
        assert len(r["j"].encode()) <= 8192 and "null" not in r["j"]
    return out


def test_price_rise(found):
    (e,) = found["price"]
    assert e["ct"] == "modified" and e["delta"] == {"enc": "val", "a": "$59/mo", "b": "$49/mo"}
    assert e["why"]["cat"] == "price_increase" and e["why"]["mat"] == "high" and 0.70 <= e["why"]["sal"] <= 0.89 and "20.4%" in e["why"]["summary"]
    assert e["followup"]["act"] == "re_run_downstream" and e["conf"] >= 0.85
    assert e["seg"][0]["label_path"] == "Plans › Team plan › price"
    assert list(e) == ["v", "id", "src", "obs", "base", "seg", "ct", "delta", "why", "followup", "conf", "prov"]


def test_noise_makes_no_event(found):
    assert "noop" not in found


def test_added_and_removed(found):
    (e,) = found["added"]
    assert e["ct"] == "added" and e["why"]["cat"] == "plan_removed" and e["followup"]["act"] == "escalate_human"
    assert [x["ct"] for x in found["removed"]] == ["removed"]


def test_prose_is_an_inline_diff(found):
    (e,) = found["prose"]
    assert e["delta"]["enc"] == "idiff" and ["-", "faster"] in e["delta"]["ops"] and ["+", "quicker"] in e["delta"]["ops"]


def test_redesign_is_one_event(found):
    (e,) = found["redesign"]
    assert e["why"]["mat"] == "high" and e["why"]["sal"] == 0.75 and "overlap" in e["delta"]["a"] and e["conf"] == 0.6


def test_cascades(found):
    (e,) = [x for x in found["churn"] if x["delta"]["enc"] == "struct"]
    assert len(found["churn"]) == 1 and len(e["delta"]["sample"]) == 8 and e["delta"]["truncated"] == 32
    (g,) = found["grow"]
    assert g["delta"]["modified"] == 36 and g["delta"]["added"] == 14
    # Twenty rows stay twenty events, beside the container's own: a table's text is all its rows'.
    assert len(found["small"]) == 21


def test_blocks(spark):
    html = page(extra="<pre>a  b</pre><table><tr><th>k</th><td>1</td></tr></table><p id=z><del>old</del> 2024-05-06</p>")
    _, blocks, docs = engine.canonical(spark.createDataFrame([("t", 1, "u", "o", html, "selector", ".Plans")], SCHEMA))
    b = blocks.orderBy("seq").collect()
    assert [x["ty"] for x in b] == ["heading", "paragraph", "heading", "price", "list_item", "list_item", "code", "table", "table_row", "date"]
    assert b[6]["text"] == "a  b" and b[8]["value"]["cells"] == ["k", "1"] and b[8]["parent_slot"] == b[7]["slot_key"]
    assert b[7]["preorder_idx"] == 8 and b[8]["preorder_idx"] == 7
    assert b[9]["anchored_by"] == "anchor" and b[9]["restyle_sig"] == 1 and len({x["slot_key"] for x in b}) == len(b)
    assert docs.first()["block_count"] == 10


def test_packs():
    p = load("pricing")
    assert p.type_weight["table_row"] == 0.9 and p.cats["content_edit"] == "notify" and p.rules[0]["sticky"] and load("nothing").id == "default"


def test_segment_paths_equal_the_fold(spark):
    """Skipped levels included: a path holds at most level - 1 headings above a heading of a level."""
    rng = random.Random(8)
    rows = [(f"t{d}", 1, f"s{i}", i, "heading" if rng.random() < 0.6 else "paragraph", rng.randint(1, 6), f"x{i}") for d in range(20) for i in range(25)]
    rows = [(*r[:5], r[5] if r[4] == "heading" else None, r[6]) for r in rows]
    got = {(r["tid"], r["slot_key"]): r["seg"]["label_path"] for r in segment_index(spark.createDataFrame(rows, "tid string, rev long, slot_key string, seq long, ty string, level int, text string")).collect()}
    for d in range(20):
        path = []
        for _, _, slot, _, ty, level, text in [r for r in rows if r[0] == f"t{d}"]:
            assert got[(f"t{d}", slot)] == " › ".join([*path, text if ty == "heading" else "prose"])
            if ty == "heading":
                path = [*path[: level - 1], text]


def test_residuals_of_mixed_types(spark):
    block = "struct<seq:long,ty:string,norm_hash:long>"
    side = lambda name, *xs: spark.createDataFrame([("t", 1, 2, x) for x in xs], f"tid string, from_rev long, to_rev long, {name} {block}")
    old = side("o", (0, "p", 7), (1, "h", 7), (2, "p", 7), (3, "p", 8), (4, "p", 8), (5, "p", 9))
    new = side("n", (0, "p", 7), (1, "p", 7), (2, "h", 7), (9, "p", 8), (10, "h", 10))
    assert sorted((r["o"]["seq"], r["n"]["seq"]) for r in exact_residual(old, new).collect()) == [(0, 0), (2, 1), (3, 9)]
