"""The engine's verbs: whole plans over tables of observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webdelta.operators import diff, events, salience, segment, store
from webdelta.operators.mask import masked, parsed_rules
from webdelta.operators.packs import Pack, load
from webdelta.plans.tables import settled
from webdelta.sources.html import extracted


def canonical(observations: DataFrame, types: dict[str, str] | None = None, strip_text: list[str] = (), strip_attrs: list[str] = (), ignore: list[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """observations (tid, rev, url, obs, html) to pages, blocks and docs. Ignore rules feed both the stripping and the mask."""
    rules = parsed_rules(list(ignore))
    strip_text = [*strip_text, *[v for k, v in rules if k == "regex"]]
    strip_attrs = [*strip_attrs, *[v for k, v in rules if k == "attr"]]
    pages = settled(extracted(observations), "pages")
    blocks = settled(masked(segment.blocks(pages, types, strip_text, strip_attrs), [r for r in rules if r[0] != "regex"]), "blocks")
    return pages.drop("nodes"), blocks, segment.docs(blocks)


def scored_units(blocks: DataFrame, docs: DataFrame, pack: Pack) -> tuple[DataFrame, DataFrame]:
    pairs = settled(diff.revision_pairs(docs), "pairs")
    units = settled(diff.units(blocks, pairs), "units")
    return settled(salience.scored(diff.clustered(units), pairs, pack), "scored"), pairs


def observe(observations: DataFrame, archetype: str | None = None, min_salience: str = "low", **how) -> DataFrame:
    """Events of all successive revisions of all targets."""
    pages, blocks, docs = canonical(observations, **how)
    pack = load(archetype)
    units, pairs = scored_units(blocks, docs, pack)
    return events.assembled(units, pairs, pages, events.segment_index(blocks), pack, min_salience)


def score_pair(spark: SparkSession, before: str, after: str, url: str = "file:pair", **how) -> DataFrame:
    """Events between two HTML texts, without a store."""
    rows = [("pair", 1, url, "1970-01-01T00:00:00Z", before), ("pair", 2, url, "1970-01-01T00:00:01Z", after)]
    return observe(spark.createDataFrame(rows, "tid string, rev long, url string, obs string, html string"), **how)


def changes(observations: DataFrame, tid: str, old_rev: int, new_rev: int, **how) -> DataFrame:
    """Events between any two revisions of one target, nothing gated."""
    two = observations.filter((F.col("tid") == tid) & F.col("rev").isin(old_rev, new_rev))
    return observe(two, min_salience="none", **how)


def explain(observations: DataFrame, archetype: str | None = None, **how) -> DataFrame:
    """Scored units with their signals, the part of each in the score, and what decided the action."""
    _, blocks, docs = canonical(observations, **how)
    return scored_units(blocks, docs, load(archetype))[0].select(*diff.PAIR, "slot_key", "ct", "block_type", "score", "sal", "mat", "cat", "act", "decided_by", "noise", "signals")


def feed(observations: DataFrame, since: str | None = None, cursor: str | None = None, limit: int = store.PAGE, by_salience: bool = False, tids: list[str] | None = None, **how) -> DataFrame:
    """A page of the events of all retained transitions."""
    x = store.ring(observations)
    x = x.filter(F.col("tid").isin(tids)) if tids else x
    e = observe(x, **how)
    e = e.filter(F.col("event.obs") > since) if since else e
    order = ([F.col("sal").desc()] if by_salience else []) + [F.col("tid"), F.col("to_rev"), F.col("event.id")]
    return store.feed_page(e, order, cursor, limit)


def rules(observations: DataFrame, **how) -> DataFrame:
    """How well each target's newest observation still fits the one before: blocks, shared slot share, a warning."""
    from webdelta.functions.text import overlap

    p = diff.revision_pairs(canonical(observations, **how)[2])
    share = overlap(F.col("new_slots"), F.col("old_slots"))
    return p.select(*diff.PAIR, "old_count", "new_count", share.alias("slot_overlap"), F.when(F.col("new_count") == 0, "zero_match").when(share < events.LOW_OVERLAP, "low_overlap").otherwise("healthy").alias("state"))
