"""The smaller verbs: seeding and listing what is stored, rendering and reading events, publishing their schema."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webdelta.operators import store
from webdelta.operators.events import event_json
from webdelta.sources import config

VERSION = "1"
#: The wire event's keys, in order.
KEYS = ["v", "id", "src", "obs", "base", "seg", "ct", "delta", "why", "followup", "conf", "prov"]


def snapshot(versions: DataFrame, observations: DataFrame) -> DataFrame:
    """versions with the observations stored as each target's next revision, whether or not they differ; the ring is kept."""
    new = observations.join(store.next_revs(versions), "tid", "left").withColumn("rev", F.coalesce("next_rev", F.lit(1)).cast("long")).select(*versions.columns)
    return store.ring(versions.unionByName(new))


def listed(targets: DataFrame, versions: DataFrame) -> DataFrame:
    """Targets with their newest revision, when it was seen, and how many are kept."""
    state = versions.groupBy("tid").agg(F.max("rev").alias("rev"), F.max_by("obs", "rev").alias("obs"), F.count(F.lit(1)).alias("kept"))
    return targets.join(state, targets["id"] == state["tid"], "left").select("id", "url", "archetype", "rev", "obs", F.coalesce("kept", F.lit(0)).alias("kept"))


def shown(versions: DataFrame, tid: str, rev: int | None = None) -> DataFrame:
    """One stored version, the newest by default."""
    x = versions.filter(F.col("tid") == tid)
    return x.filter(F.col("rev") == rev) if rev is not None else store.latest(x).select(*versions.columns)


def jsonl(events: DataFrame) -> DataFrame:
    """One line per event, minified; write it with write.text."""
    return events.select(event_json(F.col("event")).alias("value"))


def pretty(events: DataFrame) -> DataFrame:
    """One readable line per event."""
    w = F.col("event.why")
    return events.select(F.concat_ws("  ", F.rpad(F.upper(w["mat"]), 8, " "), F.format_string("%.2f", w["sal"]), F.rpad(w["cat"], 18, " "), F.col("event.src.tid"), w["summary"], F.concat(F.lit("-> "), F.col("event.followup.act"))).alias("value"))


def read_events(lines: DataFrame, schema: T.DataType) -> DataFrame:
    """Event JSON (column value) back to structs. Unknown keys are ignored; lines of another version or shape are dropped."""
    x = lines.select(F.from_json("value", schema).alias("event"))
    return x.filter((F.col("event.v") == VERSION) & F.col("event.id").isNotNull())


def json_schema(event: T.StructType) -> str:
    """The JSON Schema of the wire event, from its struct."""

    def of(t: T.DataType) -> dict:
        if isinstance(t, T.StructType):
            return {"type": "object", "additionalProperties": False, "properties": {f.name: of(f.dataType) for f in t.fields}}
        if isinstance(t, T.ArrayType):
            return {"type": "array", "items": of(t.elementType)}
        return {"type": {T.StringType: "string", T.BooleanType: "boolean"}.get(type(t), "integer" if isinstance(t, T.IntegralType) else "number")}

    out = of(event) | {"$schema": "https://json-schema.org/draft/2020-12/schema", "title": "change event"}
    out["required"] = [k for k in KEYS if k != "prov"]
    return json.dumps(out, ensure_ascii=False)


def init(path: str) -> None:
    """A first config file; an existing one stays."""
    with open(path, "x", encoding="utf-8") as f:
        f.write('[defaults]\nschedule = "15m"\nrender = "auto"\n')


def watch(path: str, url: str, tid: str | None = None) -> str:
    """Adds a target to the config file; returns its id."""
    with open(path, encoding="utf-8") as f:
        text = config.with_target(f.read(), url, tid)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return tid or config.slug(url)


def targets(spark: SparkSession, path: str) -> DataFrame:
    with open(path, encoding="utf-8") as f:
        return config.targets(spark, config.expanded(f.read()))
