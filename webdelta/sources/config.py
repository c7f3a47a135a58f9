"""Targets from TOML: defaults, environment expansion, durations, ad-hoc targets, writers."""

from __future__ import annotations

import os
import re
import tomllib

from pyspark.sql import DataFrame, SparkSession

TARGETS = "id string, url string, schedule_s long, archetype string, selects array<string>, ignores array<string>, types map<string,string>, strategy string, root_selector string, render string"
UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400}


def seconds(text: str) -> int:
    """'90s', '15m', '6h', '1d' or a bare number of seconds."""
    m = re.fullmatch(r"\s*(\d+)\s*([smhd]?)\s*", text)
    if not m:
        raise ValueError(f"bad duration: {text!r}")
    return int(m[1]) * UNITS.get(m[2], 1)


def expanded(text: str, env: dict[str, str] | None = None) -> str:
    """${NAME} by the environment, empty if unknown; $$ is $; an unclosed ${ stays."""
    env = os.environ if env is None else env
    return re.sub(r"\$\$|\$\{([^}]*)\}", lambda m: "$" if m[0] == "$$" else env.get(m[1], ""), text)


def secrets(path: str, env: dict[str, str] | None = None) -> dict[str, str]:
    """NAME=value lines under the environment, which wins."""
    out = {}
    with open(path, encoding="utf-8") as f:
        for line in f:
            k, sep, v = line.strip().partition("=")
            if sep and not k.startswith("#"):
                out[k.strip()] = v.strip().strip("\"'")
    return out | dict(os.environ if env is None else env)


def slug(url: str) -> str:
    return re.sub(r"[^a-z0-9]+", "-", re.sub(r"^https?://", "", url.lower())).strip("-") or "target"


def parsed(text: str) -> list[dict]:
    """Targets of a TOML text, over its [defaults]. ValueError if an id appears twice."""
    t = tomllib.loads(text)
    base, out, seen = t.get("defaults", {}), [], set()
    for x in t.get("target", []):
        x = base | x
        tid = x.get("id") or slug(x["url"])
        if tid in seen:
            raise ValueError(f"duplicate target id: {tid}")
        seen.add(tid)
        as_list = lambda v: [v] if isinstance(v, str) else list(v or [])
        selects = as_list(x.get("select"))
        strategy = x.get("strategy") or ("selector" if selects or x.get("root_selector") else "readability")
        out.append({"id": tid, "url": x["url"], "schedule_s": seconds(str(x.get("schedule", "15m"))), "archetype": x.get("archetype", "default"), "selects": selects, "ignores": as_list(x.get("ignore")), "types": dict(x.get("types", {})), "strategy": strategy, "root_selector": x.get("root_selector") or ", ".join(selects) or None, "render": x.get("render", "auto")})
    return out


def targets(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([tuple(t.values()) for t in parsed(text)], TARGETS)


def ad_hoc(url: str) -> dict:
    return parsed(f'[[target]]\nurl = "{url}"\n')[0]


def with_target(text: str, url: str, tid: str | None = None) -> str:
    """The TOML text with one more target."""
    new = f'\n[[target]]\nid = "{tid or slug(url)}"\nurl = "{url}"\n'
    parsed(text + new)
    return text.rstrip("\n") + "\n" + new
