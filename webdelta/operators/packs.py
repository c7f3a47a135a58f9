"""Scoring rules as data: bands, type weights, keyword rules, category rows; TOML files that extend each other."""

from __future__ import annotations

import hashlib
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

FOLDER = Path(__file__).parent.parent / "plans" / "packs"
#: The default type weights, band floors and actions of bands, and what actions cost, cheapest first.
TYPE_WEIGHT = {"price": 1.0, "date": 0.85, "number": 0.85, "heading": 0.8, "table_row": 0.75, "table": 0.75, "code": 0.7, "list_item": 0.55, "link": 0.5, "paragraph": 0.45, "text": 0.2}
BANDS = {"critical": 0.90, "high": 0.70, "medium": 0.40, "low": 0.15}
BAND_ACTION = {"none": "ignore", "low": "notify", "medium": "notify", "high": "re_run_downstream", "critical": "escalate_human"}
ACTION_COST = ["ignore", "notify", "refetch_linked", "fetch_detail", "re_run_downstream", "open_ticket", "escalate_human", "page_oncall"]
SIGNALS = ["type", "mag", "num", "date", "neg", "pos", "kw"]


@dataclass
class Pack:
    id: str = "default"
    bands: dict = field(default_factory=lambda: dict(BANDS))
    band_action: dict = field(default_factory=lambda: dict(BAND_ACTION))
    type_weight: dict = field(default_factory=lambda: dict(TYPE_WEIGHT))
    signals: dict = field(default_factory=lambda: dict.fromkeys(SIGNALS, 1.0))
    rules: list = field(default_factory=list)  # id, match, weight, action, sticky, cat
    cats: dict = field(default_factory=dict)  # cat -> action

    def stamp(self) -> str:
        text = repr((self.bands, self.band_action, self.type_weight, self.signals, self.rules, sorted(self.cats.items())))
        return f"{self.id}@sha:{hashlib.sha256(text.encode()).hexdigest()[:4]}"


def layered(base: Pack, text: str) -> Pack:
    """base under a TOML pack: the pack's scalars win, its rules follow the base's, category rows are replaced by name."""
    t = tomllib.loads(text)
    p = Pack(t.get("id", base.id), base.bands | t.get("bands", {}), base.band_action | t.get("band_action", {}), base.type_weight | t.get("block_type_weight", {}), base.signals | t.get("signals", {}), list(base.rules), dict(base.cats))
    for r in t.get("rule", []):
        if "match" in r:
            p.rules.append({"id": r.get("id", ""), "match": r["match"], "weight": float(r.get("weight", 1.0)), "action": r.get("action"), "sticky": bool(r.get("sticky", False)), "cat": r.get("cat")})
        elif "cat" in r:
            p.cats[r["cat"]] = r["act"]
    return p


def load(archetype: str | None = None) -> Pack:
    """A shipped pack over the default one; unknown archetypes are the default."""
    base = layered(Pack(), (FOLDER / "default.toml").read_text())
    path = FOLDER / f"{archetype}.toml"
    return layered(base, path.read_text()) if archetype and archetype != "default" and path.is_file() else base
