"""Scores of an anchor at a given time, as Catalyst expressions over the columns of ``memory.anchors``."""

from __future__ import annotations

from collections.abc import Callable
from math import log

from pyspark.sql import Column
from pyspark.sql import functions as F

Survival = Callable[[Column, Column], Column]

_c = F.col


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


def hours(since: str | Column, as_of: float) -> Column:
    """Hours from a time to ``as_of``; never negative."""
    return F.greatest(F.lit(0.0), (F.lit(as_of) - (_c(since) if isinstance(since, str) else since)) / 3600.0)


# -- survival curves: hours and strength to the remaining share -------------


def ebbinghaus(least: float = 1.0, most: float = 336.0) -> Survival:
    """Exponential forgetting with a time constant between ``least`` and ``most`` hours."""
    return lambda t, s: F.exp(-t / (F.lit(least) + s * (most - least)))


def ebbinghaus_ghost(t: Column, s: Column, least: float = 1.0, most: float = 336.0) -> Column:
    """The faster curve of pruned memories."""
    return F.exp(-t / (F.lit(least * 0.2) + s * (most * 0.15)))


def power_law(alpha: float = 0.5, scale: float = 50.0) -> Survival:
    return lambda t, s: F.pow(1.0 + t / (F.lit(scale) * (0.2 + s * 1.8)), F.lit(-alpha))


def exponential(per_day: float = 0.05) -> Survival:
    return lambda t, s: F.exp(-(F.lit(per_day / 24.0) * (1.0 - s * 0.8)) * t)


def custom(curve: Survival) -> Survival:
    """A curve of the caller's, kept within 0 and 1."""
    return lambda t, s: clip(curve(t, s), 0.0, 1.0)


#: Curves by name; callers may add their own.
CURVES: dict[str, Survival] = {"ebbinghaus": ebbinghaus(), "power_law": power_law(), "exponential": exponential()}


def half_life(name: str, s: Column) -> Column:
    """Hours until half is left, for the built-in curves."""
    return {
        "ebbinghaus": (1.0 + s * 335.0) * log(2),
        "power_law": F.lit(50.0) * (0.2 + s * 1.8) * (2.0 ** (1.0 / 0.5) - 1.0),
        "exponential": F.lit(log(2)) / F.greatest(F.lit(0.0001), F.lit(0.05 / 24.0) * (1.0 - s * 0.8)),
    }[name]


def strength() -> Column:
    return _c("importance") * 0.30 + _c("stability") * 0.25 + F.abs("emotional_valence") * 0.20 + _c("frequency") * 0.15 + _c("confidence") * 0.10


# -- composite scores -------------------------------------------------------


def relevance() -> Column:
    return clip(_c("importance") * F.greatest(_c("success_feedback"), F.lit(0.01)) * (1.0 + F.abs("emotional_valence") * 0.2), 0.01, 1.0)


def importance_score() -> Column:
    return clip(_c("importance") * 0.5 + F.abs("emotional_valence") * 0.25 + _c("surprise") * 0.25, 0.01, 1.0)


def decay_factor(as_of: float, curve: Survival | None = None) -> Column:
    d = (curve or CURVES["ebbinghaus"])(hours("last_at", as_of), strength())
    return F.greatest(F.lit(0.01), d + (1.0 - d) * _c("stability") * 0.5)


#: What a lifecycle state does to the retention.
STATE_FACTOR = {"rehearsing": 1.3, "ghost": 0.3, "reactivated": 0.7}


def _by_state(of: dict[str, float], default: float) -> Column:
    out = None
    for k, v in of.items():
        out = F.when(_c("state") == k, v) if out is None else out.when(_c("state") == k, v)
    return out.otherwise(default)


def retention(as_of: float, curve: Survival | None = None, contradictions: Column | None = None) -> Column:
    """Geometric mean of five factors, times state, decay, importance bonus and contradiction penalty."""
    low = lambda c: F.greatest(F.lit(0.01), c)
    product = low(relevance()) * low(_c("recency")) * low(_c("frequency") + 0.01) * low(_c("success_feedback")) * low(_c("confidence"))
    score = F.pow(product, F.lit(0.2)) * _by_state(STATE_FACTOR, 1.0) * decay_factor(as_of, curve) * (1.0 + importance_score() * 0.3)
    if contradictions is not None:
        score = score * F.greatest(F.lit(0.1), 1.0 - contradictions * 0.15)
    return clip(score, 0.0, 1.0)


def confidence_score(as_of: float, sources: float = 1.0) -> Column:
    return clip(_c("confidence") * min(1.0, sources * 0.33) * F.exp(-hours("created_at", as_of) / 168.0), 0.01, 1.0)


#: Tags of memories that state a rule rather than an event.
ABSTRACT_TAGS = ("preference", "style", "rule", "pattern", "habit", "convention", "principle", "lesson", "knowledge", "architecture", "design")


def semantic_density() -> Column:
    base = (1.0 - _c("hippocampal_dependency")) * 0.6 + _c("stability") * 0.4
    n = F.size(F.array_intersect("tags", F.array(*map(F.lit, ABSTRACT_TAGS))))
    with_schema = F.when(_c("schema_ref").isNotNull(), F.greatest(base, F.lit(0.7))).otherwise(base)
    return clip(F.when(n > 0, F.greatest(with_schema, 0.5 + n * 0.1)).otherwise(with_schema), 0.0, 1.0)


#: Thermal level by lifecycle state, and what each level weighs, costs and is stored in.
THERMAL = {"active": "hot", "rehearsing": "hot", "consolidating": "warm", "dormant": "warm", "ghost": "dead", "reactivated": "hot"}
PRIORITY = {"hot": 1.0, "warm": 0.6, "cold": 0.2, "frozen": 0.05, "dead": 0.0}
COST = {"hot": 0.0, "warm": 0.3, "cold": 0.8, "frozen": 0.95, "dead": 1.0}
TIER = {"hot": "memory", "warm": "disk", "cold": "index", "frozen": "archive", "dead": "audit"}


def lookup(of: dict, key: Column, default=None) -> Column:
    """A small fixed table as an expression."""
    pairs = [x for k, v in of.items() for x in (F.lit(k), F.lit(v))]
    found = F.try_element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def thermal() -> Column:
    return lookup(THERMAL, _c("state"), "warm")


def thermal_from_retention(r: Column, as_of: float) -> Column:
    """The level of anchors whose state does not say it, from retention, frequency and idle time."""
    plastic = _c("state").isin("active", "rehearsing", "reactivated")
    return (
        F.when(plastic & (hours("last_at", as_of) < 24), "hot").when((r > 0.4) | (_c("frequency") > 0.1), "hot")
        .when(r > 0.15, "warm").when(r > 0.06, "cold").when(r > 0.01, "frozen").otherwise("dead")
    )


def activation_potential(as_of: float) -> Column:
    boost = F.exp(-hours("last_at", as_of) / 168.0) * (1.0 + F.least(F.lit(0.2), _c("frequency") * 0.2)) * (1.0 + F.abs("emotional_valence") * 0.15)
    return clip(retention(as_of) * boost * lookup(PRIORITY, thermal()), 0.0, 1.0)


#: The lifecycle's transitions, (state, event) to state.
TRANSITIONS = {
    ("active", "replay"): "rehearsing", ("active", "consolidate"): "consolidating", ("active", "prune"): "ghost",
    ("rehearsing", "consolidate"): "consolidating", ("rehearsing", "retrieve"): "active", ("consolidating", "stabilize"): "dormant",
    ("consolidating", "retrieve"): "active", ("dormant", "retrieve"): "active", ("dormant", "prune"): "ghost", ("dormant", "replay"): "rehearsing",
    ("ghost", "revive"): "reactivated", ("reactivated", "consolidate"): "consolidating", ("reactivated", "stabilize"): "dormant",
}


def transition(state: Column, event: Column) -> Column:
    """The next state; without a rule the state stays."""
    return F.coalesce(lookup({f"{s}/{e}": t for (s, e), t in TRANSITIONS.items()}, F.concat_ws("/", state, event)), state)


def decayed_recency(as_of: float) -> Column:
    """Recency after the time since the last activation; dormant and revived memories fade more slowly."""
    r = CURVES["ebbinghaus"](hours("last_at", as_of), strength())
    r = F.when(_c("state") == "ghost", r * 0.3).when(_c("state") == "dormant", r + (1.0 - r) * 0.3).when(_c("state") == "reactivated", r + (1.0 - r) * 0.15).otherwise(r)
    return F.greatest(F.lit(0.01), _c("recency") * r)


def is_retrievable() -> Column:
    return _c("state") != "ghost"
