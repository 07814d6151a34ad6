"""Scores of an edge at a given time, as Catalyst expressions over the columns of ``memory.edges``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemospark.functions.decay import clip, hours, lookup

# What a relation's type multiplies an edge's weight by when it is followed.
TRAVERSAL = {
    "causes": 1.5, "fixes": 1.4, "depends_on": 1.3, "contradicts": 0.5, "upgrades": 1.2, "summarizes": 1.1, "related_workflow": 1.2,
    "same_project": 1.2, "same_user_goal": 1.3, "superseded_by": 0.4, "invalidated_by": 0.3, "caused_by": 1.4, "derived_from": 1.2,
    "causal": 1.5, "temporal": 1.2, "topical": 1.0, "refines": 1.1, "generalizes": 1.0, "analogous_to": 0.9, "before": 1.0, "after": 1.0,
    "during": 1.1, "resolves": 1.3, "duplicates": 0.6, "conflicts_with": 0.7, "instance_of": 1.0, "bridge": 0.8, "transitive_closure": 0.7,
    "cross_domain": 1.3, "preference": 1.3, "task_flow": 1.4, "ownership": 1.1,
}
# Relations that explain an edge, those that do not although allowed, and the strong ones.
EXPLICABLE = (
    "causes", "fixes", "depends_on", "contradicts", "upgrades", "summarizes", "related_workflow", "same_project", "same_user_goal",
    "superseded_by", "invalidated_by", "caused_by", "derived_from", "causal", "temporal", "topical", "refines", "generalizes",
    "analogous_to", "before", "after", "during", "resolves", "duplicates", "conflicts_with",
)
LEGACY = ("topical", "semantic", "similar", "related")
STRONG = (
    "causes", "fixes", "depends_on", "contradicts", "upgrades", "superseded_by", "invalidated_by", "caused_by", "derived_from",
    "resolves", "conflicts_with", "duplicates",
)
# How long a type is worth keeping (of 10), how fast it fades (an hour), how long use extends it (hours).
PRIORITY = {
    "causes": 10, "causal": 10, "fixes": 9, "resolves": 9, "depends_on": 8, "derived_from": 8, "invalidated_by": 7, "supersedes": 7,
    "compresses": 6, "summarizes": 6, "before": 5, "after": 5, "preference": 4, "topical": 3, "related": 2, "contradicts": 1,
}
FADE = {
    "causes": 0.0003, "fixes": 0.0003, "resolves": 0.0003, "depends_on": 0.0005, "derived_from": 0.0005, "invalidated_by": 0.0005,
    "supersedes": 0.0005, "compresses": 0.001, "summarizes": 0.001, "before": 0.002, "after": 0.002, "topical": 0.005,
    "preference": 0.003, "related": 0.008, "contradicts": 0.004,
}
EXTEND = {"causes": 720.0, "fixes": 720.0, "depends_on": 360.0, "topical": 24.0, "related": 12.0}

LEAST_WEIGHT = 0.02

_c = F.col


def traversal_weight(weight: Column | None = None) -> Column:
    return (_c("weight") if weight is None else weight) * lookup(TRAVERSAL, _c("edge_type"), 1.0)


def gated_weight(weight: Column | None = None) -> Column:
    """The weight an implicit edge is admitted with: unexplained relations are damped, strong ones boosted."""
    w = _c("weight") if weight is None else weight
    t = _c("edge_type")
    damped = F.when(~t.isin(*EXPLICABLE) | t.isin(*LEGACY), F.greatest(F.lit(0.02), w * 0.3)).otherwise(w)
    return F.when(t.isin(*STRONG), F.least(F.lit(1.0), damped * 1.1)).when(~t.isin(*EXPLICABLE), F.greatest(F.lit(0.05), damped * 0.5)).otherwise(damped)


def valid_until() -> Column:
    """End of validity: 90 days after creation for strong relations, 14 for others."""
    return _c("created_at") + F.when(_c("edge_type").isin(*STRONG), 90.0 * 86400).otherwise(14.0 * 86400)


def is_expired(as_of: float) -> Column:
    return valid_until() < as_of


def retrieval_score(as_of: float, confidence: float = 0.5) -> Column:
    """Weight with bonuses for confidence, recent use and confirmation; less for superseded knowledge."""
    penalty = F.when(_c("edge_type").isin("superseded_by", "invalidated_by", "contradicts"), 0.4).otherwise(1.0)
    confirmed = F.least(F.lit(1.0), _c("co_count") * 0.2)
    ordered = F.when(_c("edge_type").isin("before", "after", "during"), 0.05).otherwise(0.0)
    score = penalty * (_c("weight") + 0.2 * confidence + 0.1 * F.exp(-hours("last_at", as_of) / 168.0) + 0.15 * confirmed + ordered)
    return F.when(is_expired(as_of), 0.0).otherwise(clip(score, 0.0, 1.5))


def keep_score(as_of: float) -> Column:
    """Worth of an edge when a node has too many: type, weight, last use and activity."""
    recent = F.exp(-hours("last_at", as_of) / 720.0)
    return lookup(PRIORITY, _c("edge_type"), 2).cast("double") / 10.0 * 0.4 + _c("weight") * 0.3 + recent * 0.15 + F.least(F.lit(1.0), _c("co_count") / 10.0) * 0.15


def faded_weight(as_of: float) -> Column:
    """Weight after the idle time at the type's rate, not below the least weight."""
    return F.greatest(F.lit(LEAST_WEIGHT), _c("weight") * F.exp(-lookup(FADE, _c("edge_type"), 0.005) * hours("last_at", as_of)))


def hebbian_weight(as_of: float) -> Column:
    """Edges used within a day grow, others shrink with the logarithm of their idle time."""
    h = hours("last_at", as_of)
    grown = F.least(F.lit(1.0), _c("weight") + 0.03)
    shrunk = F.greatest(F.lit(0.0), _c("weight") - F.least(F.lit(0.1), F.log(1.0 + h / 24.0) * 0.02))
    return F.when((_c("co_count") > 0) & (h < 24), grown).otherwise(shrunk)
