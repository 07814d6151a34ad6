"""A memory store behind one object: remember, update, forget, connect, recall, consolidate.

Every change is a batch and makes a new version of the tables, so it may be rolled back.
Times are given by the caller.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions import decay, links
from mnemospark.functions import text as T
from mnemospark.sources import memory
from mnemospark.sources.snapshots import SnapshotStore, deleted, upserted
from mnemospark.store import Scratch

ANCHORS = (
    "id string, text string, session string, tags array<string>, schema_ref string, created_at double, last_at double, replay_count bigint, state string, "
    + ", ".join(f"{n} double" for n in memory.VECTOR)
    + ", natural_frequency double, phase_offset double, coupling_strength double, damping double"
)
PAIRS = "lo string, hi string, edge_type string, weight double, co_count bigint, last_at double, created_at double, n_edges bigint"
GHOSTS = "id string, tags array<string>, pruned_at double, revival_count int, importance double, residual map<string,double>"

#: What an item may say besides its text, with defaults.
ITEM = {"session": "", "tags": [], "importance": 0.5, "emotional_valence": 0.0, "surprise": 0.5}


@dataclass
class MemoryManager:
    """The tables anchors, pairs and ghosts of a store and the operations on them."""

    spark: SparkSession
    root: str

    def __post_init__(self) -> None:
        self.store = SnapshotStore(self.spark, self.root)
        if not self.store.versions():
            self.store.save({"anchors": self.spark.createDataFrame([], ANCHORS), "pairs": self.spark.createDataFrame([], PAIRS), "ghosts": self.spark.createDataFrame([], GHOSTS)})

    def anchors(self) -> DataFrame:
        return self.store.load("anchors")

    def pairs(self) -> DataFrame:
        return self.store.load("pairs")

    def ghosts(self) -> DataFrame:
        return self.store.load("ghosts")

    def _save(self, anchors: DataFrame | None = None, pairs: DataFrame | None = None, ghosts: DataFrame | None = None) -> int:
        return self.store.save({"anchors": anchors if anchors is not None else self.anchors(), "pairs": pairs if pairs is not None else self.pairs(), "ghosts": ghosts if ghosts is not None else self.ghosts()})

    def created(self, items: DataFrame, at: float) -> DataFrame:
        """Items (text, session, tags, importance, emotional_valence, surprise) as anchors.

        The id is a hash of text and session; texts are clipped to 280 characters; of
        items with one id the most important counts.
        """
        c = F.col
        frequency = decay.clip(0.3 + 0.4 * c("importance") + 0.2 * F.abs("emotional_valence"), 0.1, 1.0)
        new = {
            "id": F.substring(F.sha2(F.concat("text", "session"), 256), 1, 16), "text": F.substring("text", 1, 280), "schema_ref": F.lit(None).cast("string"),
            "created_at": F.lit(at), "last_at": F.lit(at), "replay_count": F.lit(0).cast("bigint"), "state": F.lit("active"),
            **{n: F.lit(d) for n, d in memory.VECTOR.items() if n not in ITEM}, "natural_frequency": frequency, "phase_offset": F.lit(0.0),
            "coupling_strength": F.least(F.lit(1.0), 0.25 + 0.15 * F.abs("emotional_valence")), "damping": F.lit(0.1),
        }
        names = [f.name for f in self.anchors().schema]
        made = items.filter("text is not null and trim(text) <> ''").withColumns(new).select(*names)
        return memory.latest(made, c("id"), "importance").select(*names)

    def remember(self, items: DataFrame | Iterable[Mapping[str, Any]], at: float, gate: bool = False) -> int:
        """Stores items; known ones are activated instead.  With ``gate`` only what the write gate accepts."""
        if not isinstance(items, DataFrame):
            rows = [(i["text"], *[i.get(k, d) for k, d in ITEM.items()]) for i in items]
            items = self.spark.createDataFrame(rows, "text string, session string, tags array<string>, importance double, emotional_valence double, surprise double")
        if gate:
            items = items.filter(T.gate(F.col("text"), F.col("importance"), F.col("emotional_valence"), F.col("tags")).startswith("accept"))
        new = self.created(items, at)
        old = self.anchors()
        known = old.join(new.select("id"), "id", "left_semi").withColumns({
            "last_at": F.lit(at), "frequency": F.least(F.lit(1.0), F.col("frequency") + 0.05), "recency": F.lit(1.0),
        })
        fresh = new.join(old.select("id"), "id", "left_anti")
        return self._save(anchors=upserted(old, known.select(*old.columns).unionByName(fresh.select(*old.columns)), "id"))

    def update(self, changes: DataFrame, at: float) -> int:
        """Applies changes (id, text, tags): a text that is not null replaces, tags are added."""
        old = self.anchors()
        j = old.join(changes.toDF("id", "new_text", "new_tags"), "id")
        done = j.withColumns({"text": F.coalesce(F.substring("new_text", 1, 280), "text"), "tags": F.array_sort(F.array_union("tags", F.coalesce("new_tags", F.array().cast("array<string>")))), "last_at": F.lit(at)})
        return self._save(anchors=upserted(old, done.select(*old.columns), "id"))

    def forget(self, ids: DataFrame, at: float) -> int:
        """Removes anchors (id) and their edges; each leaves a ghost with three tenths of its edges' weights."""
        a, p = self.anchors(), self.pairs()
        gone = a.join(ids.select("id").distinct(), "id", "left_semi")
        residual = memory.both_ways(p).join(gone.select(F.col("id").alias("node")), "node").groupBy(F.col("node").alias("id")).agg(
            F.map_from_entries(F.collect_list(F.struct("other", F.col("weight") * 0.3))).alias("residual")
        )
        traces = gone.join(residual, "id", "left").select("id", "tags", F.lit(at).alias("pruned_at"), F.lit(0).alias("revival_count"), "importance", "residual")
        left = p.join(gone.select(F.col("id").alias("lo")), "lo", "left_anti").join(gone.select(F.col("id").alias("hi")), "hi", "left_anti")
        return self._save(anchors=deleted(a, ids, "id"), pairs=left.select(*p.columns), ghosts=upserted(self.ghosts(), traces, "id"))

    def revive(self, ids: DataFrame, texts: DataFrame, at: float) -> int:
        """Brings ghosts (id) back as anchors with a text (id, text), reactivated and less stable."""
        g = self.ghosts().join(ids.select("id").distinct(), "id", "left_semi").join(texts.select("id", "text"), "id")
        rows = g.withColumns({n: F.lit(v) for n, v in ITEM.items() if n in ("session", "emotional_valence")} | {"surprise": F.lit(0.7)})
        back = self.created(rows.withColumn("session", F.lit("revived")).drop("id"), at).drop("id")
        named = back.join(g.select("id", F.substring("text", 1, 280).alias("text")), "text").withColumn("state", F.lit("reactivated"))
        a = self.anchors()
        return self._save(anchors=upserted(a, named.select(*a.columns), "id"), ghosts=deleted(self.ghosts(), ids, "id"))

    def connect(self, edges: DataFrame, at: float) -> int:
        """Adds edges (src, dst, weight, edge_type) between known anchors by the edge gate; known pairs grow by 0.05."""
        ids = self.anchors().select("id")
        known = edges.join(ids.toDF("src"), "src", "left_semi").join(ids.toDF("dst"), "dst", "left_semi").filter("src <> dst")
        gated = known.select(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"), "edge_type", links.gated_weight().alias("w"))
        new = gated.groupBy("lo", "hi").agg(F.max_by("edge_type", "w").alias("t"), F.max("w").alias("w"), F.count("*").alias("n"))
        p = self.pairs()
        j = p.join(new, ["lo", "hi"], "full")
        grown = F.when(F.col("weight").isNull(), F.least(F.lit(1.0), F.col("w") + 0.05 * (F.col("n") - 1))).otherwise(F.least(F.lit(1.0), F.col("weight") + 0.05 * F.coalesce("n", F.lit(0))))
        touched = F.col("n").isNotNull()
        rows = j.select(
            "lo", "hi", F.coalesce("edge_type", "t").alias("edge_type"), grown.alias("weight"), (F.coalesce("co_count", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("co_count"),
            F.when(touched, F.lit(at)).otherwise(F.col("last_at")).alias("last_at"), F.coalesce("created_at", F.lit(at)).alias("created_at"), (F.coalesce("n_edges", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("n_edges"),
        )
        return self._save(pairs=rows)

    def recall(self, text: str, k: int = 24) -> DataFrame:
        """What several paths recall for a text: (id, path, score, rank)."""
        from mnemospark.plans.pipelines import recall

        return recall(self.anchors(), memory.both_ways(self.pairs()), text, k)

    def consolidate(self) -> dict[str, int]:
        """One cycle of consolidation; returns its counts."""
        from mnemospark.plans.pipelines import consolidate

        a, p = self.anchors(), self.pairs()
        kept, left, traces, report = consolidate(a, p, Scratch(self.spark, "consolidate"))
        ghosts = traces.withColumn("residual", F.lit(None).cast("map<string,double>")).select("id", "tags", "pruned_at", "revival_count", "importance", "residual")
        self._save(anchors=kept.select(*a.columns), pairs=left.select(*p.columns), ghosts=upserted(self.ghosts(), ghosts, "id"))
        return dict(report)

    def stats(self, as_of: float) -> dict[str, Any]:
        """Numbers of anchors, edges and ghosts, and mean retention."""
        a = self.anchors().agg(F.count("*").alias("anchors"), F.avg(decay.retention(as_of)).alias("mean_retention")).first().asDict()
        return a | {"edges": self.pairs().count(), "ghosts": self.ghosts().count(), "version": self.store.versions()[-1]}
