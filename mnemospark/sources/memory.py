"""The memory model over the stored tables: one clean row per record.

Times are epoch seconds (double).  Nothing reads the clock: every operator takes the
time it is asked for, ``AS_OF`` in the registered queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemospark.functions import notation
from mnemospark.functions import vectors as V
from mnemospark.sources.tables import table

#: 2025-08-01 00:00 UTC, after the last activation of the stored anchors.
AS_OF = 1754006400.0

#: The fields of a state vector in their stored order, with defaults.
VECTOR = {
    "importance": 0.5, "frequency": 0.0, "recency": 1.0, "emotional_valence": 0.0, "stability": 0.0, "surprise": 0.5,
    "hippocampal_dependency": 1.0, "success_feedback": 0.5, "confidence": 0.5, "decay_rate": 0.01,
}


def state_vector(c: Column | str) -> dict[str, Column]:
    """The fields of a stored vector: lists of 10, or of 13 with novelty and task relevance merged in.

    Missing elements and unreadable lists take the defaults.
    """
    v = F.from_json(c, "array<double>")
    at = lambda i: F.try_element_at(v, F.lit(i + 1))
    out = {n: F.coalesce(at(i), F.lit(d)) for i, (n, d) in enumerate(VECTOR.items())}
    old = F.coalesce(F.size(v) >= 13, F.lit(False))
    out["surprise"] = F.when(old, F.greatest(out["surprise"], at(9))).otherwise(out["surprise"])
    out["importance"] = F.when(old, F.greatest(out["importance"], at(10))).otherwise(out["importance"])
    return out


def latest(df: DataFrame, by: Column, *order: str) -> DataFrame:
    """The last row of each key by the given columns, descending, nulls last."""
    w = W.partitionBy("_key").orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("_key", by).filter("_key is not null").withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def anchors(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each anchor id: its newest row, with the state vector and oscillator spelled out.

    Unknown states count as active, null texts as empty and missing replay counts as 0.
    """
    rows = latest(table(spark, folder, "anchors"), notation.key("id"), "loaded_at", "last_activated_at", "load_file", "state")
    number = lambda n, d: F.coalesce(F.get_json_object("oscillator_json", f"$.{n}").try_cast("double"), F.lit(d))
    return rows.select(
        F.col("_key").alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source_session", F.lit("")).alias("session"),
        notation.tags("tags_json").alias("tags"), notation.key("schema_ref").alias("schema_ref"),
        F.col("created_at"), F.col("last_activated_at").alias("last_at"), F.coalesce("replay_count", F.lit(0)).alias("replay_count"),
        F.coalesce(notation.state("state"), F.lit("active")).alias("state"), *[c.alias(n) for n, c in state_vector("vector_json").items()],
        number("natural_frequency", 0.5).alias("natural_frequency"), number("phase_offset", 0.0).alias("phase_offset"),
        number("coupling_strength", 0.3).alias("coupling_strength"), number("damping", 0.1).alias("damping"),
        F.get_json_object("prediction_json", "$.emotional_tone").try_cast("double").alias("predicted_tone"),
    )


def edges(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each edge_id: its newest row, ends as keys, the first relation name as type.

    Edges with a null or blank end and links to itself are left out; an edge without a
    readable type is topical.
    """
    rows = latest(table(spark, folder, "edges"), F.col("edge_id"), "loaded_at", "load_file", "weight")
    return rows.select(
        "edge_id", notation.key("source").alias("src"), notation.key("target").alias("dst"), "weight",
        F.coalesce(F.try_element_at(notation.edge_types("edge_type"), F.lit(1)), F.lit("topical")).alias("edge_type"),
        F.col("co_activation_count").alias("co_count"), "created_at", F.coalesce("last_activated_at", "created_at").alias("last_at"),
    ).filter("src is not null and dst is not null and src <> dst").withColumns({"lo": F.least("src", "dst"), "hi": F.greatest("src", "dst")})


def pairs(edges: DataFrame) -> DataFrame:
    """One edge for each unordered pair: the heaviest, ties to the lower edge_id; counts are summed."""
    best = F.max_by(F.struct("edge_type", "src", "dst", "edge_id"), F.struct("weight", -F.col("edge_id")))
    return edges.groupBy("lo", "hi").agg(
        best.alias("b"), F.max("weight").alias("weight"), F.sum("co_count").alias("co_count"), F.max("last_at").alias("last_at"),
        F.min("created_at").alias("created_at"), F.count("*").alias("n_edges"),
    ).select("lo", "hi", "b.edge_type", "weight", "co_count", "last_at", "created_at", "n_edges")


def both_ways(pairs: DataFrame) -> DataFrame:
    """Pairs from either end: node, other and the rest."""
    rest = [c for c in pairs.columns if c not in ("lo", "hi")]
    return pairs.select(F.col("lo").alias("node"), F.col("hi").alias("other"), *rest).unionByName(
        pairs.select(F.col("hi").alias("node"), F.col("lo").alias("other"), *rest)
    )


def ghosts(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each ghost id, the last pruned; missing importance is 0.5."""
    rows = latest(table(spark, folder, "ghosts"), notation.key("id"), "pruned_at", "original_importance")
    return rows.select(
        F.col("_key").alias("id"), notation.tags("original_tags_json").alias("tags"), "pruned_at", F.coalesce("revival_count", F.lit(0)).alias("revival_count"),
        F.coalesce("original_importance", F.lit(0.5)).alias("importance"), "residue_blob",
    )


def vectors(spark: SparkSession, folder: str, dimensions: int = 64) -> DataFrame:
    """(id, embedding) of the anchors whose blob holds exactly ``dimensions`` float32, all finite and not all zero.

    Of an id with several blobs the least counts.
    """
    blobs = table(spark, folder, "anchors").filter(F.octet_length("embedding_blob") == 4 * dimensions).groupBy(notation.key("id").alias("id")).agg(F.min("embedding_blob").alias("blob"))
    return blobs.filter("id is not null").select("id", V.floats("blob").alias("embedding")).filter(V.usable(F.col("embedding")))


def schemas(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each schema id, its newest: template, slots, instance ids, confidence, tags."""
    rows = latest(table(spark, folder, "schemas"), notation.key("id"), "loaded_at", "confidence", "template")
    return rows.select(
        F.col("_key").alias("id"), "template", "slots_json", notation.ids("instance_ids_json").alias("ids"), "confidence", "created_at", notation.tags("tags_json").alias("tags")
    )
