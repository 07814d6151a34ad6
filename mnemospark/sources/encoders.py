"""Vectors for rows that bring none: from texts by hashing or term weights, from images by shape and brightness."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.functions import text as T

#: Components of an image's vector: a difference hash, a histogram, mean and deviation.
IMAGE_PARTS = (64, 8, 1, 1)


def hashed(c: Column | str, dimensions: int = 64) -> Column:
    """A unit vector that depends on the text alone: components from SHA-256 of the text and the component's number.

    Equal texts have equal vectors, others are as good as random.  Null stays null.
    """
    text = F.col(c) if isinstance(c, str) else c
    part = lambda i: F.conv(F.substring(F.sha2(F.concat(text, F.lit(":"), i.cast("string")), 256), 1, 8), 16, 10).cast("double") / 2147483648.0 - 1.0
    raw = F.transform(F.sequence(F.lit(1), F.lit(dimensions)), part)
    return F.when(text.isNotNull(), _unit(raw))


def _unit(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(0.0))


def weighted_terms(docs: DataFrame, dimensions: int = 64) -> DataFrame:
    """(id, embedding): term frequency times inverse document frequency of (id, text), folded to a fixed length by a hash and scaled to one.

    Document frequencies are over all documents.  Texts without a token have a zero vector.
    """
    toks = docs.select("id", T.tokens(F.coalesce("text", F.lit(""))).alias("toks"))
    n = toks.count()
    each = toks.select("id", F.explode("toks").alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    df = each.groupBy("term").agg(F.count("*").alias("df"))
    slot = F.pmod(F.xxhash64("term"), F.lit(dimensions)).cast("int")
    sign = F.when(F.pmod(F.xxhash64("term", F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    weight = F.col("tf") * (F.log((n + 1) / (F.col("df") + 1)) + 1.0)
    cells = each.join(df, "term").select("id", slot.alias("slot"), (sign * weight).alias("w")).groupBy("id", "slot").agg(F.sum("w").alias("w"))
    maps = cells.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "w"))).alias("m"))
    vector = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0)))
    return toks.select("id").join(maps, "id", "left").select("id", _unit(F.when(F.col("m").isNull(), F.array_repeat(F.lit(0.0), dimensions)).otherwise(vector)).alias("embedding"))


def grey(data: bytes) -> np.ndarray | None:
    """The grey values of a binary PGM or PPM image as rows; None for anything else."""
    fields, at = [], 0
    while len(fields) < 4 and at < len(data):
        while at < len(data) and data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.find(b"\n", at) + 1 or len(data)
            continue
        end = at
        while end < len(data) and not data[end : end + 1].isspace():
            end += 1
        fields.append(data[at:end])
        at = end
    if len(fields) < 4 or fields[0] not in (b"P5", b"P6") or not all(f.isdigit() for f in fields[1:]):
        return None
    width, height, most = map(int, fields[1:])
    depth = 3 if fields[0] == b"P6" else 1
    body = data[at + 1 : at + 1 + width * height * depth]
    if not 0 < most < 256 or len(body) < width * height * depth or not width * height:
        return None
    values = np.frombuffer(body, np.uint8).reshape(height, width, depth).astype(np.float64)
    return (values @ np.array([0.299, 0.587, 0.114]) if depth == 3 else values[:, :, 0]) * 255.0 / most


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """The image in another size: each value is the mean of the part it stands for."""
    rows = np.linspace(0, image.shape[0], height + 1)
    cols = np.linspace(0, image.shape[1], width + 1)
    cut = lambda edges, i: slice(int(edges[i]), max(int(edges[i]) + 1, int(np.ceil(edges[i + 1]))))
    return np.array([[image[cut(rows, r), cut(cols, c)].mean() for c in range(width)] for r in range(height)])


def image_vector(data: bytes | None) -> list[float] | None:
    """The unit vector of an image: whether brightness rises to the right in an 8 by 8 grid, a histogram of eight bins, mean and deviation."""
    image = grey(bytes(data)) if data is not None else None
    if image is None:
        return None
    small, medium = resized(image, 8, 9), resized(image, 32, 32)
    bits = np.where(small[:, :-1] < small[:, 1:], 1.0, -1.0).ravel()
    bins = np.bincount(np.minimum(7, (medium // 32).astype(int)).ravel(), minlength=8) / medium.size
    v = np.concatenate([bits, bins, [medium.mean() / 255.0, min(1.0, medium.std() / 128.0)]])
    return (v / np.linalg.norm(v)).tolist()


def _image_vectors(contents: pd.Series) -> pd.Series:
    return contents.map(image_vector)


def image(c: Column | str) -> Column:
    """The vector of an image's bytes (the ``content`` of Spark's binaryFile source); null where it cannot be read."""
    return F.pandas_udf(_image_vectors, "array<double>")(c)
