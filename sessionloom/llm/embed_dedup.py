"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

Equal vectors collapse first.  The rest of a label is dealt into tiles; each pair of
tiles is one row of work.  Unit vectors are quantised to int8 with a scale and the exact
norm of the error, so a product of quantised tiles bounds every cosine from above; only
pairs whose bound reaches the threshold are computed again in double precision.  A tile
pair gives each vector's number of links and a spanning forest of them, never the pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import ship, staged
from sessionloom.llm.components import connected_components
from sessionloom.llm.vectors import is_valid, matrix

THRESHOLD = 0.98
#: Bytes of a tile's vectors, on average, and its least number of vectors.  Every tile goes
#: to all tiles of its label, so what is shuffled falls with their size.
TILE_BYTES, TILE = 1 << 20, 1024
#: Rows and columns of the products that are computed at once.
_PRODUCT = 1024
#: Candidate pairs that are computed in double precision at once.
_EXACT = 100_000


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, scales and error norms of the unit vectors of ``x``."""
    unit = x.astype(np.float64)
    unit /= np.abs(unit).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    return q, scale, np.linalg.norm(unit - q * scale[:, None], axis=1)


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    x, y = x.astype(np.float64), y.astype(np.float64)
    x, y = x / np.abs(x).max(axis=1, keepdims=True), y / np.abs(y).max(axis=1, keepdims=True)
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


def tile_links(x: np.ndarray, y: np.ndarray, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (into x, into y) of the pairs at the threshold; with ``same``, x is y
    and each pair counts once."""
    qx, sx, ex = quantised(x)
    qy, sy, ey = (qx, sx, ex) if same else quantised(y)
    # Products of int8 rows are whole numbers that float32 holds exactly up to 2 ** 24.
    kind = np.float32 if x.shape[1] * 127 * 127 < 1 << 24 else np.float64
    near = (qx.astype(kind) @ qy.astype(kind).T).astype(np.float64) * sx[:, None] * sy[None, :]
    # |u.v - p.q| <= |p| |v - q| + |u - p| |v|, with |p| <= 1 + |u - p| and |v| = 1.
    near += (1 + ex)[:, None] * ey[None, :] + ex[:, None] + 1e-9
    found = np.nonzero(near >= threshold)
    if same:
        once = found[0] < found[1]
        found = found[0][once], found[1][once]
    kept = [np.zeros((2, 0), np.int64)]
    for at in range(0, len(found[0]), _EXACT):
        i, j = found[0][at : at + _EXACT], found[1][at : at + _EXACT]
        ok = cosine(x[i], y[j]) >= threshold
        kept.append(np.stack([i[ok], j[ok]]))
    return tuple(np.concatenate(kept, axis=1))


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest vertex reachable from each of n vertices."""
    label = np.arange(n)
    while True:
        before = label.copy()
        least = np.minimum(label[i], label[j])
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        label = label[label]
        if (label == before).all():
            return label


def _links_in_parts(x: np.ndarray, y: np.ndarray, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """``tile_links`` of large tiles, some rows and columns at a time."""
    found = [np.zeros((2, 0), np.int64)]
    for i in range(0, len(x), _PRODUCT):
        for j in range(i if same else 0, len(y), _PRODUCT):
            a, b = tile_links(x[i : i + _PRODUCT], y[j : j + _PRODUCT], same and i == j, threshold)
            found.append(np.stack([a + i, b + j]))
    return tuple(np.concatenate(found, axis=1))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile: int | None = None) -> DataFrame:
    """One row ``(vec_id, n_links, component_id, kept)`` for each row of
    ``vectors(vec_id, embedding, label)``.

    Only vectors of one label (not null) and one length link, at a cosine of ``threshold``
    or more in double precision.  Vectors that are null, empty, zero or hold null or
    non-finite components, and rows without a vec_id, link with nothing and are their
    own component (null without an id, and not kept).  Equal rows are links of each other.
    ``tile`` sets the vectors of a tile.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding").cast("array<float>").alias("embedding"))
    part = is_valid(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = staged(rows.withColumn("part", part), "vectors")
    single = rows.where("part").groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    single = staged(single.withColumn("dim", F.size("embedding")), "distinct-vectors")
    size = F.lit(tile) if tile else F.greatest(F.lit(TILE), F.lit(TILE_BYTES) / (4 * F.col("dim")))
    groups = single.groupBy("label", "dim").agg(F.ceil(F.count("*") / size).cast("int").alias("tiles"))
    dealt = single.join(groups, ["label", "dim"]).withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    tiles = dealt.groupBy("label", "dim", "tiles", "tile").agg(F.collect_list(F.struct("rep", "copies", "embedding")).alias("rows"))
    tiles = staged(tiles.select("label", "dim", "tiles", "tile", F.col("rows.rep").alias("rep"), F.col("rows.copies").alias("copies"), F.flatten("rows.embedding").alias("flat")), "tiles")

    key = ["label", "dim", "i", "j"]
    left = tiles.select("label", "dim", F.col("tile").alias("i"), F.explode(F.sequence("tile", F.col("tiles") - 1)).alias("j"), *[F.col(c).alias(f"{c}_i") for c in ("rep", "copies", "flat")])
    right = tiles.select("label", "dim", F.explode(F.sequence(F.lit(0), "tile")).alias("i"), F.col("tile").alias("j"), *[F.col(c).alias(f"{c}_j") for c in ("rep", "copies", "flat")])

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                dim, i, j = (b.column(k)[r].as_py() for k in range(3))
                ids, copies, flat = ([b.column(k)[r].values.to_numpy(zero_copy_only=False) for k in (at, at + 3)] for at in (3, 4, 5))
                x, y = (f.reshape(-1, dim) for f in flat)
                a, c = _links_in_parts(x, y, i == j, threshold)
                if not len(a):
                    continue
                both = np.concatenate(ids)
                other = c if i == j else c + len(ids[0])
                links = np.zeros(len(both), np.int64)
                np.add.at(links, a, copies[1][c])
                np.add.at(links, other, copies[0][a])
                to = both.copy()
                label = forest(len(both), a, other)
                least = np.full(len(both), np.iinfo(np.int64).max)
                np.minimum.at(least, label, both)
                to = least[label]
                seen = links > 0
                yield pa.record_batch([pa.array(both[seen]), pa.array(links[seen]), pa.array(to[seen])], ["rep", "links", "to"])

    pairs = left.join(right, key).select("dim", "i", "j", "rep_i", "copies_i", "flat_i", "rep_j", "copies_j", "flat_j")
    found = staged(pairs.mapInArrow(_one_by_one(run), "rep long, links long, to long"), "tile-links")
    parts = connected_components(found.select(F.col("rep").alias("u"), F.col("to").alias("v")))
    degrees = found.groupBy("rep").agg(F.sum("links").alias("links"))
    known = single.select("label", "embedding", "rep", "copies").join(degrees, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    known = staged(
        known.select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("component"), F.lit(True).alias("part")), "vector-groups"
    )
    out = rows.join(known, ["label", "embedding", "part"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))


def _one_by_one(run):
    """Rows of large arrays: no more than a few at a time."""

    def sliced(batches):
        for b in batches:
            yield from run(b.slice(at, 1) for at in range(b.num_rows))

    return sliced
