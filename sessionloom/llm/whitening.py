"""Whitening of embeddings by a tiled covariance.

Vectors become whole numbers, and each distinct one counts once.  The distinct vectors
are cut into blocks of rows, and each block into column blocks of ``TILE`` dimensions.
Column blocks of one row block meet by a join on the row block, a pair for each tile of
the upper half of the covariance; tasks multiply the pairs, sum what falls on the same
tile, and the tiles' sums meet by tile.  Only sums, tiles and components, whose size
depends on the number of dimensions alone, come to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import ship, staged, unstage

#: Dimensions of a tile's side, entries of a row block at most, and components given out.
TILE, ENTRIES, COMPONENTS = 32, 1 << 18, 16
SCALE, SHIFT = 64.0, 1_000_000


@dataclass
class Whitening:
    """What the fit gives: count and sums, components by row, their eigenvalues, trace."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """``(vec_id, x)`` of the rows whose vector is neither null nor empty and holds neither
    nulls nor numbers that aren't finite.  Where lengths differ, the most frequent one
    stays, the longer one of two as frequent.  Entries beyond 2^44 / ``SCALE`` count as that."""
    e = F.col("embedding")
    finite = F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.where(e.isNotNull() & (F.size(e) > 0)).where(finite)
    common = rows.groupBy(F.size(e).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, x array<long>")
    most = float(1 << 44)
    x = F.transform(e, lambda c: F.floor(F.least(F.greatest(c.cast("double") * SCALE, F.lit(-most)), F.lit(most))) + F.lit(SHIFT).cast("long"))
    return rows.where(F.size(e) == common["d"]).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _packed(y: np.ndarray) -> tuple[str, bytes]:
    """The smallest whole numbers that hold a block less the common shift."""
    most = max(-int(y.min(initial=0)), int(y.max(initial=0)))
    kind = "i1" if most < 2**7 else "i2" if most < 2**15 else "i4" if most < 2**31 else "i8"
    return kind, y.astype(kind).tobytes()


def _unpacked(kind: str, payload: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(payload, kind).astype(np.int64).reshape(rows, -1)


def column_blocks(distinct: DataFrame) -> DataFrame:
    """``x`` -> ``(row_block, col, rows, kind, payload, sums)``: the block of each row block
    that starts at each multiple of ``TILE``."""

    def cut(batches):
        task, serial = TaskContext.get().partitionId(), 0
        for b in batches:
            x = _matrix(b.column(0)) if b.num_rows else np.zeros((0, 1), np.int64)
            step = max(1, ENTRIES // x.shape[1])
            for at in range(0, len(x), step):
                y = x[at : at + step] - SHIFT
                out = []
                for c in range(0, y.shape[1], TILE):
                    part = y[:, c : c + TILE]
                    out.append(((task << 32) + serial, c, len(part), *_packed(part), part.sum(axis=0).tolist()))
                serial += 1
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*out, strict=True)], schema=_BLOCK)

    return distinct.select("x").mapInArrow(cut, "row_block long, col int, rows long, kind string, payload binary, sums array<long>")


_BLOCK = pa.schema([("row_block", pa.int64()), ("col", pa.int32()), ("rows", pa.int64()), ("kind", pa.string()), ("payload", pa.binary()), ("sums", pa.list_(pa.int64()))])
_TILE = pa.schema([("row", pa.int32()), ("col", pa.int32()), ("payload", pa.binary())])


def _emitted(tiles: dict) -> pa.RecordBatch:
    rows = [(*at, t.tobytes()) for at, t in sorted(tiles.items())]
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True) if rows else ([], [], []), _TILE, strict=True)], schema=_TILE)


def tiled_products(blocks: DataFrame, middle: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """Sums over all rows of products of entries less ``middle``, by tile of the upper half.

    Whole numbers are multiplied as doubles, which is exact up to 2^53 and as good as
    doubles are beyond it."""
    ship(blocks.sparkSession)
    held = blocks.sparkSession.sparkContext.broadcast(middle)
    a, b = blocks.select("row_block", "col", "rows", "kind", "payload"), blocks.select("row_block", F.col("col").alias("col_b"), F.col("kind").alias("kind_b"), F.col("payload").alias("payload_b"))
    pairs = a.join(b, "row_block").where("col <= col_b")

    def multiply(batches):
        tiles: dict = {}
        for batch in batches:
            for r in batch.to_pylist():
                left = _unpacked(r["kind"], r["payload"], r["rows"])
                right = _unpacked(r["kind_b"], r["payload_b"], r["rows"])
                left = (left - held.value[r["col"] : r["col"] + left.shape[1]]).astype(np.float64)
                right = (right - held.value[r["col_b"] : r["col_b"] + right.shape[1]]).astype(np.float64)
                at = (r["col"], r["col_b"])
                tiles[at] = tiles.get(at, 0.0) + left.T @ right
        yield _emitted(tiles)

    def add(batches):
        tiles: dict = {}
        for batch in batches:
            for r in batch.to_pylist():
                at = (r["row"], r["col"])
                tiles[at] = tiles.get(at, 0.0) + np.frombuffer(r["payload"], np.float64)
        yield _emitted(tiles)

    shape = "row int, col int, payload binary"
    # A task's sums by tile first, then all tasks' by a few lots of a tile, then by tile.
    part = pairs.mapInArrow(multiply, shape).repartition(F.col("row"), F.col("col"), F.pmod(F.spark_partition_id(), F.lit(16))).mapInArrow(add, shape)
    found = part.repartition("row", "col").mapInArrow(add, shape).collect()
    out: dict = {}
    for r in found:
        out[r["row"], r["col"]] = out.get((r["row"], r["col"]), 0.0) + np.frombuffer(r["payload"], np.float64)
    return out


def _merged(a, b):
    """Count, mean and centred products of two lots together."""
    (n, mean, m2), (k, other, p2) = a, b
    if not n or not k:
        return a if n else b
    delta = other - mean
    return n + k, mean + delta * (k / (n + k)), m2 + p2 + np.outer(delta, delta) * (n * k / (n + k))


def identity_error(blocks: DataFrame, w: Whitening) -> float:
    """The largest entry, but for its sign, of the whitened fit list's covariance less the
    identity.  Lots are centred on their own means before they are multiplied."""
    ship(blocks.sparkSession)
    held = blocks.sparkSession.sparkContext.broadcast((w.components, w.values, w.sums / w.n - SHIFT))
    whole = blocks.groupBy("row_block").agg(F.first("rows").alias("rows"), F.sort_array(F.collect_list(F.struct("col", "kind", "payload"))).alias("parts"))

    def moments(batches):
        components, values, mean = held.value
        total = (0, np.zeros(len(values)), np.zeros((len(values), len(values))))
        for b in batches:
            for r in b.to_pylist():
                y = np.hstack([_unpacked(p["kind"], p["payload"], r["rows"]) for p in r["parts"]])
                z = ((y - mean) @ components.T) / np.sqrt(values)
                own = z.mean(axis=0)
                total = _merged(total, (len(z), own, (z - own).T @ (z - own)))
        if total[0]:
            yield pa.record_batch([pa.array([total[0]]), pa.array([total[1].tolist()]), pa.array([total[2].ravel().tolist()])], ["n", "mean", "m2"])

    total = (0, None, None)
    for r in whole.mapInArrow(moments, "n long, mean array<double>, m2 array<double>").collect():  # one row a task
        k = len(r["mean"])
        total = _merged(total, (r["n"], np.array(r["mean"]), np.array(r["m2"]).reshape(k, k)))
    return float(np.abs(total[2] / total[0] - np.eye(len(w.values))).max())


def fit(x: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct ``x``; None of no rows.  Components along which all
    vectors are the same have no scale and are left out."""
    ship(x.sparkSession)
    blocks = staged(column_blocks(x.select("x").distinct()), "column-blocks")
    sums = blocks.select("col", F.posexplode("sums").alias("k", "s")).groupBy((F.col("col") + F.col("k")).alias("i")).agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    n = blocks.where("col = 0").agg(F.sum("rows")).first()[0]
    if not n:
        unstage(blocks)
        return None
    less = [int(s) for _, s in sorted((r["i"], r["s"]) for r in sums)]
    d = len(less)
    # Entries are centred by the whole number next to their mean, so products are whole
    # numbers; what is left of the mean, half at most, is taken off the sums.
    middle = np.array([(2 * s + n) // (2 * n) for s in less], np.int64)
    left = np.array([s - n * int(m) for s, m in zip(less, middle, strict=True)], np.float64) / n
    v = np.zeros((d, d))
    for (i, j), t in tiled_products(blocks, middle).items():
        t = t.reshape(min(TILE, d - i), min(TILE, d - j))
        v[i : i + t.shape[0], j : j + t.shape[1]] = t / n
        v[j : j + t.shape[1], i : i + t.shape[0]] = t.T / n
    v -= np.outer(left, left)
    values, vectors = np.linalg.eigh(v)
    keep = [k for k in range(d - 1, -1, -1) if values[k] > values[-1] * d * 1e-14][:components] if values[-1] > 0 else []
    out = Whitening(n, np.array([s + n * SHIFT for s in less], dtype=object), vectors[:, keep].T.copy(), values[keep], float(np.trace(v)), 0.0)
    out.sums = out.sums.astype(np.int64) if all(abs(int(s)) < 2**62 for s in out.sums) else out.sums
    if keep:
        out.identity_error = identity_error(blocks, out)
    unstage(blocks)
    return out


def _deviation(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sums over dimensions of (n*x-S)^2, exactly; None where a long can't hold it."""
    most = max(int(np.abs(x).max(initial=0)) * n, max((abs(int(s)) for s in sums), default=0)) * 2
    if most < 2**62 and sums.dtype == np.int64:
        by = n * x - sums
        if int(np.abs(by).max(initial=0)) ** 2 * x.shape[1] < 2**63:
            return (by * by).sum(axis=1).tolist()
    exact = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    return [v if v < 2**63 else None for v in exact]


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)`` of each
    vector that takes part, and component.

    Vectors that are null, empty or hold nulls or numbers that aren't finite are left out,
    as are those of another length than most.  Repeated vectors count once in the fit and
    have a row each in the result; a null vec_id stays null.  With fewer dimensions, or
    fewer directions in which vectors differ, there are fewer components; an empty table,
    and one whose vectors are all equal, gives an empty result.  ``deviation`` is null
    where a long can't hold it.  Other columns are ignored."""
    x = whole_numbers(vectors)
    w = fit(x, components)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if w is None or not len(w.values):
        return x.sparkSession.createDataFrame([], schema)
    held = x.sparkSession.sparkContext.broadcast(w)

    def project(batches):
        w = held.value
        # Entries less their mean's whole part are small, so the rest of the mean counts fully.
        base = np.array([int(s) // w.n for s in w.sums], np.int64)
        rest = np.array([int(s) % w.n for s in w.sums], np.float64) / w.n
        k = len(w.values)
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                x = _matrix(part.column(1))
                z = ((x - base) - rest) @ w.components.T / np.sqrt(w.values)
                ids = part.column(0).take(pa.array(np.repeat(np.arange(len(x)), k)))
                dev = pa.array(_deviation(x, w.n, w.sums), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k)))
                m = len(x)
                yield pa.record_batch(
                    [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, w.n)), dev, pa.array(z.ravel()), pa.array(np.tile(w.values / w.trace, m)), pa.array(np.full(m * k, w.identity_error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return x.mapInArrow(project, schema)
