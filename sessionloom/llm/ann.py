"""Approximate nearest neighbours: an NN-descent graph and greedy search on it.

Equal vectors are one node.  Random hyperplanes give the graph a start; each round of
NN-descent then joins every node with its neighbours and those it is a neighbour of, and
introduces them to each other (neighbours of neighbours), until few links change.  Alone
that stops with links missing that no common neighbour tells of, the more the larger the
table; so each round also introduces those that lie on the same side of new hyperplanes,
and a search expands hardly more nodes of a large table than of a small one.  A query
starts from its own node, if its vector is one, and a fixed number of pivots, and follows
the graph: each round joins the best unexpanded nodes of
every query with the graph and with the vectors, until its list is stable.  How long the
lists must be depends on the vectors; a sample of the queries, whose nearest nodes are
known by brute force, tells: the lists double until these are found.
"""

from __future__ import annotations

import gc
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionloom.llm.common import ship, staged, unstage
from sessionloom.llm.vectors import is_valid, matrix

#: Neighbours of a node; trees of the start and of each round, and size of their leaves.
DEGREE, TREES, LEAF = 24, 8, 1024
#: NN-descent ends after a round that renews no more than this share of the links.
CHANGED = 0.01
#: Members introduced to each other around a node, and introductions each one keeps.
MEETING, KEPT = 48, 16
#: Length of a query's list at first, nodes it expands in a round, and pivots.
BEAM, EXPANDED, PIVOTS = 96, 48, 1024
NEAREST = 10
#: Queries whose nearest nodes are known by brute force, and the share of these to find.
SAMPLE, RECALL = 128, 0.96


def _tidy(spark) -> None:
    """Let Spark drop the shuffle files of finished rounds."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def nodes_of(vectors: DataFrame) -> DataFrame:
    """``(node, vec, ids)``: distinct valid vectors, named by their smallest vec_id, with
    the smallest ``NEAREST + 1`` ids that hold them (no result needs more)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("vec")).where(is_valid(F.col("vec")) & F.col("vec_id").isNotNull()).distinct()
    rank = F.row_number().over(W.partitionBy("vec").orderBy("vec_id"))
    few = rows.withColumn("rank", rank).where(f"rank <= {NEAREST + 1}")
    return few.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("node"), "vec", "ids")


def _closest(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the k nearest other rows and their squared distances."""
    x = x.astype(np.float64)
    n = len(x)
    sq = (x * x).sum(axis=1)
    d = sq[:, None] + sq[None, :] - 2 * (x @ x.T)
    np.fill_diagonal(d, np.inf)
    k = min(k, n - 1)
    at = np.argpartition(d, k - 1, axis=1)[:, :k]
    return at, np.maximum(np.take_along_axis(d, at, axis=1), 0)


def _introduce(groups: DataFrame, keep: int) -> DataFrame:
    """``groups(ids, flat, radii)`` of a few vectors each -> ``(node, other, dist)``: for each
    member its nearest others in the group, if nearer than its radius."""

    def run(batches):
        for b in batches:
            held, size = [], 0
            for ids, flat, radii in zip(*b.columns, strict=True):
                ids = ids.values.to_numpy(zero_copy_only=False)
                if len(ids) < 2:
                    continue
                at, d = _closest(flat.values.to_numpy(zero_copy_only=False).reshape(len(ids), -1), keep)
                d = d.astype(np.float32)
                nearer = d < radii.values.to_numpy(zero_copy_only=False)[:, None]
                held.append((np.repeat(ids, nearer.sum(axis=1)), ids[at[nearer]], d[nearer]))
                size += len(held[-1][0])
                if size > 200_000:
                    yield _best(held)
                    held, size = [], 0
            if held:
                yield _best(held)

    return groups.select("ids", "flat", "radii").mapInArrow(run, "node long, other long, dist float")


def _best(held) -> pa.RecordBatch:
    """Each pair of a batch once."""
    node, other, dist = map(np.concatenate, zip(*held, strict=True))
    order = np.lexsort((other, node))
    node, other, dist = node[order], other[order], dist[order]
    new = np.ones(len(node), bool)
    new[1:] = (node[1:] != node[:-1]) | (other[1:] != other[:-1])
    return pa.record_batch([pa.array(node[new]), pa.array(other[new]), pa.array(dist[new])], ["node", "other", "dist"])


def _nearest_links(links: DataFrame, k: int) -> DataFrame:
    once = links.groupBy("node", "other").agg(F.min("dist").alias("dist"), F.min("fresh").alias("fresh"))
    rank = F.row_number().over(W.partitionBy("node").orderBy("dist", "other"))
    return once.withColumn("rank", rank).where(f"rank <= {k}").drop("rank")


def _centre(nodes: DataFrame, dim: int) -> np.ndarray:
    centre = nodes.select(*[F.avg(F.col("vec")[i]).alias(f"a{i}") for i in range(dim)]).first()
    return np.array([x or 0.0 for x in centre])


def _codes(placed: DataFrame, n: int, centre: np.ndarray, turn: int) -> DataFrame:
    """``placed(node, vec, radius)`` with the side of random hyperplanes it is on, for each
    tree; each turn has planes of its own."""
    bits = max(0, math.ceil(math.log2(max(1, n / LEAF))))
    planes = np.random.default_rng((7, turn)).standard_normal((TREES if bits else 1, bits, len(centre)))

    def run(batches):
        for b in batches:
            x = matrix(b.column(1)).astype(np.float64) - centre
            for tree in range(len(planes)):
                code = np.zeros(len(x), np.int64)
                for plane in planes[tree]:
                    code = code * 2 + (x @ plane > 0)
                yield pa.record_batch([*b.columns, pa.array(np.full(len(x), tree, np.int32)), pa.array(code)], ["node", "vec", "radius", "tree", "code"])

    return staged(placed.select("node", "vec", "radius").mapInArrow(run, "node long, vec array<float>, radius float, tree int, code long"), "ann-codes")


def _sides(coded: DataFrame, turn: int) -> DataFrame:
    """Groups of vectors on the same side, for each tree."""
    # A crowded side is dealt into groups of about LEAF.
    crowds = coded.groupBy("tree", "code").agg(F.ceil(F.count("*") / (2 * LEAF)).cast("int").alias("parts"))
    dealt = coded.join(crowds, ["tree", "code"]).withColumn("chunk", F.pmod(F.xxhash64("node", "tree", F.lit(turn)), F.col("parts")))
    members = dealt.groupBy("tree", "code", "chunk").agg(F.collect_list(F.struct("node", "vec", "radius")).alias("x"))
    return members.select(F.col("x.node").alias("ids"), F.flatten("x.vec").alias("flat"), F.col("x.radius").alias("radii"))


def neighbour_graph(nodes: DataFrame, degree: int = DEGREE, changed: float = CHANGED) -> DataFrame:
    """``(node, other, dist)``: about the ``degree`` nearest nodes of each node."""
    n = nodes.count()
    first = nodes.select(F.size("vec").alias("dim")).first()
    if not n:
        return nodes.select("node", F.col("node").alias("other"), F.lit(0.0).cast("float").alias("dist"))
    centre, anywhere, turn = _centre(nodes, first[0]), F.lit(float("inf")).cast("float"), 0
    coded = _codes(nodes.withColumn("radius", anywhere), n, centre, turn)
    graph = staged(_nearest_links(_introduce(_sides(coded, turn), degree).withColumn("fresh", F.lit(1)), degree), "ann-graph")
    while True:  # ends: links only get shorter
        unstage(coded)
        _tidy(nodes.sparkSession)
        turn += 1
        # Around each node: its neighbours, and as many that it is a neighbour of.
        turned = graph.select(F.col("other").alias("node"), F.col("node").alias("other"), "dist")
        rank = F.row_number().over(W.partitionBy("node").orderBy(F.xxhash64("node", "other", F.lit(turn))))
        turned = turned.withColumn("rank", rank).where(f"rank <= {MEETING - degree}").drop("rank")
        around = graph.select("node", "other").union(turned.select("node", "other")).distinct()
        # What is no nearer than a node's farthest neighbour can't become one.
        radius = graph.groupBy("node").agg(F.when(F.count("*") == degree, F.max("dist")).otherwise(float("inf")).cast("float").alias("radius"))
        placed = nodes.join(radius, "node", "left").select("node", "vec", F.coalesce("radius", anywhere).alias("radius"))
        met = around.join(placed.withColumnRenamed("node", "other"), "other")
        met = met.groupBy("node").agg(F.collect_list(F.struct("other", "vec", "radius")).alias("x"))
        groups = met.select("node", F.col("x.other").alias("ids"), F.flatten("x.vec").alias("flat"), F.col("x.radius").alias("radii"))
        coded = _codes(placed, n, centre, turn)
        known, met = graph.withColumn("fresh", F.lit(0)), _introduce(groups, KEPT).unionByName(_introduce(_sides(coded, turn), KEPT)).withColumn("fresh", F.lit(1))
        after = staged(_nearest_links(known.unionByName(met), degree), "ann-graph")
        unstage(graph)
        graph = after
        links, fresh = graph.agg(F.count("*"), F.coalesce(F.sum("fresh"), F.lit(0))).first()
        if fresh <= changed * links:
            unstage(coded)
            return graph.drop("fresh")


def _reach(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(query_id, reach, near)`` for a sample of the queries: the distance within which
    their ``NEAREST + 1`` nearest nodes lie, by brute force, and how many these are."""
    sample = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(SAMPLE).select("query_id", "vec").collect()
    held = queries.sparkSession.sparkContext.broadcast((np.array([r[0] for r in sample], np.int64), np.array([r[1] for r in sample], np.float64)))

    def run(batches):
        ids, q = held.value
        for b in batches:
            x = matrix(b.column(0)).astype(np.float64)
            for i in range(len(ids) if len(x) else 0):
                d = np.sqrt(((x - q[i]) ** 2).sum(axis=1))
                d = np.sort(np.partition(d, NEAREST)[: NEAREST + 1] if len(d) > NEAREST else d)
                yield pa.record_batch([pa.array(np.full(len(d), ids[i])), pa.array(d)], ["query_id", "dist"])

    near = nodes.select("vec").mapInArrow(run, "query_id long, dist double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("dist"))
    return near.withColumn("rank", rank).where(f"rank <= {NEAREST + 1}").groupBy("query_id").agg(F.max("dist").alias("reach"), F.count("*").alias("near"))


def search(queries: DataFrame, nodes: DataFrame, graph: DataFrame, beam: int = BEAM, expanded: int = EXPANDED, pivots: int = PIVOTS, recall: float = RECALL) -> DataFrame:
    """``queries(query_id, vec)`` -> ``(query_id, vec, found, dist)``: arrays of the nearest
    nodes met, and their exact distances, nearest first.

    ``beam`` doubles until the sample's queries have met ``recall`` of their nearest nodes,
    or every query has expanded all nodes that the graph leads it to.
    """
    spark = queries.sparkSession
    sample = nodes.orderBy(F.xxhash64("node"), "node").limit(pivots).select("node", "vec").collect()
    held = spark.sparkContext.broadcast((np.array([r[0] for r in sample], np.int64), np.array([r[1] for r in sample], np.float64)))

    def merged(beam, query, found, dist, done, ids, x):
        """The list after new nodes, and the nodes to expand next: only those within
        ``beam``; the list goes on to twice that, for when it doubles."""
        d = np.sqrt(((x - query) ** 2).sum(axis=1))
        found, dist, done = np.concatenate([found, ids]), np.concatenate([dist, d]), np.concatenate([done, np.zeros(len(ids), bool)])
        order = np.lexsort((~done, found))
        found, dist, done = found[order], dist[order], done[order]
        new = np.ones(len(found), bool)
        new[1:] = found[1:] != found[:-1]
        found, dist, done = found[new], dist[new], done[new]
        order = np.lexsort((found, dist))[: 2 * beam]
        found, dist, done = found[order], dist[order], done[order]
        ahead = np.nonzero(~done[:beam])[0][:expanded]
        done = done.copy()
        done[ahead] = True
        return found, dist, done, found[ahead]

    names = ["query_id", "vec", "found", "dist", "done", "next"]
    schema = "query_id long, vec array<float>, found array<long>, dist array<double>, done array<boolean>, next array<long>"

    def batch(rows):
        cols = list(zip(*rows, strict=True))
        kinds = [pa.int64(), pa.list_(pa.float32()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.bool_()), pa.list_(pa.int64())]
        return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    def begin(batches):
        ids, x = held.value
        for b in batches:
            rows = []
            for query_id, vec, own in zip(b.column(0).to_pylist(), matrix(b.column(1)), b.column(2).to_pylist(), strict=True):
                none, query = np.zeros(0), vec.astype(np.float64)
                seeds = (ids, x) if own is None else (np.append(ids, own), np.vstack([x, query]))
                rows.append((query_id, vec, *merged(beam, query, none.astype(np.int64), none, none.astype(bool), *seeds)))
            if rows:
                yield batch(rows)

    def proceed(beam):
        def run(batches):
            for b in batches:
                rows, size = [], 0
                for r in range(b.num_rows):
                    vec, found, dist, done, ids, flat = (b.column(k)[r].values for k in range(1, 7))
                    vec, found, dist, done, ids, flat = (v.to_numpy(zero_copy_only=False) for v in (vec, found, dist, done, ids, flat))
                    rows.append((b.column(0)[r].as_py(), vec, *merged(beam, vec.astype(np.float64), found, dist, done.astype(bool), ids, flat.astype(np.float64).reshape(len(ids), len(vec)))))
                    size += len(rows[-1][2])
                    if size > 200_000:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

        return run

    back = graph.select(F.col("other").alias("node"), F.col("node").alias("other"), "dist")
    rank = F.row_number().over(W.partitionBy("node").orderBy("dist", "other"))
    back = back.withColumn("rank", rank).where(f"rank <= {DEGREE}").drop("rank")
    ways = graph.union(back).groupBy("node").agg(F.collect_set("other").alias("others"))
    ways = staged(ways, "ann-ways")
    begun = queries.select("query_id", "vec").join(nodes.select("vec", "node"), "vec", "left").select("query_id", "vec", "node")
    state = staged(begun.mapInArrow(begin, schema), "ann-search")
    reach = staged(_reach(queries, nodes), "ann-reach")
    none = F.array().cast("array<long>").alias("ids"), F.array().cast("array<float>").alias("flat")
    kept = "query_id", "vec", "found", "dist", "done"
    widened = False
    while True:  # a query expands a node once, so every query ends
        open_ = state.where("size(next) > 0")
        if open_.isEmpty():
            if widened or _met(state, reach) >= recall:
                break
            beam, widened = 2 * beam, True
            told = state.select(*kept, *none)
        else:
            widened = False
            ahead = open_.select("query_id", F.explode("next").alias("node"), "found").join(ways, "node")
            ahead = ahead.select("query_id", F.explode(F.array_except("others", "found")).alias("node")).distinct()
            met = ahead.join(nodes.select("node", "vec"), "node").groupBy("query_id").agg(F.collect_list("node").alias("ids"), F.flatten(F.collect_list("vec")).alias("flat"))
            told = state.select(*kept).join(met, "query_id", "left").select(*kept, F.coalesce("ids", none[0]).alias("ids"), F.coalesce("flat", none[1]).alias("flat"))
        after = staged(told.mapInArrow(proceed(beam), schema), "ann-search")
        unstage(state)
        state = after
    return state.select("query_id", "vec", "found", "dist")


def _met(state: DataFrame, reach: DataFrame) -> float:
    """The share of the sample's nearest nodes that its queries have met."""
    within = F.size(F.filter("dist", lambda d: d <= F.col("reach") * (1 + 1e-12)))
    met, near = state.join(F.broadcast(reach), "query_id").agg(F.sum(F.least(within, F.col("near"))), F.sum("near")).first()
    return met / near if near else 1.0


def nearest(vectors: DataFrame, is_query, k: int = NEAREST) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` (at most ``NEAREST``) nearest rows found
    for each query row, without the query's own, by Euclidean distance in double
    precision; ties go to the smaller vec_id.  Vectors of one length only; rows whose
    vector is null, empty, zero or not finite, or that lack an id, take no part.
    """
    ship(vectors.sparkSession)
    nodes = staged(nodes_of(vectors), "ann-nodes")
    queries = vectors.select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<float>").alias("vec"))
    queries = queries.where(is_query(F.col("query_id")) & is_valid(F.col("vec"))).dropDuplicates(["query_id"])
    found = search(queries, nodes, neighbour_graph(nodes), max(BEAM, k))
    pairs = found.select("query_id", F.explode(F.slice(F.arrays_zip("found", "dist"), 1, NEAREST + 1)).alias("x")).select("query_id", F.col("x.found").alias("node"), F.col("x.dist").alias("score"))
    named = pairs.join(nodes.select("node", "ids"), "node").select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return named.withColumn("rank", rank).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")
