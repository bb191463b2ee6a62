"""Best-fit packing of token sequences by bin completion.

Lengths are whole numbers up to the capacity, so a packing problem is its histogram of
lengths: how many bins of each filling to use.  The search runs on that histogram (at
most one count for each length, whatever the corpus is) and answers with fillings and
their multiplicities.  Each piece's rank among the pieces of its length then names its
bin, so the assignment is a join of counts, not a walk over pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionloom.llm.common import ship, staged
from sessionloom.llm.tokens import encoder

CAPACITY = 1024
#: Search limits: nodes in all, fillings kept of a node, steps to enumerate them.  When
#: one is reached the best packing so far stands; every piece is packed in any case.
NODES, WIDTH, STEPS = 3000, 6, 4000
#: Pieces of one length that are ranked in one task.
RANKED = 500_000


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram: ``(lengths, times)`` of the bins used."""
    groups: dict[int, list[list]] = {}
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            rest = min((r for r in groups if r >= length), default=None)
            if rest is None:
                per = min(n, capacity // length)
                bins, content, left = n // per, (), capacity
            else:
                content, times = groups[rest][-1]
                per, left = min(n, rest // length), rest
                bins = min(times, n // per)
                groups[rest][-1][1] -= bins
                if not groups[rest][-1][1]:
                    groups[rest].pop()
                if not groups[rest]:
                    del groups[rest]
            groups.setdefault(left - per * length, []).append([content + (length,) * per, bins])
            n -= per * bins
    return [(content, times) for group in groups.values() for content, times in group]


def fillings(counts: dict[int, int], gap: int, width: int = WIDTH, steps: int = STEPS) -> list[tuple[int, tuple[int, ...]]]:
    """Undominated fillings of ``gap``, as ``(waste, lengths)``, the least waste first.

    A filling is dominated if another length would still fit beside it, or if one of its
    lengths could give way to a longer one that is there; both leave more waste.
    """
    lengths = sorted((x for x, n in counts.items() if n and x <= gap), reverse=True)
    if not lengths:
        return [(gap, ())]
    found: list[tuple[int, tuple[int, ...]]] = []
    used: dict[int, int] = {}
    left = [steps]
    shortest = lengths[-1]
    # Where the lengths that fit into a rest begin; what doesn't fit is never walked over.
    fitting = np.searchsorted(-np.array(lengths), -np.arange(gap + 1)).tolist()
    place = {x: i for i, x in enumerate(lengths)}

    def replaceable(rest: int, chosen: tuple[int, ...]) -> bool:
        """A longer length that is there would fit in the place of a chosen one."""
        return any(used.get(x, 0) < counts[x] for y in set(chosen) for x in lengths[fitting[min(y + rest, gap)] : place[y]])

    def grow(at: int, rest: int, chosen: tuple[int, ...]) -> bool:
        """True: enough found."""
        left[0] -= 1
        if left[0] < 0:
            return True
        fits = False
        for i in range(max(at, fitting[rest]), len(lengths)):
            x = lengths[i]
            if used.get(x, 0) >= counts[x]:
                continue
            fits = True
            used[x] = used.get(x, 0) + 1
            stop = grow(i, rest - x, (*chosen, x))
            used[x] -= 1
            if stop:
                return True
        if not fits and not (shortest <= rest and used.get(shortest, 0) < counts[shortest]) and not replaceable(rest, chosen):
            found.append((rest, chosen))
        return sum(w == 0 for w, _ in found) >= width

    grow(0, gap, ())
    if not found:  # steps ran out before the first
        rest, chosen = gap, []
        for x in lengths:
            k = min(rest // x, counts[x])
            rest -= k * x
            chosen += [x] * k
        found = [(rest, tuple(chosen))]
    return sorted(found, key=lambda f: (f[0], len(f[1])))[:width]


def complete_bins(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[tuple[int, ...], int]]:
    """Branch and bound over bin completions: ``(lengths, times)`` of the bins used.

    A node fills bins around the longest length left.  A branch is given up once its
    waste shows that it can't beat the incumbent, which is best fit at first.
    """
    counts = {x: n for x, n in counts.items() if n}
    if not counts:
        return []
    if min(counts) < 1 or max(counts) > capacity:
        raise ValueError("lengths must be between 1 and the capacity")
    total = sum(x * n for x, n in counts.items())
    over_half = sum(n for x, n in counts.items() if 2 * x > capacity)
    bound = max(-(-total // capacity), over_half)
    best = best_fit(counts, capacity)
    size = sum(n for _, n in best)

    def branches(state: dict[int, int]):
        longest = max(state)
        rest = dict(state)
        rest[longest] -= 1
        for waste, filling in fillings(rest, capacity - longest):
            content = (longest, *filling)
            need = {x: content.count(x) for x in set(content)}
            times = min(state[x] // k for x, k in need.items())
            after = {x: n - need.get(x, 0) * times for x, n in state.items()}
            yield content, times, waste * times, {x: n for x, n in after.items() if n}

    stack = [(branches(counts), 0, 0, [])]
    while stack and nodes and size > bound:
        options, used, wasted, plan = stack[-1]
        step = next(options, None)
        if step is None:
            stack.pop()
            continue
        nodes -= 1
        content, times, waste, state = step
        if wasted + waste > (size - 1) * capacity - total:
            continue
        chosen = [*plan, (content, times)]
        if not state:
            if used + times < size:
                best, size = chosen, used + times
            continue
        stack.append((branches(state), used + times, wasted + waste, chosen))
    return best


def crc32_of(raw: memoryview) -> int:
    return zlib.crc32(raw)


def document_pieces(
    docs: DataFrame, tokenizer_path: str, end_id: int, spaces: bool = True, capacity: int = CAPACITY, digest: Callable[[memoryview], int] | None = None
) -> DataFrame:
    """``(doc_id, piece, start, length, ids)``: the token ids of each text (null: empty)
    and ``end_id``, cut into pieces of ``capacity`` with the short one first.  With
    ``digest`` its value of the ids' bytes (unsigned 32-bit, little-endian) replaces them."""
    ship(docs.sparkSession)
    end = end_id.to_bytes(4, "little")

    def run(batches):
        tool = encoder(tokenizer_path, spaces)
        for b in batches:
            doc_ids = b.column(0).to_pylist()
            for at in range(0, len(doc_ids), 256):
                part = doc_ids[at : at + 256]
                cols: list[list] = [[], [], [], [], []]
                for doc_id, raw in zip(part, tool.encode(b.column(1)[at : at + 256].to_pylist()), strict=True):
                    raw = memoryview(raw + end)
                    n = len(raw) // 4
                    start, length = 0, (n - 1) % capacity + 1
                    for piece in range(-(-n // capacity)):
                        ids = raw[4 * start : 4 * (start + length)]
                        row = (doc_id, piece, start, length, digest(ids) if digest else np.frombuffer(ids, "<u4").astype(np.int32))
                        for col, x in zip(cols, row, strict=True):
                            col.append(x)
                        start, length = start + length, capacity
                yield pa.record_batch(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64() if digest else pa.list_(pa.int32()))],
                    ["doc_id", "piece", "start", "length", "ids"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, piece int, start long, length long, ids {'long' if digest else 'array<int>'}")


def pack(pieces: DataFrame, capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """``pieces`` (with ``length``, from 1 to ``capacity``) and ``sequence_id`` and
    ``offset`` of each.

    Equal lengths may change places; all columns stay.  An empty table packs into
    nothing.  Repeated rows are pieces of their own.
    """
    pieces = staged(pieces, "pieces")
    n = pieces.count()
    # More salts for more rows, so that what is ranked in one task stays bounded.
    salts = max(64, n // RANKED)
    others = [c for c in pieces.columns if c not in ("ids", "length")]
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*others), F.lit(salts)).cast("int"))
    sizes = staged(salted.groupBy("length", "_salt").agg(F.count("*").alias("n")), "length-counts")
    counts = {int(x): int(k) for x, k in sizes.groupBy("length").agg(F.sum("n")).collect()}
    ahead = W.partitionBy("length").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    firsts = staged(sizes.select("length", "_salt", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("_first")), "length-ranks")

    # By length: ranks from which on a filling's place is used, its first bin, its offset.
    places: dict[int, tuple[list, list, list]] = {}
    taken: dict[int, int] = {}
    bins = 0
    for content, times in complete_bins(counts, capacity, nodes):
        offset = 0
        for x in content:
            ranks, first, offsets = places.setdefault(x, ([], [], []))
            ranks.append(taken.get(x, 0))
            first.append(bins)
            offsets.append(offset)
            taken[x] = taken.get(x, 0) + times
            offset += x
        bins += times
    held = pieces.sparkSession.sparkContext.broadcast({x: tuple(map(np.array, p)) for x, p in places.items()})

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd

        lengths, ranks = length.to_numpy(), rank.to_numpy()
        sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
        for x in np.unique(lengths):
            at, (froms, first, offsets) = lengths == x, held.value[int(x)]
            i = np.searchsorted(froms, ranks[at], side="right") - 1
            sequence[at], offset[at] = first[i] + ranks[at] - froms[i], offsets[i]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    order = W.partitionBy("length", "_salt").orderBy(*[c for c in others])
    ranked = salted.join(firsts, ["length", "_salt"]).withColumn("_rank", F.col("_first") + F.row_number().over(order) - 1)
    placed = ranked.withColumn("_at", place("length", "_rank"))
    return placed.select(*pieces.columns, F.col("_at.sequence_id").alias("sequence_id"), F.col("_at.offset").alias("offset"))


def packed(docs: DataFrame, tokenizer_path: str, end_id: int, digest: Callable[[memoryview], int] | None = None) -> DataFrame:
    """Pieces of all documents with their places; see ``document_pieces`` and ``pack``."""
    return pack(document_pieces(docs, tokenizer_path, end_id, digest=digest))
