"""Frequent phrases and how much more often their words meet than chance would have it.

Texts are pieces between punctuation, pieces are words.  Candidates come from sketches:
hashes of words, then of pairs, then of longer runs, are counted in cells, and a run can
be frequent only if its own cell and those of all its parts are.  Cells only ever count
too much, so what is frequent is never missed.  The phrases behind full cells, and the
words that stand first or last in them, become Aho-Corasick automata whose patterns have
a space on either side, over texts whose words have one space between them and whose
pieces have a line feed: so a pattern matches whole words within a piece, and overlapping
matches share spaces.  Each task counts matches in its part of the corpus; sums over
tasks are the exact frequencies, and only these pass thresholds.

Every shuffle between tasks carries counts in packed ranges of cells or patterns.  The
sketch has a cell for every ``BYTES_PER_CELL`` bytes of text up to ``MOST_CELLS``: what the
driver sends on is one bit for each cell.  Beyond that, cells count too much more often,
and the automata get more phrases to find infrequent, but results stay whole.  Patterns
are dealt into shards of about ``SHARD_BYTES``, each scanned by itself, so no automaton
grows with the corpus.
"""

from __future__ import annotations

import re
from collections import Counter
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionloom.llm.common import ship, staged, unstage

LEAST, LONGEST, TOP = 100, 5, 2000
BYTES_PER_CELL, LEAST_CELLS, MOST_CELLS, RANGES = 32, 1 << 16, 1 << 30, 256
SHARD_BYTES = 24_000_000
#: Bytes of text that are taken apart at once, and of one word that are hashed together.
CHUNK, WORD_BYTES = 1 << 21, 256
#: Entries that a task counts before it passes them on.
HELD = 1 << 21

_KIND = np.zeros(256, np.uint8)  # 0: in words, 1: between words, 2: between pieces
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_PLAIN = bytes(0x0A if _KIND[i] == 2 else 0x20 if _KIND[i] == 1 else int(_LOWER[i]) for i in range(256))
_SPACES = re.compile(rb"  +")
_FACTOR = 0x9E3779B97F4A7C15
_POWERS = np.array([pow(_FACTOR, i, 1 << 64) for i in range(WORD_BYTES)], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits over 64 bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _word_hashes(buf: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits for each word; words of the same letters have the same."""
    import xxhash

    if not len(first):
        return np.zeros(0, np.uint64)
    size = np.minimum(end - first, WORD_BYTES)
    starts = np.r_[0, np.cumsum(size)[:-1]]
    place = np.arange(int(size.sum())) - np.repeat(starts, size)
    letters = _LOWER[buf[np.repeat(first, size) + place]].astype(np.uint64) + np.uint64(1)
    out = _mixed(np.add.reduceat(letters * _POWERS[place], starts))
    for i in np.flatnonzero(end - first > WORD_BYTES):
        out[i] = xxhash.xxh64_intdigest(_LOWER[buf[first[i] : end[i]]].tobytes())
    return out


class Words:
    """Words of a run of texts: where they are, their pieces, texts and hashes."""

    def __init__(self, buf: np.ndarray, text_ends: np.ndarray):
        kind = _KIND[buf]
        edge = np.flatnonzero(np.diff(np.r_[True, kind != 0, True].astype(np.int8)))
        self.buf, self.first, self.end = buf, edge[0::2], edge[1::2]
        self.piece = np.cumsum(kind == 2, dtype=np.int64)[self.first] if len(self.first) else np.zeros(0, np.int64)
        self.text = np.searchsorted(text_ends, self.first, side="right")
        # Words are hashed in lots, so that only a few bytes for each letter are held.
        lot = np.searchsorted(self.first, np.arange(CHUNK, len(buf) + CHUNK, CHUNK))
        self.hash = np.concatenate([_word_hashes(buf, self.first[a:b], self.end[a:b]) for a, b in zip(np.r_[0, lot], np.r_[lot, len(self.first)], strict=True)])

    def runs(self, seeds: np.ndarray):
        """For each length from 1: hashes of the runs that begin at each word, and whether
        they end within the piece.  ``seeds``: by text, what tells languages apart."""
        own = _mixed(self.hash ^ seeds[self.text]) if len(self.first) else self.hash
        run, n = own, len(own)
        yield run, np.ones(n, bool)
        for k in range(2, LONGEST + 1):
            m = max(0, n - k + 1)
            run = run.copy()
            run[:m] = _mixed(run[:m] * np.uint64(3) + own[n - m :])
            within = np.zeros(n, bool)
            within[:m] = self.piece[:m] == self.piece[n - m :]
            yield run, within

    def phrase(self, at: int, k: int) -> str:
        parts = (_LOWER[self.buf[self.first[i] : self.end[i]]].tobytes() for i in range(at, at + k))
        return b" ".join(parts).decode("utf-8")


def _taken_apart(batch):
    """``(words, langs)`` of the batch's texts, in lots of about ``CHUNK`` bytes.  A long
    text is cut between pieces, which nothing that is counted crosses."""
    lot, langs, size = [], [], 0
    cut = re.compile(rb"[.,;:!?\x0A-\x0D]")

    def ended():
        ends = np.cumsum([len(x) + 1 for x in lot])
        return Words(np.frombuffer(b"\n".join(lot) + b"\n", np.uint8), ends), langs

    for text, lang in zip(batch.column(1), batch.column(0), strict=True):
        raw, lang = (text.as_py() or "").encode(), lang.as_py()
        at = 0
        while at < len(raw):
            if len(raw) - at <= CHUNK:
                to = len(raw)
            else:
                end = cut.search(raw, at + CHUNK)
                to = end.end() if end else len(raw)
            lot.append(raw[at:to])
            langs.append(lang)
            size, at = size + to - at, to
            if size >= CHUNK:
                yield ended()
                lot, langs, size = [], [], 0
    if lot:
        yield ended()


def _seeds(langs: list[str]) -> np.ndarray:
    import xxhash

    known = {x: xxhash.xxh64_intdigest(x) for x in set(langs)}
    return np.array([known[x] for x in langs], np.uint64)


def _is_full(bits: np.ndarray, run: np.ndarray, shift: int) -> np.ndarray:
    cell = run >> np.uint64(shift)
    return (bits[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _alive(words: Words, seeds: np.ndarray, full: dict[int, np.ndarray], shift: int):
    """``(length, hashes, which)``: runs of each length all of whose parts, as far as
    ``full`` has their lengths, are in full cells."""
    before = None
    for k, (run, within) in enumerate(words.runs(seeds), 1):
        which = within
        if before is not None:
            which = which & before & np.r_[before[1:], False]
        yield k, run, which
        # A longer run can be alive only where this one is.
        if k in full:
            which = which.copy()
            at = np.flatnonzero(which)
            which[at] = _is_full(full[k], run[at], shift)
        before = which


# Counts of numbered things, summed over all tasks in packed ranges.

_COUNTS = pa.schema([("range", pa.int32()), ("cells", pa.binary()), ("counts", pa.binary())])
_COUNTS_DDL = "`range` int, cells binary, counts binary"


def _packed(cells: np.ndarray, counts: np.ndarray, span: int) -> pa.RecordBatch:
    """Sorted cells and their counts, a row for each range of ``span`` cells."""
    cuts = np.r_[0, np.flatnonzero(np.diff(cells // span)) + 1, len(cells)] if len(cells) else np.array([0])
    rows = [(int(cells[a] // span), (cells[a:b] % span).astype(np.uint32).tobytes(), counts[a:b].astype(np.uint32).tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True) if rows else ([], [], []), _COUNTS, strict=True)], schema=_COUNTS)


class _Held:
    """A task's counts until they are passed on."""

    def __init__(self, span: int):
        self.span, self.lots, self.size = span, [], 0

    def add(self, cells: np.ndarray, counts: np.ndarray | None = None):
        if counts is None:
            cells, counts = np.unique(cells, return_counts=True)
        self.lots.append((cells, counts))
        self.size += len(cells)
        if self.size >= 2 * HELD:
            self._merge()

    def _merge(self):
        if self.lots:
            cells, at = np.unique(np.concatenate([c for c, _ in self.lots]), return_inverse=True)
            self.lots = [(cells, np.bincount(at, np.concatenate([n for _, n in self.lots]), len(cells)).astype(np.int64))]
            self.size = len(cells)

    def passed_on(self, least: int = 0):
        """Counts of the lots so far, if they are ``least`` at least."""
        if self.size >= least and self.lots:
            self._merge()
            if self.size >= least:
                (cells, counts), self.lots, self.size = self.lots[0], [], 0
                yield _packed(cells, counts, self.span)


def _by_range(counted: DataFrame) -> DataFrame:
    return counted.repartition("range").sortWithinPartitions("range")


def _sums(batches, span: int):
    """Packed counts in the order of their ranges -> ``(range, sums of all its cells)``."""
    mine, total = None, None
    for b in batches:
        for r, cells, counts in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if r != mine:
                if mine is not None:
                    yield mine, total
                mine, total = r, np.zeros(span, np.int64)
            total[np.frombuffer(cells, np.uint32)] += np.frombuffer(counts, np.uint32)  # a cell once in each row
    if mine is not None:
        yield mine, total


def _full_cells(docs: DataFrame, lengths: tuple[int, ...], full: dict[int, np.ndarray], cells: int, least: int) -> np.ndarray:
    """One bit for each cell: whether runs of the lengths come to ``least`` in it.  A cell
    serves all the lengths; hashes of different lengths differ."""
    spark = docs.sparkSession
    held, shift, span = spark.sparkContext.broadcast(full), 64 - (cells.bit_length() - 1), cells // RANGES

    def count(batches):
        mine = _Held(span)
        for b in batches:
            for words, langs in _taken_apart(b):
                for k, run, which in _alive(words, _seeds(langs), held.value, shift):
                    if k in lengths:
                        mine.add((run[which] >> np.uint64(shift)).astype(np.int64))
                    if k == max(lengths):
                        break
                yield from mine.passed_on(HELD)
        yield from mine.passed_on()

    def settle(batches):
        for r, sums in _sums(batches, span):
            yield pa.record_batch([pa.array([r], pa.int32()), pa.array([np.packbits(sums >= least, bitorder="little").tobytes()], pa.binary())], ["range", "bits"])

    rows = _by_range(docs.mapInArrow(count, _COUNTS_DDL)).mapInArrow(settle, "`range` int, bits binary")
    out = np.zeros(cells // 8, np.uint8)
    for r in rows.collect():  # a bit for each cell
        out[r["range"] * (span // 8) : (r["range"] + 1) * (span // 8)] = np.frombuffer(r["bits"], np.uint8)
    held.unpersist()
    return out


_PHRASES = "`range` int, lang array<string>, phrase array<string>"


def _candidates(docs: DataFrame, full: dict[int, np.ndarray], cells: int) -> DataFrame:
    """``(lang, phrase)``: what stands behind full cells.  A task passes each on about once,
    packed by ranges of hashes; what arrives from all tasks is told apart a range at a time."""
    held, shift = docs.sparkSession.sparkContext.broadcast(full), 64 - (cells.bit_length() - 1)

    def packed(found: dict[int, tuple[list, list]]):
        names = ["range", "lang", "phrase"]
        return pa.record_batch([pa.array(list(found), pa.int32()), pa.array([x for x, _ in found.values()], pa.list_(pa.string())), pa.array([x for _, x in found.values()], pa.list_(pa.string()))], names)

    def find(batches):
        seen: set[int] = set()
        out: dict[int, tuple[list, list]] = {}
        for b in batches:
            for words, langs in _taken_apart(b):
                for k, run, which in _alive(words, _seeds(langs), held.value, shift):
                    if k < 2:
                        continue
                    at = np.flatnonzero(which)
                    at = at[_is_full(held.value[k], run[at], shift)]
                    hashes, firsts = np.unique(run[at], return_index=True)
                    for h, i in zip(hashes.tolist(), at[firsts].tolist(), strict=True):
                        if h not in seen:
                            seen.add(h)
                            mine = out.setdefault(h % RANGES, ([], []))
                            mine[0].append(langs[words.text[i]])
                            mine[1].append(words.phrase(i, k))
                    if len(seen) > HELD:
                        yield packed(out)
                        seen, out = set(), {}
        if out:
            yield packed(out)

    def tell_apart(batches):
        mine, found = None, set()
        for b in batches:
            for r, langs, phrases in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r != mine:
                    yield from _rows(found)
                    mine, found = r, set()
                found.update(zip(langs, phrases, strict=True))
        yield from _rows(found)

    return _by_range(docs.mapInArrow(find, _PHRASES)).mapInArrow(tell_apart, "lang string, phrase string")


def _rows(found: set[tuple[str, str]]):
    if found:
        langs, phrases = zip(*found, strict=True)
        yield pa.record_batch([pa.array(langs, pa.string()), pa.array(phrases, pa.string())], ["lang", "phrase"])


def plain(text: str | None) -> str:
    """Words of a piece between single spaces, pieces between line feeds, A to Z in lower
    case; a space at either end."""
    flat = (text or "").encode().translate(_PLAIN).replace(b"\n", b" \n ")
    return _SPACES.sub(b" ", b" " + flat + b" ").decode()


def automata(patterns: list[tuple[str, str]]) -> dict:
    """An automaton for each language; a match is a pattern's place in the list."""
    import ahocorasick

    out: dict = {}
    for i, (lang, phrase) in enumerate(patterns):
        out.setdefault(lang, ahocorasick.Automaton()).add_word(f" {phrase} ", i)
    for a in out.values():
        a.make_automaton()
    return out


_built: dict = {}


def _automata_of(key: str, patterns: list[tuple[str, str]]) -> dict:
    """The automata of a shard, built once in each worker process."""
    if key not in _built:
        _built.clear()
        _built[key] = automata(patterns)
    return _built[key]


def exact_counts(docs: DataFrame, patterns: list[tuple[str, str]], key: str) -> DataFrame:
    """``(lang, phrase, f)`` of the patterns that occur, overlaps included."""
    held, span = docs.sparkSession.sparkContext.broadcast(patterns), max(1, -(-len(patterns) // RANGES))

    def scan(batches):
        from sessionloom.llm import collocations as shipped  # whose automata outlive the task

        found = shipped._automata_of(key, held.value)
        counts: Counter = Counter()
        for b in batches:
            for lang, text in zip(b.column(0), b.column(1), strict=True):
                a = found.get(lang.as_py())
                if a is not None and text.as_py():
                    counts.update(map(itemgetter(1), a.iter(plain(text.as_py()))))
        if counts:
            cells = np.array(sorted(counts), np.int64)
            n = np.array([counts[c] for c in cells.tolist()], np.int64)
            while len(cells):  # counts beyond 32 bits go in parts
                yield _packed(cells, np.minimum(n, 2**32 - 1), span)
                cells, n = cells[n >= 2**32], n[n >= 2**32] - (2**32 - 1)

    def settle(batches):
        for r, sums in _sums(batches, span):
            at = np.flatnonzero(sums)
            mine = [held.value[r * span + i] for i in at.tolist()]
            yield pa.record_batch([pa.array([x for x, _ in mine], pa.string()), pa.array([x for _, x in mine], pa.string()), pa.array(sums[at])], ["lang", "phrase", "f"])

    return _by_range(docs.mapInArrow(scan, _COUNTS_DDL)).mapInArrow(settle, "lang string, phrase string, f long")


def _words_in(docs: DataFrame) -> DataFrame:
    """``(lang, n)``: occurrences of words."""

    def count(batches):
        total: Counter = Counter()
        for b in batches:
            for words, langs in _taken_apart(b):
                for at, k in zip(*(x.tolist() for x in np.unique(words.text, return_counts=True)), strict=True):
                    total[langs[at]] += k
        if total:
            yield pa.record_batch([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["lang", "n"])

    return docs.mapInArrow(count, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n"))


def frequencies(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``(lang, phrase, words, f)`` of every phrase of 2 to ``LONGEST`` words with ``f >=
    least``, and of the words that stand first or last in one (``words`` 1)."""
    spark = docs.sparkSession
    ship(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = LEAST_CELLS
    while cells < MOST_CELLS and cells * BYTES_PER_CELL < size:
        cells *= 2
    full: dict[int, np.ndarray] = {}
    for lengths in ((1,), (2,), tuple(range(3, LONGEST + 1))):
        bits = _full_cells(docs, lengths, full, cells, least)
        full |= dict.fromkeys(lengths, bits)
    phrases = staged(_candidates(docs, full, cells), "phrases")
    ends = phrases.select("lang", F.explode(F.array(F.substring_index("phrase", " ", 1), F.substring_index("phrase", " ", -1))).alias("phrase"))
    wanted = staged(phrases.unionByName(ends.distinct()).withColumn("h", F.xxhash64("lang", "phrase")), "patterns")
    total = wanted.agg(F.sum(F.octet_length("phrase") + 2)).first()[0] or 0
    shards, found = -(-total // SHARD_BYTES), []
    for i in range(shards):
        rows = wanted.where(F.pmod("h", F.lit(shards)) == i).select("lang", "phrase").collect()  # about SHARD_BYTES
        found.append(staged(exact_counts(docs, sorted((r["lang"], r["phrase"]) for r in rows), f"{wanted._staged_at}/{i}"), "counts"))
    unstage(phrases)
    unstage(wanted)
    if not found:
        return spark.createDataFrame([], "lang string, phrase string, words int, f long")
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    words = F.size(F.split("phrase", " "))
    return every.select("lang", "phrase", words.alias("words"), "f").where(F.col("f") >= least)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's phrases by score.

    Null texts are empty, null languages ``und``.  Repeated rows count each.  Texts without
    words, and an empty table, give no phrase.  Ties in score and frequency go to the
    smaller phrase by bytes.  Memory grows with the longest piece (text without any
    punctuation), not with the longest text.  Other columns are ignored."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    f = staged(frequencies(rows, least), "frequencies")
    n = staged(_words_in(rows), "word-counts")
    found = f.where("words > 1").select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    # Parts of longer candidates that are as frequent say nothing that those don't.
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda s: F.array_join(F.slice("w", s, k), " "))))
    within = found.where(F.size("w") > 2).select("lang", "a", F.explode(F.array_distinct(inner)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = found.join(within, ["lang", "phrase"], "left").where("longer IS NULL OR 100 * longer < 100 * a").drop("longer")
    cuts = kept.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("rest"))
    part = lambda name, at: f.select(F.col("lang"), F.col("phrase").alias(at), F.col("f").alias(name))
    cuts = cuts.join(part("l", "first"), ["lang", "first"]).join(part("r", "rest"), ["lang", "rest"]).join(F.broadcast(n), "lang")  # n: a row for each language
    score = F.expr("CAST(1000 * CAST(a AS decimal(17,0)) * CAST(n AS decimal(17,0)) AS decimal(38,0)) div (CAST(l AS decimal(19,0)) * CAST(r AS decimal(19,0)))")
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score")
    # The first of each of 64 lots, then of them: no language is sorted whole in one task.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    lots = best.withColumn("lot", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    lots = lots.withColumn("rank", F.row_number().over(W.partitionBy("lang", "lot").orderBy(*order))).where(F.col("rank") <= top)
    ranked = lots.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = """
WITH pieces AS (
  SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)),
words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
counts AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM words GROUP BY lang),
runs AS (
  SELECT lang, k, array_to_string(w[s:s + k - 1], ' ') AS phrase
  FROM (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS s FROM words, range(1, 6) AS t(k))),
f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM runs GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
inside AS (
  SELECT lang, array_to_string(w[s:s + j - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, w, a, j, unnest(range(1, len(w) - j + 2)) AS s FROM c, range(2, 5) AS t(j) WHERE j < k)
  GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a),
cuts AS (
  SELECT d.lang, d.phrase, a, p.f AS l, q.f AS r, n, cut, (1000 * a * n) // (p.f * q.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM kept) d
  JOIN f p ON p.lang = d.lang AND p.phrase = array_to_string(d.w[1:cut], ' ')
  JOIN f q ON q.lang = d.lang AND q.phrase = array_to_string(d.w[cut + 1:], ' ')
  JOIN counts ON counts.lang = d.lang),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""
