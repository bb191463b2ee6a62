"""Ranked full-text search over an inverted index, built for one query or kept on disk.

A kept index is a store of segments.  A segment holds the postings of some sessions, in
folders by the beginning of the term, so a query lists and reads the folders of its own
terms alone.  Sessions that have changed come into a new segment, and the small table
``live`` says in which segment a session is valid and how many blocks and terms it has;
when segments are many they are merged into one.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom import schema, store
from sessionloom.staging import staged, unstage

K1, B = 1.2, 0.75


def _plain_letters() -> dict[str, str]:
    """Small letters that are one of a to z with one mark, and the letter without it."""
    out = {}
    for c in map(chr, range(0xC0, 0x2000)):
        parts = [chr(int(x, 16)) for x in unicodedata.decomposition(c).split() if not x.startswith("<")]
        if len(parts) == 2 and "a" <= parts[0] <= "z" and unicodedata.combining(parts[1]):
            out[c] = parts[0]
    return out


_LETTERS = _plain_letters()
#: Marks that stand by themselves are left out.
_MARKS = "".join(map(chr, range(0x300, 0x370)))
_FOLDED = str.maketrans(_LETTERS | dict.fromkeys(_MARKS))


def fold(text):
    """Small letters without marks; ``parse_query`` folds by the same table."""
    return F.translate(F.lower(F.coalesce(text, F.lit(""))), "".join(_LETTERS) + _MARKS, "".join(_LETTERS.values()))


def _tokens(text):
    return F.filter(F.split(fold(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def postings(blocks: DataFrame, weights: dict[str, float]) -> tuple[DataFrame, DataFrame]:
    """``blocks(block_id, <columns>)``, one row a block -> postings ``(term, block_id, col,
    pos, weight, length)`` and lengths ``(block_id, length)`` of all columns together.

    Neither needs a shuffle, and each text is taken apart once: its terms are rows' own
    columns before anything is made of them.  Null columns have no terms, blocks without
    terms no row.  Other columns of ``blocks`` stay beside the lengths."""
    rest = [c for c in blocks.columns if c not in weights]
    names = [f"t{i}" for i in range(len(weights))]
    terms = blocks.select(*rest, F.explode(F.array(F.struct(*[_tokens(F.col(c)).alias(n) for c, n in zip(weights, names, strict=True)]))).alias("c"))
    length = sum((F.size(F.col(f"c.{n}")) for n in names), F.lit(0)).cast("long")
    sized = terms.select(*rest, length.alias("length"), "c")
    entry = lambda i, w: lambda t, pos: F.struct(t.alias("term"), F.lit(i).alias("col"), pos.alias("pos"), F.lit(w).alias("weight"))
    every = F.concat(*[F.transform(F.col(f"c.{n}"), entry(i, float(w))) for i, (n, w) in enumerate(zip(names, weights.values(), strict=True))])
    rows = sized.select(*rest, "length", F.explode(every).alias("e")).select("e.term", *rest, "e.col", "e.pos", "e.weight", "length")
    return rows, sized.where("length > 0").select(*rest, "length")


def parse_query(query: str) -> list[tuple[tuple[str, ...], bool]]:
    """The phrases of a query: words between quotes, and each other word by itself, which may
    fall into several terms.  The last phrase ends with a prefix.  A query without terms
    finds nothing."""
    parts = re.findall(r'"((?:\\"|[^"])*)"?|((?:\\"|\S)+)', query.replace("\0", " "))
    out: list[tuple[tuple[str, ...], bool]] = []
    for i, (quoted, word) in enumerate(parts):
        plain = (quoted or word).replace('\\"', '"').lower().translate(_FOLDED)
        terms = tuple(t for t in re.split(r"[\W_]+", plain) if t)
        if terms:
            out.append((terms, i == len(parts) - 1))
    return out


def _statistics(lengths: DataFrame) -> tuple[int, float]:
    """Blocks with terms, and the mean of their lengths."""
    r = lengths.agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
    return r["n"], r["mean"] or 0.0


def _places(phrases) -> tuple[Column, Column]:
    """Whether a term is wanted, and the places in phrases that it can take."""
    wanted, places = F.lit(False), []
    for i, (terms, prefix) in enumerate(phrases):
        for k, term in enumerate(terms):
            match = F.col("term").startswith(term) if prefix and k == len(terms) - 1 else F.col("term") == term
            wanted = wanted | match
            places.append(F.when(match, F.struct(F.lit(i).alias("i"), F.lit(k).alias("k"))))
    return wanted, F.array_compact(F.array(*places))


def _scored(found: DataFrame, n: int, mean: float, phrases, visible: DataFrame | None) -> DataFrame:
    """``(block_id, score)`` of the blocks that hold all phrases."""
    wanted, takes = _places(phrases)
    at = found.where(wanted).withColumn("p", F.explode(takes)).select("block_id", "length", "col", "weight", F.col("p.i").alias("i"), (F.col("pos") - F.col("p.k")).alias("start"))
    if any(len(terms) > 1 for terms, _ in phrases):
        need = F.element_at(F.array(*[F.lit(len(terms)) for terms, _ in phrases]), F.col("i") + 1)
        at = at.groupBy("block_id", "length", "col", "weight", "i", "start").agg(F.count("*").alias("n")).where(F.col("n") == need)
    # Read once: hits are counted for each phrase, then scored.
    hits = staged(at.groupBy("block_id", "i").agg(F.sum("weight").alias("tf"), F.first("length").alias("length")), "hits")
    seen = {r["i"]: r["df"] for r in hits.groupBy("i").agg(F.count("*").alias("df")).collect()}  # one row a phrase
    weigh = F.when(F.lit(False), 0.0)
    for i, df in seen.items():
        # The logarithm is the JVM's, as it is for every other part of the score.
        idf = F.log(F.lit((n - df + 0.5) / (df + 0.5)))
        weigh = weigh.when(F.col("i") == i, F.when(idf <= 0, 1e-6).otherwise(idf))
    part = weigh * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(mean)))
    scored = hits.groupBy("block_id").agg((-F.sum(part)).alias("score"), F.count("*").alias("phrases"))
    scored = scored.where(F.col("phrases") == len(phrases)).select("block_id", F.round("score", 6).alias("score"))
    return scored if visible is None else scored.join(visible.select("block_id"), "block_id", "left_semi")


def bm25(index: tuple[DataFrame, DataFrame], query: str, limit: int = 100, offset: int = 0, visible: DataFrame | None = None) -> DataFrame:
    """``(block_id, score)`` of the blocks that hold all phrases, the best (most negative)
    first, ties by block.  Counts are those of all blocks; ``visible(block_id)`` then says
    which of them may be shown."""
    found, lengths = index
    phrases = parse_query(query)
    if not phrases:
        return lengths.limit(0).select("block_id", F.lit(0.0).alias("score"))
    return _scored(found, *_statistics(lengths), phrases, visible).orderBy("score", "block_id").offset(offset).limit(limit)


# An index that is kept.

#: Letters of a term that say in which folder it lies.
PREFIX = 3
SEGMENTS = 8
#: The searched columns of a block and their weights.
WEIGHTS = {"text": 4.0, "tool_name": 2.0, "tool_input": 1.0}
POSTINGS = "term string, block_id long, session_id long, col int, pos int, weight double, length long, beginning string"
LIVE = "session_id long, segment string, mark long, blocks long, terms long"
#: What a search page gives at most, and up to where its total is exact.
PAGE, COUNTED = 100, 1000


def _segments(at: store.Manifest) -> list[str]:
    return sorted(name for name in at.tables if name.startswith("postings-"))


def refresh(spark: SparkSession, path: str, block: DataFrame, marks: DataFrame) -> int:
    """Bring the index at ``path`` in step with ``block``; ``marks(session_id, mark)`` change
    whenever the session does.  Sessions whose mark is new are taken apart again, those
    without a mark leave the index.  Returns how many were."""
    at = store.manifest(spark, path)
    live = store.read(spark, path, "live", LIVE, at)
    marks = staged(marks.select("session_id", "mark").distinct(), "marks")
    same = live.join(marks, ["session_id", "mark"], "left_semi")
    changed = staged(marks.join(same, "session_id", "left_anti"), "changed")
    n, gone = changed.count(), live.join(marks, "session_id", "left_anti").isEmpty() is False
    if n or gone:
        merge = len(_segments(at)) >= SEGMENTS
        if merge:
            changed, same = marks, same.limit(0)
        change = store.Change(spark, path, at)
        name = f"postings-{change.generation}"
        rows = block.join(changed.select("session_id"), "session_id", "left_semi").select(F.col("id").alias("block_id"), "session_id", *WEIGHTS)
        found, lengths = postings(rows, WEIGHTS)
        # Terms lie sorted in their files, so a reader skips the parts without its own.
        found = found.withColumn("beginning", F.substring("term", 1, PREFIX))
        change.put(name, found, POSTINGS, "beginning", sort=["term"], spread="block_id")
        sums = lengths.groupBy("session_id").agg(F.count("*").alias("blocks"), F.sum("length").alias("terms"))
        new = changed.join(sums, "session_id", "left").select("session_id", F.lit(name).alias("segment"), "mark", F.coalesce("blocks", F.lit(0)).alias("blocks"), F.coalesce("terms", F.lit(0)).alias("terms"))
        change.put("live", same.select(*[f.split()[0] for f in LIVE.split(", ")]).unionByName(new), LIVE, "session_id")
        if merge:
            for old in _segments(at):
                change.tables.pop(old)
        change.commit()
    for df in (marks, changed):
        unstage(df)
    return n


def session_marks(source: DataFrame) -> DataFrame:
    """Marks from an archive's list of files ``(path, size, mtime, session_id)``."""
    return source.where("session_id IS NOT NULL").groupBy("session_id").agg(F.xxhash64(F.max(F.struct("mtime", "size", "path"))).alias("mark"))


def kept_postings(spark: SparkSession, path: str, phrases, at: store.Manifest | None = None) -> DataFrame:
    """The valid postings in the folders that the phrases' terms can lie in."""
    at = store.manifest(spark, path) if at is None else at
    whole = [t for terms, prefix in phrases for k, t in enumerate(terms) if not (prefix and k == len(terms) - 1 and len(t) < PREFIX)]
    folders = None
    if len(whole) == sum(len(terms) for terms, _ in phrases):
        begins = spark.createDataFrame([(t[:PREFIX],) for t in sorted(set(whole))], "b string")
        folders = sorted(r["k"] for r in begins.select(store.folder_of(F.col("b"), at.folders).alias("k")).distinct().collect())
    live = store.read(spark, path, "live", LIVE, at).select("session_id", "segment")
    wanted, _ = _places(phrases)
    out = None
    for name in _segments(at):
        part = store.read(spark, path, name, POSTINGS, at, folders).where(wanted).join(live.where(F.col("segment") == name), "session_id", "left_semi")
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], POSTINGS) if out is None else out


@dataclass
class Page:
    """A page of hits ``(block_id, score)`` with their snippets, the total, and whether there
    are more than that."""

    rows: DataFrame
    total: int
    is_capped: bool


def page(spark: SparkSession, path: str, query: str, block: DataFrame, visible: DataFrame | None = None, limit: int = 30, offset: int = 0, most: int = PAGE) -> Page:
    """A page from a kept index.  ``block`` gives the hits' texts, ``visible(block_id)`` which
    may be shown; a page has ``most`` hits at most (``COUNTED`` for a search that wants all
    pages at once)."""
    phrases = parse_query(query)
    empty = spark.createDataFrame([], "block_id long, score double, snippet string")
    if not phrases:
        return Page(empty, 0, False)
    at = store.manifest(spark, path)
    sums = store.read(spark, path, "live", LIVE, at).agg(F.sum("blocks").alias("n"), F.sum("terms").alias("terms")).first()
    if not sums["n"]:
        return Page(empty, 0, False)
    scored = staged(_scored(kept_postings(spark, path, phrases, at), sums["n"], sums["terms"] / sums["n"], phrases, visible), "scored")
    count = scored.limit(COUNTED + 1).count()
    limit = max(1, min(limit, most))
    top = scored.orderBy("score", "block_id").offset(max(0, offset)).limit(limit)
    texts = block.select(F.col("id").alias("block_id"), *WEIGHTS)
    rows = top.join(texts, "block_id", "left").select("block_id", "score", matching_snippet([F.col(c) for c in WEIGHTS], phrases).alias("snippet"))
    return Page(rows.orderBy("score", "block_id"), min(count, COUNTED), count > COUNTED)


def _pattern(terms: tuple[str, ...], prefix: bool) -> str:
    """The phrase at the beginning of a folded text."""
    last = r"[\p{L}\p{N}]*" if prefix else r"(?![\p{L}\p{N}])"
    return r"^[^\p{L}\p{N}]*" + r"[^\p{L}\p{N}]+".join(re.escape(t) for t in terms) + last


def snippet(text: Column, phrases, words: int = 12) -> Column:
    """The words around the first phrase that is found, words that begin or continue a phrase
    in brackets; null where there is none.  ``phrases`` as ``parse_query`` gives them, or one
    term."""
    phrases = [((phrases,), True)] if isinstance(phrases, str) else phrases
    tokens = F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+")

    def span(all_words: Column, i: Column) -> Column:
        """How many words from ``i`` a phrase takes; 0 of none."""
        out = F.lit(0)
        for terms, prefix in phrases:
            for m in range(len(terms), 0, -1):
                joined = fold(F.array_join(F.slice(all_words, i, F.lit(m)), " "))
                out = F.when(F.regexp_like(joined, F.lit(_pattern(terms, prefix))), F.greatest(out, F.lit(m)) if m == len(terms) else F.lit(m)).otherwise(out)
        return out

    # Words that hold a first term at all come first: few are looked at any closer.
    firsts = [terms[0] for terms, _ in phrases]
    held = lambda w: F.exists(F.array(*[F.lit(t) for t in firsts]), lambda t: fold(w).contains(t))
    places = F.filter(F.transform(tokens, lambda w, i: F.when(held(w), i + 1)), lambda i: i.isNotNull())
    at = F.try_element_at(F.filter(places, lambda i: span(tokens, i) > 0), F.lit(1))
    first = F.greatest(F.lit(1), at - words // 2)
    part = F.slice(tokens, first, F.lit(words))
    spans = F.transform(part, lambda w, i: span(part, i + 1))
    marked = F.transform(part, lambda w, i: F.exists(F.transform(spans, lambda m, j: (j <= i) & (i < j + m)), lambda x: x))
    shown = F.zip_with(part, marked, lambda w, m: F.when(m, F.concat(F.lit("["), w, F.lit("]"))).otherwise(w))
    return F.when(at.isNotNull(), F.array_join(shown, " "))


def matching_snippet(columns: list[Column], phrases) -> Column:
    """The first column's snippet that holds a phrase; else the beginning of the first column
    that isn't null; else nothing."""
    heads = [F.array_join(F.slice(F.split(F.trim(c), r"\s+"), 1, 12), " ") for c in columns]
    return F.coalesce(*[snippet(c, phrases) for c in columns], *heads, F.lit(""))


def archive_index(spark: SparkSession, path: str, archive_path: str) -> int:
    """Bring the index at ``path`` in step with the archive; returns the sessions taken apart."""
    at = store.manifest(spark, archive_path)
    block = store.read(spark, archive_path, "block", schema.BLOCK, at)
    return refresh(spark, path, block, session_marks(store.read(spark, archive_path, "source", schema.SOURCE, at)))
