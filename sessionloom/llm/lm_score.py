"""Document probabilities under a unigram model of subwords, over all segmentations.

The pieces are those of an existing vocabulary file; nothing is added to them.  Their
scores are log relative frequencies of the pieces in the training words.  A text is
the sequence of its words (lower-case A-Z) and one end; each word begins with the
vocabulary's boundary mark, so no piece spans two words, and the text's probability is
the product of its words' and the end's.  A word's probability is the sum over all its
segmentations, by a forward recursion in log space.  It is computed once for each
distinct word, wherever that word stands.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import ship, staged

BOUNDARY = "▁"
#: Words whose counts and probabilities every task holds: the most frequent ones.  The
#: others are joined; none of them can be more than 1 / HOT_WORDS of all tokens.
HOT_WORDS = 100_000
#: Characters from which on a word is held by its digest, so that what is held has a bound
#: in bytes.
LONG_WORD = 64
#: Added to each piece's count.
SMOOTHING = 0.1
_FLUSH = 400_000
_NEVER = float("-inf")


class Lattice:
    """The forward recursion over a word's segmentations."""

    def __init__(self, pieces: list[str], log_probs: list[float]):
        """``pieces`` as in the vocabulary; ``log_probs`` natural logarithms by piece, and
        one more at the end for the end of a text."""
        self.end = log_probs[len(pieces)]
        self.first, self.inner, bytes_ = {}, {}, {}
        for piece, p in zip(pieces, log_probs, strict=False):
            if len(piece) == 6 and piece.startswith("<0x"):
                bytes_[int(piece[3:5], 16)] = p
            elif piece.startswith(BOUNDARY):
                self.first[piece[1:]] = p
            elif BOUNDARY not in piece:
                self.inner[piece] = p
        self.bytes = bytes_
        self.longest = max(map(len, [*self.first, *self.inner, ""]))
        self.starts = {x[:k] for x in [*self.first, *self.inner] for k in range(1, len(x) + 1)}

    def _char(self, c: str) -> float:
        """A character by its bytes; only for those that are no piece themselves."""
        return sum(self.bytes.get(b, _NEVER) for b in c.encode("utf-8", "surrogatepass"))

    def word(self, word: str) -> float:
        """Natural log of the probability of the boundary mark and the word."""
        n = len(word)
        alpha = [_NEVER] * (n + 1)
        terms: list[list[float]] = [[] for _ in range(n + 1)]
        exp, log, starts, inner, first, longest = math.exp, math.log, self.starts, self.inner, self.first, self.longest
        alpha[0] = first.get("", _NEVER)
        for k in range(1, min(n, longest) + 1):
            if (p := first.get(word[:k])) is not None:
                terms[k].append(p)
        for i in range(n):
            if i:
                t = terms[i]
                if not t:
                    continue
                if len(t) == 1:
                    alpha[i] = t[0]
                else:
                    m = max(t)
                    alpha[i] = m + log(sum([exp(x - m) for x in t])) if m > _NEVER else m
                terms[i] = ()
            a = alpha[i]
            for k in range(i + 1, min(n, i + longest) + 1):
                piece = word[i:k]
                if piece not in starts:
                    break
                if (p := inner.get(piece)) is not None:
                    terms[k].append(a + p)
            if word[i] not in inner:
                terms[i + 1].append(a + self._char(word[i]))
        m = max(terms[n], default=_NEVER)
        return m + log(sum([exp(x - m) for x in terms[n]])) if m > _NEVER else m


def vocabulary(model_file: str):
    """(processor, pieces) of a sentencepiece file; its scores are not read."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return sp, [sp.id_to_piece(i) for i in range(sp.get_piece_size())]


def words_of(text: str | bytes | None) -> list[bytes]:
    """The words in UTF-8.  Bytes are split at the six ASCII white-space characters and
    lower-cased in A-Z alone; str.split() and str.lower() would do more."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    return raw.lower().split()


def short_name(word: bytes) -> bytes:
    """The word, or a digest that no word equals (it begins with a space)."""
    if len(word) < LONG_WORD or len(word.decode("utf-8", "replace")) < LONG_WORD:
        return word
    return b" " + hashlib.sha256(word).hexdigest().encode()


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 7 is 2; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def count_words(docs: DataFrame) -> DataFrame:
    """``docs(text, held)`` -> ``(word, c, total)``: occurrences in training texts and in
    all.  The end of a text is the word ``""``."""

    def run(batches):
        train, rest, size = Counter(), Counter(), 0

        def out():
            words = list(train.keys() | rest.keys())
            c = [train[w] for w in words]
            total = [a + rest[w] for a, w in zip(c, words, strict=True)]
            return pa.record_batch([pa.array(words, pa.string()), pa.array(c, pa.int64()), pa.array(total, pa.int64())], ["word", "c", "total"])

        for b in batches:
            for text, held in zip(b.column(0).cast(pa.binary()), b.column(1).to_pylist(), strict=True):
                counts = rest if held else train
                counts.update(words_of(text.as_py()))
                counts[b""] += 1
                if len(train) + len(rest) > _FLUSH:
                    yield out()
                    train.clear()
                    rest.clear()
        if train or rest:
            yield out()

    found = docs.select("text", "held").mapInArrow(run, "word string, c long, total long")
    return found.groupBy("word").agg(F.sum("c").alias("c"), F.sum("total").alias("total"))


def piece_counts(words: DataFrame, model_file: str) -> DataFrame:
    """``(piece_id, n)``: pieces in all training words, as the vocabulary splits them."""

    def run(batches):
        sp, pieces = vocabulary(model_file)
        counts = np.zeros(len(pieces) + 1, dtype=np.int64)
        for b in batches:
            texts, times = b.column(0).to_pylist(), b.column(1).to_numpy()
            for at in range(0, len(texts), 10_000):
                part = texts[at : at + 10_000]
                # The vocabulary's own spacing puts the boundary mark before each word.
                ids = sp.encode([t for t in part if t], num_threads=1)
                n = times[at : at + 10_000]
                kept = n[[bool(t) for t in part]]
                lengths = np.fromiter(map(len, ids), np.int64, len(ids))
                flat = np.fromiter((i for x in ids for i in x), np.int64, int(lengths.sum()))
                np.add.at(counts, flat, np.repeat(kept, lengths))
                counts[-1] += int(n.sum() - kept.sum())
        ids = np.nonzero(counts)[0]
        yield pa.record_batch([pa.array(ids), pa.array(counts[ids])], ["piece_id", "n"])

    found = words.where("c > 0").select("word", "c").mapInArrow(run, "piece_id long, n long")
    return found.groupBy("piece_id").agg(F.sum("n").alias("n"))


def train(words: DataFrame, model_file: str) -> tuple[list[str], list[float]]:
    """Pieces and natural log probabilities (the end's last).  The driver gets one count
    for each piece of the vocabulary, however large the corpus is."""
    _, pieces = vocabulary(model_file)
    counts = np.full(len(pieces) + 1, SMOOTHING)
    for piece_id, n in piece_counts(words, model_file).collect():
        counts[piece_id] += n
    return pieces, np.log(counts / counts.sum()).tolist()


def _word_scores(words: DataFrame, pieces: list[str], log_probs: list[float]) -> DataFrame:
    model = words.sparkSession.sparkContext.broadcast((pieces, log_probs))

    def run(batches):
        lattice = Lattice(*model.value)
        for b in batches:
            scores = [lattice.word(w) if w else lattice.end for w in b.column(0).to_pylist()]
            yield pa.record_batch([*b.columns, pa.array(scores, pa.float64())], ["word", "c", "total", "logp"])

    return words.select("word", "c", "total").mapInArrow(run, "word string, c long, total long, logp double")


def _by_text(docs: DataFrame, hot: list) -> DataFrame:
    """Sums over the hot words of each text, and its other words with their counts.
    ``hot`` has words by their ``short_name``."""
    held = docs.sparkSession.sparkContext.broadcast(
        ({w.encode("utf-8", "surrogatepass"): i for i, (w, _, _) in enumerate(hot)}, np.array([c for _, c, _ in hot], dtype=np.float64), np.array([p for _, _, p in hot]))
    )

    def run(batches):
        place, c, logp = held.value
        known, base = c > 0, np.log10(c + 1)
        missing = len(c)
        known, base, logp = np.append(known, False), np.append(base, 0.0), np.append(logp, 0.0)
        get = place.get
        for b in batches:
            doc_ids = b.column(0).to_pylist()
            for start in range(0, len(doc_ids), 1000):
                part = doc_ids[start : start + 1000]
                rows, rare, times, ends = [], [], [], [0]
                for text in b.column(1)[start : start + 1000].cast(pa.binary()).to_pylist():
                    counts = Counter(words_of(text))
                    counts[b""] = 1
                    keys = list(counts)
                    n = np.fromiter(counts.values(), np.int64, len(keys))
                    at = np.fromiter(map(get, keys, repeat(missing)), np.int64, len(keys))
                    for i in np.nonzero(at == missing)[0].tolist():
                        if len(keys[i]) >= LONG_WORD:
                            at[i] = get(short_name(keys[i]), missing)
                    out = np.nonzero(at == missing)[0].tolist()
                    rare += [keys[i] for i in out]
                    times += n[out].tolist()
                    ends.append(len(rare))
                    rows.append((xxhash.xxh64_intdigest(text or b"") - (1 << 63), int(n.sum()), int(n[known[at]].sum()), float(n @ base[at]), float(n @ logp[at])))
                texts, sizes, knowns, bases, scores = zip(*rows, strict=True)
                yield pa.record_batch(
                    [
                        pa.array(part, pa.int64()), pa.array(texts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(knowns, pa.int64()), pa.array(bases, pa.float64()), pa.array(scores, pa.float64()),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(rare, pa.string())), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(times, pa.int64())),
                    ],
                    ["doc_id", "digest", "n_tokens", "n_known", "base", "logp", "rare", "times"],
                )

    schema = "doc_id long, digest long, n_tokens long, n_known long, base double, logp double, rare array<string>, times array<long>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def lattice_scores(docs: DataFrame, model_file: str, held: Callable[[Column], Column] = held_out, hot_words: int = HOT_WORDS) -> DataFrame:
    """One row ``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``
    for each row of ``docs``.

    The model learns from all rows that are not held out.  ``score`` and ``base_score`` (an
    add-one unigram model of whole words) are log10 probabilities of the text and its
    end.  Null and empty texts have one token, the end.  Rows with a null id are training
    rows.  Repeated rows count as often as they stand and get equal rows.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held(F.col("doc_id")).alias("held"))
    counted = staged(count_words(rows), "word-counts")
    sums = counted.agg(F.sum("c"), F.count_if(F.col("c") > 0)).first()
    n_train, distinct = sums[0] or 0, sums[1] or 0
    words = staged(_word_scores(counted, *train(counted, model_file)), "word-scores")
    name = F.when(F.length("word") < LONG_WORD, F.col("word")).otherwise(F.concat(F.lit(" "), F.sha2(F.col("word").cast("binary"), 256)))
    hot = [tuple(r) for r in words.select(name.alias("name"), "c", "logp", "total").orderBy(F.col("total").desc(), "name").limit(hot_words).select("name", "c", "logp").collect()]
    texts = staged(_by_text(rows, hot), "text-sums")

    rare = texts.select("doc_id", "digest", F.posexplode(F.arrays_zip("rare", "times")).alias("pos", "x"))
    rare = rare.select("doc_id", "digest", F.col("x.rare").alias("word"), F.col("x.times").alias("n"), (F.col("pos") == 0).cast("long").alias("copies"))
    met = rare.join(words.select("word", "c", "logp"), "word")
    met = met.groupBy("doc_id", "digest").agg(
        F.sum("copies").alias("copies"),
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known"),
        F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more_base"),
        F.sum(F.col("n") * F.col("logp")).alias("more_logp"),
    )
    # The copies of a row were summed together: each has its share.
    met = met.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), *[(F.col(c) / F.col("copies")).alias(c) for c in ("more_known", "more_base", "more_logp")])
    out = texts.drop("rare", "times").join(met, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    more = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return out.select(
        "doc_id",
        held(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.round(more("more_known")).cast("long")).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + more("more_base") - F.col("n_tokens") * math.log10(n_train + distinct + 1)).alias("base_score"),
        ((F.col("logp") + more("more_logp")) / math.log(10)).alias("score"),
    )
