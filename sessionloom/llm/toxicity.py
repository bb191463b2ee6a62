"""Toxicity by compression distance.

Two zstandard dictionaries are trained, on ordinary and on toxic text.  Ordinary text's
dictionary holds what ordinary texts are made of; toxic text is made of that as well and
of phrases of its own, so its dictionary holds both: one trained on the parts of toxic
texts that ordinary ones lack, and ordinary text's dictionary, so that ordinary words cost
the same with either.  A document is cut into windows
of words, each compressed behind a phrase that ends both dictionaries: its one long match
pays for the block's headers, so even a short match in the window shows.  Where a window
is shorter with the toxic dictionary than with the ordinary one, it resembles toxic text;
a logistic threshold, calibrated on labelled documents that the dictionaries have not
seen, turns the windows' differences into a score.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import ship

#: Labelled documents the model is fitted on, at most, and characters of all of them.
SAMPLE_DOCS, SAMPLE_CHARS = 8000, 40_000_000
WINDOW = 3
#: Bytes of the ordinary dictionary, and of what the toxic one has besides it.
DICTIONARY_BYTES, TOXIC_BYTES = 4096, 8192
#: Words of the longest run by which toxic texts' own phrases are found.
GRAM = 3
_FACTOR = np.int64(6364136223846793005)
#: Bytes of the phrase in front of each window.
CARRIER = 48
#: Windows of a document and in all that the ordinary dictionary is trained on.
TRAINED_PER_TEXT, TRAINED = 60, 60_000
THRESHOLD = 0.3
_CUT = (1, 2, 3, 4, 5, 6, 8)
_EDGE = b".,;:!?\"'()[]"


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 4 is 2; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def windows(text: str | None) -> list[bytes]:
    """Runs of ``WINDOW`` words of the whole text, the last one with what is left."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return [b" " + b" ".join(words[i : i + WINDOW]) + b" " for i in range(0, len(words), WINDOW)]


class Model:
    """The dictionaries' bytes and the calibrated threshold."""

    def __init__(self, ordinary: bytes, toxic: bytes, mean=None, scale=None, weights=None):
        self.ordinary, self.toxic = ordinary, toxic
        self.mean, self.scale, self.weights = mean, scale, weights
        self._tools = None

    def __getstate__(self):
        return self.__dict__ | {"_tools": None}

    def differences(self, parts: list[bytes]) -> np.ndarray:
        import zstandard as z

        if self._tools is None:
            params = z.ZstdCompressionParameters(strategy=z.STRATEGY_LAZY2, min_match=4, window_log=15, hash_log=13, chain_log=13, search_log=4, target_length=16, write_content_size=0, write_checksum=0, write_dict_id=0)
            dictionaries = [z.ZstdCompressionDict(x, dict_type=z.DICT_TYPE_RAWCONTENT) for x in (self.ordinary, self.toxic)]
            self._tools = [z.ZstdCompressor(compression_params=params, dict_data=d).compress for d in dictionaries]
        plain, toxic = self._tools
        carried = [self.ordinary[-CARRIER:] + x for x in parts]
        return np.fromiter((len(plain(x)) - len(toxic(x)) for x in carried), np.int64, len(carried))

    def features(self, text: str | None) -> list[float]:
        d = self.differences(windows(text))
        top = np.sort(d)[::-1][:3]
        top = np.pad(top, (0, 3 - len(top)))
        return [*top.tolist(), float(d.mean()) if len(d) else 0.0, math.log1p(len(d)), *[math.log1p(int((d >= k).sum())) for k in _CUT]]

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([self.features(t) for t in texts], dtype=np.float64).reshape(len(texts), -1)
        x = np.c_[(x - self.mean) / self.scale, np.ones(len(x))]
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -500, 500)))


def _least(toxic: list[str]) -> int:
    """Toxic documents that must hold an expression: few where there are few."""
    return min(4, max(1, len(toxic) // 3))


def _grams(text: str) -> tuple[list[bytes], list[np.ndarray]]:
    """The text's words without punctuation around them, and the hashes of its runs of one
    to ``GRAM`` words, the same in every process."""
    import xxhash

    words = [w.strip(_EDGE) or w for w in text.encode("utf-8", "surrogatepass").lower().split()]
    one = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)).astype(np.int64)
    runs = [one]
    for n in range(1, min(GRAM, len(words))):
        runs.append(runs[-1][:-1] * _FACTOR + one[n:])
    return words, runs


def _own_phrases(toxic: list[str], ordinary: list[str], ratio: float = 30.0) -> list[bytes]:
    """The longest parts of each toxic text that are made of runs of one to ``GRAM`` words
    that toxic documents hold ``ratio`` times as often as ordinary ones.  Phrases whose
    single words are ordinary are among them."""
    each = [np.unique(np.concatenate(_grams(t)[1])) for t in toxic]
    if not each:
        return []
    found, counts = np.unique(np.concatenate(each), return_counts=True)
    found, counts = found[counts >= _least(toxic)], counts[counts >= _least(toxic)]
    if not len(found):
        return []
    others = np.zeros(len(found), np.int64)
    for t in ordinary:
        x = np.unique(np.concatenate(_grams(t)[1]))
        at = np.minimum(np.searchsorted(found, x), len(found) - 1)
        others[at[found[at] == x]] += 1
    own = found[counts / len(toxic) >= ratio * (others + 0.5) / max(len(ordinary), 1)]
    parts = []
    for t in toxic:
        words, runs = _grams(t)
        marked = np.zeros(len(words) + 1, bool)
        for n, hashes in enumerate(runs, 1):
            at = np.nonzero(np.isin(hashes, own))[0]
            for k in range(n):
                marked[at + k] = True
        start = None
        for i, m in enumerate(marked.tolist()):
            if m and start is None:
                start = i
            elif not m and start is not None:
                parts.append(b" " + b" ".join(words[start:i]) + b" ")
                start = None
    return parts


def _trained(samples: list[bytes], size: int) -> bytes:
    """zstandard's dictionary of the samples; few are said again until they are enough to
    train on, and where that doesn't help, as when all are a few bytes, they are joined.  Of
    none, nothing."""
    import zstandard as z

    said = list(samples)
    while said and len(said) <= TRAINED:
        try:
            return z.train_dictionary(size, said, k=32, d=6).as_bytes()
        except z.ZstdError:
            said += said
    return b"".join(x for x, _ in reversed(Counter(samples).most_common()))[-size:]


def _phrases(text: str) -> list[bytes]:
    """Eight words each, for the ordinary dictionary."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return [b" " + b" ".join(words[i : i + 8]) + b" " for i in range(0, len(words), 8)]


def _spread(parts: list[bytes], most: int) -> list[bytes]:
    """At most ``most`` of the parts, evenly from all of them."""
    return parts[:: -(-len(parts) // most)] if len(parts) > most else parts


def train(rows: list[tuple[int, str, int]]) -> Model:
    """``(order, text, toxic)`` of distinct texts -> a model.  Two thirds make the
    dictionaries, one third calibrates.  Without either class every score is that class's
    share."""
    rows = sorted(rows, key=lambda r: (r[0], r[1]))
    fitted, kept = [r for i, r in enumerate(rows) if i % 3], rows[::3]
    toxic, ordinary = [r[1] for r in fitted if r[2]], [r[1] for r in fitted if not r[2]]
    samples = [w for t in ordinary for w in _spread(_phrases(t), TRAINED_PER_TEXT)]
    common = _trained(_spread(samples, TRAINED), DICTIONARY_BYTES) or b" the "
    theirs = _trained(_spread(_own_phrases(toxic, ordinary), TRAINED), TOXIC_BYTES)
    model = Model(common, theirs + common)
    x = np.array([model.features(r[1]) for r in kept] or [model.features("")], dtype=np.float64)
    y = np.array([r[2] for r in kept] or [0], dtype=np.float64)
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    x = np.c_[(x - model.mean) / model.scale, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    penalty = np.append(np.ones(x.shape[1] - 1), 0.01)
    for _ in range(50):  # Newton steps of a ridge logistic regression
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    model.weights = w
    return model


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """A model from labelled documents that are not held out: whole distinct texts, the first
    ``sample_docs`` in the order of a hash of their ids.  A text with which the characters
    would exceed ``sample_chars`` is left out, and the next ones are tried.  Equal texts
    count once; a text with several labels is toxic if one of them says so."""
    marked = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("_toxic"))
    texts = docs.where(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("_doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    texts = texts.withColumn("_same", F.sha2(F.col("_text").cast("binary"), 256))
    # Ids are chosen first, so that the texts of the others are never moved.
    sizes = texts.select("_doc", "_same", F.length("_text").alias("_chars"))
    distinct = sizes.join(marked, F.col("_doc") == F.col("_id")).groupBy("_same").agg(F.min(F.struct(F.xxhash64("_id").alias("o"), "_id")).alias("at"), F.max("_toxic").alias("_toxic"), F.first("_chars").alias("_chars"))
    picked, chars = [], 0
    for r in distinct.orderBy("at", "_same").limit(sample_docs).collect():
        if chars + r["_chars"] <= sample_chars:
            chars += r["_chars"]
            picked.append((r["at"]["o"], r["at"]["_id"], r["_same"], 1 if r["_toxic"] else 0))
    kinds = dict(marked.dtypes)
    chosen = docs.sparkSession.createDataFrame(picked, f"o long, _id {kinds['_id']}, _key string, _toxic int")
    rows = texts.join(F.broadcast(chosen), (F.col("_id") == F.col("_doc")) & (F.col("_key") == F.col("_same"))).select("_key", "o", "_text", "_toxic").collect()
    # Repeated rows of one id and text.
    return train([(r["o"], r["_text"], r["_toxic"]) for r in {r["_key"]: r for r in rows}.values()])


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of each row of ``docs``.

    Null texts score as empty ones, which have the score of no window at all.  Whole texts
    count however long they are; equal texts have equal scores, and repeated rows a row
    each.  A null doc_id is not held out.  An empty table gives an empty result; without
    any labelled document every score is 0 or near it.  Other columns are ignored."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                scores = held.value.score(part.column(1).to_pylist())
                yield pa.record_batch([part.column(0), pa.array(scores)], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        return pd.Series(held.value.score(texts.tolist()))

    return docs.where(score(F.col("text")) < threshold)
