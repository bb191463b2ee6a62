"""Language identification by compression.

Each language has a zstandard raw-content dictionary: pieces of its own texts.  A text is
reduced to its letters, cut into windows, and each window is compressed with every
dictionary; the language with which the whole text takes the fewest bytes is the one it
resembles most.  Each window stands behind a short phrase that ends all dictionaries: its
one long match pays for the block's headers, so that short matches in the window show.
Where the two best languages are within ``NARROW`` bytes, the text's distinct words are
compressed again in windows of a few words, so that a word said a thousand times and one
said once weigh alike; what ties even then goes to the more frequent language.  How far
the second best is behind says how sure the choice is: a logistic curve, calibrated on
documents that are in no dictionary, turns that margin into a score, and choices that
score less than ``ACCEPTED`` are marked as rejected.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import ship

#: Distinct texts of a language that its dictionary and calibration are made from, at most,
#: and bytes of each, taken from all over the text.
TEXTS, EXCERPT = 256, 2048
#: Bytes of a dictionary, of the phrase that ends all of them, and of a window.
DICTIONARY_BYTES, CARRIER, WINDOW = 65_536, 48, 1024
#: Bytes between the two best languages below which distinct words decide, in windows of
#: so many words.
NARROW, WORDS = 2, 4
ACCEPTED = 0.8
UNKNOWN = "und"
_NO_LETTERS = re.compile(r"[\W\d_]+")


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 3 is 1; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def folded(text: str | None) -> bytes:
    """The letters of the whole text in lower case, runs of anything else as one space."""
    return _NO_LETTERS.sub(" ", (text or "").lower()).strip().encode("utf-8", "surrogatepass")


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


class Model:
    """Dictionaries by language, the most frequent language first, and the curve."""

    def __init__(self, langs: list[str], dictionaries: list[bytes], carrier: bytes, weights: np.ndarray | None = None):
        self.langs, self.dictionaries, self.carrier = langs, dictionaries, carrier
        self.weights = weights
        self._tools = None

    def __getstate__(self):
        return self.__dict__ | {"_tools": None}

    def _sizes(self, parts: list[bytes]) -> np.ndarray:
        import zstandard as z

        if self._tools is None:
            params = z.ZstdCompressionParameters(strategy=z.STRATEGY_LAZY2, min_match=4, window_log=17, hash_log=15, chain_log=15, search_log=5, target_length=32, write_content_size=0, write_checksum=0, write_dict_id=0)
            made = [z.ZstdCompressionDict(d + self.carrier, dict_type=z.DICT_TYPE_RAWCONTENT) for d in self.dictionaries]
            self._tools = [z.ZstdCompressor(compression_params=params, dict_data=d).compress for d in made]
        carried = [self.carrier + b" " + p + b" " for p in parts]
        return np.array([sum(len(shrink(p)) for p in carried) for shrink in self._tools], np.int64)

    def sizes(self, text: bytes) -> np.ndarray:
        """Bytes of the folded text with each dictionary."""
        found = self._sizes([text[i : i + WINDOW] for i in range(0, len(text), WINDOW)])
        best = np.partition(found, min(1, len(found) - 1))
        if len(found) > 1 and best[1] - best[0] <= NARROW:
            words = list(dict.fromkeys(text.split()))
            found = self._sizes([b" ".join(words[i : i + WORDS]) for i in range(0, len(words), WORDS)])
        return found

    def choice(self, text: bytes) -> tuple[int, list[float]]:
        """The language's place and what the curve makes its score of."""
        found = self.sizes(text)
        at = int(found.argmin())
        behind = float(np.delete(found, at).min() - found[at]) if len(found) > 1 else 0.0
        return at, [np.log1p(behind), behind / max(1.0, float(found[at])), 1.0]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """``(language, score, accepted)``."""
        if not self.langs or not has_letter(text):
            return UNKNOWN, 0.0, False
        at, features = self.choice(folded(text))
        score = float(1 / (1 + np.exp(-np.clip(np.dot(features, self.weights), -500, 500))))
        return self.langs[at], score, score >= ACCEPTED


def excerpt(text: bytes, most: int = EXCERPT) -> bytes:
    """At most ``most`` bytes: eight parts from all over a longer text."""
    if len(text) <= most:
        return text
    part = most // 8
    starts = [round(i * (len(text) - part) / 7) for i in range(8)]
    return b" ".join(text[s : s + part] for s in starts)


def train(texts: dict[str, list[bytes]], frequent: list[str]) -> Model:
    """Folded texts by language -> a model.  Of every three texts two are for the
    dictionary and one for the curve; a language with one text alone has it in its
    dictionary.  ``frequent`` names the languages, the most frequent first."""
    langs = [x for x in frequent if any(texts.get(x, ()))]
    ours = {x: [t for i, t in enumerate(texts[x]) if t and i % 3 != 2] or [t for t in texts[x] if t] for x in langs}
    made = [b" ".join(ours[x])[-DICTIONARY_BYTES:] for x in langs]
    share = max(1, CARRIER // max(1, len(langs)))
    model = Model(langs, made, b"".join(d[:share] for d in made)[:CARRIER])
    x, y = [], []
    for lang in langs:
        for t in (t for i, t in enumerate(texts[lang]) if t and i % 3 == 2):
            for part in (t, t[:200], t[:40]):  # margins of short texts too
                at, features = model.choice(part)
                x.append(features)
                y.append(langs[at] == lang)
    model.weights = _curve(np.array(x or [[0.0, 0.0, 1.0]]), np.array(y or [True], dtype=np.float64))
    return model


def _curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton steps of a ridge logistic regression."""
    w = np.zeros(x.shape[1])
    penalty = np.array([0.01, 0.01, 0.01])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(docs: DataFrame, texts: int = TEXTS) -> Model:
    """A model from documents that aren't held out and name a language.

    At most ``texts`` distinct texts of each language, the one with the smallest hash in
    each of so many hash classes, so copies count once however many there are; a language
    is as frequent as it has documents.  What comes to the driver is bounded by languages,
    texts and ``EXCERPT``."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("h"))
    # Hashes alone are grouped; a class's smallest hash names its text.
    picks = rows.groupBy("lang", F.pmod("h", F.lit(texts)).alias("class")).agg(F.min("h").alias("h"), F.count("*").alias("n")).collect()
    if not picks:
        return Model([], [], b"")
    count: dict[str, int] = {}
    for r in picks:
        count[r["lang"]] = count.get(r["lang"], 0) + r["n"]
    chosen = spark.createDataFrame([(r["lang"], r["h"]) for r in picks], "lang string, h long")

    def parts(batches):
        for b in batches:
            at = b.schema.get_field_index("text")
            cut = [excerpt(folded(x.as_py())) for x in b.column(at)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(cut, pa.binary())], ["lang", "h", "part"])

    found = rows.join(F.broadcast(chosen), ["lang", "h"], "left_semi").select("lang", "h", "text").mapInArrow(parts, "lang string, h long, part binary")
    by: dict[str, list[bytes]] = {}
    for r in sorted(found.groupBy("lang", "h").agg(F.min("part").alias("part")).collect(), key=lambda r: (r["lang"], r["h"])):
        by.setdefault(r["lang"], []).append(bytes(r["part"]))
    return train(by, sorted(count, key=lambda x: (-count[x], x)))


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, accepted)`` of each row of ``docs``.

    Null texts and texts without a letter are ``und`` with score 0, all are where nothing
    was learned.  Whole texts count however long they are; equal texts have equal results
    and repeated rows a row each; a null doc_id is not held out.  ``accepted`` is false
    where the margin is too narrow to rely on.  An empty table gives an empty result;
    other columns are ignored."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                found = [held.value.predict(t.as_py()) for t in part.column(1)]
                langs, scores, sure = zip(*found, strict=True)
                yield pa.record_batch([part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(sure, pa.bool_())], ["doc_id", "lang_pred", "score", "accepted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")
