"""Language identification, whitening and collocations against brute force and odd input."""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from oracle import both, duck
from sessionloom.llm import collocations, language_id, queries, whitening
from test_operators import DOCS, SF, empty_docs, odd_docs

# 11


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = dict(duck(SF).execute("SELECT doc_id, lang FROM documents").fetchall())
    rows = queries.op11_language_id(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(truth) and len(rows) == len(truth) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) >= 0.95
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held if r.accepted]) >= 0.97


def test_choice_is_the_smallest_compressed_size():
    import zstandard as z

    texts = {"xa": [b"lorem ipsum dolor sit amet " * 3, b"amet sit dolor ipsum lorem"] * 3, "xb": [b"un deux trois quatre cinq six " * 3, b"six cinq quatre trois deux"] * 3}
    model = language_id.train(texts, ["xa", "xb"])
    for text in (b"dolor sit amet", b"quatre cinq six " * 200):
        parts = [text[i : i + language_id.WINDOW] for i in range(0, len(text), language_id.WINDOW)]
        params = z.ZstdCompressionParameters(strategy=z.STRATEGY_LAZY2, min_match=4, window_log=17, hash_log=15, chain_log=15, search_log=5, target_length=32, write_content_size=0, write_checksum=0, write_dict_id=0)
        plain = [sum(len(z.ZstdCompressor(compression_params=params, dict_data=z.ZstdCompressionDict(d + model.carrier, dict_type=z.DICT_TYPE_RAWCONTENT)).compress(model.carrier + b" " + p + b" ")) for p in parts) for d in model.dictionaries]
        assert model._sizes(parts).tolist() == plain
        assert model.choice(text)[0] == int(np.argmin(plain))
    assert model.predict("LOREM, ipsum!")[0] == "xa" and model.predict("trois... deux")[0] == "xb"
    assert model.predict("123 !?") == model.predict(None) == model.predict("") == ("und", 0.0, False)


def test_language_odd_input(spark):
    for docs in (odd_docs(spark), odd_docs(spark).withColumn("lang", docs_lang())):
        rows = language_id.predicted(docs, language_id.fit(docs)).collect()
        assert len(rows) == 11 and {r.lang_pred for r in rows if r.doc_id in (1, 2, 3)} == {"und"}
        assert len({(r.lang_pred, r.score) for r in rows if r.doc_id == 7}) == 1
    empty = empty_docs(spark)
    assert language_id.predicted(empty, language_id.fit(empty)).count() == 0
    nothing = language_id.predicted(odd_docs(spark), language_id.fit(empty)).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}


def docs_lang():
    from pyspark.sql import functions as F

    return F.when(F.col("doc_id") < 6, F.lit("aa")).when(F.col("doc_id") < 8, F.lit("bb"))


def test_language_sample_counts_copies_once(spark):
    copies = [(i, "copied words of one language", "aa", "s", 1, 1, "x", "y", 1, 1) for i in range(300)]
    others = [(1000 + i, f"other{chr(97 + i % 26)} word{chr(97 + i // 26)}", "bb", "s", 1, 1, "x", "y", 1, 1) for i in range(200)]
    model = language_id.fit(spark.createDataFrame(copies + others, DOCS))
    assert model.langs == ["aa", "bb"] and model.dictionaries[0].count(b"copied") == 1
    assert len(language_id.excerpt(b"x" * 10**6)) <= language_id.EXCERPT + 7


# 12


def brute_whitening(rows):
    """``{vec_id: (deviation, projections)}``, eigenvalues and n, all in plain numpy."""
    x = [(i, np.floor(64 * np.array(v, float)).astype(np.int64) + 1_000_000) for i, v in rows]
    u = np.unique(np.array([v for _, v in x]), axis=0)
    n, s = len(u), u.sum(axis=0)
    e, q = np.linalg.eigh(np.cov((u - s / n).T, bias=True))
    e, q = e[::-1], q[:, ::-1]
    return [(i, int(((n * v - s) ** 2).sum()), ((v - s / n) @ q) / np.sqrt(np.maximum(e, 1e-30))) for i, v in x], e, n


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], "vec_id long, embedding array<float>, label int, x string, n int")


@pytest.mark.parametrize(("d", "n"), [(5, 40), (33, 200), (70, 300)])
def test_whitening(spark, monkeypatch, d, n):
    monkeypatch.setattr(whitening, "ENTRIES", 16 * d)  # several row blocks
    rng = np.random.default_rng(d)
    data = (rng.normal(size=(n, d)) * np.linspace(0.3, 3, d) + 5).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(data)] + [(n, data[0].tolist()), (n + 1, data[0].tolist())]
    theirs, e, k = brute_whitening(rows)
    got: dict = {}
    for r in whitening.whitened(vectors(spark, rows)).collect():
        got.setdefault(r.vec_id, {})[r.component] = r
    parts = min(16, d)
    assert len(got) == n + 2 and all(set(g) == set(range(1, parts + 1)) for g in got.values())
    signs = np.sign([theirs[0][2][c] * got[0][c + 1].whitened for c in range(parts)])
    for i, deviation, z in theirs:
        assert (got[i][1].deviation, got[i][1].n) == (deviation, k == n and n)
        assert np.allclose(z[:parts] * signs, [got[i][c + 1].whitened for c in range(parts)], atol=1e-9)
    assert np.allclose([got[0][c + 1].explained for c in range(parts)], e[:parts] / e.sum(), rtol=1e-9)
    assert 0 <= got[0][1].identity_error < 1e-9


def test_whitening_odd_input(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [1.0, nan]), (4, [inf, 0.0]), (5, [None, 1.0]), (6, [0.0, 0.0]), (7, [1.0, 2.0]), (8, [1.0, 2.0]), (None, [3.0, 1.0]), (9, [1.0, 2.0, 3.0])]
    out = whitening.whitened(vectors(spark, rows)).collect()
    assert {r.vec_id for r in out} == {6, 7, 8, None} and {r.n for r in out} == {3}
    assert len(out) == 8
    assert whitening.whitened(vectors(spark, [])).count() == 0
    assert whitening.whitened(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    assert {r.component for r in whitening.whitened(vectors(spark, [(1, [1.0, 2.0]), (2, [2.0, 2.0])])).collect()} == {1}
    huge = whitening.whitened(vectors(spark, [(1, [3e38, 2.0]), (2, [2.0, -3e38]), (3, [0.0, 1.0])])).collect()
    assert {r.vec_id for r in huge} == {1, 2, 3} and all(np.isfinite(r.whitened) for r in huge)


# 13


def brute_phrases(docs, least):
    """Counts by the plain rule: ``{lang: n}``, ``{(lang, words): f}`` and the result's rows."""
    n, f = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    cands = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    rows: dict = {}
    for (lang, w), a in cands.items():
        inside = any(x == lang and len(v) > len(w) and 100 * b >= 100 * a and any(v[i : i + len(w)] == w for i in range(len(v))) for (x, v), b in cands.items())
        if not inside:
            score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            rows.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return n, {(lang, i): (p.decode(), -a, left, right, n[lang], -s) for lang, each in rows.items() for i, (s, a, p, left, right) in enumerate(sorted(each)[:2000], 1)}


def as_docs(spark, docs):
    return spark.createDataFrame([(i, t, lang, "s", 1, 1, "x", "y", 1, 1) for i, (t, lang) in enumerate(docs)], DOCS)


def phrases_of(df):
    return {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect()}


@pytest.mark.parametrize("least", [2, 4])
def test_collocations(spark, monkeypatch, least):
    rng = np.random.default_rng(least)
    words = ["a", "B", "c", "dé", "ß.x", "the", "THE\x1cq", "a b", "x" * 300]
    joins = [" ", "  ", "\t", ", ", "\n", ". ", " ; "]
    docs = [("".join(words[i] + joins[j] for i, j in zip(rng.integers(0, len(words), 60), rng.choice(len(joins), 60, p=[0.6, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05]), strict=True)), ["en", "fr", None][k % 3]) for k in range(30)]
    docs += [docs[0], (None, "en"), ("", None), ("a a a a a a a", "de"), ("...", "de")]
    _, want = brute_phrases(docs, least)
    assert len(want) > 100
    assert phrases_of(collocations.collocations(as_docs(spark, docs), least)) == want
    # Several automata, and a sketch too narrow to tell much apart.
    for name, value in (("SHARD_BYTES", 3000), ("LEAST_CELLS", 2048), ("MOST_CELLS", 2048)):
        monkeypatch.setattr(collocations, name, value)
    assert phrases_of(collocations.collocations(as_docs(spark, docs), least)) == want


def test_texts_are_cut_between_pieces(monkeypatch):
    import pyarrow as pa

    texts = ["Aa bb, cc dd ee. ff " * 30, None, "", "x y z " * 40, "one", ". , ;"]
    batch = pa.record_batch([pa.array(["en", "fr", "en", "fr", "en", "en"]), pa.array(texts)], ["lang", "text"])

    def found():
        out = Counter()
        for words, langs in collocations._taken_apart(batch):
            seeds = collocations._seeds(langs)
            for k, _, which in collocations._alive(words, seeds, {}, 40):
                out.update((langs[words.text[i]], words.phrase(i, k)) for i in np.flatnonzero(which).tolist())
        return out

    whole = found()
    monkeypatch.setattr(collocations, "CHUNK", 48)
    assert found() == whole
    assert whole["en", "aa bb"] == 30 and whole["en", "ff aa"] == 29 and whole["fr", "x y z"] == 40 and ("en", "bb cc") not in whole


def test_collocations_give_their_sql(spark):
    ours, theirs = both(queries.op13_collocations(spark, SF), queries.ORACLES["op13_collocations"], SF)
    assert ours == theirs


def test_collocations_odd_input(spark):
    assert collocations.collocations(empty_docs(spark)).count() == 0
    odd = odd_docs(spark)
    assert phrases_of(collocations.collocations(odd)) == brute_phrases([(r.text, r.lang) for r in odd.collect()], 100)[1]
    same = as_docs(spark, [("one two", "en")] * 150)
    assert phrases_of(collocations.collocations(same)) == {("en", 1): ("one two", 150, 150, 150, 300, 2000)}


def test_only_the_first_phrases_of_a_language(spark):
    docs = [(f"w{i} v{i}", lang) for i, lang in itertools.product(range(40), ("en", "fr"))] * 2
    got = phrases_of(collocations.collocations(as_docs(spark, docs), 2, top=5))
    assert sorted(got) == [(x, i) for x in ("en", "fr") for i in range(1, 6)]
    assert [got["en", i][0] for i in range(1, 6)] == ["w0 v0", "w1 v1", "w10 v10", "w11 v11", "w12 v12"]
