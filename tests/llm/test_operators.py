"""The training-data operators against brute force, round trips and held-out labels."""

from __future__ import annotations

import itertools
import math
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from oracle import both, duck
from sessionloom.llm import ann, embed_dedup, html_extract, lm_score, mixing, packing, queries, simhash, token_codes, toxicity, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, component_id string, size string, `rank` int, _id int"
LONG = "word " * 60_000


def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, clashing names."""
    more = ("en", "a", 1, 1, "x", "y", 1, 1)
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "one"), (5, "one two"), (6, LONG), (7, "some words that stand here"), (7, "some words that stand here"), (None, "no id here at all"), (8, "ünïcode   wörds   x"), (9, "\x1c odd \x0b controls")]
    docs = [(i, t, *more) for i, t in rows]
    docs[3] = (*docs[3][:3], None, *docs[3][4:])
    return spark.createDataFrame(docs, DOCS)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def texts(name="documents", cols="doc_id, text"):
    return duck(SF).execute(f"SELECT {cols} FROM {name}").fetchall()


# 1


def test_lattice_sums_over_all_segmentations():
    pieces = ["▁", "▁a", "▁ab", "a", "b", "ab", "ba", "<0xC3>", "<0xA9>"]
    logp = [math.log(p) for p in (0.1, 0.2, 0.05, 0.1, 0.2, 0.1, 0.1, 0.03, 0.02, 0.1)]
    lattice, p = lm_score.Lattice(pieces, logp), dict(zip(pieces, logp, strict=False))
    for word in ("a", "ab", "aba", "abab", "bab"):
        total = 0.0
        full = "▁" + word
        for cuts in itertools.product([0, 1], repeat=len(full) - 1):
            at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(full)]
            parts = [full[x:y] for x, y in itertools.pairwise(at)]
            if all(x in p for x in parts):
                total += math.exp(sum(p[x] for x in parts))
        assert lattice.word(word) == pytest.approx(math.log(total), abs=1e-12)
    assert lattice.word("é") == pytest.approx(p["▁"] + p["<0xC3>"] + p["<0xA9>"])


def test_scores_and_baseline(spark):
    model = public_tokenizers.path("piece_bpe_32k.model")
    for hot in (5, 200_000):
        out = {r.doc_id: r for r in lm_score.lattice_scores(spark.read.parquet(f"{SF}/documents.parquet"), model, hot_words=hot).collect()}
        docs = texts()
        words = {i: [*[w for w in lm_score.words_of(t) if w], ""] for i, t in docs}
        held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in words}
        counts: dict[str, int] = {}
        for i, ws in words.items():
            for w in ws if not held[i] else ():
                counts[w] = counts.get(w, 0) + 1
        n, v = sum(counts.values()), len(counts)
        for i, ws in words.items():
            r = out[i]
            assert (r.held_out, r.n_tokens, r.train_tokens) == (held[i], len(ws), n)
            assert r.n_known == sum(w in counts for w in ws)
            assert r.base_score == pytest.approx(sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in ws))
            assert -1e7 < r.score < 0


def test_words_are_cut_as_bytes():
    text = "Ä\x1cB \t\n\x0b\x0c\rÉa\x85B\u2003C  "
    assert [w.decode() for w in lm_score.words_of(text)] == ["Ä\x1cb", "Éa\x85b\u2003c"] == [w.decode() for w in lm_score.words_of(text.encode())]
    assert lm_score.words_of(None) == lm_score.words_of(" \n") == []
    assert lm_score.short_name(("ä" * 63).encode()) == ("ä" * 63).encode() and lm_score.short_name(b"x" * 64).startswith(b" ")
    long = ("Wörter und WORDS " * 400_000).encode()
    begun = time.process_time()
    parts = lm_score.words_of(long)
    between = time.process_time()
    by_char = long.lower().decode().translate(dict.fromkeys(range(9, 14), " ")).split(" ")
    assert len(parts) == len(by_char) - 1 == 1_200_000 and between - begun < 0.7 * (time.process_time() - between)


def test_lm_odd_input(spark):
    model = public_tokenizers.path("piece_bpe_32k.model")
    rows = lm_score.lattice_scores(odd_docs(spark), model).collect()
    assert len(rows) == 11 and all(math.isfinite(r.score) for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert lm_score.lattice_scores(empty_docs(spark), model).count() == 0


# 2


def brute_links(rows):
    ok = [(i, np.array(v, float), l) for i, v, l in rows if i is not None and l is not None and v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    links, label = {i: 0 for i, *_ in ok}, {i: i for i, *_ in ok}
    edges = [(a[0], b[0]) for a, b in itertools.combinations(ok, 2) if a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= 0.98]
    for a, b in edges:
        links[a] += 1
        links[b] += 1
    for _ in edges:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    return links, label


def test_embedding_dedup(spark):
    rows = duck(SF).execute("SELECT vec_id, embedding, label FROM embeddings").fetchall()
    links, label = brute_links(rows)
    for tile in (7, 1024):
        out = embed_dedup.near_duplicates(spark.read.parquet(f"{SF}/embeddings.parquet"), tile=tile).collect()
        assert len(out) == len(rows)
        for r in out:
            assert (r.n_links, r.component_id, r.kept) == (links.get(r.vec_id, 0), label.get(r.vec_id, r.vec_id), label.get(r.vec_id, r.vec_id) == r.vec_id)


def test_embedding_dedup_gives_its_sql(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "_PRODUCT", 5)
    ours, theirs = both(queries.op2_embedding_dedup(spark, SF), queries.ORACLES["op2_embedding_dedup"], SF)
    assert ours == theirs


def test_embedding_dedup_odd_input(spark):
    schema = "vec_id long, embedding array<float>, label int, rep int, links int, part string"
    nan, inf = float("nan"), float("inf")
    vectors = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], None), (4, [0.0, 0.0], 1), (5, None, 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, [1.0, None], 1), (9, [1.0, 0.0], 2), (10, [1.0, 0.0], 1), (11, [1e-30, 0.0], 1), (12, [], 1)]
    df = spark.createDataFrame([(*v, 1, 1, "p") for v in vectors], schema)
    out = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(df).collect()}
    assert out[1] == (3, 1, True) and out[2] == (3, 1, False) and out[11] == (3, 1, False)
    assert all(out[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 12))
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


# 3


def test_mixing(spark):
    out = queries.op3_source_mixing(spark, SF)
    ours, theirs = both(out, mixing.ORACLE, SF)
    assert ours == theirs
    per: dict = {}
    for r in mixing.mixture(spark.read.parquet(f"{SF}/documents.parquet")).collect():
        assert r.taken <= 3 * r["size"]
        per.setdefault(r.source, [r.target, 0, 0])
        per[r.source][1] += r.taken
        per[r.source][2] = max(per[r.source][2], r["size"])
    assert all(abs(target - taken) <= largest for target, taken, largest in per.values())


def test_mixing_odd_input(spark):
    docs = odd_docs(spark)
    out = mixing.mixture(docs).collect()
    assert len(out) == 11
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in mixed.collect()) == sum(r.taken for r in out)
    assert mixing.mixture(empty_docs(spark)).count() == 0
    assert mixing.mixed_documents(empty_docs(spark)).count() == 0


def test_mixing_narrows_the_range_of_the_end(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SORTED", 1)
    monkeypatch.setattr(mixing, "BUCKETS", 3)
    ours, theirs = both(queries.op3_source_mixing(spark, SF), mixing.ORACLE, SF)
    assert ours == theirs


def test_mixing_takes_some_of_equal_rows(spark):
    """Source a has ten equal rows of three words and lies alone: its target is its size;
    with b's excess it takes more, but never a part of a row."""
    rows = [(1, "x y z", "a", i) for i in range(10)] + [(None, "p q", "b", i) for i in range(45)] + [(i, "w" * 4000, "c", i) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, skey int").repartition(5)
    per: dict = {}
    for r in mixing.mixture(docs).collect():
        t = per.setdefault(r.source, [r.target, 0, r["size"]])
        t[1] += r.taken
        assert r.taken % r["size"] == 0 and r.taken <= 3 * r["size"]
    assert all(abs(t[0] - t[1]) <= t[2] / 2 for t in per.values())
    mixed = mixing.mixed_documents(docs).collect()
    for s, t in per.items():
        assert sum(len(r.text.split()) for r in mixed if r.source == s) == t[1]
    assert {r.skey for r in mixed if r.source == "a"} == set(range(10))


# 4


def plain_fingerprint(text):
    words = bytes(text or "", "utf-8", "surrogatepass").lower().replace(b"\x0b", b" ").split()
    if not words:
        return 0
    k = min(3, len(words))
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(spark):
    docs = texts()
    fps = {i: plain_fingerprint(t) for i, t in docs}
    label = {i: i for i in fps}
    edges = [(a, b) for a, b in itertools.combinations(fps, 2) if (fps[a] ^ fps[b]).bit_count() <= 3]
    for _ in range(10):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    out = queries.op4_simhash_golay(spark, SF).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in out} == {i: (f"{fps[i]:016x}", label[i]) for i in fps}
    kept = simhash.keep_one(spark.read.parquet(f"{SF}/documents.parquet"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(label.values()))


def test_golay_keys_meet_within_three_bits():
    rng = np.random.default_rng(1)
    base = rng.integers(-(1 << 63), 1 << 63, 2000, dtype=np.int64)
    for bits in range(4):
        other = base.copy().view(np.uint64)
        for k in range(len(other)):
            for b in rng.choice(64, bits, replace=False):
                other[k] ^= np.uint64(1) << np.uint64(b)
        r1, k1 = simhash.golay_keys(base, False)
        r2, k2 = simhash.golay_keys(other.view(np.int64), True)
        a, b = set(zip(r1.tolist(), k1.tolist(), strict=True)), set(zip(r2.tolist(), k2.tolist(), strict=True))
        assert {r for r, _ in a & b} == set(range(len(base)))


def test_simhash_odd_input(spark):
    out = simhash.near_duplicates(odd_docs(spark)).collect()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r.component_id)
    assert by[1] == by[2] == by[3] == [1] and by[7] == [7, 7] and len(out) == 11
    kept = simhash.keep_one(odd_docs(spark))
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 4, 5, 6, 7, 8, 9, None]
    assert simhash.near_duplicates(empty_docs(spark)).count() == 0


# 5


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def tokenizer(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_token_files(spark):
    encode, start, want = tokenizer("word_bpe_49k.json"), 0, set()
    for i, t in sorted(texts()):
        ids = [*encode(t), 2]
        want.add((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert {(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in queries.op5_token_codes(spark, SF).collect()} == want


@pytest.mark.parametrize(("name", "spaces"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_special_strings_get_the_library_ids(name, spaces):
    from sessionloom.llm.tokens import Encoder
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    rows = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y  <|startoftext|>\n z", "  <|endoftext|>  "]
    plain = Tokenizer.from_file(path)
    got = [np.frombuffer(x, "<u4").tolist() for x in Encoder(path, spaces).encode(rows)]
    assert got == [plain.encode(x, add_special_tokens=False).ids for x in rows]


def test_any_token_is_addressable():
    ids = np.random.default_rng(3).integers(0, 1 << 17, 5000).astype(np.uint32)
    ids[::3] %= 256
    codes = token_codes.Codes(token_codes.encode_codes(ids, [None, 5], np.array([0, 2000, 5000])))
    assert codes.tokens().tolist() == ids.tolist() and codes.doc_ids == [None, 5]
    assert all(codes.token(i) == ids[i] for i in range(0, 5000, 7))
    assert token_codes.Codes(token_codes.encode_codes(np.zeros(0, np.uint32), [], np.array([0]))).tokens().tolist() == []


def test_token_files_odd_input(spark):
    path, encode = public_tokenizers.path("word_bpe_49k.json"), tokenizer("word_bpe_49k.json")
    docs = odd_docs(spark)
    out = token_codes.read_token_files(spark, *token_codes.write_token_files(docs, path, 2)).collect()
    assert sorted((str(r.doc_id), r.ids) for r in out) == sorted((str(r.doc_id), [*encode(r.text), 2]) for r in docs.collect())
    assert token_codes.read_token_files(spark, *token_codes.write_token_files(empty_docs(spark), path, 2)).count() == 0


# 6


def test_warc(spark):
    ours, theirs = both(queries.op6_warc_dictionary(spark, SF), queries.ORACLES["op6_warc_dictionary"], SF)
    assert ours == theirs


def test_warc_odd_input(spark):
    big = "<p>" + "x y " * 100_000
    rows = [(1, "u", None), (2, "u", ""), (3, None, big), (4, "u\r\nX: y", big), (None, "n", big), (5, "u", "short"), (6, "u", "short")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    directory, manifest = warc.write_archives(pages)
    out = {r.page_id: r for r in warc.read_archives(spark, directory).collect()}
    assert manifest.agg({"n_records": "sum"}).first()[0] == 7
    assert out[3].payload == big.encode() and out[4].refers_to == out[None].refers_to == 3 and out[6].record_type == "response"
    # A page in two equal rows is a response twice; its copies refer to the page, not to one record.
    twice, _ = warc.write_archives(spark.createDataFrame([(1, "u", big), (1, "u", big), (2, "v", big)], "page_id long, url string, html string"), date="2024-01-01T00:00:00Z")
    again = sorted((r.page_id, r.record_type, r.refers_to) for r in warc.read_archives(spark, twice).collect())
    assert again == [(1, "response", None), (1, "response", None), (2, "revisit", 1)]
    empty, _ = warc.write_archives(pages.limit(0))
    assert warc.read_archives(spark, empty).count() == 0


def test_records_are_complete(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", "<p>" + "same text " * 40 + str(i // 2)) for i in range(20)] + [(1, "http://x/1", "again")], "page_id long, url string, html string")
    directory, _ = warc.write_archives(pages)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(directory).select("content").collect()
    fields = [warc.parse_record(raw)[0] for f in files for raw in warc.records_of(bytes(f.content))]
    ids = {x["WARC-Record-ID"] for x in fields}
    assert len(ids) == len(fields) == 21
    assert all(re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", x["WARC-Date"]) and re.fullmatch(r"<urn:uuid:[-0-9a-f]{36}>", x["WARC-Record-ID"]) for x in fields)
    revisits = [x for x in fields if x["WARC-Type"] == "revisit"]
    assert len(revisits) == 10 and all(x["WARC-Refers-To"] in ids and x["WARC-Refers-To-Target-URI"] for x in revisits)


@pytest.mark.parametrize("n", [1, 2, 5])
def test_small_archives_have_a_dictionary_too(n):
    records = [f"WARC/1.1\r\nWARC-Record-ID: {i}\r\nContent-Length: 5\r\n\r\nab{i}de".encode() for i in range(n)]
    data = warc.archive(records)
    assert data[:4] == warc.struct.pack("<I", warc.SKIPPABLE) and list(warc.records_of(data)) == records
    assert warc.archive([]) == b"" and list(warc.records_of(b"")) == []


def test_archive_starts_with_its_dictionary():
    records = [warc.record(warc.record_id(i), "2024-01-01T00:00:00Z", i, "http://x", b"<html>" + b"same words " * 40 + str(i).encode(), "0" * 64) for i in range(200)]
    records[3] = warc.record(warc.record_id(3), "2024-01-01T00:00:00Z", 3, "http://x", b"q" * 9_000_000, "0" * 64)
    data = warc.archive(records)
    assert int.from_bytes(data[:4], "little") == warc.SKIPPABLE
    assert list(warc.records_of(data)) == records
    assert len(data) < sum(map(len, records[:3] + records[4:])) / 3


# 7


def check_packing(rows, capacity=1024):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for members in by.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing(spark):
    rows = queries.op7_bin_completion(spark, SF).collect()
    bins = check_packing(rows)
    assert bins <= math.ceil(sum(r.length for r in rows) / 1024) * 1.01 + 1
    encode = tokenizer("byte_bpe_50k.json")
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    for i, t in texts():
        ids, got = [*encode(t), 2], sorted(pieces[i], key=lambda r: r.piece)
        assert [r.piece for r in got] == list(range(len(got))) and all(r.length == 1024 for r in got[1:])
        assert all(r.ids_crc32 == crc(ids[r.start : r.start + r.length]) for r in got) and sum(r.length for r in got) == len(ids)


def test_bin_completion_is_optimal_on_small_cases():
    rng = np.random.default_rng(5)

    def fewest(lengths, capacity):
        best = len(lengths)

        def place(i, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if i == len(lengths):
                best = len(bins)
                return
            for k in range(len(bins)):
                if bins[k] + lengths[i] <= capacity and bins[k] not in bins[:k]:
                    place(i + 1, [*bins[:k], bins[k] + lengths[i], *bins[k + 1 :]])
            place(i + 1, [*bins, lengths[i]])

        place(0, [])
        return best

    for _ in range(25):
        lengths = sorted(rng.integers(2, 20, 9).tolist(), reverse=True)
        counts = {x: lengths.count(x) for x in lengths}
        plan = packing.complete_bins(counts, 20)
        used = {}
        for content, times in plan:
            assert sum(content) <= 20
            for x in content:
                used[x] = used.get(x, 0) + times
        assert used == counts and sum(t for _, t in plan) == fewest(lengths, 20)


def test_packing_odd_input(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = packing.packed(odd_docs(spark), path, 2).collect()
    check_packing(rows)
    assert sorted(str(r.doc_id) for r in rows if r.piece == 0) == sorted(str(r.doc_id) for r in odd_docs(spark).collect())
    assert packing.packed(empty_docs(spark), path, 2).count() == 0


# 8


def test_nearest_neighbours(spark):
    v = [(i, np.array(x, float)) for i, x in duck(SF).execute("SELECT vec_id, embedding FROM embeddings ORDER BY 1").fetchall() if x is not None and None not in x and np.isfinite(np.array(x, float)).all() and np.any(x)]
    ids, x = np.array([i for i, _ in v]), np.stack([e for _, e in v])
    out = {}
    for r in queries.op8_nn_descent(spark, SF).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits = total = 0
    for q in ids[ids % 100 == 0].tolist():
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        for i, score in out[q]:
            assert i != q and score == pytest.approx(d[ids == i][0], abs=1e-12)
        assert out[q] == sorted(out[q], key=lambda r: (r[1], r[0])) and len(out[q]) == 10
        true = [i for i in ids[np.lexsort((ids, d))].tolist() if i != q][:10]
        hits, total = hits + len({i for i, _ in out[q]} & set(true)), total + 10
    assert hits / total >= 0.9


def test_clusters_without_pivots(spark):
    rng = np.random.default_rng(3)
    x = (np.repeat(rng.standard_normal((60, 16)) * 20, 40, axis=0) + rng.standard_normal((2400, 16)) * 0.1).astype(np.float32)
    nodes = ann.nodes_of(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).localCheckpoint()
    asked = nodes.where("node % 40 = 7").select(nodes.node.alias("query_id"), "vec")
    out = {r.query_id: r.found[1:11] for r in ann.search(asked, nodes, ann.neighbour_graph(nodes), pivots=16).collect()}
    hits = 0
    for q, found in out.items():
        d = ((x.astype(float) - x[q]) ** 2).sum(axis=1)
        hits += len(set(np.argsort(d)[1:11].tolist()) & set(found))
    assert len(out) == 60 and hits / 600 >= 0.95, hits


def test_lists_grow_until_the_nearest_are_met(spark):
    x = np.random.default_rng(11).standard_normal((1500, 48)).astype(np.float32)
    nodes = ann.staged(ann.nodes_of(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")), "test-nodes")
    asked = nodes.where("node % 10 = 0").select(nodes.node.alias("query_id"), "vec")
    graph = ann.staged(ann.neighbour_graph(nodes, degree=4, changed=0.2).select("node", "other", "dist"), "test-graph")
    hits = 0
    for r in ann.search(asked, nodes, graph, beam=12, expanded=12, pivots=4).collect():
        d = ((x.astype(float) - x[r.query_id]) ** 2).sum(axis=1)
        hits += len(set(np.argsort(d)[1:11].tolist()) & set(r.found[1:11]))
    assert hits / 1500 >= 0.93, hits


def test_links_that_no_neighbour_tells_of(spark):
    x = np.random.default_rng(13).standard_normal((4000, 48)).astype(np.float32)
    nodes = ann.staged(ann.nodes_of(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")), "test-nodes")
    near, _ = ann._closest(x, 8)
    links = {(r.node, r.other) for r in ann.neighbour_graph(nodes, degree=8).collect()}
    assert len(links) == 8 * 4000
    assert len(links & {(i, j) for i, row in enumerate(near.tolist()) for j in row}) / len(links) >= 0.9


def test_nearest_odd_input(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (None, [1.0, 1.0]), (100, [0.5, 0.5])]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "vec_id long, embedding array<float>, node int, dist string")
    out = ann.nearest(df, lambda i: i % 100 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in out] == [(0, 1, 1), (0, 2, 100), (0, 3, 2), (100, 1, 0), (100, 2, 1), (100, 3, 2)]
    assert ann.nearest(df.limit(0), lambda i: i % 100 == 0).count() == 0


# 9


def test_toxicity_on_held_out_labels(spark):
    out = {r.doc_id: r for r in queries.op9_toxicity(spark, "/root/testdata/sf0.01").collect()}
    labels = duck("/root/testdata/sf0.01").execute("SELECT doc_id, toxic FROM labels WHERE toxic IS NOT NULL").fetchall()
    pairs = [(out[i].score, t) for i, t in labels if i in out and out[i].held_out]
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in out.values())
    good, bad = [s for s, t in pairs if t], [s for s, t in pairs if not t]
    assert sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad)) > 0.7


def planted(spark, n=600):
    rng = np.random.default_rng(11)
    words = ["".join(x) for x in rng.choice(list("aeioulnrst"), (300, 5))]
    docs, labels = [], []
    for i in range(n):
        text = [str(w) for w in rng.choice(words, 60)]
        if i % 4 == 0:
            text[10:10] = ["zorkface", "blethead", "gruntpig"]
            text[40:40] = ["zorkface"]
        docs.append((i, " ".join(text)))
        labels.append((i, int(i % 4 == 0)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_finds_planted_words(spark):
    docs, labels = planted(spark)
    out = toxicity.scored(docs, toxicity.fit(docs, labels)).collect()
    assert all(r.predicted == int(r.doc_id % 4 == 0) for r in out)
    assert {r.doc_id for r in toxicity.without_toxic(docs, labels).collect()} == {i for i in range(600) if i % 4}


def test_window_differences_are_plain_compression_lengths():
    import zstandard as z

    toxic = [f"well {w} you rotten liar and go away {i}" for i, w in enumerate("then so yes no ok fine sure right".split() * 4)]
    clean = [f"the weather in town {i} is fine for a walk along the river" for i in range(60)]
    model = toxicity.train([(i, t, 1) for i, t in enumerate(toxic)] + [(100 + i, t, 0) for i, t in enumerate(clean)])
    text = "you rotten liar the weather in town"
    parts = [b" you rotten liar ", b" the weather in ", b" town "]
    assert toxicity.windows(text) == parts

    def length(part, dictionary):
        params = z.ZstdCompressionParameters(strategy=z.STRATEGY_LAZY2, min_match=4, window_log=15, hash_log=13, chain_log=13, search_log=4, target_length=16, write_content_size=0, write_checksum=0, write_dict_id=0)
        return len(z.ZstdCompressor(compression_params=params, dict_data=z.ZstdCompressionDict(dictionary, dict_type=z.DICT_TYPE_RAWCONTENT)).compress(part))

    carrier = model.ordinary[-toxicity.CARRIER :]
    plain = [length(carrier + p, model.ordinary) - length(carrier + p, model.toxic) for p in parts]
    assert model.differences(parts).tolist() == plain and plain[0] > max(plain[1:])


def test_toxicity_odd_input(spark):
    _, labels = planted(spark)
    docs = odd_docs(spark)
    model = toxicity.fit(docs, labels)
    assert toxicity.scored(docs, model).count() == 11
    assert toxicity.scored(empty_docs(spark), toxicity.fit(empty_docs(spark), labels.limit(0))).count() == 0
    assert toxicity.without_toxic(docs, labels.limit(0)).columns == docs.columns


def fitted_rows(monkeypatch, *args, **more):
    monkeypatch.setattr(toxicity, "train", lambda rows: rows)
    return {text: toxic for _, text, toxic in toxicity.fit(*args, **more)}


def test_toxicity_trains_on_every_distinct_text(spark, monkeypatch):
    kept = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 4 != 2][:120]
    head = "the licence of this source says that all of its texts begin with the very same long line of words " * 2
    docs = [(i, "a copy" if n < 60 else f"{head} and then {n}") for n, i in enumerate(kept)]
    labels = [(i, int(n in (59, 90, 100))) for n, i in enumerate(kept)]
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    rows = fitted_rows(monkeypatch, docs, labels)
    assert len(rows) == 61 and {t for t, x in rows.items() if x} == {"a copy", f"{head} and then 90", f"{head} and then 100"}
    # Copies don't use up the sample.
    assert len(fitted_rows(monkeypatch, docs, labels, sample_docs=61)) == 61


def test_one_long_text_does_not_end_the_sample(spark, monkeypatch):
    kept = [i for i in range(100) if zlib.crc32(str(i).encode()) % 4 != 2][:20]
    for long in kept[::5]:
        docs = spark.createDataFrame([(i, "x" * 5000 if i == long else f"short {i}") for i in kept], "doc_id long, text string")
        rows = fitted_rows(monkeypatch, docs, spark.createDataFrame([(i, 0) for i in kept], "doc_id long, toxic int"), sample_chars=1000)
        assert set(rows) == {f"short {i}" for i in kept if i != long}


@pytest.mark.parametrize("every", [4, 80])
def test_toxic_phrases_of_ordinary_words(every):
    rng = np.random.default_rng(5)
    words = ["".join(x) for x in rng.choice(list("aeioulnrst"), (300, 5))]
    rows = []
    for i in range(600):
        text = [str(w) for w in rng.choice(words, 60)]
        if i % every == 0:
            text[10:15] = text[40:45] = words[7:12]
        rows.append((i, " ".join(text), int(i % every == 0)))
    model = toxicity.train(rows[:400])
    out = model.score([r[1] for r in rows[400:]])
    assert [int(x >= 0.3) for x in out] == [r[2] for r in rows[400:]]


# 10

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies here</div><article><h1>A &amp; B</h1><p>First&nbsp;block of   some
words.</p><script>var x = "<p>no</p>";</script><p>Second <b>block</b> &lt;here&gt;.</p><aside>Related things</aside></article>
<div class="comments"><p>Nice post, said a reader with many many words in a row</p></div><footer>Imprint</footer></body></html>"""


def test_main_text(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 1), (2, "v", None, 1), (3, None, "", 1), (4, "w", "<p>unclosed <b>text", 1), (5, "x", "<nav>only a menu</nav>", 1), (6, "y", "plain words", 1)], "page_id long, url string, html string, text int")
    out = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract(pages).collect()}
    want = "A & B\n\nFirst block of some words.\n\nSecond block <here>."
    assert out[1] == (want, len(want)) and out[2] == out[3] == out[5] == ("", 0)
    assert out[4][0] == "unclosed text" and out[6][0] == "plain words"
    assert html_extract.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    "page",
    [
        "<body class='page has-sidebar comments-open'><nav>Menu of it</nav><article>{}</article></body>",
        "<body><div class='layout with-sidebar'><article>{}</article><div class=sidebar>Other things</div></div></body>",
        "<body><main class='widget-area'>{}<div class=share>Share it</div></main></body>",
        "<body><article class='post comments-open'>{}</article><div class=comments><article class=comment>Nice one</article></div></body>",
        "<body><form id=aspnet><div><article>{}</article></div><footer>Imprint</footer></form></body>",
        "<body><main><article class='post comments-open'>{}</article><article class=related>Other text</article></main></body>",
        "<body><div class='layout with-sidebar'><nav>Menu of it</nav><div>{}</div></div></body>",
    ],
)
def test_wrappers_are_content(page):
    text = "Some words of the text stand here and go on for a while. " * 3
    assert html_extract.main_text(page.format(f"<p>{text}</p>"), html_extract.DEFAULT_WEIGHTS) == text.strip()


def test_other_articles_are_no_part_of_the_text():
    text = "Some words of the text stand here and go on for a while. " * 3
    card = "<article><div><div><a href=x>A teaser</a></div></div></article>" + "<div><img></div>" * 9
    page = f"<body>{card}<article><h1>Title</h1><p>{text}</p></article>{'<div><img></div>' * 9}{card}</body>"
    assert html_extract.main_text(page, html_extract.DEFAULT_WEIGHTS) == f"Title\n\n{text.strip()}"


def test_deep_and_unclosed_markup_takes_linear_time():
    w = html_extract.DEFAULT_WEIGHTS
    start = time.perf_counter()
    for page in ("<div><b>" * 20_000 + "text" + "</i>" * 20_000, "<article>" * 20_000 + "word " + "<article>x</article>" * 3_000, "<table>" + "<b>" * 20_000 + "<tr></tr>" * 20_000):
        html_extract.main_text(page, w)
    assert time.perf_counter() - start < 20  # seconds; squared work takes minutes
    assert html_extract.main_text("<article>" + "<div>" * 3_000 + "some words here", w) == "some words here"


def test_weights_count_a_page_once(spark):
    page = "<nav>a b</nav><article><p>some more words here</p></article><p>x</p>"
    one = spark.createDataFrame([(1, page)], "page_id long, html string")
    many = spark.createDataFrame([(i, page) for i in range(50)] + [(50, None), (51, "no marks")], "page_id long, html string").repartition(5)
    assert html_extract.fit_weights(one) == html_extract.fit_weights(many)
    assert html_extract.fit_weights(one.limit(0)) == html_extract.DEFAULT_WEIGHTS


TEXT = "Some words of the text stand here and go on for a while. " * 12


@pytest.mark.parametrize(
    "page",
    [
        "<body><article>Five words of a teaser</article><div>{}</div></body>",
        "<body><nav><a href=x>Home</a></nav><div><article class=card><a href=y>Read on</a></article></div><div id=page>{}</div><footer>Imprint</footer></body>",
        "<body><div class=header>Name</div><div>{}</div><div class=sidebar><a href=x>One</a> <a href=y>Two</a></div></body>",
        "<body><header>Name</header>{}<ul class='nav'><li><a href=x>One</a><li><a href=y>Two</a></ul></body>",
    ],
)
def test_pages_whose_articles_are_missing_or_elsewhere(page):
    # The scan may take in a few words beside the text, but never leaves the text for them.
    text = html_extract.main_text(page.format(f"<p>{TEXT}</p>"), html_extract.DEFAULT_WEIGHTS)
    assert text.endswith(TEXT.strip()) and len(text) <= len(TEXT) + 30


@pytest.mark.parametrize("opening", ["section id=related-work", "div id=reply-to-critics", "p class=notice-of-motion", "div class='social-theory long'", "math"])
def test_names_that_only_hold_such_words_are_content(opening):
    text = f"Before it.\n\n{TEXT.strip()}\n\nAfter it." if opening != "math" else f"Before it.{TEXT.rstrip()}After it."
    name = opening.split()[0]
    page = f"<article><p>Before it.</p><{opening}>{TEXT}</{name}><p>After it.</p></article>"
    if opening == "math":
        page = f"<article><p>Before it.<math>{TEXT.rstrip()}<annotation>TeX</annotation></math>After it.</p></article>"
    assert html_extract.main_text(page, html_extract.DEFAULT_WEIGHTS) == text


@pytest.mark.parametrize("name", ["comments", "cookie-notice", "related-posts", "newsletter-box", "shareButtons", "comments comment-list", "promo banner", "sponsored-links"])
def test_blocks_with_such_names_are_no_content(name):
    page = f"<article><p>{TEXT}</p><div class='{name}'><p>{'Other words that stand there. ' * 9}</p></div><p>End.</p></article>"
    assert html_extract.main_text(page, html_extract.DEFAULT_WEIGHTS) == f"{TEXT.strip()}\n\nEnd."
    links = f"<article><p>{TEXT}</p><div id='see-also-related'><a href=x>One of them</a> or <a href=y>the other one</a></div></article>"
    assert html_extract.main_text(links, html_extract.DEFAULT_WEIGHTS) == TEXT.strip()


@pytest.mark.parametrize("seed", range(12))
def test_the_scan_equals_all_contiguous_runs(seed):
    rng = np.random.default_rng(seed)
    weights = {"word": 1.0, "link": 0.3, "tag": -1.5, "tag:b": -0.4}
    parts = []
    for i in range(int(rng.integers(2, 9))):
        body = " ".join(f"w{i}x{j}" for j in range(int(rng.integers(0, 9))))
        parts.append(str(rng.choice([f"<div>{body}</div>", f"<div><b>{body}</b></div>", f"<div><a href=x>{body}</a></div>", "<div><i></i><i></i></div>", f"<nav>{body}</nav>"])))
    row, _ = html_extract.items("<body>" + "".join(parts) + "</body>")

    def score(x):
        kind, value, out, _, link = x
        if out or kind == "break":
            return 0.0
        return weights.get("tag:" + value.removeprefix("/"), weights["tag"]) if kind == "tag" else len(value.split()) * weights["link" if link else "word"]

    runs = {(a, b): sum(map(score, row[a:b])) for a in range(len(row)) for b in range(a + 1, len(row) + 1)}
    best = max(runs.values())
    text = html_extract.main_text("<body>" + "".join(parts) + "</body>", weights)
    if best <= 0:
        assert text == ""
        return
    # The text is one best run, its first and last block whole.
    whole = set()
    for (a, b), s in runs.items():
        if abs(s - best) < 1e-9:
            while a > 0 and row[a - 1][0] != "break":
                a -= 1
            while b < len(row) and row[b][0] != "break":
                b += 1
            blocks = "".join("\n" if x[0] == "break" else x[1] if x[0] == "text" and not x[2] else "" for x in row[a:b]).split("\n")
            whole.add("\n\n".join(" ".join(x.split()) for x in blocks if x.split()))
    assert text in whole


def test_scan_finds_the_best_contiguous_run():
    page = "<div><a>x</a><a>y</a></div><div>" + "good words stand here " * 10 + "</div><div><a>z</a></div>"
    text = html_extract.main_text(page, html_extract.DEFAULT_WEIGHTS)
    assert text == ("good words stand here " * 10).strip()


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs = out
    rows = corpus_pipeline.run(spark, SF).collect()
    check_packing(rows)
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
