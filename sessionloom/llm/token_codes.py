"""Token ids in directly addressable codes: files with random access to every token.

An id is cut into chunks of 8 bits.  Level 0 holds the lowest chunk of every id, level
k the next chunk of those that go on, and a bitmap on each level marks the ones that
go on.  A directory with the number of set bits before each 512-bit block gives the
place on the next level with one count, so no block is decoded to reach a token.

File: ``DACT``, version, number of levels, documents (u32 each), tokens (u64); document
ids (i64, with a null bitmap) and starts (u64, one more than documents); then for each
level its length (u64), chunks, bitmap (u64 words) and directory (u64).
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionloom.llm.common import make_dir, scratch_path, ship, staged
from sessionloom.llm.files import write_file
from sessionloom.llm.tokens import encoder

MAGIC = b"DACT"
#: Tokens after which a writer begins another file.
FILE_TOKENS = 8_000_000
_BLOCK = 512


def encode_codes(ids: np.ndarray, doc_ids: list[int | None], starts: np.ndarray) -> bytes:
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 255
        chunks = (rest & 255).astype(np.uint8)
        words = -(-len(rest) // 64)
        bits = np.zeros(words * 8, dtype=np.uint8)
        packed = np.packbits(more, bitorder="little")
        bits[: len(packed)] = packed
        bitmap = bits.view("<u8")
        blocks = -(-words * 64 // _BLOCK)
        counts = np.zeros(blocks * 8, dtype=np.int64)
        counts[:words] = np.bitwise_count(bitmap)
        directory = np.concatenate(([0], np.cumsum(counts.reshape(-1, 8).sum(axis=1)))).astype("<u8")
        levels.append(struct.pack("<Q", len(rest)) + chunks.tobytes() + bitmap.tobytes() + directory.tobytes())
        rest = rest[more] >> 8
        if not len(rest):
            break
    nulls = np.packbits(np.array([x is None for x in doc_ids], dtype=bool), bitorder="little").tobytes()
    names = np.array([0 if x is None else x for x in doc_ids], dtype="<i8").tobytes()
    head = MAGIC + struct.pack("<IIIQ", 1, len(levels), len(doc_ids), len(ids))
    return head + names + nulls + np.asarray(starts, dtype="<u8").tobytes() + b"".join(levels)


class Codes:
    """A file's content."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token file")
        _, n_levels, n_docs, self.n_tokens = struct.unpack_from("<IIIQ", data, 4)
        at = 24
        names = np.frombuffer(data, "<i8", n_docs, at)
        at += 8 * n_docs
        nulls = np.unpackbits(np.frombuffer(data, np.uint8, -(-n_docs // 8), at), count=n_docs, bitorder="little")
        at += -(-n_docs // 8)
        self.doc_ids = [None if z else int(x) for x, z in zip(names, nulls, strict=True)]
        self.starts = np.frombuffer(data, "<u8", n_docs + 1, at)
        at += 8 * (n_docs + 1)
        self.levels = []
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<Q", data, at)
            chunks = np.frombuffer(data, np.uint8, n, at + 8)
            at += 8 + n
            words = -(-n // 64)
            bitmap = np.frombuffer(data, "<u8", words, at)
            at += 8 * words
            blocks = -(-words * 64 // _BLOCK) + 1
            self.levels.append((chunks, bitmap, np.frombuffer(data, "<u8", blocks, at)))
            at += 8 * blocks

    def token(self, i: int) -> int:
        """Token ``i`` alone, by rank."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = shift = 0
        for chunks, bitmap, directory in self.levels:
            value |= int(chunks[i]) << shift
            word, bit = divmod(i, 64)
            here = int(bitmap[word])
            if not here >> bit & 1:
                break
            first = i // _BLOCK * (_BLOCK // 64)
            rank = int(directory[i // _BLOCK]) + sum(int(x).bit_count() for x in bitmap[first:word])
            i = rank + (here & ((1 << bit) - 1)).bit_count()
            shift += 8
        return value

    def tokens(self) -> np.ndarray:
        """All tokens."""
        values = None
        for chunks, bitmap, _ in reversed(self.levels):
            out = chunks.astype(np.uint32)
            if values is not None and len(values):
                more = np.unpackbits(bitmap.view(np.uint8), count=len(chunks), bitorder="little").astype(bool)
                out[more] |= values << 8
            values = out
        return values


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, spaces: bool = False, directory: str | None = None) -> tuple[str, DataFrame]:
    """Encode each text (null: empty), append ``end_id``, write files in doc_id order
    (null first; rows of one doc_id in the order of their texts).

    Gives the folder and its manifest: ``(file, first_token, n_tokens)``.  Only the two
    columns doc_id and text are read.
    """
    spark = docs.sparkSession
    ship(spark)
    directory = make_dir(spark, directory or scratch_path(spark, "tokens"))
    end = struct.pack("<I", end_id)

    def run(batches):
        pid, seq = TaskContext.get().partitionId(), 0
        names, sizes, held = [], [], []
        total = 0
        done = []

        def flush():
            nonlocal seq, names, sizes, held, total
            ids = np.frombuffer(b"".join(held), "<u4")
            starts = np.concatenate(([0], np.cumsum(sizes)))
            name = f"tokens-{pid:06d}-{seq:06d}.dac"
            write_file(directory, name, encode_codes(ids, names, starts))
            done.append((name, pid, seq, len(ids)))
            seq, names, sizes, held, total = seq + 1, [], [], [], 0

        tool = encoder(tokenizer_path, spaces)
        for b in batches:
            ids = b.column(0).to_pylist()
            for at in range(0, len(ids), 512):
                for doc_id, raw in zip(ids[at : at + 512], tool.encode(b.column(1)[at : at + 512].to_pylist()), strict=True):
                    held.append(raw + end)
                    names.append(doc_id)
                    sizes.append(len(raw) // 4 + 1)
                    total += sizes[-1]
                    if total >= FILE_TOKENS:
                        flush()
        if names:
            flush()
        if done:
            f, p, s, n = zip(*done, strict=True)
            yield pa.record_batch([pa.array(f), pa.array(p, pa.int32()), pa.array(s, pa.int32()), pa.array(n, pa.int64())], ["file", "pid", "seq", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sorted_rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    written = staged(sorted_rows.mapInArrow(run, "file string, pid int, seq int, n_tokens long"), "token-manifest")
    # One row for each file of FILE_TOKENS tokens.
    before = W.partitionBy(F.lit(0)).orderBy("pid", "seq").rowsBetween(W.unboundedPreceding, -1)
    return directory, written.select("file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("first_token"), "n_tokens")


def read_token_files(spark, directory: str, manifest: DataFrame, keep_ids: bool = True) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32[, ids])`` of each document in the files."""
    ship(spark)

    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0), b.column(1), strict=True):
                codes = Codes(content.as_py())
                ids = codes.tokens()
                raw, at = memoryview(ids.astype("<u4").tobytes()), codes.starts.astype(np.int64)
                crcs = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(at[:-1], at[1:], strict=True)]
                name = path.as_py().rsplit("/", 1)[-1]
                out = [pa.array(codes.doc_ids, pa.int64()), pa.array(at[:-1]), pa.array(np.diff(at)), pa.array(crcs, pa.int64()), pa.array([name] * len(crcs))]
                if keep_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.record_batch(out, [f"c{i}" for i in range(len(out))])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, file string" + ", ids array<int>" * keep_ids
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.dac").load(directory).select("path", "content")
    found = files.mapInArrow(run, schema).join(manifest.select("file", "first_token"), "file")
    return found.select("doc_id", (F.col("start") + F.col("first_token")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if keep_ids else []))
