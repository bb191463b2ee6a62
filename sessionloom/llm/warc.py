"""WARC archives of zstandard frames with a dictionary in front.

Each archive begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary,
then one frame for each record, so a record can be read with its offset and the
dictionary alone.  Every archive's dictionary is built from records of its own, taken
evenly from all of it.  Records are WARC/1.1: a response's block is an HTTP response with
the payload as its body; a revisit has no block.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from datetime import UTC, datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import make_dir, scratch_path, ship, staged
from sessionloom.llm.files import write_file

SKIPPABLE = 0x184D2A5D
#: Payload bytes of an archive; bytes, records and bytes of each record that its dictionary
#: is built from; the dictionary's size.
ARCHIVE_BYTES, SAMPLE_BYTES, SAMPLE_RECORDS, SAMPLE_EACH, DICTIONARY_BYTES = 32 << 20, 4 << 20, 1000, 64 << 10, 64 << 10
#: Smaller payloads are always stored.
LEAST_REVISIT = 100
LEVEL = 3


_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_IDS = uuid.UUID("5f0d7c1e-6f8e-4c39-9a55-8a1c3f6f6b60")


def record_id(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(_IDS, '/'.join(map(str, parts)))}>"


def record(name: str, date: str, page_id: int | None, url: str | None, payload: bytes, digest: str, first: tuple[int, str | None, str | None] | None = None) -> bytes:
    """One record.  ``first``: page_id, URL and record id (None: not known) of the response
    that a revisit repeats."""
    one_line = lambda x: " ".join((x or "").split())
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if first else 'response'}",
        f"WARC-Record-ID: {name}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {one_line(url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        "Content-Type: application/http; msgtype=response",
    ]
    if first:
        head += [f"WARC-Refers-To: {first[2]}"] if first[2] else []
        head += [
            f"WARC-Refers-To-Target-URI: {one_line(first[1])}",
            f"WARC-Refers-To-Date: {date}",
            f"X-Refers-To-Page: {first[0]}",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    block = b"" if first else _HTTP + payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """A record's fields and payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]


def archive(records: list[bytes], level: int = LEVEL) -> bytes:
    """The bytes of an archive.  Few records are given to the training again until they are
    enough for it.  An archive without records is empty, without such a frame."""
    import zstandard

    sample, size = [], 0
    # A long record gives its beginning only, so it doesn't crowd the others out.
    whole = sum(min(len(r), SAMPLE_EACH) for r in records)
    for r in records[:: max(1, -(-len(records) // SAMPLE_RECORDS), -(-whole // SAMPLE_BYTES))]:
        sample.append(r[:SAMPLE_EACH])
        size += len(sample[-1])
    dictionary, said = None, list(sample)
    while said and dictionary is None and len(said) <= SAMPLE_RECORDS + 64:
        try:
            dictionary = zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, size // 8)), said)
        except zstandard.ZstdError:
            said += said
    out = []
    if dictionary is not None:
        raw = dictionary.as_bytes()
        out.append(struct.pack("<II", SKIPPABLE, len(raw)) + raw)
    tool = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_content_size=True)
    return b"".join(out + [tool.compress(r) for r in records])


def records_of(data: bytes):
    """Yield the records of an archive."""
    import zstandard

    at, dictionary = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == SKIPPABLE:
        (size,) = struct.unpack_from("<I", data, 4)
        dictionary, at = zstandard.ZstdCompressionDict(data[8 : 8 + size]), 8 + size
    tool = zstandard.ZstdDecompressor(dict_data=dictionary)
    view = memoryview(data)
    while at < len(data):
        # A frame's end isn't stored: the decompressor says how much it left.
        frame = tool.decompressobj()
        raw = [frame.decompress(view[at : at + 65536])]
        at += min(65536, len(data) - at)
        while not frame.eof:
            if at >= len(data):
                raise ValueError("the archive breaks off")
            raw.append(frame.decompress(view[at : at + 65536]))
            at += min(65536, len(data) - at)
        at -= len(frame.unused_data)
        yield b"".join(raw)


def with_decisions(pages: DataFrame) -> DataFrame:
    """``(page_id, url, payload, digest, refers_to, first_url, first_rows)``: ``refers_to`` is
    the smallest page_id with the same payload, for payloads that are revisits, else null;
    ``first_rows`` is how many rows with the payload that page_id has.

    Equal payloads of ``LEAST_REVISIT`` bytes or more are stored once.  Null html is an
    empty payload.  Null page ids come after all others; payloads whose pages all lack an
    id are all stored.  Where the smallest page_id stands in several equal rows, each of
    them is a response.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    # Copies of a page are counted before they meet: no payload is moved.
    per_page = rows.where(F.octet_length("payload") >= LEAST_REVISIT).groupBy("digest", "page_id").agg(F.count("*").alias("n"), F.min("url").alias("url"))
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "n", "url"))).alias("f")
    again = per_page.groupBy("digest").agg(F.sum("n").alias("rows"), first).where("rows > 1 AND f IS NOT NULL")
    again = staged(again.select("digest", F.col("f.page_id").alias("first"), F.col("f.n").alias("first_rows"), F.col("f.url").alias("first_url")), "repeated-payloads")
    joined = rows.join(again, "digest", "left")
    return joined.select("page_id", "url", "payload", "digest", F.expr("if(page_id <=> first, null, first)").alias("refers_to"), "first_url", "first_rows")


def write_archives(pages: DataFrame, directory: str | None = None, level: int = LEVEL, date: str | None = None) -> tuple[str, DataFrame]:
    """Write all rows of ``pages(page_id, url, html)``; gives the folder and its manifest
    ``(file, n_records, n_bytes)``.  ``date`` (YYYY-MM-DDThh:mm:ssZ) is that of all records,
    by default the time of the call.

    A record's id follows from its page and payload if that page has them once, else from
    its place, so ids are unique within the folder and a task that runs again writes the
    same ones."""
    spark = pages.sparkSession
    ship(spark)
    directory = make_dir(spark, directory or scratch_path(spark, "warc"))
    folder = directory.rstrip("/").rsplit("/", 1)[-1]
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches):
        pid, seq = TaskContext.get().partitionId(), 0
        held, size, done = [], 0, []

        def flush():
            nonlocal held, size, seq
            data, name = archive(held, level), f"pages-{pid:06d}-{seq:06d}.warc.zst"
            write_file(directory, name, data)
            done.append((name, len(held), len(data)))
            held, size, seq = [], 0, seq + 1

        for b in batches:
            for row in zip(*b.columns, strict=True):
                page_id, url, payload, digest, refers_to, first_url, first_rows = (x.as_py() for x in row)
                name, first = record_id("place", folder, pid, seq, len(held)), None
                if refers_to is not None:
                    first = (refers_to, first_url, record_id("page", refers_to, digest) if first_rows == 1 else None)
                elif first_rows == 1:  # others refer to it
                    name = record_id("page", page_id, digest)
                held.append(record(name, date, page_id, url, payload, digest, first))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    flush()
        if held:
            flush()
        if done:
            f, n, s = zip(*done, strict=True)
            yield pa.record_batch([pa.array(f), pa.array(n, pa.int64()), pa.array(s, pa.int64())], ["file", "n_records", "n_bytes"])

    return directory, staged(with_decisions(pages).mapInArrow(run, "file string, n_records long, n_bytes long"), "warc-manifest")


def read_archives(spark, directory: str, keep_payload: bool = True) -> DataFrame:
    """``(page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload])``
    of each record.  A stored payload is hashed again and must agree with its record."""
    ship(spark)

    def run(batches):
        for b in batches:
            for content in b.column(0):
                cols: list[list] = [[] for _ in range(7)]
                size = 0
                for raw in records_of(content.as_py()):
                    fields, payload = parse_record(raw)
                    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    n = int(fields["X-Payload-Length"])
                    if kind == "response" and (len(payload) != n or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
                    name, ref = fields["X-Page-ID"], fields.get("X-Refers-To-Page")
                    row = (int(name) if name else None, fields["WARC-Target-URI"], n, digest, kind, int(ref) if ref else None, payload if keep_payload else None)
                    for col, x in zip(cols, row, strict=True):
                        col.append(x)
                    size += len(payload)
                    if size > 8 << 20 or len(cols[0]) >= 5000:
                        yield batch(cols)
                        cols, size = [[] for _ in range(7)], 0
                if cols[0]:
                    yield batch(cols)

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]

    def batch(cols):
        return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(directory).select("content")
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    found = files.mapInArrow(run, schema)
    return found if keep_payload else found.drop("payload")
