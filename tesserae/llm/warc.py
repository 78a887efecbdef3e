"""WARC archives: write records with an index, read selected records by coalesced byte ranges.

Files are opened with ``pyarrow.fs``, so the shared folder may be a mounted
path or any store that Arrow has a driver for, by its Hadoop name too.  Records
follow WARC 1.1: each file starts with a warcinfo record, every record has an id
of its own, and a revisit names its response by WARC-Refers-To (by target and
date alone where a page repeats its payload), so other readers resolve it too.
``X-Page-Id``, ``X-Page-Url`` and ``X-Refers-To-Page`` carry pages and urls as they
are beside that.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.shared import Workspace, small_batches
from tesserae.sources.storage import opened

INDEX = "file string, offset long, length long, page_id long, url string, digest string, record_type string"
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
#: A range takes the next record when the gap before it is at most GAP bytes and the range stays within RANGE.
GAP, RANGE = 1 << 16, 8 << 20
#: Bytes of archive that one reading task gets, about.
SPLIT = 64 << 20
#: Revisits that may be broadcast to the pages; beyond, pages are joined with them by a shuffle.
MOST_REVISITS = 1_000_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Stands for the target of a record without a url.
NO_URL = "urn:x-page:"
#: What a header may hold as it is; the per cent sign is the escape.
PLAIN = "".join(map(chr, range(33, 127))).replace("%", "")


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest}')}>"


def _target(url: str | None, page_id: int | None) -> str:
    if url is None:
        return f"{NO_URL}{'none' if page_id is None else page_id}"
    return quote(url, safe=PLAIN + "%")


def _gzip(record: bytes, level: int) -> bytes:
    press = zlib.compressobj(level, zlib.DEFLATED, 31)
    return press.compress(record) + press.flush()


def _packed(head: list[str], block: bytes) -> bytes:
    return ("\r\n".join(["WARC/1.1", *head, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def _info(name: str, date: str) -> bytes:
    """The record that a file starts with."""
    block = b"format: WARC File Format 1.1\r\nconformsTo: http://iipc.github.io/warc-specifications/specifications/warc-format/warc-1.1/\r\n"
    return _packed(["WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields"], block)


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None, again: bool, date: str) -> bytes:
    """One record, without compression.  A revisit has the HTTP head only, whose Content-Length is that of the payload it stands for.

    Only a response that others may refer to, and of which there is one
    (``again`` says otherwise), has an id that follows from its page.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    named = page_id is not None and refers_to is None and not again
    head = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id, digest) if named else f'<urn:uuid:{uuid.uuid4()}>'}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_target(url, page_id)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-Id: {'none' if page_id is None else page_id}",
        "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        head.append(f"X-Page-Url: {quote(url, safe=PLAIN)}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Target-URI: {_target(refers_url, refers_to)}", f"WARC-Refers-To-Date: {date}", f"X-Refers-To-Page: {refers_to}"]
        head += [] if again else [f"WARC-Refers-To: {_record_id(refers_to, digest)}"]
    return _packed(head, http if refers_to is not None else http + payload)


def _writer(root: str, level: int, date: str, min_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, at = None, "", 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:  # named after the attempt: only files that the index names count
                name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                store, path = opened(root)
                store.create_dir(path, recursive=True)
                out = store.open_output_stream(f"{path}/{name}", compression=None)
                out.write(first := _gzip(_info(name, date), level))
                at = len(first)
            rows = []
            for page_id, url, payload, refers, refers_url, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                digest = _digest(payload)
                data = _gzip(_record(page_id, url, payload, digest, refers, refers_url, bool(again) or len(payload) < min_bytes, date), level)
                out.write(data)
                rows.append((name, at, len(data), page_id, url, digest, "response" if refers is None else "revisit"))
                at += len(data)
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in INDEX.split(", ")])
        if out is not None:
            out.close()

    return write


def _payload() -> Column:
    return F.coalesce(F.col("html"), F.lit("")).cast("binary")


def refer(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, _sha, refers_to, refers_url and again: pages that repeat the payload of a smaller page_id, and all of a payload that a page has twice.

    ``refers_to`` is null for the smallest page_id, ``again`` true where any page
    repeats the payload itself.  Payloads are equal when their SHA-1, length and
    64-bit hash are.  The counts combine before the shuffle, and the join back can
    split a payload that a third of all pages share.
    """
    raw = _payload()
    keys = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.sha1(raw).alias("_sha"), F.octet_length(raw).alias("_n"), F.xxhash64(raw).alias("_x"))
    keys = keys.where((F.col("_n") >= min_bytes) & F.col("page_id").isNotNull())
    by_page = keys.groupBy("_sha", "_n", "_x", "page_id").agg(F.min(F.struct("page_id", "url")).alias("place"), F.count("*").alias("c"))
    firsts = by_page.groupBy("_sha", "_n", "_x").agg(F.min("place").alias("_first"), F.sum("c").alias("_c"), (F.max("c") > 1).alias("again")).where("_c > 1").drop("_c")
    firsts = Workspace(pages.sparkSession, "revisits").save(firsts, "firsts")  # a join with an aggregate's rows could not be split
    out = keys.drop("url").join(firsts, ["_sha", "_n", "_x"]).where("again OR page_id > _first.page_id")
    later = F.col("page_id") > F.col("_first.page_id")
    return out.select("page_id", "_sha", F.when(later, F.col("_first.page_id")).alias("refers_to"), F.when(later, F.col("_first.url")).alias("refers_url"), "again").distinct()


def write_archives(pages: DataFrame, root: str, min_bytes: int = 0, level: int = 2, revisits: DataFrame | None = None, date: str | None = None) -> DataFrame:
    """Write one gzip-member record for each row of ``pages`` (page_id, url, html) below ``root``; give the index.

    The index is lazy: materialise it once, since each run of it writes files
    of its own.  ``revisits`` are the rows of ``refer``, written before by the
    caller, or worked out here; up to MOST_REVISITS of them are broadcast, and
    payloads are written where they are read.  A null html is an empty payload;
    a null page_id or url is kept as null; a null page_id is never revisited and
    is always a response, as are all rows with the smallest page_id of their
    payload.  Records are dated ``date``, or when the plan is made.
    """
    small_batches(pages.sparkSession)
    payload = _payload()
    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("_sha"))
    known = refer(pages, min_bytes) if revisits is None else revisits
    few = revisits is not None and revisits.count() <= MOST_REVISITS
    rows = narrow.join(F.broadcast(known) if few else known, ["page_id", "_sha"], "left").select("page_id", "url", "payload", "refers_to", "refers_url", "again")
    return rows.mapInArrow(_writer(root, level, date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), min_bytes), INDEX)


def _parse(data: bytes) -> tuple:
    head, _, rest = data.partition(b"\r\n\r\n")
    field = dict(re.findall(r"^([\w-]+): (.*)$", head.decode().replace("\r\n", "\n"), re.M))
    http, _, payload = rest[: int(field["Content-Length"])].partition(b"\r\n\r\n")
    want = field["WARC-Payload-Digest"].removeprefix("sha1:")
    kind, page, refers, url = field["WARC-Type"], field["X-Page-Id"], field.get("X-Refers-To-Page"), field.get("X-Page-Url")
    size = int(re.search(rb"^Content-Length: (\d+)", http, re.M)[1])
    if kind == "response":
        size, got = len(payload), _digest(payload)
        if got != want:
            raise ValueError(f"page {page}: the payload's digest is {got}, its record says {want}")
    return (None if page == "none" else int(page), None if url is None else unquote(url), size, want, kind, None if refers is None else int(refers), payload if kind == "response" else None)


def _reader(root: str, payloads: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = opened(root)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        names = [x.split()[0] for x in READ.split(", ")]

        def emit(name: str, spans: list[tuple[int, int]]) -> pa.RecordBatch:
            first, end = spans[0][0], spans[-1][0] + spans[-1][1]
            with store.open_input_file(f"{path}/{name}") as f:
                data = f.read_at(end - first, first)
            rows = [_parse(zlib.decompress(data[o - first : o - first + n], 31)) for o, n in spans]
            if not payloads:
                rows = [(*r[:-1], None) for r in rows]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        name, spans = None, []
        for batch in batches:
            for file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                end = spans[-1][0] + spans[-1][1] if spans else 0
                if spans and (file != name or offset - end > GAP or offset + length - spans[0][0] > RANGE):
                    yield emit(name, spans)
                    spans = []
                name = file
                spans.append((offset, length))
        if spans:
            yield emit(name, spans)

    return read


def read_records(index: DataFrame, root: str, where: Column | None = None, payloads: bool = True) -> DataFrame:
    """Read the records that ``where`` selects from the index; columns as in READ.

    Selected records are dealt to tasks by their file and their place in it,
    about SPLIT bytes each, sorted, and neighbours merge into ranges of at
    most RANGE bytes; a task holds one range at a time.  Payloads are checked
    against their digests.
    """
    spark = index.sparkSession
    chosen = (index if where is None else index.where(where)).select("file", "offset", "length")
    total = chosen.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    # a number of partitions that is given stays: the rows are small, what they point to is not
    n = max(spark.sparkContext.defaultParallelism, -(-total // SPLIT))
    ranged = chosen.withColumn("part", F.floor(F.col("offset") / F.lit(SPLIT))).repartition(n, "file", "part").sortWithinPartitions("file", "offset")
    return ranged.select("file", "offset", "length").mapInArrow(_reader(root, payloads), READ)
