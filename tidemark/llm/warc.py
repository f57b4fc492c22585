r"""WARC archives of pages, and their index by an external merge.

Each record is a gzip member of its own, so that a capture can be fetched by file, offset and length alone. Members are
packed into rows of a stated size and written through Spark's own text writer (so a lost task leaves nothing behind),
whose line separator is the empty gzip member: an archive is a plain sequence of members. Reading parses each archive
into index entries, sorted by URL key and time: a run. Runs are written out, cut into ranges of keys, and each range is merged from
its pieces of all runs by a loser tree. Ranges are cut by key, time and page together, so a URL with very many captures
spans many ranges.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.store import fresh_path, small_batches, stash

MIN_PAYLOAD = 100
#: An archive holds this many rows at most, each of this many bytes or of one record that is larger.
ROWS_PER_FILE, ROW_BYTES = 8, 4 << 20
ENTRIES_PER_RANGE = 250_000
_ID = "urn:x-page:"
_EPOCH = 1_700_000_000
_CRLF = "\r\n"
_EMPTY = gzip.compress(b"", mtime=0)


def decide(pages: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """``page_id, url, html, digest, size, refers_to`` of every page; ``refers_to`` is null for responses.

    Of equal payloads of ``min_payload`` bytes or more, that with the smallest page id is the response. Ids and digests
    alone are grouped; a page whose id is null revisits if any equal page has an id.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"),
        F.sha2(html, 256).alias("digest"), F.octet_length(html).cast("bigint").alias("size"),
    )
    large = rows.where(F.col("size") >= min_payload).select("page_id", "digest")
    first = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1 and first is not null")
    # a table of its own, so that a payload of very many pages can be split in the join
    first = stash(first.select("digest", "first"), "responses")
    again = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return rows.join(first, "digest", "left").select("page_id", "url", "html", "digest", "size", again.alias("refers_to"))


def record() -> Column:
    """A WARC record without the two line breaks that end it."""
    name = lambda c: F.concat(F.lit(f"<{_ID}"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    target = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F]", "%20")
    time = F.date_format(F.timestamp_seconds(F.lit(_EPOCH) + F.coalesce(F.pmod("page_id", F.lit(100_000_000)), F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "), F.col("size").cast("string"), F.lit(_CRLF * 2))
    response = F.col("refers_to").isNull()
    block = F.when(response, F.concat(http, F.col("html"))).otherwise(http)
    fields = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(response, F.lit("response")).otherwise(F.lit("revisit"))),
        F.concat(F.lit("WARC-Record-ID: "), name("page_id")),
        F.concat(F.lit("WARC-Target-URI: "), target),
        F.concat(F.lit("WARC-Date: "), time),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(~response, F.concat(F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{_CRLF}WARC-Refers-To: "), name("refers_to"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws(_CRLF, *fields), F.lit(_CRLF * 2), block)


def write_archives(pages: DataFrame, path: str, min_payload: int = MIN_PAYLOAD, rows_per_file: int = ROWS_PER_FILE, row_bytes: int = ROW_BYTES) -> None:
    """Archives of all pages under ``path``: one gzip member for each record, files bounded by bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(members: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(members)], type=pa.binary())], names=["value"])

        members, size = [], 0
        for b in batches:
            for raw in b.column(0):
                member = gzip.compress(raw.as_py() + b"\r\n\r\n", compresslevel=6, mtime=0)
                if members and size + len(member) > row_bytes:
                    yield told(members)
                    members, size = [], 0
                members.append(member)
                size += len(member)
        if members:
            yield told(members)

    small_batches(pages.sparkSession)
    records = decide(pages, min_payload).select(record().cast("binary").alias("value"))
    (
        records.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
        .write.option("encoding", "ISO-8859-1").option("lineSep", _EMPTY.decode("latin-1")).option("compression", "none")
        .option("maxRecordsPerFile", rows_per_file).text(path)
    )


def members(data: memoryview) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each gzip member of an archive; the empty ones between rows are passed over."""
    at = 0
    while at < len(data):
        inflate, parts, fed = zlib.decompressobj(31), [], at
        while not inflate.eof:
            chunk = data[fed : fed + (1 << 16)]
            if not len(chunk):
                raise ValueError("an archive ends inside a record")
            parts.append(inflate.decompress(chunk))
            fed += len(chunk)
        end = fed - len(inflate.unused_data)
        content = b"".join(parts)
        if content:
            yield at, end - at, content
        at = end


def read_record(content: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block of a record."""
    head, found, rest = content.partition(b"\r\n\r\n")
    version, *lines = head.decode().split(_CRLF)
    if not found or not version.startswith("WARC/"):
        raise ValueError(f"no record begins with {version[:40]!r}")
    fields = {k.lower(): v for k, v in (x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)}
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record does not end in two line breaks after its block")
    return fields, rest[:size]


def url_key(url: str) -> str:
    """Sort key of a URL: host labels from the top down, then path and query."""
    try:
        parts = urlsplit(url.lower())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.lower()
    host = re.sub(r"^www\d*\.", "", host)
    port_text = f":{port}" if port and (parts.scheme, port) not in (("http", 80), ("https", 443)) else ""
    return f"{','.join(reversed(host.split('.')))}{port_text}){parts.path or '/'}{'?' + parts.query if parts.query else ''}"


def _page(value: str | None) -> int | None:
    found = re.fullmatch(rf"<{_ID}(-?\d+)>", value or "")
    return int(found[1]) if found else None


_ENTRY = (
    "url_key string, time string, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, "
    "file string, offset bigint, length bigint"
)
_NAMES = [x.split()[0] for x in _ENTRY.split(", ")]
_KINDS = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]


def entry_of(fields: dict[str, str], block: bytes, place: tuple[str, int, int]) -> tuple:
    """Index entry of a record, with its file, offset and length: a response's payload is measured and digested anew, a revisit's is taken from its headers."""
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields["warc-type"]
    if kind == "response":
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
    else:
        size, digest = int(re.search(rb"Content-Length: (\d+)", http)[1]), fields["warc-payload-digest"].removeprefix("sha256:")
    return url_key(fields["warc-target-uri"]), fields["warc-date"], _page(fields["warc-record-id"]), size, digest, kind, _page(fields.get("warc-refers-to")), *place


def _order(entry: tuple) -> tuple:
    return entry[0], entry[1], entry[2] is not None, entry[2] or 0, entry[3:6], entry[6] or 0, entry[7:]


def _batch(entries: list[tuple], extra: list[pa.Array] = (), names: list[str] = ()) -> pa.RecordBatch:
    columns = [pa.array([e[k] for e in entries], type=t) for k, t in enumerate(_KINDS)]
    return pa.RecordBatch.from_arrays([*columns, *extra], names=[*_NAMES, *names])


def sorted_runs(spark: SparkSession, path: str) -> DataFrame:
    """Entries of all archives, with ``seq`` (place in the order of the archive's run)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                entries = sorted((entry_of(*read_record(x), (name, at, n)) for at, n, x in members(memoryview(content.as_buffer()))), key=_order)
                for k in range(0, len(entries), 10_000):
                    part = entries[k : k + 10_000]
                    yield _batch(part, [pa.array(range(k, k + len(part)), type=pa.int32())], ["seq"])

    return files.select("path", "content").mapInArrow(run, f"{_ENTRY}, seq int")


class LoserTree:
    """k-way merge: inner nodes hold the loser of their match, so a new front plays one match on each level."""

    def __init__(self, runs: Iterable[Iterator[tuple]]):
        self.runs = list(runs)
        self.k = max(1, len(self.runs))
        self.front = [self._next(i) for i in range(len(self.runs))] or [None]
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _next(self, i: int) -> tuple | None:
        entry = next(self.runs[i], None)
        return None if entry is None else (_order(entry), entry)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.front[a], self.front[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x[0], a) < (y[0], b)

    def _play(self, i: int) -> None:
        node = (i + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other == -1:
                self.losers[node] = i
                return
            if self._beats(other, i):
                self.losers[node], i = i, other
            node //= 2
        self.losers[0] = i

    def __iter__(self) -> Iterator[tuple]:
        while (held := self.front[self.losers[0]]) is not None:
            winner = self.losers[0]
            yield held[1]
            self.front[winner] = self._next(winner)
            self._play(winner)


def merge_runs(runs: DataFrame, entries_per_range: int = ENTRIES_PER_RANGE) -> DataFrame:
    """All entries in global order: partition by partition, and within each by URL key, time and page id.

    A range holds about ``entries_per_range`` entries, the bound of a merge's memory.
    """
    held = stash(runs, "runs")
    ranges = max(1, -(-held.count() // entries_per_range))
    ranges = max(ranges, int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pieces = held.repartitionByRange(ranges, "url_key", "time", "page_id", "payload_digest").sortWithinPartitions("file", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_run: dict[str, list[tuple]] = {}
        for b in batches:
            columns = [b.column(k).to_pylist() for k in range(len(_NAMES))]
            for entry in zip(*columns, strict=True):
                by_run.setdefault(entry[_NAMES.index("file")], []).append(entry)
        out = []
        for entry in LoserTree(map(iter, by_run.values())):
            out.append(entry)
            if len(out) == 10_000:
                yield _batch(out)
                out = []
        yield _batch(out)

    return pieces.mapInArrow(run, _ENTRY)


def fetch(entry: dict, data: bytes) -> tuple[dict[str, str], bytes]:
    """The record that an index entry points to, from the bytes ``offset`` to ``offset + length`` of its file."""
    (_, _, content), = members(memoryview(data[entry["offset"] : entry["offset"] + entry["length"]]))
    return read_record(content)


def archive_pages(pages: DataFrame, min_payload: int = MIN_PAYLOAD, rows_per_file: int = ROWS_PER_FILE, row_bytes: int = ROW_BYTES) -> DataFrame:
    """Write all pages to archives in the shared folder, read the archives, and return their merged index.

    One row per input row: :data:`_ENTRY`. A null html is an empty payload, a null url an empty target; repeated rows of
    a page are responses both. An empty table gives an empty index. The archives stay, as the index points into them.
    """
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_archives(pages, path, min_payload, rows_per_file, row_bytes)
    return merge_runs(sorted_runs(spark, path))
