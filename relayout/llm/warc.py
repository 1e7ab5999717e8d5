"""WARC archives of captures, their index merged from sorted runs, and reading back through it.

Writing: of records with equal payloads (by SHA-1) the one with the smallest id is a response, the others revisit it. Tasks
write archive files, a gzip member per record, to a shared folder and return their captures as sorted runs, by
URL key and timestamp. A file counts only by the rows its task returned, so what a lost attempt left is never read.

Index: runs are dealt out by ranges of (key, timestamp, id), so that one busy URL spreads over tasks too, and each
range merges its parts of all runs with a loser tree into one ordered capture history.

Reading: each index row is read at its file and offset and checked against its digest.

Captures without a time get one from their id, a second each from 1970 on.

Defined cases. Null payload: empty. Payloads below ``least_bytes``: always a response. Null URL: no target and an empty
key. Repeated rows with the smallest id: all responses. Null ids: after all others; alone with a payload they are
responses. White space and control characters of a URL: percent-encoded. No rows: no files, no rows. Other
columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relayout.llm.shared import folder, prepare, stored

#: Bytes of records in one archive file, about.
FILE_BYTES = 64 << 20
#: Captures in one sorted run at most, and in one range of the merge on average.
RUN_ROWS = 50_000
RANGE_ROWS = 200_000

_SCHEMA = (
    "key string, time string, page_id {kind}, run string, file string, offset long, length long, record_type string"
)
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def url_key(url: str | None) -> str:
    """The URL with its host's labels in reverse, lower case, without scheme, www and fragment."""
    if not url:
        return ""
    rest = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://", "", url.strip()).split("#", 1)[0].lower()
    host, slash, path = rest.partition("/")
    host = re.sub(r":(80|443)$", "", host.rpartition("@")[2])
    labels = host.removeprefix("www.").split(".")
    return ",".join(reversed(labels)) + ")" + (slash + path if slash else "/")


def capture_time(page_id: int | None) -> datetime:
    return datetime(1970, 1, 1, tzinfo=UTC) + timedelta(seconds=(page_id or 0) % 250_000_000_000)


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _number(name: str) -> int | None:
    number = name.removeprefix("<urn:page:").removesuffix(">")
    return None if number == "none" else int(number)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit with the response's headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_name(page_id)}",
        f"WARC-Date: {capture_time(page_id):%Y-%m-%dT%H:%M:%SZ}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url:
        head.append("WARC-Target-URI: " + _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if kind == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: {_name(refers_to)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def with_kinds(pages: DataFrame, least_bytes: int) -> DataFrame:
    """page_id, url, payload, first: the smallest id with the same payload."""
    read = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("sha", F.sha1("payload"))
    # groups first, of digests alone: the payloads are shuffled once, and a hot digest's join can be split
    first = read.select("sha", "page_id").groupBy("sha").agg(
        F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id")).alias("lead")
    )
    joined = read.join(first, "sha")
    revisit = (F.octet_length("payload") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("lead.page_id"))
    return joined.select("page_id", "url", "payload", revisit.alias("revisit"), F.col("lead.page_id").alias("first"))


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0) -> DataFrame:
    """Write archives below ``path``; the captures as sorted runs (stored, not lazy)."""
    prepare(pages.sparkSession)
    fields = [*(line.split(" ")[0] for line in _SCHEMA.split(", "))]

    def run_of(rows: list[tuple]) -> pa.RecordBatch:
        rows.sort(key=lambda row: (row[0], row[1], row[2] is None, row[2] or 0))
        name = uuid.uuid4().hex
        columns = list(zip(*((*row[:3], name, *row[3:]) for row in rows)))
        kinds = [pa.string(), pa.string(), pa.int64(), *[pa.string()] * 2, *[pa.int64()] * 2, pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], fields)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(path)
        out, file, written, rows = None, "", 0, []
        try:
            for batch in batches:
                for row in batch.to_pylist():
                    if out is None or written >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        store.create_dir(base, recursive=True)
                        file, written = f"captures-{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{base}/{file}", compression=None)
                    kind = "revisit" if row["revisit"] else "response"
                    data = record(row["page_id"], row["url"], row["payload"], kind, row["first"])
                    member = gzip.compress(data, 1, mtime=0)
                    out.write(member)
                    time = f"{capture_time(row['page_id']):%Y%m%d%H%M%S}"
                    rows.append((url_key(row["url"]), time, row["page_id"], file, written, len(member), kind))
                    written += len(member)
                    if len(rows) >= RUN_ROWS:
                        yield run_of(rows)
                        rows = []
        finally:
            if out is not None:
                out.close()
        if rows:
            yield run_of(rows)

    captures = with_kinds(pages, least_bytes).mapInArrow(write, _SCHEMA.format(kind="long"))
    return stored(captures, "capture-runs")


class LoserTree:
    """Merge of k sorted sequences: each inner node keeps the loser of its match, the winner goes up."""

    def __init__(self, sequences: list[Iterable[tuple]]):
        self.sources = [iter(sequence) for sequence in sequences]
        self.heads = [next(source, None) for source in self.sources]
        k = max(1, len(self.sources))
        self.losers = [-1] * k
        for i in range(len(self.sources)):
            self._replay(i)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x, a) <= (y, b))

    def _replay(self, winner: int) -> None:
        node = (winner + len(self.losers)) // 2
        while node > 0:
            other = self.losers[node]
            if other == -1:  # the first to come waits for its opponent
                self.losers[node] = winner
                return
            if self._beats(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.sources and self.heads[self.losers[0]] is not None:
            winner = self.losers[0]
            yield self.heads[winner]
            self.heads[winner] = next(self.sources[winner], None)
            self._replay(winner)


def merge_runs(runs: DataFrame, captures: int) -> DataFrame:
    """The captures in order within ranges that ascend with the partition: the merged index."""
    ranges = max(1, -(-captures // RANGE_ROWS))
    fields = [field.name for field in runs.schema.fields]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[str, list[list[tuple]]] = {}
        schema = None
        for batch in batches:
            schema = batch.schema
            columns = [batch.column(name).to_pylist() for name in fields]
            for row in zip(*columns):
                key = (row[0], row[1], row[2] is None, row[2] or 0)
                mine = parts.setdefault(row[3], [[]])
                if mine[-1] and mine[-1][-1][0] > key:  # a run read in several parts goes on as another run
                    mine.append([])
                mine[-1].append((key, row[4], row[5], row))
        held = []
        for *_, row in LoserTree([run for mine in parts.values() for run in mine]):
            held.append(row)
            if len(held) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], fields)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], fields)

    dealt = runs.repartitionByRange(ranges, "key", "time", F.col("page_id").asc_nulls_last())
    return dealt.mapInArrow(merge, runs.schema)


#: Bytes of archives that a task reads, on average.
READ_BYTES = 8 << 20


def read_archives(index: DataFrame, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and payload of each indexed record."""
    prepare(index.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(path)
        name, source = None, None
        for batch in batches:
            found = []
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, store.open_input_file(f"{base}/{file}")
                headers, http, payload = parse(gzip.decompress(source.read_at(length, offset)))
                digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                kind, size = headers["WARC-Type"], int(http["Content-Length"])
                if kind == "response" and (payload_digest(payload), len(payload)) != (digest, size):
                    raise ValueError(f"damaged record in {file} at {offset}")
                refers = _number(headers["WARC-Refers-To"]) if kind == "revisit" else None
                found.append((_number(headers["WARC-Record-ID"]), size, digest, kind, refers, payload))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
            columns = list(zip(*found)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
        if source is not None:
            source.close()

    # a file's records lie in a few tasks in the order of the file; salted, as files can be large. The number of tasks
    # goes by the archives' bytes, which the index's own few bytes say nothing about
    block = F.floor(F.col("offset") / F.lit(READ_BYTES))
    tasks = max(1, -(-(index.agg(F.sum("length")).first()[0] or 0) // READ_BYTES))
    placed = index.select("file", "offset", "length").repartition(tasks, F.col("file"), block)
    return placed.sortWithinPartitions("file", "offset").mapInArrow(
        read,
        "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary",
    )


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives, in the shared one."""
    return f"{folder(spark)}/warc-{uuid.uuid4().hex[:10]}"


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write the pages' archives, merge their index and read every record back through it."""
    path = archive_folder(pages.sparkSession)
    runs = write_archives(pages, path, least_bytes)
    index = stored(merge_runs(runs, runs.count()), "capture-index")
    return read_archives(index, path)
