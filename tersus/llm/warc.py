"""WARC archives: writing them from rows, reading their records, and resolving revisits.

Archives are ``.warc.gz`` files in the shared folder, one gzip member for each record. A task writes files under names of
its own attempt and returns their paths; that table, the manifest, is all that later jobs go by, so what a lost
or doubled task left behind is never read.

Deduplicating reads the headers of all records and shuffles them by payload digest; payloads stay in their files. Of
responses with equal payloads one stays the original; each other one, and each revisit that was there before, is
joined to it. Every archive is then written anew by one task: records have fresh ids, lengths and digests, and what
became a revisit has headers alone and refers to its original.
"""

from __future__ import annotations

import base64
import hashlib
import mmap
import os
import re
import uuid
import zlib
from datetime import datetime, timezone

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tersus.session import scratch_dir

from .common import col, mounted, prepare_workers, shuffle_partitions, written

VERSION = b"WARC/1.1"
#: Fixed value: the profile of a revisit whose payload digest equals an earlier record's.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, records long, bytes long"
HEADERS = ("path string, number long, record_id string, type string, key long, uri string, date string, digest string, "
           "payload_bytes long, content string, refers_to string")


# ------------------------------------------------------------------ records
def payload_digest(payload: bytes) -> str:
    """As WARC headers write it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def hex_digest(digest: str | None) -> str | None:
    """Lowercase hex of a ``sha1:`` digest in base 32, or of one that is in hex already."""
    value = (digest or "").partition(":")[2]
    if len(value) == 32:
        return base64.b32decode(value.upper()).hex()
    return value.lower() or None


def record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A record as one gzip member. Headers without a value are left out; line breaks in values become spaces."""
    lines = [VERSION] + [f"{name}: {re.sub('[\r\n]+', ' ', value)}".encode("utf-8", "surrogatepass")
                         for name, value in headers if value is not None]
    lines.append(b"Content-Length: %d" % len(block))
    packed = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packed.compress(b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n") + packed.flush()


def http_headers(length: int) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length


def response(record_id: str, date: str, uri: str | None, key: int | None, http: bytes, payload: bytes) -> bytes:
    return record([("WARC-Type", "response"), ("WARC-Record-ID", record_id), ("WARC-Date", date), ("WARC-Target-URI", uri),
                   ("X-Row-Key", None if key is None else str(key)), ("WARC-Payload-Digest", payload_digest(payload)),
                   ("WARC-Block-Digest", payload_digest(http + payload)), ("Content-Type", "application/http; msgtype=response")],
                  http + payload)


def revisit(record_id: str, date: str, uri: str | None, key: int | None, http: bytes, digest: str, to_id: str,
            to_uri: str | None, to_date: str | None) -> bytes:
    return record([("WARC-Type", "revisit"), ("WARC-Record-ID", record_id), ("WARC-Date", date), ("WARC-Target-URI", uri),
                   ("X-Row-Key", None if key is None else str(key)), ("WARC-Payload-Digest", digest),
                   ("WARC-Block-Digest", payload_digest(http)), ("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", to_id),
                   ("WARC-Refers-To-Target-URI", to_uri), ("WARC-Refers-To-Date", to_date),
                   ("Content-Type", "application/http; msgtype=response")], http)


def warcinfo(date: str) -> bytes:
    return record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date),
                   ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")


def _members(data):
    """The members of a gzip file, one after the other, each unpacked; or the whole of a plain file."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    at = 0
    while at < len(data):
        unpack, parts, size = zlib.decompressobj(31), [], 1 << 12
        while not unpack.eof:
            if at >= len(data):
                raise ValueError("the last record is cut off")
            fed = data[at:at + size]
            parts.append(unpack.decompress(fed))
            at += len(fed) - len(unpack.unused_data)
            size = min(2 * size, 1 << 20)
        yield b"".join(parts)


def records(path: str):
    """(headers with lower-case names, block) of every record of an archive, one record in memory at a time."""
    if not os.path.getsize(path):
        return
    with open(path, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
        for member in _members(data):
            at = 0
            while at < len(member):
                end = member.find(b"\r\n\r\n", at)
                first, *lines = member[at:max(end, at)].split(b"\r\n")
                if end < 0 or not first.startswith(b"WARC/"):
                    raise ValueError(f"{path}: no WARC record where one should begin")
                fields = (line.decode("utf-8", "replace").partition(":") for line in lines)
                headers = {name.strip().lower(): value.strip() for name, _, value in fields}
                length = int(headers["content-length"])
                block = bytes(member[end + 4:end + 4 + length])
                if len(block) < length:
                    raise ValueError(f"{path}: a record is cut off")
                yield headers, block
                at = end + 4 + length
                while member[at:at + 2] == b"\r\n":
                    at += 2


def http_parts(headers: dict, block: bytes) -> tuple[bytes, bytes]:
    """HTTP headers and payload of a block; a block that is no HTTP message is all payload."""
    end = block.find(b"\r\n\r\n") if headers.get("content-type", "").startswith("application/http") else -1
    return (block[:end + 4], block[end + 4:]) if end >= 0 else (b"", block)


# ------------------------------------------------------------------ writing
class ArchiveWriter:
    """A task's archives: files of about ``file_bytes``, in place only when whole."""

    def __init__(self, folder: str, date: str, file_bytes: int):
        self.folder, self.date, self.file_bytes = mounted(folder), date, file_bytes
        self.file, self.done = None, []
        os.makedirs(self.folder, exist_ok=True)

    def add(self, packed: bytes) -> None:
        if self.file is None:
            self.path, self.records = f"{self.folder}/{uuid.uuid4().hex}.warc.gz", 0
            self.file = open(self.path + ".tmp", "wb")
            self.file.write(warcinfo(self.date))
        self.file.write(packed)
        self.records += 1
        if self.file.tell() >= self.file_bytes:
            self.close()

    def close(self) -> None:
        if self.file is not None:
            self.done.append((self.path, self.records, self.file.tell()))
            self.file.close()
            os.replace(self.path + ".tmp", self.path)
            self.file = None

    def manifest(self) -> pa.RecordBatch:
        self.close()
        paths, counts, sizes = zip(*self.done) if self.done else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())],
                                          ["path", "records", "bytes"])


def now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def write_archives(df: DataFrame, key_col: str, uri_col: str | None, payload_col: str, file_bytes: int = 128 << 20) -> DataFrame:
    """A response record for each row, its payload the text in UTF-8 (null: empty). Returns the manifest: path, records,
    bytes of each archive. ``key_col`` (a whole number, null allowed) is kept in the header ``X-Row-Key``."""
    prepare_workers(df.sparkSession)
    folder, date = scratch_dir(df.sparkSession, "llm", "warc"), now()
    uri = F.lit(None) if uri_col is None else col(uri_col)
    rows = df.select(col(key_col).cast("long").alias("key"), uri.cast("string").alias("uri"),
                     F.coalesce(col(payload_col).cast("string"), F.lit("")).alias("payload"))

    def run(batches):
        out = ArchiveWriter(folder, date, file_bytes)
        for batch in batches:
            for key, uri, payload in zip(*(c.to_pylist() for c in batch.columns[:2]), batch.column("payload").cast(pa.binary())):
                body = payload.as_py()
                out.add(response(f"<urn:uuid:{uuid.uuid4()}>", date, uri, key, http_headers(len(body)), body))
        yield out.manifest()
    return written(rows.mapInArrow(run, MANIFEST), "warc-manifest")


# ------------------------------------------------------------------ reading
def _spread(archives: DataFrame) -> DataFrame:
    """The archives dealt over the tasks, a fixed number of them: to Spark, rows of paths look small enough for one. (By a
    hash of the path, as a join by the path itself would make the exchange look needless.)"""
    return archives.repartition(shuffle_partitions(archives.sparkSession), F.xxhash64("path"))


def read_headers(manifest: DataFrame, batch_rows: int = 10_000) -> DataFrame:
    """What ``HEADERS`` lists of every response and revisit record: digests are in hex, ``payload_bytes`` and ``content``
    (a second hash) are of the payload, null for a revisit. A payload that does not fit its digest is an error."""
    prepare_workers(manifest.sparkSession)
    names = [c.split()[0] for c in HEADERS.split(", ")]
    kinds = pa.schema([(n, pa.int64() if c.endswith("long") else pa.string()) for n, c in zip(names, HEADERS.split(", "))])

    def row(path, number, headers, block):
        digest, size, content = hex_digest(headers.get("warc-payload-digest")), None, None
        if headers["warc-type"] == "response":
            payload = http_parts(headers, block)[1]
            found = hashlib.sha1(payload).hexdigest()
            if digest not in (None, found):
                raise ValueError(f"{path}: record {number} does not have the payload of its digest")
            digest, size, content = found, len(payload), xxhash.xxh3_128_hexdigest(payload)
        key = headers.get("x-row-key")
        return dict(zip(names, (path, number, headers.get("warc-record-id"), headers["warc-type"], None if key is None else int(key),
                                headers.get("warc-target-uri"), headers.get("warc-date"), digest, size, content,
                                headers.get("warc-refers-to"))))

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                for number, (headers, block) in enumerate(records(mounted(path))):
                    if headers.get("warc-type") in ("response", "revisit"):
                        rows.append(row(path, number, headers, block))
                    if len(rows) == batch_rows:
                        yield pa.RecordBatch.from_pylist(rows, kinds)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, kinds)
    return _spread(manifest).mapInArrow(run, HEADERS)


def resolve_revisits(headers: DataFrame, least_bytes: int) -> DataFrame:
    """path, number and the original's to_key, to_id, to_uri, to_date for each record that is to be a revisit.

    Of responses whose payloads (digest, length and second hash) are equal and have ``least_bytes`` or more, the one of the
    largest key stays (null keys are the smallest; ties: the largest record id). A revisit refers to the response
    of its digest with the largest key, whatever its length, and is left as it is where there is none."""
    headers = written(headers, "warc-headers")
    same = ["digest", "payload_bytes", "content"]
    one = F.struct(F.col("key").isNotNull().alias("known"), "key", "record_id", "uri", "date")
    groups = written(headers.filter("type = 'response'").groupBy(*same).agg(F.max(one).alias("one"), F.count("*").alias("copies")),
                     "warc-originals")
    to = [F.col(f"one.{c}").alias(new) for c, new in (("key", "to_key"), ("record_id", "to_id"), ("uri", "to_uri"), ("date", "to_date"))]
    copies = (headers.filter((F.col("type") == "response") & (F.col("payload_bytes") >= least_bytes))
              .join(groups.filter("copies > 1"), same).filter("record_id != one.record_id"))
    revisits = headers.filter("type = 'revisit'").join(groups.groupBy("digest").agg(F.max("one").alias("one")), "digest")
    return copies.select("path", "number", *to).unionByName(revisits.select("path", "number", *to))


def fresh_id(record_id: str) -> str:
    """The new id of a record: told by its old one, so that a revisit knows its original's."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, record_id)}>"


def deduplicate_archives(manifest: DataFrame, least_bytes: int = 1000, file_bytes: int = 128 << 20) -> DataFrame:
    """The archives written anew with each payload of ``least_bytes`` or more once; returns their manifest.

    What refers to what: see ``resolve_revisits``. Records other than responses and revisits are left out, but for a
    new warcinfo record in each file. Empty archives and an empty manifest give none."""
    resolved = resolve_revisits(read_headers(manifest), least_bytes)
    # a file's revisits: at most its records, and files are bounded
    by_file = resolved.groupBy("path").agg(F.collect_list(F.struct("number", "to_id", "to_uri", "to_date")).alias("revisits"))
    work = _spread(manifest.select("path").join(by_file, "path", "left"))
    folder, date = scratch_dir(manifest.sparkSession, "llm", "warc"), now()

    def run(batches):
        out = ArchiveWriter(folder, date, file_bytes)
        for batch in batches:
            for path, changed in zip(batch.column("path").to_pylist(), batch.column("revisits")):
                to = {r["number"]: r for r in changed.as_py() or ()}
                for number, (headers, block) in enumerate(records(mounted(path))):
                    if headers.get("warc-type") not in ("response", "revisit"):
                        continue
                    http, payload = http_parts(headers, block)
                    key = headers.get("x-row-key")
                    own = (fresh_id(headers["warc-record-id"]), headers.get("warc-date", date), headers.get("warc-target-uri"),
                           None if key is None else int(key), http)
                    if headers["warc-type"] == "response" and number not in to:
                        out.add(response(*own, payload))
                        continue
                    digest = headers.get("warc-payload-digest") or payload_digest(payload)
                    if number in to:
                        target = (fresh_id(to[number]["to_id"]), to[number]["to_uri"], to[number]["to_date"])
                    else:  # its original is in no archive here
                        target = tuple(headers.get(h) for h in ("warc-refers-to", "warc-refers-to-target-uri", "warc-refers-to-date"))
                    out.add(revisit(*own, digest, *target))
        yield out.manifest()
    return written(work.mapInArrow(run, MANIFEST), "warc-manifest")


def read_resolved(manifest: DataFrame) -> DataFrame:
    """key, uri, payload_bytes, payload_digest, record_type, refers_to of every record; a revisit has the length of the
    response that it refers to, and that one's key as ``refers_to`` (both null if it is not in these archives)."""
    headers = written(read_headers(manifest), "warc-headers")
    originals = headers.filter("type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("key").alias("to_key"),
                                                          F.col("payload_bytes").alias("to_bytes"))
    own = headers.filter("type = 'response'").select("key", "uri", "payload_bytes", F.col("digest").alias("payload_digest"),
                                                     F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    revisits = headers.filter("type = 'revisit'").join(originals, "refers_to", "left").select(
        "key", "uri", F.col("to_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.lit("revisit").alias("record_type"), F.col("to_key").alias("refers_to"))
    return own.unionByName(revisits)


def archive_round_trip(df: DataFrame, least_bytes: int = 1000, key_col: str = "page_id", uri_col: str = "url",
                       payload_col: str = "html") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each row, from archives that were written,
    deduplicated and read back.

    Null payloads count as empty. Of equal payloads of ``least_bytes`` or more the row with the largest id is the
    response (null ids are the smallest; of rows with equal ids any one), the others revisit it. Ids that are null stay null, also
    as ``refers_to``. Repeated rows give a record each; an empty table gives no rows; a payload is held whole by one
    task, however long; other columns are not read.
    """
    manifest = deduplicate_archives(write_archives(df, key_col, uri_col, payload_col), least_bytes)
    return read_resolved(manifest).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def existing_archives(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The manifest of archives that lie in the shared folder already (their records are not counted)."""
    return spark.createDataFrame([(p, None, os.path.getsize(mounted(p))) for p in paths], MANIFEST)
