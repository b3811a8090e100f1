"""WARC archives as a Spark data source: spark.read.format("warc"), df.write.format("warc").

Reading: files are dealt to partitions by size. A record's header is parsed first; predicates on record_type and the other
header columns that Spark pushes down are tried on it, and the block of a record that fails them, or whose payload nobody asks
for, is passed over (by a seek in plain files) without being decoded.

Writing: each task writes files under names of its own attempt and reports them; the commit writes a manifest of the reported
files, one a write. Readers read the files of all manifests since the last overwrite, so appends add up, and files of lost
executors and repeated attempts are in none. White space and control characters in addresses are percent-encoded.

Files are opened through pyarrow's file systems, so a path is a folder of any store they know (file, hdfs, s3, gs).

archive_pages() writes one record a page: of equal payloads, the smallest page_id is a response and the others revisit it.
Null and empty html are empty payloads; a payload of any length is one record, held whole by the task that writes or checks it;
rows that repeat are records of their own; an empty table makes an archive without records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import time
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from .common import broadcast_if_small, materialize, scratch_path

COLUMNS = "record_id string, record_type string, target_uri string, date string, content_type string, content_length bigint, payload_digest string, payload_length bigint, refers_to string, headers map<string,string>, payload binary"
#: Header field of each column.
FIELD = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "content_type": "content-type", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
SPLIT, ROLL = 64 << 20, 256 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def open_fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


class Committed(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, int, int]]):
        self.files = files


class _Plain:
    """Bytes of a plain file from place at of what is held, which is only moved when more is read; skip() does not read."""

    def __init__(self, file, block: int = 1 << 20):
        self.file, self.block, self.held, self.at, self.size = file, block, b"", 0, file.size()

    def more(self, n: int) -> bytes:
        """At least n further bytes, if there are as many."""
        return self.file.read(max(self.block, n))

    def fill(self, n: int) -> bool:
        """Holds n bytes from at on, if there are as many."""
        short = n - (len(self.held) - self.at)
        if short > 0:
            self.held, self.at = self.held[self.at :] + self.more(short), 0
        return len(self.held) - self.at >= n

    def head(self) -> bytes | None:
        """Up to and without the next blank line; None at the end."""
        seen = 0
        while (end := self.held.find(b"\r\n\r\n", self.at + max(0, seen - 3))) < 0:
            seen = len(self.held) - self.at
            if not self.fill(seen + 1):
                if self.held[self.at :].strip():
                    raise ValueError("a record header is cut off")
                return None
        out, self.at = self.held[self.at : end], end + 4
        return out

    def take(self, n: int) -> bytes:
        if not self.fill(n):
            raise ValueError("a record is cut off")
        out, self.at = self.held[self.at : self.at + n], self.at + n
        return out

    def skip(self, n: int) -> None:
        held = len(self.held) - self.at
        if n <= held:
            self.at += n
            return
        to = self.file.tell() + n - held
        if to > self.size:
            raise ValueError("a record is cut off")
        self.file.seek(to)
        self.held, self.at = b"", 0


class _Gzip(_Plain):
    """Bytes of a file of gzip members."""

    def __init__(self, file, block: int = 1 << 20):
        super().__init__(file, block)
        self.z, self.raw = zlib.decompressobj(31), b""

    def more(self, n: int) -> bytes:
        parts, have = [], 0
        while have < n:
            self.raw = self.raw or self.file.read(self.block)
            if not self.raw:
                break
            parts.append(self.z.decompress(self.raw))
            have += len(parts[-1])
            self.raw = self.z.unused_data
            if self.z.eof:
                self.z = zlib.decompressobj(31)
        return b"".join(parts)

    def skip(self, n: int) -> None:
        while n > (held := len(self.held) - self.at):
            n -= held
            self.held, self.at = b"", 0
            if not self.fill(1):
                raise ValueError("a record is cut off")
        self.at += n


def parse_head(head: bytes) -> dict[str, str]:
    """Fields of a record header by lower-case name; continued lines are joined."""
    lines = head.lstrip(b"\r\n").decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    out: dict[str, str] = {}
    name = ""
    for line in lines[1:]:
        if line[:1] in " \t" and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def _payload(kind: str, block: bytes) -> bytes:
    """What follows the HTTP header in a block of HTTP, otherwise the block."""
    return block.partition(b"\r\n\r\n")[2] if kind.startswith("application/http") else block


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.split = int(options.get("split", SPLIT))
        self.payload = options.get("payload", "true").lower() == "true"
        self.verify = options.get("verify", "false").lower() == "true"
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            column = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if column in FIELD and column not in ("payload_digest", "record_id", "refers_to"):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[column] = values & self.wanted.get(column, values)
            else:
                yield f

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        system, local = open_fs(self.path)
        info = system.get_file_info(local)
        if info.type == fs.FileType.File:
            found = [(info.path, info.size)]
        else:
            listed = {x.base_name: x for x in system.get_file_info(fs.FileSelector(local, recursive=False)) if x.type == fs.FileType.File}
            if told := manifests(listed):
                found = []
                for name in told:
                    with system.open_input_stream(listed[name].path) as f:
                        found += [(f"{local}/{n}", s) for n, _, s in json.loads(f.read())["files"]]
            else:
                found = [(x.path, x.size) for n, x in listed.items() if n.endswith((".warc", ".warc.gz"))]
        groups: list[list[str]] = []
        room = 0
        for path, size in sorted(found, key=lambda x: (-x[1], x[0])):
            if not groups or size > room:
                groups.append([])
                room = self.split
            groups[-1].append(path)
            room -= size
        return [Files(g) for g in groups] or [Files([])]

    def records(self, path: str) -> Iterator[tuple]:
        system, _ = open_fs(self.path)
        with system.open_input_file(path) as file:
            source = (_Gzip if path.endswith(".gz") else _Plain)(file)
            while (head := source.head()) is not None:
                if not head.strip():
                    continue
                h = parse_head(head)
                n = int(h.get("content-length", 0))
                if any(h.get(FIELD[c]) not in v for c, v in self.wanted.items()):
                    source.skip(n)
                    continue
                payload = None
                digest = h.get("warc-payload-digest")
                length = int(h["x-payload-length"]) if "x-payload-length" in h else None
                full = h.get("warc-type") != "revisit"
                if full and (self.payload or self.verify):
                    payload = _payload(h.get("content-type", ""), source.take(n))
                    length = len(payload)
                    if self.verify and digest and digest.startswith("sha1:") and digest != f"sha1:{sha1_base32(payload)}":
                        raise ValueError(f"the payload of {h.get('warc-record-id')} does not have its digest")
                else:
                    source.skip(n)
                rest = [(k, v) for k, v in h.items() if k not in FIELD.values() and k != "content-length"]
                yield (*(h.get(FIELD[c]) for c in ("record_id", "record_type", "target_uri", "date", "content_type")), n, digest, length, h.get("warc-refers-to"), rest, payload if self.payload else None)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        s, i = pa.string(), pa.int64()
        kinds = [s, s, s, s, s, i, s, i, s, pa.map_(s, s), pa.binary()]
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        schema = pa.schema(list(zip(names, kinds, strict=True)))
        rows, size = [], 0
        for path in partition.paths:
            for r in self.records(path):
                rows.append(r)
                size += 500 + len(r[-1] or b"")
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=schema)


def record(r: dict) -> bytes:
    """One record: r has record_id, record_type, target_uri, date, payload, payload_digest, payload_length, refers_to."""
    payload = r["payload"] or b""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % (r["payload_length"] or 0)
    block = http if r["record_type"] == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {r['record_type']}", f"WARC-Record-ID: {r['record_id']}", f"WARC-Date: {r['date']}"]
    if r["target_uri"]:
        head.append("WARC-Target-URI: " + _BLANK.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), r["target_uri"]))
    head.append(f"WARC-Payload-Digest: {r['payload_digest']}")
    if r["record_type"] == "revisit":
        head += [f"WARC-Refers-To: {r['refers_to']}", f"WARC-Profile: {_PROFILE}", f"X-Payload-Length: {r['payload_length']}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_BLANK = re.compile(r"[\s\x00-\x1f\x7f]")


def manifests(names) -> list[str]:
    """The manifests to be read: those of the last overwrite and of the appends after it, or all appends."""
    told = sorted(n for n in names if re.fullmatch(r"_manifest-\d{20}-(append|overwrite)-[0-9a-f]{32}\.json", n))
    return told[max((i for i, n in enumerate(told) if "-overwrite-" in n), default=0) :]


class WarcWriter(DataSourceArrowWriter):
    """A write has an id of its own, in the names of its files and of its manifest; manifests are ordered by time of commit. An
    overwrite is one manifest like any other, after which older ones count no more; their files go when it stands."""

    def __init__(self, options: dict[str, str], overwrite: bool = False):
        self.path, self.overwrite, self.write_id = options["path"], overwrite, uuid.uuid4().hex
        self.gzip = options.get("compression", "none") == "gzip"
        self.roll = int(options.get("roll", ROLL))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Committed:
        from pyspark import TaskContext

        task = TaskContext.get()
        system, local = open_fs(self.path)
        system.create_dir(local, recursive=True)
        files, out, name, n, size = [], None, "", 0, 0
        for batch in iterator:
            for r in batch.to_pylist():
                data = record(r)
                data = gzip.compress(data, 6, mtime=0) if self.gzip else data
                if out is None or size + len(data) > self.roll:
                    if out is not None:
                        out.close()
                        files.append((name, n, size))
                    name, n, size = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(files):04d}-{self.write_id}.warc{'.gz' * self.gzip}", 0, 0
                    out = system.open_output_stream(f"{local}/{name}", buffer_size=1 << 20, compression=None)
                out.write(data)
                n, size = n + 1, size + len(data)
        if out is not None:
            out.close()
            files.append((name, n, size))
        return Committed(files)

    def commit(self, messages: list[Committed | None]) -> None:
        from pyarrow import fs

        system, local = open_fs(self.path)
        system.create_dir(local, recursive=True)
        told = {"files": [f for m in messages if m for f in m.files]}
        before = [x for x in system.get_file_info(fs.FileSelector(local, recursive=False)) if x.type == fs.FileType.File]
        latest = max((int(m[1]) for x in before if (m := re.match(r"_manifest-(\d{20})-", x.base_name))), default=0)
        at = max(time.time_ns(), latest + 1)  # after every one that stands, whatever the clocks say
        with system.open_output_stream(f"{local}/_manifest-{at:020d}-{'overwrite' if self.overwrite else 'append'}-{self.write_id}.json") as f:
            f.write(json.dumps(told).encode())
        if self.overwrite:
            for x in before:
                if self.write_id not in x.base_name and (x.base_name.startswith("_manifest-") or x.base_name.endswith((".warc", ".warc.gz"))):
                    system.delete_file(x.path)

    def abort(self, messages: list[Committed | None]) -> None:
        system, local = open_fs(self.path)
        for m in messages:
            for name, _, _ in m.files if m else []:
                system.delete_file(f"{local}/{name}")


class WarcDataSource(DataSource):
    """Options: path; reading: split (bytes a partition), payload (false: not returned), verify (true: digests are checked);
    writing: compression (none or gzip, a member a record), roll (bytes a file)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def archive_pages(pages: DataFrame, path: str, min_bytes: int = 0, compression: str = "none") -> None:
    """Writes one record a row of pages(page_id, url, html). Null html is an empty payload. Rows that repeat the smallest
    page_id of a payload are responses too; a row without page_id is a response only if no other row has its payload."""
    register(pages.sparkSession)
    body = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8")
    rows = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url"), body.alias("payload")).withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    groups = rows.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    groups = materialize(groups, "payloads")  # payloads that repeat; a hot one is a hot key of the left side of a join only
    joined = rows.join(broadcast_if_small(groups, groups.count()), "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    named = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    joined.select(
        named(F.col("page_id")).alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.lit("1970-01-01T00:00:00Z").alias("date"),
        F.when(~again, F.col("payload")).alias("payload"),
        _base32(F.col("digest")).alias("payload_digest"),
        F.col("size").cast("long").alias("payload_length"),
        F.when(again, named(F.col("first"))).alias("refers_to"),
    ).write.format("warc").option("path", path).option("compression", compression).mode("append").save()


def _base32(hex_digest):
    """sha1: and the base-32 form of a hexadecimal SHA-1, five bits at a time."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    out = [F.lit("sha1:")]
    for k in range(0, 40, 5):  # 5 hexadecimal digits are 4 letters
        n = F.conv(F.substring(hex_digest, k + 1, 5), 16, 10).cast("long")
        out += [F.substring(letters, F.shiftright(n, s).bitwiseAND(F.lit(31)).cast("int") + F.lit(1), F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def read_back(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of archived pages; payloads are read and checked."""
    register(spark)
    r = spark.read.format("warc").option("path", path).option("payload", "false").option("verify", "true").load()
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(.*)>$', 1) AS {kind})")
    return r.select(page("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"))


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Archives pages in the shared folder and reads the archives back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    archive_pages(pages, path, min_bytes)
    return read_back(spark, path, pages.schema["page_id"].dataType.simpleString())
