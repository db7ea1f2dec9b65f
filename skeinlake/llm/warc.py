"""Deterministic sharded WARC writer, and a reader.

Records are sorted by page id and dealt to shards that are ranges of page ids of
at most ``shard_bytes`` payload bytes; a shard is written as one or more files, a new
one begun when the compressed size reaches ``roll_bytes``. Headers, record ids
and digests are made anew from the content, so the same pages give the same
files, byte for byte, whatever the partitions. Of equal payloads (of at least
``min_revisit`` bytes) the one of the largest page id is the response; the others
are revisits of it.

The ranges are found by bytes, not by ids: ranges with too many bytes are cut into
narrower ones, round after round, so ids that lie far off or close together change
nothing. An id with more bytes than a shard, or all rows without an id, are dealt
to shards of their own by payload digest. The driver sees sums of ranges only, of
which there are some ``4 * MAX_SHARDS`` at most (shards grow beyond that many).

Tasks write under temporary names that no other attempt uses. What the successful
attempts wrote is listed in a table in the shared folder; tasks then give those files
their final names, which may be repeated, and the driver writes manifest.json last,
itself by renaming. A folder without it isn't read, one with it isn't written.
Files that a lost attempt left are removed with the temporary folder.

Cases: a null html is an empty payload, one of any size is written whole; a null url
gives no target URI; null page ids sort first; of repeated rows each has its record,
one of them the response; an empty table gives a manifest without files; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import frames

ROLL_BYTES = 16 << 20
SHARD_BYTES = 64 << 20
#: Least number of ranges of page ids that a round sums, and most shards.
ID_RANGES, MAX_SHARDS = 4096, 1 << 16
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = pa.schema([("shard", pa.int64()), ("part", pa.int64()), ("temporary", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha1", pa.string())])


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}/{copy}')}>"


def _safe(url: str) -> str:
    return "".join(c if 32 < ord(c) != 127 else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, refers: tuple[int | None] | None, copy: int) -> bytes:
    """A record, uncompressed. refers: the page id of the response, in a tuple, for a revisit."""
    digest = sha1(payload)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers else head + payload
    fields = [("WARC-Type", "revisit" if refers else "response"), ("WARC-Record-ID", record_id(page_id, digest, copy)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", _safe(url)))
    if page_id is not None:
        fields.append(("WARC-Page-ID", str(page_id)))
    if refers:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers[0], digest, 0))]
        if refers[0] is not None:
            fields.append(("WARC-Refers-To-Page-ID", str(refers[0])))
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{sha1(block)}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """One gzip member, without a time."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def members(content: bytes) -> Iterator[tuple[int, bytes]]:
    """Offset and data of each gzip member."""
    view, at = memoryview(content), 0
    while at < len(view):
        z, parts, to = zlib.decompressobj(31), [], at
        while not z.eof:
            if to >= len(view):
                raise ValueError("a gzip member is cut short")
            parts.append(z.decompress(view[to : to + 16384]))
            to += 16384
        yield at, b"".join(parts)
        at = min(to, len(view)) - len(z.unused_data)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and block of a record; digests are verified."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if first != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n" or fields["WARC-Block-Digest"] != f"sha1:{sha1(block)}":
        raise ValueError("not a whole WARC record")
    return fields, block


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _open(uri: str):
    system, path = _filesystem(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(path)


class _Files:
    """The files of one task: a row of MANIFEST for each that is complete."""

    def __init__(self, out: str, roll: int):
        self.out, self.roll, self.shard, self.stream, self.rows = f"{out}/_temporary/{uuid.uuid4().hex}", roll, None, None, []

    def add(self, shard: int, data: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.part = shard, 0
        if self.stream is None:
            self.name = f"{self.out}/{shard:06d}-{self.part:05d}"
            self.stream, self.records, self.bytes, self.digest = _open(self.name), 0, 0, hashlib.sha1()
        self.stream.write(data)
        self.digest.update(data)
        self.records += 1
        self.bytes += len(data)
        if self.bytes >= self.roll:
            self.close()

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.rows.append((self.shard, self.part, self.name, self.records, self.bytes, self.digest.hexdigest()))
            self.stream, self.part = None, self.part + 1


def _bytes_by_range(small: DataFrame, starts: np.ndarray) -> np.ndarray:
    """Payload bytes of the ids from each start on to the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.searchsorted(starts, b.column("page_id").to_numpy(), "right") - 1
            own, back = np.unique(at, return_inverse=True)
            n = np.zeros(len(own), np.int64)
            np.add.at(n, back, b.column("n").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(n)], names=["r", "n"])

    out = np.zeros(len(starts), np.int64)
    for r, n in small.where("page_id IS NOT NULL").select("page_id", "n").mapInArrow(run, "r long, n long").groupBy("r").agg(F.sum("n")).toLocalIterator():  # a row a range
        out[r] = n
    return out


class _Shards:
    """Cells of ids and the shards of each: those from ``starts`` on to the next, and before them the rows without an id."""

    def __init__(self, small: DataFrame, shard_bytes: int):
        low, high, total, unknown = small.agg(F.min("page_id"), F.max("page_id"), F.sum("n"), F.sum(F.when(F.col("page_id").isNull(), F.col("n")))).first()
        self.limit = max(shard_bytes, -(-(total or 0) // MAX_SHARDS))
        starts, ends, sums = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if low is not None:
            starts, ends, sums = np.array([low]), np.array([high]), np.array([(total or 0) - (unknown or 0)])
        while True:
            wide = np.flatnonzero((sums > self.limit) & (ends > starts))
            if not len(wide):
                break
            cut = [starts[np.setdiff1d(np.arange(len(starts)), wide)]]
            for i in wide.tolist():
                first, ids = int(starts[i]), int(ends[i]) - int(starts[i]) + 1
                n = min(ids, max(-(-4 * int(sums[i]) // self.limit), ID_RANGES // len(wide), 2))
                width = -(-ids // n)
                cut.append(np.array([first + k * width for k in range(-(-ids // width))], np.int64))
            starts = np.sort(np.concatenate(cut))
            ends = np.append(starts[1:] - 1, high)
            sums = _bytes_by_range(small, starts)
        cells = np.append(unknown or 0, sums)
        self.split = np.maximum(1, -(-cells // self.limit)).astype(np.int64)
        first, held, at = [], 0, 0
        for n, k in zip(cells.tolist(), self.split.tolist(), strict=True):
            if held and held + n > self.limit:
                at, held = at + 1, 0
            first.append(at)
            held += n
            at += k - 1
        self.starts, self.first, self.count = starts, np.array(first, np.int64), at + 1

    def of(self, page_id: Column, sha: Column) -> Column:
        """The number of a row's shard."""
        starts, first, split = self.starts, self.first, self.split

        @F.pandas_udf("long")
        def shard(known: pd.Series, ids: pd.Series, part: pd.Series) -> pd.Series:
            cell = np.where(known, np.searchsorted(starts, ids.to_numpy(), "right"), 0)
            return pd.Series(first[cell] + (part.to_numpy() * split[cell] >> 32))

        return shard(page_id.isNotNull(), F.coalesce(page_id, F.lit(0)).cast("long"), F.conv(F.substr(sha, F.lit(1), F.lit(8)), 16, 10).cast("long"))


MANIFEST_NAMES = "shard long, part long, temporary string, records long, bytes long, sha1 string"


def write(pages: DataFrame, out: str, roll_bytes: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES, min_revisit: int = 0) -> DataFrame:
    """Writes the pages' archives into the folder ``out`` (a path or URI); returns the manifest: file, records, bytes, sha1."""
    spark = frames.ready(pages.sparkSession)
    system, folder = _filesystem(out)
    if _exists(system, f"{folder}/manifest.json"):
        raise FileExistsError(f"{out} already holds archives")
    with frames.scratch(spark):
        return _commit(_written(pages, out, roll_bytes, shard_bytes, min_revisit), out)


def _written(pages: DataFrame, out: str, roll_bytes: int, shard_bytes: int, min_revisit: int) -> DataFrame:
    """MANIFEST's rows of the files that were written under temporary names."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    small = p.select("page_id", F.sha1("payload").alias("sha"), F.octet_length("payload").cast("long").alias("n"))
    small = frames.stored(small, "warc-digests")
    shards = _Shards(small, shard_bytes)
    groups = small.where(F.col("n") >= min_revisit).groupBy("sha").agg(F.max("page_id").alias("keeper"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    # stored, so that the join gets two plain shuffles, of which Spark splits what is skewed
    groups = frames.stored(groups, "warc-groups")
    revisits = small.select("page_id", "sha").join(groups, "sha").select("page_id", F.col("sha"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "keeper").distinct()
    rows = p.select("page_id", F.sha1("payload").alias("sha"), F.lit(1).alias("kind"), "url", "payload", F.lit(None).cast("long").alias("keeper"))
    dealt = revisits.unionByName(rows).withColumn("shard", shards.of(F.col("page_id"), F.col("sha")))
    ordered = dealt.repartitionById(shards.count, F.col("shard").cast("int")).sortWithinPartitions("shard", "page_id", "sha", "kind", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, last, keeper, copy = _Files(out, roll_bytes), object(), None, -1
        for b in batches:
            names = ("page_id", "sha", "kind", "url", "payload", "keeper", "shard")
            for page_id, sha, kind, url, payload, own, at in zip(*(b.column(n) for n in names), strict=True):
                page_id, sha = page_id.as_py(), sha.as_py()
                if (page_id, sha) != last:
                    last, keeper, copy = (page_id, sha), None, -1
                if kind.as_py() == 0:
                    keeper = (own.as_py(),)
                    continue
                copy += 1
                again = keeper is not None and (copy > 0 or keeper[0] != page_id)
                files.add(at.as_py(), member(record(page_id, url.as_py(), payload.as_py(), keeper if again else None, copy)))
        files.close()
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in files.rows], f.type) for i, f in enumerate(MANIFEST)], schema=MANIFEST)

    return frames.stored(ordered.mapInArrow(run, MANIFEST_NAMES), "warc-manifest")


def _exists(system, path: str) -> bool:
    from pyarrow.fs import FileType

    return system.get_file_info(path).type != FileType.NotFound


def _publish(system, source: str, target: str) -> None:
    """Renames source; done already if only the target is there, as after a repeated task."""
    if _exists(system, source):
        try:
            system.move(source, target)
        except OSError:
            if _exists(system, source) or not _exists(system, target):
                raise
    elif not _exists(system, target):
        raise FileNotFoundError(source)


def _commit(written: DataFrame, out: str) -> DataFrame:
    spark = written.sparkSession
    system, folder = _filesystem(out)
    system.create_dir(folder, recursive=True)
    named = written.withColumn("file", F.format_string("pages-%06d-%05d.warc.gz", "shard", "part"))

    def publish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, _ = _filesystem(out)
        for b in batches:
            for temporary, file in zip(b.column("temporary").to_pylist(), b.column("file").to_pylist(), strict=True):
                _publish(here, _filesystem(temporary)[1], f"{folder}/{file}")
            yield b.select(["file", "records", "bytes", "sha1"])

    manifest = frames.stored(named.repartition(frames.partitions(spark)).mapInArrow(publish, "file string, records long, bytes long, sha1 string"), "warc-files", outer=True)
    if _exists(system, f"{folder}/_temporary"):
        system.delete_dir(f"{folder}/_temporary")
    with system.open_output_stream(f"{folder}/manifest.json.tmp") as f:
        f.write(b'{"files": [')
        for i, r in enumerate(manifest.orderBy("file").toLocalIterator()):  # a row a file, written as it comes
            f.write(("," * (i > 0) + "\n " + json.dumps(r.asDict())).encode())
        f.write(b"\n]}\n")
    system.move(f"{folder}/manifest.json.tmp", f"{folder}/manifest.json")
    return manifest


READ = pa.schema([("file", pa.string()), ("position", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


#: Payload bytes and records that the reader holds before it sends them on.
HELD_BYTES, HELD_RECORDS = 4 << 20, 1000


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """READ's columns of every record in a finished folder; payload is null for revisits."""
    frames.ready(spark)
    schema = "file string, position long, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    system, path = _filesystem(folder)
    if not _exists(system, f"{path}/manifest.json"):
        raise FileNotFoundError(f"{folder} holds no finished archives")
    whole = lambda v: int(v) if v is not None else None

    def rows(path: str, content: bytes) -> Iterator[tuple]:
        for at, data in members(content):
            fields, block = parse(data)
            http, _, payload = block.partition(b"\r\n\r\n")
            n = int(http.rpartition(b"Content-Length: ")[2])
            digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
            kind = fields["WARC-Type"]
            if kind == "response" and (len(payload) != n or sha1(payload) != digest):
                raise ValueError("a payload differs from its digest")
            yield path, at, whole(fields.get("WARC-Page-ID")), fields.get("WARC-Target-URI"), kind, n, digest, whole(fields.get("WARC-Refers-To-Page-ID")), payload if payloads and kind == "response" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path"), b.column("content"), strict=True):
                held, size = [], 0
                for row in rows(path.as_py().rsplit("/", 1)[-1], content.as_buffer()):
                    held.append(row)
                    size += len(row[-1] or b"")
                    if len(held) >= HELD_RECORDS or size >= HELD_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), READ, strict=True)], schema=READ)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), READ, strict=True)], schema=READ)

    source = spark.read.format("binaryFile").option("pathGlobFilter", "pages-*.warc.gz").load(folder).select("path", "content")
    return source.mapInArrow(run, schema)


def op2_warc(spark, sf_dir: str) -> DataFrame:
    out = frames.new_path(spark, "warc")
    write(frames.table(spark, sf_dir, "pages"), out)
    return read(spark, out, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS h FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS keeper FROM d)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, (5 * (i // 4) + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to
FROM g
"""
