"""WARC archives: a deterministic sharded writer and its reader.

Records are range-sorted by their id; the ranges are cut at every so many ranks of the ids, and a task writes one range as a run of
files, each closed once its compressed size passes a limit. Every record is one gzip member with regenerated headers (lengths,
digests, ids derived from content) and a fixed date, so that bytes repeat exactly. A file is written under a temporary name of
its task attempt and renamed when complete; its row of the manifest is committed with the task by Spark's own committer, and
readers take only files that the manifest lists. A retried or speculative task writes the same names with the same bytes.

Of records with equal payloads of at least `revisit_bytes`, that of the smallest id is a response, the others are revisits that
refer to it and store no payload. The smallest ids are found on (id, digest) rows alone; these verdicts travel to the range of
their page, so that the html is shuffled once.

Defined cases: a null html is the empty payload; a null url is written as an empty target; a page without id is written with the
id `null` and always a response; of repeated rows with one id and payload, the first is a response if the id is the smallest; pages of any length are one
record; an empty table gives no archives. Extra columns are ignored, whatever their names. A task that fails removes its unfinished file, and one that
finds a file finished by an attempt before it keeps that.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import range_cuts, range_of, shared_dir, written

REVISIT_BYTES = 100
#: Compressed bytes after which a file is closed and the next begun.
FILE_BYTES = 64 << 20
#: Rows of a range, about; ranges are what tasks write.
RANGE_ROWS = 5_000
DATE = "2000-01-01T00:00:00Z"
LEVEL = 4
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def revisits(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """page_id, digest, first: for each page with an id whose payload others have too, the smallest id of that payload."""
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("html", F.lit("")).cast("binary").alias("_raw"))
    slim = slim.where(F.col("page_id").isNotNull() & (F.octet_length("_raw") >= revisit_bytes)).select("page_id", F.sha2("_raw", 256).alias("digest"))
    # A written table keeps both sides of the join splittable where one payload is hot.
    many = written(slim.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies"))
    return slim.join(many, "digest").select("page_id", "digest", "first")


def record(page_id: int | None, url: str | None, html: bytes, digest: str, kind: str, refers: int | None) -> bytes:
    """One record as one gzip member."""
    name = hashlib.sha256(f"{page_id}|{digest}|{kind}".encode()).hexdigest()[:32]
    block = HEAD + html if kind == "response" else HEAD
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{name[:8]}-{name[8:12]}-{name[12:16]}-{name[16:20]}-{name[20:]}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {(url or '').replace(chr(13), ' ').replace(chr(10), ' ')}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"X-Page-ID: {'null' if page_id is None else page_id}",
        f"X-Payload-Length: {len(html)}",
        *([f"WARC-Refers-To-Page: {refers}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if kind == "revisit" else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", LEVEL, mtime=0)


def parse(file, step: int = 1 << 18) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, payload) of the records of an open archive, a gzip member at a time; checks lengths and digests."""
    held = file.read(step)
    while held:
        d, parts = zlib.decompressobj(31), []
        while not d.eof:
            if not held:
                raise ValueError("a record ends before its gzip member does")
            parts.append(d.decompress(held))
            held = d.unused_data if d.eof else file.read(step)
        held = held or file.read(step)
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines)
        block = rest[: int(fields["Content-Length"])]
        if version != "WARC/1.1" or f"sha256:{hashlib.sha256(block).hexdigest()}" != fields["WARC-Block-Digest"]:
            raise ValueError(f"a damaged record: {fields['WARC-Record-ID']}")
        yield fields, block[len(HEAD) :]


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def write_archives(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES, rows: int = RANGE_ROWS, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Writes the archives of pages (page_id, url, html) to a shared folder; returns the manifest, a row for each file."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    cuts = range_cuts(p, "page_id", rows)
    # The verdict on a page sorts before the page itself.
    verdicts = revisits(pages, revisit_bytes).select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", "first")
    both = p.withColumns({"digest": F.lit(None).cast("string"), "first": F.lit(None).cast("long")}).unionByName(verdicts)
    dealt = both.withColumn("_range", range_of("page_id", cuts)).repartitionById(len(cuts) + 1, F.col("_range"))
    dealt = dealt.sortWithinPartitions("_range", F.col("page_id").asc_nulls_first(), F.col("html").asc_nulls_first(), "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        store.create_dir(base, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        page, first_of, written_first = object(), {}, set()
        out, size, n, k, of, digest, temporary = None, 0, 0, 0, None, hashlib.sha256(), ""
        done = []

        def close() -> None:
            nonlocal out, size, n, k, digest
            out.close()
            name = f"range-{of:06d}-{k:04d}.warc.gz"
            if store.get_file_info(f"{base}/{name}").type == fs.FileType.File:
                store.delete_file(temporary)  # an attempt before this one wrote the same bytes
            else:
                store.move(temporary, f"{base}/{name}")
            done.append((of, name, n, size, digest.hexdigest()))
            out, size, n, k, digest = None, 0, 0, k + 1, hashlib.sha256()

        try:
            for batch in batches:
                for row in batch.to_pylist():
                    if row["_range"] != of and out is not None:
                        close()
                    if row["_range"] != of:
                        of, k = row["_range"], 0
                    if row["page_id"] != page:
                        page, first_of, written_first = row["page_id"], {}, set()
                    if row["html"] is None:
                        first_of[row["digest"]] = row["first"]
                        continue
                    html = row["html"].encode()
                    own = hashlib.sha256(html).hexdigest()
                    first = first_of.get(own)
                    response = first is None or first == page and own not in written_first
                    written_first.add(own)
                    raw = record(page, row["url"], html, own, "response" if response else "revisit", None if response else first)
                    if out is None:
                        temporary = f"{base}/.{attempt}-{of:06d}-{k:04d}"
                        out = store.open_output_stream(temporary, compression=None)
                    out.write(raw)
                    digest.update(raw)
                    size, n = size + len(raw), n + 1
                    if size >= file_bytes:
                        close()
            if out is not None:
                close()
        except BaseException:
            if out is not None:
                out.close()
                store.delete_file(temporary)
            raise
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=["range", "file", "records", "bytes", "sha256"])

    manifest = dealt.mapInArrow(run, "range long, file string, records long, bytes long, sha256 string")
    manifest.write.parquet(f"{folder}/_manifest")
    return manifest.sparkSession.read.parquet(f"{folder}/_manifest")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, url, record_type, payload, payload_bytes, payload_digest, refers_to of every record in the files that the manifest lists."""
    manifest = spark.read.parquet(f"{folder}/_manifest")
    schema = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        for batch in batches:
            for row in batch.to_pylist():
                found, held, n = [], 0, 0
                with store.open_input_stream(f"{base}/{row['file']}", compression=None) as file:
                    for f, payload in parse(file):
                        page = f["X-Page-ID"]
                        refers = f.get("WARC-Refers-To-Page")
                        found.append((None if page == "null" else int(page), f["WARC-Target-URI"], f["WARC-Type"], payload, int(f["X-Payload-Length"]), f["WARC-Payload-Digest"].removeprefix("sha256:"), refers and int(refers)))
                        held, n = held + len(payload), n + 1
                        if held > 4 << 20:
                            yield _rows(found, names)
                            found, held = [], 0
                if n != row["records"]:
                    raise ValueError(f"{row['file']} has {n} records, its manifest {row['records']}")
                if found:
                    yield _rows(found, names)

    files = manifest.repartition(max(1, manifest.count()), "file")
    return files.mapInArrow(run, schema)


def _rows(found: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found, strict=True), kinds, strict=True)], names=names)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes archives to a new shared folder and reads them back."""
    spark = pages.sparkSession
    folder = shared_dir(spark)
    write_archives(pages, folder)
    return read_archives(spark, folder)
