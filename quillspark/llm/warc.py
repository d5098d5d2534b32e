"""WARC archives, index first.

Writing: every record is a gzip member of its own; each task writes one archive of its partition and returns, for each record, its
file, offset, length, URL and digest. That index is a Parquet table. Reading starts from the index: the selected records
are sorted by file and offset, records that lie close together are fetched by one range read, and only those bytes are read.

Payloads that repeat are stored once: of equal payloads of at least `smallest` bytes, the record with the smallest page_id is a response and the
others are revisit records that refer to it.

A file's name is unique to the attempt that wrote it and never written again, so an index row always fits its file: retried or
lost tasks leave files that no index row names (`sweep` removes them).

Defined results: a null html is an empty payload; a null url is written as an empty URI; of rows with equal payload and equal smallest
page_id one is the response (null page_ids come last, and are found by digest alone); very long payloads are one record, held in memory one at a
time; an empty table gives no archive and an empty index. page_id is an integer of any width or a string, anything else is refused; other
columns than page_id, url and html are not kept, whatever they are called.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import bounded_batches, shared_dir, text_of, written

#: Records whose ranges are at most GAP bytes apart are read at once, up to SPAN bytes.
GAP, SPAN = 64 << 10, 8 << 20

DATE = "1970-01-01T00:00:00Z"  # archives of equal tables are equal

INDEX = "page_id {kind}, url string, file string, offset long, length long, payload_bytes long, payload_digest string, record_type string, refers_to {kind}"


IDS = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}


def id_type(kind: str) -> pa.DataType:
    if kind not in IDS:
        raise TypeError(f"page_id is {kind}: cast it to one of {', '.join(IDS)}")
    return IDS[kind]


def opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id) -> str:
    """An id as part of a header: any character that could end or change a line is percent-encoded; null has no last part."""
    return "<urn:page>" if page_id is None else f"<urn:page:{quote(str(page_id), safe='-')}>"


def record(page_id, url: str | None, payload: bytes, digest: str, original) -> bytes:
    """One gzip member. original: (page_id,) of the response that a revisit refers to, else None."""
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if original else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {len(payload)}"]
    if original:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(original[0])}"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if original else http + payload
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parsed(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a gzip member."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def decided(pages: DataFrame, smallest: int) -> DataFrame:
    """page_id, url, html, original (struct of the response's page_id, null for a response).

    Digests are counted in columns of a few bytes; the pages themselves move once, to meet the digests that repeat.
    """
    rows = pages.select("page_id", "url", text_of("html").alias("html")).withColumn("sha", F.unhex(F.sha1(F.col("html").cast("binary")))).withColumn("big", F.octet_length("html") >= smallest)
    same = rows.filter("big").groupBy("sha").agg(F.count("*").alias("n"), F.min("page_id").alias("first")).filter("n > 1")
    met = rows.join(same, "sha", "left")
    leader = F.col("page_id").eqNullSafe(F.col("first"))
    # rows that share the smallest page_id, too: all but one of them revisit
    tied = rows.filter("big").join(same, "sha").filter(leader).groupBy("sha").agg(F.count("*").alias("leaders")).filter("leaders > 1").select("sha")
    original = F.when(F.col("big") & F.col("n").isNotNull() & ~leader, F.struct(F.col("first").alias("page_id")))
    out = met.withColumn("original", original)
    if tied.limit(1).count():
        out = out.join(tied.withColumn("tied", F.lit(True)), "sha", "left")
        of_tie = F.col("tied").isNotNull() & F.col("big") & leader
        split = written(out.filter(of_tie).withColumn("k", F.monotonically_increasing_id()), "warc-ties")
        one = split.groupBy("sha").agg(F.min(F.struct("url", "k")).alias("one")).select("sha", F.col("one.k").alias("one"))
        split = split.join(one, "sha").withColumn("original", F.when(F.col("k") != F.col("one"), F.struct(F.col("first").alias("page_id")))).drop("k", "one")
        out = out.filter(~F.coalesce(of_tie, F.lit(False))).unionByName(split)
    return out.select("page_id", "url", "html", "original")


def write(pages: DataFrame, folder: str, smallest: int = 0) -> DataFrame:
    """Archives in folder/archives, and their index, a table in folder/index, as a DataFrame."""
    bounded_batches(pages.sparkSession)
    kind = pages.schema["page_id"].dataType.simpleString()
    own_type = id_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = opened(f"{folder}/archives")
        name, out, offset = f"part-{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            index: list[tuple] = []
            for row in batch.to_pylist():
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                payload = row["html"].encode("utf-8", "surrogatepass")
                digest, original = base32_sha1(payload), row["original"]
                member = record(row["page_id"], row["url"], payload, digest, original and (original["page_id"],))
                out.write(member)
                index.append((row["page_id"], row["url"], name, offset, len(member), len(payload), digest, "revisit" if original else "response", original and original["page_id"]))
                offset += len(member)
            if index:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index, strict=True), types, strict=True)], names=names)
        if out is not None:
            out.close()

    names = ["page_id", "url", "file", "offset", "length", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [own_type, pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), own_type]
    schema = INDEX.format(kind=kind)
    decided(pages, smallest).mapInArrow(run, schema).write.parquet(f"{folder}/index")
    return pages.sparkSession.read.schema(schema).parquet(f"{folder}/index")


def ranges(rows: list[dict], gap: int = GAP, span: int = SPAN) -> Iterator[list[dict]]:
    """Sorted index rows in runs that one range read covers."""
    run: list[dict] = []
    for row in rows:
        if run and (row["file"] != run[-1]["file"] or row["offset"] - (run[-1]["offset"] + run[-1]["length"]) > gap or row["offset"] + row["length"] - run[0]["offset"] > span):
            yield run
            run = []
        run.append(row)
    if run:
        yield run


def read(selected: DataFrame, folder: str) -> DataFrame:
    """The records of index rows: page_id, url, payload (null for a revisit), payload_bytes, payload_digest, record_type, refers_to, all
    as the archives have them. Fails if a record's payload doesn't have its digest."""
    kind = selected.schema["page_id"].dataType.simpleString()
    value = unquote if kind == "string" else int
    own_type = id_type(kind)

    def id_of(urn: str):
        return None if urn == "<urn:page>" else value(urn.removeprefix("<urn:page:").removesuffix(">"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = opened(f"{folder}/archives")
        name, source = None, None
        for batch in batches:
            for part in ranges(batch.to_pylist()):
                if part[0]["file"] != name:
                    name, source = part[0]["file"], fs.open_input_file(f"{root}/{part[0]['file']}")
                start = part[0]["offset"]
                source.seek(start)
                view = io.BytesIO(source.read(part[-1]["offset"] + part[-1]["length"] - start))
                out = []
                for row in part:
                    view.seek(row["offset"] - start)
                    headers, payload = parsed(view.read(row["length"]))
                    revisit, digest = headers["WARC-Type"] == "revisit", headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    if not revisit and base32_sha1(payload) != digest:
                        raise ValueError(f"{row['file']} at {row['offset']}: the payload doesn't have its digest")
                    out.append((id_of(headers["WARC-Record-ID"]), headers["WARC-Target-URI"], None if revisit else payload, int(headers["WARC-Payload-Length"]), digest, headers["WARC-Type"], id_of(headers["WARC-Refers-To"]) if revisit else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [own_type, pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), own_type]
    placed = selected.select("file", "offset", "length")
    n = max(1, -(-int(placed.agg(F.sum("length")).first()[0] or 0) // SPAN))
    dealt = placed.repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(run, f"page_id {kind}, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to {kind}")


def sweep(folder: str, index: DataFrame) -> int:
    """Deletes archives that no index row names; returns how many. One name per archive reaches the driver."""
    fs, root = opened(f"{folder}/archives")
    named = {r["file"] for r in index.select("file").distinct().collect()}
    stray = [f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(root, allow_not_found=True)) if f.base_name not in named]
    for path in stray:
        fs.delete_file(path)
    return len(stray)


def op4_warc(spark, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back through the index."""
    from .text import read_table

    folder = shared_dir(spark, "warc")
    index = write(read_table(spark, sf_dir, "pages"), folder)
    return read(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
s AS (SELECT page_id, strlen(t)::BIGINT AS payload_bytes, to_base32, min(page_id) OVER (PARTITION BY t) AS first FROM (SELECT *, sha1(t) AS hex FROM p) q,
      LATERAL (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ('0x' || substr(hex, 1 + 5 * (i // 4), 5))::INT // (32 ** (3 - i % 4))::INT % 32, 1), '' ORDER BY i) AS to_base32 FROM range(32) r(i)) b)
SELECT page_id, payload_bytes, to_base32 AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM s
"""
