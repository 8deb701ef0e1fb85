"""WARC archives: writing, normalising to one gzip member per record, reading (operator 10).

1. ``write_archives``: records as text files with gzip compression. Such a file is one gzip
   stream from end to end; a reader that wants one record must inflate all before it.
2. ``normalise``: each stream is inflated once, piece by piece; every record becomes a gzip
   member of its own, and an index line says where it lies. Members and index go out in one
   pass, as two folders whose part numbers agree. Spark's text writer ends each row with a
   line separator; here that is an empty gzip member, so the files are valid as they are.
3. ``read_archives``: the index gives offset and length of each member, and only those bytes
   are inflated.

All files are read and written by Spark, so any store that Spark reaches will do.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convolytics.llm.common import folder, text_column

#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 1000
#: Records per written file; bounds what a task inflates from one file.
RECORDS_PER_FILE = 5_000
#: The date of all records: times are not in the table.
DATE = "2024-01-01T00:00:00Z"
END = "\r\n\r\n"
#: An empty gzip member (fixed value): separates the members of a normalised file.
EMPTY = bytes.fromhex("1f8b08000000000000ff03000000000000000000")
#: Index lines per row of the index file.
INDEX_LINES = 10_000


def records(pages: DataFrame) -> DataFrame:
    """(value,): the text of a WARC record per row of ``pages`` (page_id, url, html).

    Of rows with the same payload of at least ``LEAST_BYTES`` bytes those with the largest
    page_id are responses (several if they repeat the id), the others revisit it. A null
    html is an empty payload; a null page_id counts as smaller than all others.
    """
    rows = pages.select(
        pages["page_id"].cast("long").alias("page_id"),
        F.regexp_replace(text_column(pages, "url"), r"[\r\n]", "%0A").alias("url"),
        text_column(pages, "html").alias("html"),
    )
    rows = rows.withColumn("size", F.octet_length("html"))
    large = F.col("size") >= LEAST_BYTES
    # Small payloads match nothing; keys of their own spread them over the join's tasks.
    own = F.concat(F.lit("-"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(" "), "url")
    key = F.when(large, F.sha2("html", 256)).otherwise(own)
    # Copies meet in a partial aggregation; only payloads that repeat are joined back.
    last = (
        rows.where(large)
        .select(key.alias("key"), "page_id")
        .groupBy("key")
        .agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 and response is not null")
        .drop("n")
    )
    rows = rows.withColumn("key", key).join(last, "key", "left")
    revisit = F.col("response").isNotNull() & ~F.col("response").eqNullSafe(F.col("page_id"))
    digest = F.sha1("html")
    name = lambda page: F.concat(
        F.lit("<urn:uuid:"),
        F.regexp_replace(
            F.substring(F.sha2(F.concat_ws("|", page, digest), 256), 1, 32),
            "^(.{8})(.{4})(.{4})(.{4})(.{12})$",
            "$1-$2-$3-$4-$5",
        ),
        F.lit(">"),
    )
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("size").cast("string"),
        F.lit(END),
    )
    block = F.when(revisit, head).otherwise(F.concat(head, F.col("html")))
    page = F.col("page_id").cast("string")
    lines = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.when(revisit, "WARC-Type: revisit").otherwise("WARC-Type: response"),
        F.concat(F.lit("WARC-Record-ID: "), name(page)),
        F.lit(f"WARC-Date: {DATE}"),
        F.when(F.col("url") != "", F.concat(F.lit("WARC-Target-URI: "), "url")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), digest),
        F.concat(F.lit("X-Payload-Bytes: "), F.col("size").cast("string")),
        F.concat(F.lit("X-Page-ID: "), page),
        F.when(
            revisit,
            F.concat(
                F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                F.lit("\r\nWARC-Refers-To: "),
                name(F.col("response").cast("string")),
                F.lit("\r\nX-Refers-To-Page-ID: "),
                F.col("response").cast("string"),
            ),
        ),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    return rows.select(F.concat(lines, F.lit(END), block).alias("value"))


def write_archives(pages: DataFrame, path: str, per_file: int = RECORDS_PER_FILE) -> None:
    """Write the records of ``pages`` under ``path``, each file one gzip stream."""
    (
        records(pages)
        .write.option("compression", "gzip")
        .option("lineSep", END)
        .option("maxRecordsPerFile", per_file)
        .text(path)
    )


def parse_records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(headers, block, whole record) of a stream of inflated bytes."""
    held = b""
    chunks = iter(chunks)
    while True:
        cut = held.find(b"\r\n\r\n")
        while cut < 0:
            more = next(chunks, None)
            if more is None:
                if held.strip():
                    raise ValueError("the archive ends within a record")
                return
            begin = max(0, len(held) - 3)
            held += more
            cut = held.find(b"\r\n\r\n", begin)
        lines = held[:cut].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        size = cut + 4 + int(headers["Content-Length"]) + 4
        parts, have = [held], len(held)
        while have < size:
            more = next(chunks, None)
            if more is None:
                raise ValueError("the archive ends within a record")
            parts.append(more)
            have += len(more)
        held = b"".join(parts)
        yield headers, held[cut + 4 : size - 4], held[:size]
        held = held[size:]


def inflated(content: bytes, step: int = 1 << 18) -> Iterator[bytes]:
    """The bytes of a gzip file, one or many members, inflated piece by piece."""
    while content:
        stream = zlib.decompressobj(31)
        at = 0
        while at < len(content) and not stream.eof:
            out = stream.decompress(content[at : at + step])
            at += step
            if out:
                yield out
        content = stream.unused_data + content[at:]


def normalised_rows(batches):
    """Map (content) of gzip files to the rows of one normalised file: members, index lines."""
    offset = seq = 0
    lines: list[str] = []

    def row(kind, at, data):
        return pa.RecordBatch.from_arrays(
            [pa.array([kind]), pa.array([at], pa.int64()), pa.array([data], pa.binary())],
            ["kind", "seq", "data"],
        )

    for batch in batches:
        for i in range(batch.num_rows):
            content = batch.column(0)[i].as_py()
            for headers, _, whole in parse_records(inflated(content)):
                member = gzip.compress(whole, 6, mtime=0)
                lines.append(
                    json.dumps(
                        {
                            "id": headers["WARC-Record-ID"],
                            "type": headers["WARC-Type"],
                            "uri": headers.get("WARC-Target-URI"),
                            "offset": offset,
                            "length": len(member),
                        }
                    )
                )
                yield row("warc", seq, member)
                offset += len(member) + len(EMPTY)
                seq += 1
                if len(lines) == INDEX_LINES:
                    yield row("index", seq, gzip.compress("\n".join([*lines, ""]).encode(), mtime=0))
                    lines = []
    if lines:
        yield row("index", seq, gzip.compress("\n".join([*lines, ""]).encode(), mtime=0))


def normalise(spark: SparkSession, source: str, target: str) -> None:
    """Rewrite the gzip archives under ``source`` with one member per record under ``target``.

    ``target/kind=warc`` has the archives, ``target/kind=index`` the sidecar of each, under the
    same part number: gzipped JSON lines with id, type, uri, offset and length.
    """
    content = spark.read.format("binaryFile").load(source).select("content")
    rows = content.mapInArrow(normalised_rows, "kind string, seq long, data binary")
    (
        rows.sortWithinPartitions("kind", "seq")
        .select("kind", F.col("data").cast("string").alias("value"))
        .write.partitionBy("kind")
        .option("encoding", "ISO-8859-1")
        .option("lineSep", EMPTY.decode("latin-1"))
        .text(target)
    )


def read_rows(batches):
    """Map (data, index) of normalised files to the rows of their records."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "offset"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    number = lambda x: None if x is None else int(x)
    for batch in batches:
        for i in range(batch.num_rows):
            data = memoryview(batch.column(0)[i].as_buffer())
            index = b"".join(inflated(batch.column(1)[i].as_py()))
            out = []
            for line in index.splitlines():
                entry = json.loads(line)
                at = entry["offset"]
                raw = zlib.decompress(data[at : at + entry["length"]], 31)
                headers, block, _ = next(parse_records(iter([raw])))
                payload = block[block.index(b"\r\n\r\n") + 4 :]
                kind = headers["WARC-Type"]
                digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                size = int(headers["X-Payload-Bytes"])
                if kind == "response":
                    if hashlib.sha1(payload).hexdigest() != digest or len(payload) != size:
                        raise ValueError(f"the payload of {headers['WARC-Record-ID']} is damaged")
                refers = headers.get("X-Refers-To-Page-ID")
                out.append((number(headers.get("X-Page-ID")), size, digest, kind, number(refers), at))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names
            )


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all records under ``path``, written by ``normalise``, found by the index."""

    def files(kind, name):
        part = F.regexp_extract("path", r"part-(\d+)", 1)
        read = spark.read.format("binaryFile").load(f"{path}/kind={kind}")
        return read.select(part.alias("part"), F.col("content").alias(name))

    both = files("warc", "data").join(files("index", "index"), "part").select("data", "index")
    return both.mapInArrow(
        read_rows,
        "page_id long, payload_bytes long, payload_digest string, record_type string, "
        "refers_to long, offset long",
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, offset) per page.

    Written, normalised and read back; offset: where the record's member begins in its file.
    Size and digest are those of the full payload, also for revisits. Repeated rows and null
    ids have a record each; an empty table gives an empty result; other columns are not read.
    """
    spark = pages.sparkSession
    once, members = folder(spark, "warc-streams"), folder(spark, "warc-members")
    write_archives(pages, once)
    normalise(spark, once, members)
    found = spark.read.format("binaryFile").load(members).select("path").limit(1).count()
    if not found:
        schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, offset long"
        return spark.createDataFrame([], schema)
    return read_archives(spark, members)
