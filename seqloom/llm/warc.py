"""WARC archives: writing, reading, and revisit resolution.

Archives are files of the shared folder that Spark's text writer makes: a record is a line whose separator
is the blank line that ends a WARC record. They are read back as binary files and cut by the records'
own Content-Length, so payloads may hold anything, separators and record headers included.

Resolution shuffles headers alone by payload digest: of records with equal payloads the one with the smallest
page id stays a response, the others become revisits that name it. Payloads move once, to meet these
decisions by record, when the deduplicated archives are written with fresh headers.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import join_to_classes, small_batches, stage, staged_path

CRLF = "\r\n"
#: Records in one archive at most, by the bytes of their payloads: an archive, which a reading task holds whole, has about 160 MB
#: before compression at most, or one record.
SIZE_CLASSES = [(32 << 10, 5_000), (1 << 20, 150), (None, 1)]
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 SHA-1 of a string's bytes: five hex digits are four base32 letters."""
    hexed = F.sha1(payload.cast("binary"))
    letters = []
    for at in range(1, 41, 5):
        value = F.conv(F.substring(hexed, at, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(value, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def _line(name: str, value: Column | str) -> Column:
    """A header line; none where the value is null. Line ends in a value become spaces, so that no value adds a header."""
    text = F.regexp_replace(value.cast("string"), "[\r\n]+", " ") if isinstance(value, Column) else F.lit(value)
    return F.coalesce(F.concat(F.lit(f"{name}: "), text, F.lit(CRLF)), F.lit(""))


def _urn(seed: Column) -> Column:
    h = F.md5(seed.cast("string"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def record(kind: Column, place: Column, page_id: Column, url: Column, digest: Column, payload: Column, refers_to: Column, refers_place: Column) -> Column:
    """One WARC record without the blank line that ends it. place numbers the record and gives its record id."""
    response = kind == "response"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"))
    block = F.when(response, F.concat(http, payload)).otherwise(F.lit(""))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"), _line("WARC-Type", kind), _line("WARC-Record-ID", _urn(place)), _line("WARC-Date", DATE), _line("WARC-Target-URI", url),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)), _line("WARC-Profile", F.when(~response, F.lit(PROFILE))), _line("WARC-Refers-To", F.when(~response, _urn(refers_place))),
        _line("Content-Type", F.when(response, F.lit("application/http; msgtype=response"))), _line("Seqloom-Place", place), _line("Seqloom-Page", page_id), _line("Seqloom-Refers-To-Page", F.when(~response, refers_to)),
        _line("Content-Length", F.octet_length(block)), F.lit(CRLF),
    )
    return F.concat(head, block)


def present_classes(sizes: DataFrame, size_classes: list[tuple[int | None, int]] = SIZE_CLASSES) -> dict[str, tuple[Column, int]]:
    """Name, condition on payload_size, and records of an archive, of each size class that a table shows; the first class at least.

    size_classes: (payloads of at most so many bytes, records in an archive), ascending; None: the rest.
    """
    least, tests = -1, {}
    for most, records in size_classes:
        size = F.col("payload_size")
        tests[f"over-{least}" if most is None else f"upto-{most}"] = ((size > least) & ((size <= most) if most is not None else F.lit(True)), records)
        least = most
    there = sizes.agg(*[F.coalesce(F.bool_or(test), F.lit(False)) for test, _ in tests.values()]).first()
    return {k: v for (k, v), found in zip(tests.items(), there) if found} or dict([next(iter(tests.items()))])


def write_archives(lines: DataFrame, path: str, records: int) -> None:
    """Write a one-column table of records as gzip-compressed archives."""
    lines.write.option("lineSep", CRLF * 2).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", records).text(path)


def cut_records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record in a stream of bytes; holds one record at a time."""
    held = bytearray()
    done = False
    source = iter(chunks)

    def fill(n: int) -> bool:
        nonlocal done
        while len(held) < n and not done:
            more = next(source, None)
            done = more is None
            if more:
                held.extend(more)
        return len(held) >= n

    while True:
        at = -1
        seen = 0
        while at < 0:
            at = held.find(b"\r\n\r\n", max(0, seen - 3))
            seen = len(held)
            if at < 0 and not fill(seen + 1):
                if held.strip():
                    raise ValueError("archive ends within a header")
                return
        first, *rest = bytes(held[:at]).decode("utf-8", "replace").split(CRLF)
        if not first.startswith("WARC/"):
            raise ValueError(f"no record starts at {first[:40]!r}")
        head = dict(x.split(": ", 1) for x in rest)
        size = int(head["Content-Length"])
        if not fill(at + 4 + size + 4):
            raise ValueError("archive ends within a record")
        yield head, bytes(held[at + 4 : at + 4 + size])
        del held[: at + 4 + size + 4]


def _unzipped(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    unzip = zlib.decompressobj(31)
    for at in range(0, len(data), step):
        yield unzip.decompress(data[at : at + step])
        while unzip.eof and unzip.unused_data:  # a member for each record or file
            rest, unzip = unzip.unused_data, zlib.decompressobj(31)
            yield unzip.decompress(rest)
    yield unzip.flush()


SCHEMA = "place long, page_id long, record_type string, url string, record_id string, refers_to_record string, refers_to long, header_digest string, payload_digest string, payload_bytes long"


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row for each record of the archives under path; digests and sizes are of the blocks as read."""
    small_batches(spark)  # the archives of a batch are of one scan partition, whose bytes Spark bounds
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    names = [x.split()[0] for x in SCHEMA.split(", ")] + ["payload"] * with_payload

    def run(batches):
        def flush(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds, strict=True)], names)

        kinds = [pa.int64() if x.endswith("long") else pa.string() for x in SCHEMA.split(", ")] + [pa.string()] * with_payload
        rows, held = [], 0
        for b in batches:
            for content in b.column("content"):
                for head, block in cut_records(_unzipped(content.as_py())):
                    payload = block.split(b"\r\n\r\n", 1)[1] if head["WARC-Type"] == "response" else None
                    number = lambda k, head=head: int(head[k]) if k in head else None
                    rows.append((number("Seqloom-Place"), number("Seqloom-Page"), head["WARC-Type"], head.get("WARC-Target-URI"), head["WARC-Record-ID"], head.get("WARC-Refers-To"), number("Seqloom-Refers-To-Page"), head["WARC-Payload-Digest"].removeprefix("sha1:"), None if payload is None else digest_of(payload), None if payload is None else len(payload), *([None if payload is None else payload.decode()] if with_payload else [])))
                    held += len(block) if with_payload else 64
                    if held > 4 << 20:
                        yield flush(rows)
                        rows, held = [], 0
        if rows:
            yield flush(rows)

    return files.mapInArrow(run, SCHEMA + ", payload string" * with_payload)


def resolve(headers: DataFrame, least_bytes: int = 0) -> DataFrame:
    """place, refers_to, refers_place of every record that repeats the payload of another.

    headers: place, page_id, payload_digest, payload_bytes. Of equal payloads of at least least_bytes the
    smallest page_id (nulls last, then the smallest place) is the original. Minima are partial aggregates,
    so a digest that a third of all records share costs each task one row.
    """
    long_enough = headers.where(F.col("payload_bytes") >= least_bytes).select("place", "page_id", "payload_digest")
    order = F.struct(F.col("page_id").isNull(), F.col("page_id").alias("page"), F.col("place").alias("at"))
    first = stage(long_enough.groupBy("payload_digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1"), "originals")
    return join_to_classes(long_enough, first, "payload_digest").where("place <> first.at").select("place", F.col("first.page").alias("refers_to"), F.col("first.at").alias("refers_place"))


def archive_and_dedup(pages: DataFrame, least_bytes: int = 0, path: str | None = None, size_classes: list[tuple[int | None, int]] = SIZE_CLASSES) -> DataFrame:
    """Write a response record for each page, resolve revisits, write deduplicated archives and read them back.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to, url, record_id: sizes and digests
    of the full payload, a revisit's from the response it refers to. Null html is an empty payload; a null url
    or page_id is a record without that header; rows that repeat are records of their own; an empty table
    makes empty archives and no rows; other columns are ignored. path: where the archives go (all.warc,
    dedup.warc), else the shared folder.
    """
    spark = pages.sparkSession
    base = path or staged_path(spark, "warc")
    place, payload = F.monotonically_increasing_id().alias("place"), F.coalesce("html", F.lit("")).alias("payload")
    rows = pages.select(place, F.col("page_id").cast("long").alias("page_id"), "url", payload)
    nothing = F.lit(None).cast("long")
    col = F.col
    rows = rows.withColumn("digest", base32_sha1(col("payload")))
    rows = rows.withColumn("payload_size", F.octet_length("payload"))
    classes = present_classes(rows, size_classes)
    for name, (test, most) in classes.items():
        line = record(F.lit("response"), col("place"), col("page_id"), col("url"), col("digest"), col("payload"), nothing, nothing)
        write_archives(rows.where(test).select(line), f"{base}/all.warc/{name}", most)

    headers = stage(read_archives(spark, f"{base}/all.warc"), "headers")
    decisions = stage(resolve(headers, least_bytes).withColumnRenamed("place", "at"), "decisions")
    kind = F.when(col("refers_place").isNull(), F.lit("response")).otherwise(F.lit("revisit"))
    for name, (_, most) in classes.items():
        records = read_archives(spark, f"{base}/all.warc/{name}", with_payload=True)
        decided = records.join(decisions.hint("shuffle_hash"), records["place"] == decisions["at"], "left").select("place", "page_id", "url", "payload_digest", "payload", decisions["refers_to"], "refers_place")
        line = record(kind, col("place"), col("page_id"), col("url"), col("payload_digest"), col("payload"), col("refers_to"), col("refers_place"))
        write_archives(decided.select(line), f"{base}/dedup.warc/{name}", most)

    found = read_archives(spark, f"{base}/dedup.warc").withColumn("original", F.coalesce("refers_to_record", "record_id"))
    found = stage(found, "headers")
    size = F.max(F.when(col("record_type") == "response", F.struct(col("payload_bytes").alias("full_bytes"), col("payload_digest").alias("full_digest"))))
    sizes = stage(found.groupBy("original").agg(size.alias("full"), F.count("*").alias("n")).select("original", "n", "full.*"), "sizes")
    return join_to_classes(found.drop("payload_bytes", "payload_digest"), sizes, "original").select("page_id", col("full_bytes").alias("payload_bytes"), col("full_digest").alias("payload_digest"), "record_type", "refers_to", "url", "record_id")


ORACLE = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, url, octet_length(encode(h)) AS payload_bytes, sha1(h) AS x FROM p),
b AS (SELECT page_id, payload_bytes, x, list_aggregate(list_transform(generate_series(0, 31), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(x, 1 + 5 * (i // 4)::INT, 5))::BIGINT) >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), 'string_agg', '') AS payload_digest
      FROM d),
m AS (SELECT *, min(page_id) OVER (PARTITION BY x) AS first FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM m
"""
