"""WARC archives, written and read back with boundary-chain verification (operator 6).

Writing: a record for each page; of equal payloads of at least ``LEAST_BYTES`` bytes the one with the smallest page_id is
a ``response`` record with the payload, the others are ``revisit`` records without it. Spark's text writer puts the files
together, as a record ends with a blank line and a page is text.

Reading: tasks cut the archives, in splits, at every occurrence of the version line. Each cut is a candidate record; its
own header names its length and so its successor's place. Which candidates are records follows from the start of the file
alone: pointers are doubled until every candidate that the chain from the start meets is marked. A version line inside a
payload is never met, and its bytes go back to the record that holds it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import release, scratch_path, short_batches, skew_join, stored, table

VERSION = "WARC/1.0\r\n"
LEAST_BYTES = 100
#: Payloads that occur more than once are broadcast up to so many (some 80 bytes each).
BROADCAST_ROWS = 200_000
#: Bytes between a record's payload and the next record.
GAP = "\r\n\r\n"


def with_types(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``page_id, url, html`` to ``page_id, url, payload string, digest, record_type, refers_to``.

    A null html is empty. Repeated rows are records of their own; those that share the smallest page_id of a payload are
    all responses. A null page_id comes last, and revisits nothing if its payload has no other.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    taken = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"))
    hashed = taken.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    sized = hashed.where(F.octet_length("payload") >= least_bytes)
    # only payloads that occur more than once need to meet their first copy
    firsts = stored(sized.groupBy("digest").agg(F.count("*").alias("copies"), F.min("page_id").alias("first")).where("copies > 1"))
    # a small table is sent to the payloads; with a large one payloads and digests meet in a shuffle
    joined = hashed.join(F.broadcast(firsts), "digest", "left") if firsts.count() <= BROADCAST_ROWS else skew_join(hashed, firsts.hint("merge"), "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select(
        "page_id",
        "url",
        "payload",
        "digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first")).alias("refers_to"),
    )


def _record_id(page_id: Column) -> Column:
    """``<urn:page:number:digest>`` of a record with the row's payload."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(":"), F.col("digest"), F.lit(">"))


#: What a revisit record says of its payload: it is that of the record referred to.
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def records(typed: DataFrame, date: str | None = None) -> DataFrame:
    """One text for each page: header, blank line and payload; a revisit's payload is left out.

    date: the records' date, as ``2026-01-31T12:00:00Z``; the time of writing if none is given. A record's id is made of
    its page and its payload; records that agree in both, as repeated rows do, share it, and either answers for the other.
    """
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise("")
    clean = F.regexp_replace("url", r"[\r\n]", " ")
    lines = [
        F.concat(F.lit(VERSION + "WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"))),
        F.concat(F.lit("WARC-Date: "), F.lit(date) if date else F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.concat(F.lit("WARC-Target-URI: "), clean),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(F.col("refers_to").isNotNull(), F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("refers_to")))),
        F.when(F.col("record_type") == "revisit", F.lit(f"WARC-Profile: {PROFILE}")),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return typed.select(F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), block).alias("value"))


def write(typed: DataFrame, path: str) -> None:
    records(typed).write.option("lineSep", GAP).text(path)


CANDIDATE = "file string, split long, inside long, size long, body_key string, skip long, length long, record_type string, record_id string, refers string, named_digest string, digest string"
TYPES = {"string": pa.string(), "long": pa.int64()}


def _fields(head: bytes) -> dict[bytes, str]:
    lines = (line.partition(b":") for line in head.split(b"\r\n"))
    return {name.strip().lower(): value.strip().decode("utf-8", "replace") for name, _, value in lines}


def _described(body: bytes) -> tuple:
    """What the header of a piece says (from ``skip`` on), and the digest of a piece that is as long as it says."""
    end = body.find(b"\r\n\r\n")
    fields = _fields(body[:end]) if end >= 0 else {}
    told = fields.get(b"content-length", "")
    length = int(told) if told.isascii() and told.isdigit() and len(told) < 18 else None
    whole = length is not None and end + 4 + length + len(GAP) == len(body)
    digest = hashlib.sha256(body[end + 4 : end + 4 + length]).hexdigest() if whole else None
    return end + 4, length, *(fields.get(f) for f in (b"warc-type", b"warc-record-id", b"warc-refers-to", b"warc-payload-digest")), digest


def _bodies(spark: SparkSession, path: str) -> DataFrame:
    """``file, split, body, body_key`` of every piece from one version line to the next."""
    # the reader drops the version line, its separator; a file begins with one, so its first piece is empty
    rows = spark.read.option("lineSep", VERSION).text(path).select(F.col("value").cast("binary").alias("body"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))
    return rows.withColumn("body_key", F.concat(F.md5("body"), F.octet_length("body").cast("string")))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """``CANDIDATE`` of every piece. inside: the sum of the sizes of the split's pieces before it."""
    schema = pa.schema([(name, TYPES[kind]) for name, kind in map(str.split, CANDIDATE.split(", "))])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gone: dict[tuple[str, int], int] = {}
        for batch in batches:
            out = []
            for body, file, split, key in zip(batch.column("body"), *(batch.column(c).to_pylist() for c in ("file", "split", "body_key")), strict=True):
                body = body.as_buffer().to_pybytes()
                inside, size = gone.get((file, split), 0), len(body) + len(VERSION)
                gone[file, split] = inside + size
                out.append((file, split, inside, size, key, *_described(body)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema) if out else pa.RecordBatch.from_pylist([], schema)

    return short_batches(_bodies(spark, path)).mapInArrow(emit, CANDIDATE)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """``file, split, inside, at, next`` of every piece and what its header says; ``digest`` if it is as long as that says.

    at: its place in the file; next: the place that its header gives its successor, null if it gives none. A piece's
    place is the sum of the sizes before it: a task sums along its split, a window along the splits of a file.
    """
    found = stored(_pieces(spark, path))
    sums = found.groupBy("file", "split").agg(F.sum("size").alias("total"))
    before = F.sum("total").over(W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1))
    splits = sums.select("file", "split", F.coalesce(before, F.lit(0)).alias("base"))
    at = F.col("base") + F.col("inside") - len(VERSION)
    return found.join(splits, ["file", "split"]).withColumn("at", at).where("at >= 0").withColumn("next", F.col("at") + len(VERSION) + F.col("skip") + F.col("length") + len(GAP)).drop("base", "size")


def reachable(chain: DataFrame) -> DataFrame:
    """``file, at, next`` to the ``file, at`` that the chain from place 0 meets, by pointer doubling.

    After k rounds the marked ones are the first 2^k of each file and ``next`` leads 2^k on, so rounds grow with the
    logarithm of the records in a file. Keys are single records, so a long file is no hot key.
    """
    jump = stored(chain.where("next is not null").select("file", "at", "next"))
    marked = stored(chain.where("at = 0").select("file", "at"))
    n = marked.count()
    while True:
        ahead = marked.join(jump, ["file", "at"]).select("file", F.col("next").alias("at"))
        ahead = ahead.join(chain.select("file", "at"), ["file", "at"], "left_semi")  # the end of the file is no record
        last, marked = marked, stored(marked.unionByName(ahead).distinct())
        release(last)
        m = marked.count()
        if m == n:
            return marked
        n = m
        onward = jump.select("file", F.col("at").alias("next"), F.col("next").alias("far"))
        last, jump = jump, stored(jump.join(onward, ["file", "next"]).select("file", "at", F.col("far").alias("next")))
        release(last)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    Size and digest of a response are those of the bytes read; a revisit has those of the response that it names.
    """
    pieces = stored(candidates(spark, path))
    real = reachable(pieces.select("file", "at", "next"))
    own = pieces.join(real.withColumn("real", F.lit(True)), ["file", "at"], "left")
    complete = own.where("real and digest is not null").select("record_id", "refers", "record_type", "named_digest", F.col("length").alias("payload_bytes"), F.col("digest").alias("payload_digest"))
    # a record that holds version lines, and the pieces that they cut from it: each belongs to the last such record before it
    owner = F.last(F.when(F.col("real"), F.col("at")), ignorenulls=True).over(W.partitionBy("file").orderBy("at"))
    broken = stored(own.where("(real and digest is null) or real is null").withColumn("owner", owner).where("owner is not null"))
    # their bytes are read once more, no others leave the archives; they are known by size and digest, not by where a
    # task reads them, as the files may be split otherwise by then
    wanted = stored(broken.select("body_key").distinct())
    again = _bodies(spark, path).select("body_key", "body")
    again = again.join(F.broadcast(wanted), "body_key") if wanted.count() <= BROADCAST_ROWS else skew_join(again, wanted, "body_key")
    bodies = again.groupBy("body_key").agg(F.first("body").alias("body"))
    lost = F.raise_error(F.concat(F.lit("bytes are missing of a record in "), F.col("file"))).cast("binary")
    parts = skew_join(broken, bodies.hint("merge"), "body_key", "left").withColumn("body", F.when(F.col("body").isNull(), lost).otherwise(F.col("body")).cast("string"))
    first = lambda c: F.max(F.when(F.col("real"), F.col(c))).alias(c)
    whole = parts.groupBy("file", "owner").agg(*map(first, ("skip", "length", "record_id", "refers", "record_type", "named_digest")), F.sort_array(F.collect_list(F.struct("at", "body"))).alias("parts"))
    bytes_ = F.array_join(F.transform("parts", lambda p: p["body"]), VERSION).cast("binary")
    mended = whole.withColumn("all", bytes_).select("record_id", "refers", "record_type", "named_digest", F.col("length").alias("payload_bytes"), F.sha2(F.expr("substring(all, cast(skip + 1 as int), cast(length as int))"), 256).alias("payload_digest"))
    found = stored(complete.unionByName(mended).withColumn("named_digest", F.regexp_replace("named_digest", "^sha256:", "")))
    key = lambda c, d: F.concat_ws(" ", c, d).alias("key")
    responses = found.where("record_type = 'response'").select(key("record_id", "payload_digest"), F.col("payload_bytes").alias("b"), F.col("payload_digest").alias("d")).distinct()
    revisits = skew_join(found.where("record_type = 'revisit'").select("*", key("refers", "named_digest")), responses.hint("merge"), "key", "left")
    page = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+):", 1).try_cast("long")
    columns = ["record_id", "refers", "record_type"]
    out = found.where("record_type <> 'revisit'").select(*columns, "payload_bytes", "payload_digest").unionByName(revisits.select(*columns, F.col("b").alias("payload_bytes"), F.col("d").alias("payload_digest")))
    return out.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers").alias("refers_to"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write(with_types(table(spark, sf_dir, "pages")), path)
    return read(spark, path)


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS d FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
