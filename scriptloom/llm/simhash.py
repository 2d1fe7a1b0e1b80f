"""SimHash near-duplicates found with deletion-variant signatures (operator 3).

A 64-bit fingerprint is cut into ``SEGMENTS`` = 2 halves. Two fingerprints that differ in at most 3 bits differ in at
most one bit of some half, so they agree on that half with one bit deleted. Each distinct fingerprint is indexed under
its 64 one-wildcard variants; an equality on the variant gives the candidates, the bit count of the difference verifies
them. Copies with one fingerprint are grouped before anything else.

A bucket is never paired out. Buckets of two are settled inside their aggregate; larger ones are cut into blocks by a
hash of the fingerprint, each pair of blocks is compared in one row of bounded size, and only a spanning forest of the
links found there is emitted, so the rows stay in proportion to the members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import short_batches, skew_join, stored, table
from .components import connected_components

RADIUS = 3
SEGMENTS = 2
WIDTH = 64 // SEGMENTS
#: Members of a bucket that go into one block; two blocks are compared at a time.
BLOCK = 1024
#: Members that are compared with all at once.
SLAB = 128
#: Shingles whose bits are counted at once.
SLICE = 1 << 16


def fingerprint(text: bytes, k: int = 3) -> int:
    """SimHash of the k-word shingles, repeats included; words are runs of bytes other than ASCII white space."""
    words = text.lower().split()
    if not words:
        return 0
    shingles = list(map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False))) or [b" ".join(words)]
    one, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, len(shingles), SLICE):
        h = np.array([one(s, 42) for s in shingles[i : i + SLICE]], "<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * total > len(shingles), bitorder="little")
    return int(bits.view("<i8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", k: int = 3) -> DataFrame:
    """``docs`` (any columns) with ``fp long`` added; a null or blank text has 0."""

    @F.arrow_udf("long")
    def compute(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t.as_py() or b"", k) for t in texts.cast(pa.binary())], pa.int64())

    return short_batches(docs).withColumn("fp", compute(F.col(text)))


def _variants(fp: Column) -> Column:
    """One key for each deleted bit: the segment's number, the bit's, and the segment without it."""
    keys = []
    for s in range(SEGMENTS):
        part = F.shiftrightunsigned(fp, s * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1))
        for bit in range(WIDTH):
            mark = (s * WIDTH + bit) << WIDTH
            keys.append(part.bitwiseAND(F.lit(((1 << WIDTH) - 1) & ~(1 << bit))).bitwiseOR(F.lit(mark)))
    return F.array(*keys)


def _forest(members: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) for the members of one row that are linked, directly or not, to a smaller one."""
    n = len(members)
    near = np.empty((n, n), bool)
    slabs = [slice(i, i + SLAB) for i in range(0, n, SLAB)]  # some rows at a time, as numbers take more room than flags
    for at in slabs:
        near[at] = np.bitwise_count(members[at, None] ^ members[None, :]) <= radius
    label = np.arange(n, dtype=np.int32)
    while True:
        least = np.concatenate([np.where(near[at], label[None, :], n).min(axis=1) for at in slabs]).astype(np.int32)
        least = least[least]
        if (least == label).all():
            break
        label = least
    at = np.flatnonzero(label != np.arange(n))
    return members[at], members[label[at]]


def similar_links(fingerprints: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Distinct ``fp`` to ``(u, v)``: edges that connect just what links of at most ``radius`` (<= 3) bits connect."""
    if radius >= 2 * SEGMENTS:
        raise ValueError("two segments with one deleted bit each guarantee 3 bits")
    index = fingerprints.select("fp", F.explode(_variants(F.col("fp"))).alias("key"))
    buckets = stored(index.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"))
    pairs = buckets.where("n = 2").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).select(F.col("a").alias("u"), F.col("b").alias("v"))
    large = buckets.where("n > 2").select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    # always a merge join: it can split a hot bucket, and what it shuffles grows in proportion to the fingerprints
    own = skew_join(index, large.hint("merge"), "key").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    dealt = own.select("key", "fp", "own", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    # the row of two different blocks holds both, so it also compares each with itself
    rows = dealt.where("own <> other or blocks = 1")
    rows = rows.groupBy("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(F.collect_list("fp").alias("fps"))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [], []
            for value in batch.column("fps"):
                u, v = _forest(np.unique(np.asarray(value.values, np.int64)).view(np.uint64), radius)
                us.append(u.view(np.int64))
                vs.append(v.view(np.int64))
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

    return pairs.unionByName(rows.select("fps").mapInArrow(linked, "u long, v long")).distinct()


def _grouped(docs: DataFrame, text: str, doc_id: str, radius: int) -> DataFrame:
    """``doc_id, th, fp, root, component_id`` for each row; th: a hash of the text, which tells rows of one doc_id apart."""
    taken = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("th"))
    marked = stored(with_fingerprint(taken).select("doc_id", "th", "fp"))
    vertices = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = stored(connected_components(similar_links(vertices.select("fp"), radius)))
    placed = vertices.join(roots.withColumnRenamed("u", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return skew_join(marked, placed.join(named, "root").select("fp", "root", "component_id"), "fp", "left")


def simhash_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """One row per document: ``doc_id, fp long, component_id``.

    Component: documents that links of at most ``radius`` differing bits connect; its id is the smallest non-null
    doc_id in it (null if it has none). Texts that are null or have no word share fingerprint 0 and are linked like any
    others. Repeated rows give as many rows; other columns of ``docs`` play no part; no documents give no rows.
    """
    return _grouped(docs, text, doc_id, radius).select("doc_id", "fp", "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, one of each group, with all columns of ``docs``: that with the smallest doc_id.

    Should it stand for several rows, the one with the smallest hash of its text stays, once. Null ids come last.
    """
    return keep_least(docs, _grouped(docs, "text", "doc_id", RADIUS))


def keep_least(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """The row of each ``root`` of ``grouped(doc_id, th, root)`` with the smallest doc_id (nulls last), then th."""
    best = grouped.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("best"))
    key = F.concat_ws(":", "doc_id", "th")
    keep = stored(best.select("best.*").select(key.alias("__key")))
    return docs.withColumn("__key", F.concat_ws(":", F.col("doc_id"), F.xxhash64("text"))).join(keep, "__key", "left_semi").dropDuplicates(["__key"]).drop("__key")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
