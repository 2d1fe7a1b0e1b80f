"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact similarity (operator 7).

Texts are words of [0-9a-z] and bytes from 0x80 after A-Z have been lower-cased; shingles are five words (a shorter item
is one shingle). Similarity is the weighted Jaccard index of the shingles, their counts as weights.

1. Every window of every document that has as many words as some item is a candidate. A window of n shingles whose
   similarity with an item of n shingles is t shares at least 2·t·n/(1+t) of them, so windows with fewer shingles that
   any item has are passed over without loss; that test reads a bitmap of fixed size, not the benchmark.
2. The SimHash of each other window is cut into ``BLOCKS`` blocks. Fingerprints within ``RADIUS`` bits agree up to
   ``FLIPS`` bits on some block; the index of the benchmark holds each block with each choice of so many of its bits
   flipped, and an equality join on (number of words, block, value) finds every item within the radius, for each distinct
   fingerprint once. A chance meeting of two fingerprints has a probability of 4 %.
3. The window and the item are compared exactly, up to ``COMPARED`` bits: what the blocks find beyond the radius counts.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import short_batches, skew_join, stored, table
from .wordhash import Words, chunks

SHINGLE = 5
SIMILARITY = 0.8
BLOCKS, FLIPS = 4, 3
WIDTH = 64 // BLOCKS
#: Differing bits up to which every pair is found: two of more than that may have over FLIPS bits in each block.
RADIUS = BLOCKS * (FLIPS + 1) - 1
#: Differing bits up to which a pair that the blocks find is compared. At similarity 0.8 the mean is 10, over 15 have some
#: 2 % of the pairs, over 24 fewer than 1 in 100,000.
COMPARED = 24
#: Bits of the bitmap of the benchmark's shingles (1 MB); with many more shingles it lets more windows through, no fewer.
BITMAP_BITS = 23
#: Indexes are broadcast up to so many rows (some 40 bytes each); beyond, the join shuffles.
BROADCAST_ROWS = 200_000


def _needed(n: np.ndarray | int, t: float) -> np.ndarray:
    return np.ceil(2 * t * np.asarray(n) / (1 + t) - 1e-9).astype(np.int64)


def _fingerprints(hashes: np.ndarray, first: np.ndarray, count: int) -> np.ndarray:
    """SimHash of hashes[f : f + count] for each f in first; a bit is 1 if set in over half."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.zeros((len(hashes) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=sums[1:], dtype=np.int32)
    return np.packbits(2 * (sums[first + count] - sums[first]) > count, axis=1, bitorder="little").view("<i8").ravel()


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)


def read_items(benchmark: DataFrame, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """``item_id, norm, n_words int, fp long, slots array<int>``; items without words are left out."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in chunks(batch.column("text")):
                words = Words(texts)
                hashes = words.hashes()
                place, grams = words.grams(SHINGLE, hashes)
                has = np.flatnonzero(words.counts)
                first = words.first[has]
                slots, prints = [], []
                for d, f in zip(has, first, strict=True):
                    own = grams[np.searchsorted(place, f) : np.searchsorted(place, f + words.counts[d])]
                    if not len(own):  # one shingle of all its words
                        at_n, whole = words.grams(int(words.counts[d]), hashes)
                        own = whole[np.searchsorted(at_n, f)][None]
                    slots.append(_slot(own).astype(np.int32))
                    prints.append(_fingerprints(own, np.array([0]), len(own))[0])
                columns = [batch.column("item_id").take(pa.array(at + has)), words.spans(first, first + words.counts[has] - 1), pa.array(words.counts[has].astype(np.int32)), pa.array(prints, pa.int64()), pa.array(slots, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, ["item_id", "norm", "n_words", "fp", "slots"])

    return benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).mapInArrow(read, "item_id long, norm string, n_words int, fp long, slots array<int>")


def windows(docs: DataFrame, lengths: list[int], bitmap: np.ndarray, similarity: float) -> DataFrame:
    """``doc_id, th, norm, windows array<struct<at int, n_words int, fp long>>`` of documents that have any."""
    sent = docs.sparkSession.sparkContext.broadcast((lengths, bitmap))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, packed = sent.value
        present = np.unpackbits(packed, bitorder="little").astype(bool)
        short = [n for n in sizes if n < SHINGLE]
        long = [n for n in sizes if n >= SHINGLE]
        for batch in batches:
            for at, texts in chunks(batch.column("text")):
                words = Words(texts)
                hashes = words.hashes()
                found: list[tuple[np.ndarray, int, np.ndarray]] = []  # places, words, fingerprints
                place, grams = words.grams(SHINGLE, hashes)
                hits = np.concatenate(([0], np.cumsum(present[_slot(grams)])))
                doc = words.doc
                for n in long:
                    k = n - SHINGLE + 1
                    if k > len(grams) or hits[-1] < _needed(k, similarity):
                        break
                    first = np.flatnonzero(hits[k:] - hits[:-k] >= _needed(k, similarity))
                    first = first[doc[place[first]] == doc[place[first + k - 1]]]
                    if len(first):
                        covered = np.zeros(len(grams) + 1, np.int32)
                        np.add.at(covered, first, 1)
                        np.add.at(covered, first + k, -1)
                        near = np.flatnonzero(np.cumsum(covered[:-1]))
                        found.append((place[first], n, _fingerprints(grams[near], np.searchsorted(near, first), k)))
                for n in short:
                    first, whole = words.grams(n, hashes)
                    hit = present[_slot(whole)]
                    if hit.any():
                        found.append((first[hit], n, whole[hit].view(np.int64)))
                if not found:
                    continue
                start = np.concatenate([x[0] for x in found])
                size = np.concatenate([np.full(len(x[0]), x[1]) for x in found])
                prints = np.concatenate([x[2] for x in found])
                of = doc[start]
                order = np.argsort(of, kind="stable")
                start, size, prints, of = start[order], size[order], prints[order], of[order]
                has, begin = np.unique(of, return_index=True)
                inner = pa.StructArray.from_arrays([pa.array((start - words.first[of]).astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(prints)], ["at", "n_words", "fp"])
                lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(of)).astype(np.int32)), inner)
                rows = pa.array(at + has)
                norm = words.spans(words.first[has], words.first[has + 1] - 1)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), batch.column("th").take(rows), norm, lists], ["doc_id", "th", "norm", "windows"])

    return short_batches(docs).mapInArrow(find, "doc_id long, th long, norm string, windows array<struct<at:int,n_words:int,fp:long>>")


def _flips() -> list[int]:
    """All masks of at most FLIPS of WIDTH bits."""
    return [sum(1 << i for i in places) for k in range(FLIPS + 1) for places in itertools.combinations(range(WIDTH), k)]


def _block(fp: str, b: int) -> Column:
    return F.shiftrightunsigned(F.col(fp), b * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1)).cast("int")


def _indexed(items: DataFrame) -> DataFrame:
    """``item_id, n_words, item_fp, block, value``: each block of each item with each choice of bits flipped."""
    masks = F.from_json(F.lit(json.dumps(_flips())), "array<int>")
    blocks = F.array(*(F.struct(F.lit(b).alias("block"), _block("fp", b).alias("value")) for b in range(BLOCKS)))
    each = items.select("item_id", "n_words", F.col("fp").alias("item_fp"), F.inline(blocks))
    return each.select("item_id", "n_words", "item_fp", "block", F.explode(F.transform(masks, lambda m: F.col("value").bitwiseXOR(m))).alias("value"))


def contaminations(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, th, item_id, first_word int, n_words int, similarity double``: of each document and item, the best window.

    Windows have as many words as the item; ties go to the earliest. th tells apart rows with one doc_id and different
    texts; repeated rows give one. Null and blank texts, blank items, and an empty table on either side give nothing.
    A pair of more than RADIUS differing bits may be missed if all blocks differ in more than FLIPS.
    """
    items = stored(read_items(benchmark))
    # the distinct sizes, not the items; and the bitmap: at most 2**BITMAP_BITS / 64 numbers, whatever the benchmark holds
    lengths = sorted(r[0] for r in items.select("n_words").distinct().toLocalIterator())
    words64 = items.select(F.explode("slots").alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, s & 63)")).alias("bits")).toArrow()
    bitmap = np.zeros(1 << (BITMAP_BITS - 6), "<i8")
    bitmap[words64.column("w").to_numpy()] = words64.column("bits").to_numpy()
    taken = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    suspects = stored(windows(taken, lengths, bitmap.view(np.uint8), similarity).dropDuplicates(["doc_id", "th"]))
    index = _indexed(items)
    if items.count() * BLOCKS * len(_flips()) <= BROADCAST_ROWS:
        index = F.broadcast(index)
    each = suspects.select("doc_id", "th", F.inline("windows"))
    # a passage that many documents share is looked up once
    prints = each.select("n_words", "fp").distinct()
    probes = prints.select("n_words", "fp", F.inline(F.array(*(F.struct(F.lit(b).alias("block"), _block("fp", b).alias("value")) for b in range(BLOCKS)))))
    met = probes.join(index, ["n_words", "block", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= COMPARED)
    met = stored(met.select(F.xxhash64("n_words", "fp").alias("k"), F.col("n_words").alias("n"), F.col("fp").alias("f"), "item_id").distinct())
    keyed = each.withColumn("k", F.xxhash64("n_words", "fp"))
    near = (keyed.join(F.broadcast(met), "k") if met.count() <= BROADCAST_ROWS else skew_join(keyed, met, "k")).where("n_words = n and fp = f")
    near = near.groupBy("doc_id", "th", "item_id").agg(F.sort_array(F.collect_set("at")).alias("at"))
    return _verified(near, suspects, items, similarity)


def _verified(near: DataFrame, suspects: DataFrame, items: DataFrame, similarity: float) -> DataFrame:
    """Compare each candidate window with its item, exactly, and keep the best of those that are similar enough."""
    key = F.concat_ws(":", "doc_id", "th")
    with_text = skew_join(near.withColumn("__d", key), suspects.select(key.alias("__d"), "norm"), "__d")
    pairs = skew_join(with_text, items.select("item_id", F.col("norm").alias("item")), "item_id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, th, item_id, places, norm, item in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "th", "item_id", "at", "norm", "item")), strict=True):
                words, theirs = norm.split(" "), item.split(" ")
                k = min(SHINGLE, len(theirs))
                code: dict[tuple, int] = {}
                target = np.array([code.setdefault(tuple(theirs[i : i + k]), len(code)) for i in range(len(theirs) - k + 1)])
                want = np.bincount(target)
                n, best = len(target), (0.0, 0)
                for at in places:
                    got = np.array([code.get(tuple(words[i : i + k]), -1) for i in range(at, at + n)])
                    both = int(np.minimum(np.bincount(got[got >= 0], minlength=len(want)), want).sum())
                    best = max(best, (both / (2 * n - both), -at))
                if best[0] >= similarity:
                    out.append((doc_id, th, item_id, -best[1], len(theirs), best[0]))
            if out:
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["doc_id", "th", "item_id", "first_word", "n_words", "similarity"])

    return pairs.select("doc_id", "th", "item_id", "at", "norm", "item").mapInArrow(compare, "doc_id long, th long, item_id long, first_word int, n_words int, similarity double")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no item was found, repeated rows each; columns as they were.

    Null and blank texts, and all documents if the benchmark is empty, stay.
    """
    found = stored(contaminations(docs, benchmark).select(F.concat_ws(":", "doc_id", "th").alias("__key")).distinct())
    return docs.withColumn("__key", F.concat_ws(":", F.col("doc_id"), F.xxhash64("text"))).join(found, "__key", "left_anti").drop("__key")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and item found in it."""
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "first_word", "n_words", "similarity")
