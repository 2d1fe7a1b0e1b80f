"""Near copies by the similarity of their five-word shingles (the pipeline's stage).

Similarity is the Jaccard index of the distinct shingles; words are those of operator 3. Operator 3's deletion variants
give the pairs of at most 3 differing bits. At a similarity of 0.8 some ten of 64 bits differ, and a radius that holds
nearly all such pairs leaves segments of a few bits, which tell nothing apart; so MinHash keys give candidates too. All
candidates are compared exactly: no pair below the similarity is a link, however near its fingerprints.

1. Texts with one set of shingles are one vertex. Each has ``BANDS`` keys of ``ROWS`` MinHash values; two vertices of
   similarity s share a key but for a chance of (1 - s**ROWS)**BANDS, 6e-5 at 0.8.
2. In each bucket of a key the members have the least in common. A vertex is compared with the ``FIRST`` smallest of its
   buckets' leasts, and the links make components with those of operator 3: most members of a group, however large, meet.
3. Only buckets that still hold several components are looked at again, with the shingles of their members, in blocks of
   bounded size: pairs across components are compared if the MinHash values agree well enough, each in the first bucket
   that it shares, and a spanning forest of the links is all that comes out. No pair is left out for a bucket's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import simhash
from .common import release, short_batches, skew_join, stored
from .components import connected_components
from .wordhash import Words, chunks, mix

SHINGLE = 5
SIMILARITY = 0.8
ROWS, BANDS = 6, 32
#: Leasts that a vertex is compared with in step 2; step 3 sees to what these leave apart.
FIRST = 3
#: Share of the MinHash values that must agree before step 3 compares a pair; over 4 standard deviations below 0.8.
LEAST_AGREEING = 0.68
#: Bytes of shingles of a bucket that go into one block; two blocks are compared at a time.
BLOCK = 2 << 20
#: Bytes that aren't ASCII white space (or the zero between texts).
WORD = np.ones(256, bool)
WORD[[0, 9, 10, 11, 12, 13, 32]] = False
_FACTORS = np.random.default_rng(8).integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a shorter text is one shingle, one without words the shingle 0."""
    words = Words(texts, WORD)
    hashes = words.hashes()
    place, grams = words.grams(SHINGLE, hashes)
    at = np.searchsorted(place, words.first)
    out = []
    for d, count in enumerate(words.counts):
        if count >= SHINGLE:
            out.append(np.unique(grams[at[d] : at[d + 1]]))
        else:
            own, h = hashes[words.first[d] : words.first[d + 1]], np.zeros(1, np.uint64)
            for x in own:
                h = mix(h + x)
            out.append(h)
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values, a row for each set."""
    flat, begin = np.concatenate(sets), np.cumsum([0, *(len(s) for s in sets[:-1])])
    return np.stack([np.minimum.reduceat(flat * a, begin) for a in _FACTORS], axis=1)


def _marked(docs: DataFrame) -> DataFrame:
    """``doc_id, th, fp, v, size, sig, keys``: v names the set of shingles, sig is a byte of each MinHash value."""

    @F.arrow_udf("v long, size int, sig binary, keys array<long>")
    def compute(texts: pa.Array) -> pa.Array:
        vs, sizes, sigs, keys = [], [], [], []
        for _, run in chunks(texts):
            sets = shingle_sets(run)
            signed = signatures(sets)
            for s in sets:
                vs.append(int(mix(np.bitwise_xor.reduce(mix(s)) + np.array([len(s)], np.uint64)).view(np.int64)[0]))
                sizes.append(len(s))
            sigs += [row.tobytes() for row in (signed >> np.uint64(20)).astype(np.uint8)]
            h = np.tile(np.arange(BANDS, dtype=np.uint64), (len(sets), 1))
            for r in range(ROWS):
                h = mix(h + signed[:, r::ROWS])
            keys.append(h.view(np.int64).ravel())
        flat = pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(vs) + 1) * BANDS, pa.int32()), flat)
        return pa.StructArray.from_arrays([pa.array(vs, pa.int64()), pa.array(sizes, pa.int32()), pa.array(sigs, pa.binary()), lists], ["v", "size", "sig", "keys"])

    taken = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    return simhash.with_fingerprint(taken).withColumn("m", compute(F.col("text"))).select("doc_id", "th", "fp", "m.*")


def _sets(wanted: DataFrame, docs: DataFrame, reps: DataFrame) -> DataFrame:
    """``v, set``: the shingles of the distinct ``wanted(v)``."""
    needed = wanted.join(reps.select("v", "th"), "v")
    texts = skew_join(docs.select(F.xxhash64("text").alias("th"), "text"), needed, "th").select("v", "text")

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, run in chunks(batch.column("text")):
                sets = [s.tobytes() for s in shingle_sets(run)]
                yield pa.RecordBatch.from_arrays([batch.column("v").slice(at, len(run)), pa.array(sets, pa.binary())], ["v", "set"])

    return stored(short_batches(texts).mapInArrow(shingles, "v long, set binary").dropDuplicates(["v"]))


def _similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    same = len(np.intersect1d(x, y, assume_unique=True))
    return same >= similarity * (len(x) + len(y) - same) - 1e-9


def verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, similarity: float) -> DataFrame:
    """Those of the distinct pairs ``u, w`` whose sets of shingles are similar enough."""
    sets = _sets(pairs.select(F.explode(F.array("u", "w")).alias("v")).distinct(), docs, reps)
    both = skew_join(pairs, sets.select(F.col("v").alias("u"), F.col("set").alias("a")), "u")
    both = skew_join(both, sets.select(F.col("v").alias("w"), F.col("set").alias("b")), "w")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column("a"), batch.column("b"), strict=True)
            keep = [_similar(*(np.frombuffer(s.as_buffer(), np.uint64) for s in ab), similarity) for ab in both]
            yield batch.select(["u", "w"]).filter(pa.array(keep, pa.bool_()))

    return short_batches(both.select("u", "w", "a", "b")).mapInArrow(compare, "u long, w long")


def _forest(v: np.ndarray, root: np.ndarray, own: np.ndarray, band: int, keys: np.ndarray, sig: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links between members of different roots, of one block or two of a bucket, that no others of them connect."""
    _, label = np.unique(root, return_inverse=True)
    size, out, across = np.array([len(s) for s in sets]), [], own.min() != own.max()
    for i in range(len(v) - 1):
        rest = slice(i + 1, None)
        may = (label[rest] != label[i]) & (np.minimum(size[i], size[rest]) >= similarity * np.maximum(size[i], size[rest]) - 1e-9)
        if across:
            may &= own[rest] != own[i]
        at = i + 1 + np.flatnonzero(may)
        at = at[(keys[at] == keys[i]).argmax(axis=1) == band]
        at = at[(sig[at] == sig[i]).mean(axis=1) >= LEAST_AGREEING]
        for j in at:
            if label[i] != label[j] and _similar(sets[i], sets[j], similarity):
                out.append((int(v[i]), int(v[j])))
                label[label == label[j]] = label[i]
    return out


def _across(members: DataFrame, similarity: float) -> DataFrame:
    """``key, i, j, own, v, root, keys, sig, set`` to the links ``u, v`` found in each (key, i, j)."""

    def find(group: pa.Table) -> pa.Table:
        one = group.combine_chunks()
        v, root, own = (one.column(c).to_numpy() for c in ("v", "root", "own"))
        keys = np.array([k.values.to_numpy() for k in one.column("keys")])
        sig = np.array([np.frombuffer(x.as_buffer(), np.uint8) for x in one.column("sig")])
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in one.column("set")]
        band = int((keys[0] == one.column("key")[0].as_py()).argmax())
        links = _forest(v, root, own, band, keys, sig, sets, similarity)
        return pa.table([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["u", "v"])

    return members.groupBy("key", "i", "j").applyInArrow(find, "u long, v long").distinct()


def similar_groups(docs: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """``doc_id, th, root`` for each row: rows that links connect have one root.

    A text of fewer than five words is one shingle, all of it; texts that are null or have no word are alike. th, a hash
    of the text, tells rows of one doc_id apart. Repeated rows share a root; no documents give no rows; other columns
    play no part.
    """
    marked = stored(_marked(docs))
    reps = stored(marked.groupBy("v").agg(F.min("th").alias("th"), F.first("size").alias("size"), F.first("sig").alias("sig"), F.first("keys").alias("keys")))
    # operator 3's links between fingerprints, as pairs of the least vertices that have these; and those of one fingerprint
    prints = stored(marked.select("fp", "v").distinct().withColumn("least", F.min("v").over(W.partitionBy("fp"))))
    least = prints.where("v = least").select("fp", "v")
    three = simhash.similar_links(least.select("fp"))
    three = three.join(least.select(F.col("fp").alias("u"), F.col("v").alias("x")), "u").join(least.select(F.col("fp").alias("v"), F.col("v").alias("y")), "v").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("w"))
    three = three.unionByName(prints.where("v <> least").select(F.col("least").alias("u"), F.col("v").alias("w")))

    index = reps.select("v", "size", F.explode("keys").alias("key"))
    buckets = stored(index.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("v", "size")).alias("a")).where("n > 1"))
    in_bucket = stored(skew_join(index, buckets, "key").select("key", "v", "size", "n", "a"))
    fits = F.least("size", "a.size") >= similarity * F.greatest("size", "a.size") - 1e-9
    leasts = in_bucket.where((F.col("v") != F.col("a.v")) & fits).groupBy("v").agg(F.slice(F.sort_array(F.collect_set("a.v")), 1, FIRST).alias("us"))
    pairs = leasts.select(F.explode("us").alias("u"), F.col("v").alias("w"))
    pairs = stored(pairs.unionByName(three).distinct())
    links = stored(verified(pairs, docs, reps, similarity).withColumnRenamed("w", "v"))
    release(buckets, prints)
    roots = stored(connected_components(links))

    placed = skew_join(in_bucket.select("key", "v", "size"), roots.withColumnRenamed("u", "v"), "v", "left").withColumn("root", F.coalesce("root", "v"))
    placed = stored(placed)
    release(in_bucket, roots)
    mixed = placed.groupBy("key").agg(F.sum("size").alias("n"), F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key", F.ceil(8 * F.col("n") / block).cast("int").alias("blocks"))
    own = stored(skew_join(placed, mixed, "key").withColumn("own", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int")))
    sets = _sets(own.select("v").distinct(), docs, reps)
    dealt = own.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "v", "root")
    whole = skew_join(dealt, sets.join(reps.select("v", "keys", "sig"), "v"), "v")
    found = stored(_across(whole.select("key", "i", "j", "own", "v", "root", "keys", "sig", "set"), similarity))
    roots = stored(connected_components(links.unionByName(found))).withColumnRenamed("u", "v")
    return skew_join(marked.select("doc_id", "th", "v"), roots, "v", "left").select("doc_id", "th", F.coalesce("root", "v").alias("root"))


def drop_similar(docs: DataFrame) -> DataFrame:
    """The documents that stay, one of each group, with all columns of ``docs``: that with the smallest doc_id.

    Should it stand for several rows, the one with the smallest hash of its text stays, once. Null ids come last.
    """
    return simhash.keep_least(docs, stored(similar_groups(docs)))
