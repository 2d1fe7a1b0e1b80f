"""Embedding near-duplicates by a random-projection tree forest (operator 2).

Trees of recursive splits: a node projects its vectors on a random direction and splits them at the median; those within
the spill of it go to both sides. Two vectors of the wanted cosine are compared if they share a leaf of any tree.

The first splits are fitted on a bounded sample. Where the sample has too few vectors for a node that holds more than a
leaf's worth of all, splits go on, each level of such a node with one direction and the median of the node's own sample;
so leaves keep their size at any number of vectors, and what is sent to the tasks keeps its own. Deeper trees separate
more pairs, so their number grows with the logarithm of the vectors (``trees_for``).

1. Every vector goes down every tree. What is shuffled is a row of leaf, id and a sketch of 128 signs of projections.
2. In a leaf, sketches tell which vectors may have a partner there: nearly none, where nothing is alike.
3. Only those are fetched and compared, exactly. A leaf gives back a count and a root for each vector that has links,
   never pairs. A pair that shares several leaves counts once: in the first of them, which the vectors' own lists of
   leaves tell.

Equal vectors are one vector with a number of copies. A leaf that holds more than its share, as a tight cluster does that
no split takes apart, is cut into blocks, each pair of which is compared by itself: no task gets more than two blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, skew_join, stored, table
from .components import connected_components

COSINE = 0.9
#: Share of the pairs right at the wanted cosine that the forest is meant to bring together.
RECALL = 0.97
#: Vectors that a leaf, or a block of a larger leaf, is meant to hold.
LEAF = 1600
#: Vectors that the first splits are fitted on, about, and how many of them a node must have; bounds of the fit alone.
SAMPLE, FEWEST = 20_000, 40
#: Half-width of the overlap, in standard deviations of the difference of two projections at the wanted cosine.
SPILL = 0.2
#: Random directions that all splits choose from.
DIRECTIONS = 256
#: Signs of a sketch, and by how many standard deviations two sketches of the wanted cosine may differ more than they should.
SIGNS, SLACK = 128, 4.0
#: Leaves of more than a block are broadcast up to so many; beyond, a shuffle brings them to their rows.
BROADCAST_ROWS = 200_000
#: Vectors that are compared with all of a leaf at once.
SLAB = 128
SEED = 20_240


def _survives(cosine: float, spill: float) -> float:
    """The chance that a split of unit vectors at their median leaves two of the wanted cosine together."""
    phi, tail = math.exp(-2 * spill**2) / math.sqrt(2 * math.pi), 0.5 * math.erfc(2 * spill / math.sqrt(2))
    apart = math.sqrt((2 - 2 * cosine) / (2 * math.pi)) * 2 * (phi - 2 * spill * tail)
    return 1 - min(apart, math.acos(cosine) / math.pi)


def _shrinks(cosine: float, spill: float) -> float:
    """The share of a node's vectors that go to each side."""
    return 0.5 + 0.5 * math.erf(spill * math.sqrt(2 - 2 * cosine) / math.sqrt(2))


def trees_for(n: int, leaf: int = LEAF, cosine: float = COSINE, spill: float = SPILL, recall: float = RECALL) -> int:
    """Trees that bring ``recall`` of the pairs together, if every level separates as a split of random vectors does."""
    levels = max(0.0, math.log(max(n, 1) / leaf) / -math.log(_shrinks(cosine, spill)))
    together = _survives(cosine, spill) ** levels
    return 1 if together > recall else max(3, math.ceil(math.log(1 - recall) / math.log(1 - together)))


class Forest:
    """Arrays by node: ``way`` (a direction's number, -1 for the end of the fitted part), ``cut``, ``left``, ``right``.

    levels[node]: how many splits follow there, with directions ``below[tree]`` and thresholds ``cuts[node]``.
    """

    def __init__(self, sample: np.ndarray, share: float, leaf: float, trees: int, cosine: float, spill: float, size: int, seed: int):
        rng = np.random.default_rng(seed)
        self.ways = rng.normal(size=(size, DIRECTIONS))
        self.ways /= np.linalg.norm(self.ways, axis=0)
        self.signs = rng.normal(size=(size, SIGNS))
        self.spill = spill * math.sqrt((2 - 2 * cosine) / size)
        self.share, self.leaf, self.shrink = share, leaf, _shrinks(cosine, spill)
        way, cut, left, right, levels, cuts, self.roots, below = [], [], [], [], [], {}, [], []
        projected = sample @ self.ways

        def grow(at: np.ndarray, tree: int, depth: int) -> int:
            node = len(way)
            for values, start in ((way, -1), (cut, 0.0), (left, -1), (right, -1), (levels, 0)):
                values.append(start)
            more = max(0, math.ceil(math.log(max(len(at) / share, 1) / leaf) / -math.log(self.shrink) - 0.5))
            if not more or depth >= 40:
                return node
            if len(at) < 2 * FEWEST:
                if len(at) > 1:
                    levels[node], cuts[node] = more, np.median(projected[np.ix_(at, below[tree][:more])], axis=0)
                return node
            # of a few directions the one that leaves the fewest in its spill
            tried = rng.integers(0, DIRECTIONS, 4)
            p = projected[np.ix_(at, tried)]
            middle = np.median(p, axis=0)
            best = int((np.abs(p - middle) <= self.spill).sum(axis=0).argmin())
            low, high = at[p[:, best] <= middle[best] + self.spill], at[p[:, best] > middle[best] - self.spill]
            if len(low) + len(high) < 1.7 * len(at):  # else a tight cluster, which no split takes apart
                way[node], cut[node] = int(tried[best]), float(middle[best])
                left[node], right[node] = grow(low, tree, depth + 1), grow(high, tree, depth + 1)
            return node

        for tree in range(trees):
            below.append(rng.permutation(DIRECTIONS)[:48])
            self.roots.append(grow(np.arange(len(sample)), tree, 0))
        self.way, self.left, self.right, self.levels = (np.array(v, np.int32) for v in (way, left, right, levels))
        self.cut = np.array(cut)
        deepest = int(self.levels.max(initial=0))
        self.cuts = np.zeros((len(way), deepest))
        for node, values in cuts.items():
            self.cuts[node, : len(values)] = values
        self.below, self.tree = np.array(below, np.int32), np.searchsorted(self.roots, np.arange(len(way)), "right") - 1

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of all leaves of all rows, by row, then leaf."""
        p = x @ self.ways
        row, node = np.repeat(np.arange(len(x)), len(self.roots)), np.tile(self.roots, len(x))
        done = []
        while len(row):
            way = self.way[node]
            end = way < 0
            done.append((row[end], node[end]))
            row, node, way = row[~end], node[~end], way[~end]
            off = p[row, way] - self.cut[node]
            low, high = off <= self.spill, off > -self.spill
            row, node = np.concatenate((row[low], row[high])), np.concatenate((self.left[node[low]], self.right[node[high]]))
        row, node = (np.concatenate(c) for c in zip(*done, strict=True))
        code, todo = np.ones(len(row), np.int64), self.levels[node]
        for level in range(self.cuts.shape[1]):
            go = todo > level
            off = p[row, self.below[self.tree[node], level]] - self.cuts[node, level]
            low, high = ~go | (off <= self.spill), go & (off > -self.spill)
            code = np.concatenate((np.where(go, 2 * code, code)[low], 2 * code[high] + 1))
            row, node, todo = (np.concatenate((v[low], v[high])) for v in (row, node, todo))
        leaf = node.astype(np.int64) << 40 | code
        order = np.lexsort((leaf, row))
        return row[order], leaf[order]

    def sketches(self, x: np.ndarray) -> np.ndarray:
        """Signs of projections: a row of two 64-bit numbers for each vector."""
        return np.packbits(x @ self.signs > 0, axis=1).view(np.int64)


def _alike(sketches: np.ndarray, cosine: float) -> np.ndarray:
    """Which sketches differ in no more signs than those of two vectors of the wanted cosine may."""
    s, p = sketches.view(np.uint64), math.acos(cosine) / math.pi
    most = SIGNS * p + SLACK * math.sqrt(SIGNS * p * (1 - p))
    met = np.empty((len(s), len(s)), bool)
    for i in range(0, len(s), SLAB):
        met[i : i + SLAB] = sum(np.bitwise_count(s[i : i + SLAB, None, k] ^ s[None, :, k]) for k in range(s.shape[1])) <= most
    return met


def _across(own: np.ndarray, met: np.ndarray) -> np.ndarray:
    """A row of a leaf, or of two of its blocks, against the others; of two blocks only one against the other."""
    np.fill_diagonal(met, False)
    if len(own) and own.min() != own.max():
        met &= own[:, None] != own[None, :]
    return met


def _unit(lists: pa.Array, size: int) -> np.ndarray:
    """Rows of unit length in double precision; shorter vectors read as if zeros followed."""
    lists = pa.concat_arrays([lists])
    lengths = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy().astype(float)
    x = np.zeros((len(lengths), size))
    if len(flat):
        row = np.repeat(np.arange(len(lengths)), lengths)
        x[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    x /= np.abs(x).max(axis=1, keepdims=True, initial=1e-300)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _linked(vid: np.ndarray, copies: np.ndarray, x: np.ndarray, own: np.ndarray, leaf: int, lists: pa.Array, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vid, links counted here, root) of the rows of a leaf, or of two of its blocks, that have links."""
    near = np.empty((len(x), len(x)), bool)
    for i in range(0, len(x), SLAB):
        near[i : i + SLAB] = x[i : i + SLAB] @ x.T >= cosine
    near = _across(own, near | near.T)
    has = np.flatnonzero(near.any(axis=1))
    near = near[np.ix_(has, has)]
    if not len(has):
        return vid[:0], copies[:0], vid[:0]
    taken = lists.take(pa.array(has))
    row = np.repeat(np.arange(len(has)), np.diff(taken.offsets.to_numpy()))
    places = taken.flatten().to_numpy()
    earlier, column = np.unique(places[places < leaf], return_inverse=True)
    met = np.zeros((len(has), len(earlier)), np.float32)
    met[row[places < leaf], column] = 1
    counted = near & (met @ met.T == 0)
    label = np.arange(len(has))
    while True:
        least = np.minimum(label, np.concatenate([np.where(near[i : i + SLAB], label[None, :], len(has)).min(axis=1) for i in range(0, len(has), SLAB)]))
        least = least[least]
        if (least == label).all():
            break
        label = least
    return vid[has], counted @ copies[has], vid[has][label]


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, trees: int | None = None, leaf: int = LEAF, sample: int = SAMPLE, spill: float = SPILL) -> DataFrame:
    """``vec_id, embedding`` to ``vec_id, n_links, component_id, kept``, a row for each row.

    Vectors that are null, zero or hold a null or non-finite component link with nothing, not even their copies; empty
    ones are zero. Shorter vectors are compared as if zeros followed. A row with a null vec_id takes part, but names no
    component; a component of such rows alone has a null id. Repeated rows are vectors of their own. Components are
    those of the links found; none is below ``cosine``. trees: by ``trees_for`` unless given. Equal vectors are told by
    96 bits of two hashes.
    """
    spark = vectors.sparkSession
    fine = F.coalesce(F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0), F.lit(False))
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(fine, F.col("embedding").cast(kind)).alias("embedding"))
    given = F.col("embedding").isNotNull()
    marked = rows.select("vec_id", "embedding", F.when(given, F.xxhash64("embedding")).alias("h"), F.when(given, F.hash("embedding")).alias("check"))
    distinct = marked.where("h is not null").groupBy("h", "check").agg(F.first("embedding").alias("embedding"), F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    reps = stored(distinct.withColumn("vid", F.monotonically_increasing_id()))
    n, size = reps.agg(F.count("*"), F.max(F.size("embedding"))).first()
    links = stored(_links(reps, n, size, cosine, trees, leaf, sample, spill) if n > 1 else spark.createDataFrame([], "vid long, links long, root long"))
    roots = stored(connected_components(links.select(F.col("vid").alias("u"), F.col("root").alias("v"))))
    counts = links.groupBy("vid").agg(F.sum("links").alias("links"))
    placed = reps.drop("embedding").join(counts, "vid", "left").join(roots.withColumnRenamed("u", "vid"), "vid", "left").withColumn("root", F.coalesce("root", "vid"))
    named = placed.groupBy("root").agg(F.min("least").alias("component"))
    of = stored(placed.join(named, "root").select("h", F.col("check").alias("c"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), "component"))
    release(links, roots)
    out = skew_join(marked.select("vec_id", "h", "check"), of, "h", "left").where("h is null or check = c")
    component = F.when(F.col("h").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def _links(reps: DataFrame, n: int, size: int, cosine: float, trees: int | None, leaf: int, sample: int, spill: float) -> DataFrame:
    spark = reps.sparkSession
    share = min(1.0, sample / n)
    chosen = reps.where(F.pmod("h", F.lit(1 << 20)) < max(1, int(share * (1 << 20)))).select("vid", "embedding").orderBy("vid").toArrow()
    picked = chosen.column("embedding").combine_chunks()
    picked = picked if isinstance(picked, pa.Array) else picked.chunk(0) if picked.num_chunks else pa.array([], picked.type)
    trees = trees or trees_for(n, leaf, cosine, spill)
    forest = spark.sparkContext.broadcast(Forest(_unit(picked, size), share, leaf, trees, cosine, spill, size, SEED))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _unit(batch.column("embedding"), size)
                row, place = forest.value.leaves(x)
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)), pa.array(place))
                sketch = forest.value.sketches(x)
                yield pa.RecordBatch.from_arrays([batch.column("vid"), lists, *(pa.array(np.ascontiguousarray(sketch[:, k])) for k in (0, 1))], ["vid", "leaves", "s0", "s1"])

    assigned = stored(reps.select("vid", "embedding").mapInArrow(assign, "vid long, leaves array<long>, s0 long, s1 long"))
    each = assigned.select("vid", "s0", "s1", F.explode("leaves").alias("leaf"))
    # leaves that outgrow a block, with the number of their blocks; the others have one
    large = stored(each.groupBy("leaf").agg(F.count("*").alias("held")).where(F.col("held") > 2 * leaf).select("leaf", (2 * F.ceil(F.col("held") / (2 * leaf))).cast("int").alias("blocks")))
    dealt = each.join(F.broadcast(large), "leaf", "left") if large.count() <= BROADCAST_ROWS else skew_join(each, large, "leaf", "left")
    dealt = dealt.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("vid"), F.col("blocks")).cast("int"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    paired = dealt.select("leaf", "vid", "s0", "s1", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def column(group: pa.Table, name: str) -> pa.Array:
        return pa.concat_arrays(group.column(name).combine_chunks().chunks) if isinstance(group.column(name).combine_chunks(), pa.ChunkedArray) else group.column(name).combine_chunks()

    def suspect(group: pa.Table) -> pa.Table:
        sketch = np.stack([column(group, c).to_numpy() for c in ("s0", "s1")], axis=1)
        may = _across(column(group, "own").to_numpy(), _alike(np.ascontiguousarray(sketch), cosine)).any(axis=1)
        return group.select(["leaf", "i", "j", "vid", "own"]).filter(pa.array(may))

    suspects = stored(paired.groupBy("leaf", "i", "j").applyInArrow(suspect, "leaf long, i int, j int, vid long, own int"))
    whole = reps.select("vid", "copies", "embedding").join(assigned.select("vid", "leaves"), "vid")
    fetched = skew_join(suspects, whole, "vid")

    def compare(group: pa.Table) -> pa.Table:
        found = _linked(column(group, "vid").to_numpy(), column(group, "copies").to_numpy(), _unit(column(group, "embedding"), size), column(group, "own").to_numpy(), group.column("leaf")[0].as_py(), column(group, "leaves"), cosine)
        return pa.table([pa.array(v, pa.int64()) for v in found], ["vid", "links", "root"])

    return fetched.select("leaf", "i", "j", "vid", "own", "copies", "leaves", "embedding").groupBy("leaf", "i", "j").applyInArrow(compare, "vid long, links long, root long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
