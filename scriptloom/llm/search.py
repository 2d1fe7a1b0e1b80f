"""Ranked lexical search (operator 13).

Tasks index the texts they read as shards: doc ids in order, and for each term its postings by document, as gaps and counts in
variable-length bytes. A shard is a row of a table, so counts of documents and terms are sums over it, and any task can search it.
Queries go through a shard document at a time: a heap merges the postings of their terms, the best documents so far
stand in a heap of ten, and terms that together can't lift a document into it are only looked up for documents that others have found. The
bounds are exact: no document that belongs to the result is passed over.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import short_batches, stored, table
from .wordhash import Words, chunks

#: A shard is closed when it has so many documents, or pairs of a document and a term.
SHARD_DOCS, SHARD_PAIRS = 8192, 1 << 20
#: The bitmap of the terms that are asked for has 2 to this power bits (2 MB), however many there are.
BITMAP_BITS = 24
#: Rows of (item, term) that are sent to tasks at once; more are searched in blocks.
BLOCK_ROWS = 200_000
#: A missing doc id stands after all others.
LAST = 1 << 63

INDEX = "docs array<bigint>, sizes array<bigint>, terms array<bigint>, counts array<bigint>, gaps binary, freqs binary"


def pack_numbers(values: np.ndarray) -> bytes:
    """Numbers from 0 as bytes of 7 bits, low ones first, the highest bit where more follow."""
    v = values.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    for bits in range(7, 64, 7):
        more = v >> np.uint64(bits) > 0
        if not more.any():
            break
        size += more
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(v) else 0, np.uint8)
    for k in range(int(size.max()) if len(v) else 0):
        has = np.flatnonzero(size > k)
        part = (v[has] >> np.uint64(7 * k)).astype(np.uint8) & np.uint8(127)
        out[ends[has] - size[has] + k] = part | ((size[has] > k + 1).astype(np.uint8) << np.uint8(7))
    return out.tobytes()


def unpack_numbers(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.empty(0, np.int64)
    starts = np.concatenate(([0], np.flatnonzero(b < 128)[:-1] + 1))
    place = np.arange(len(b)) - np.repeat(starts, np.diff(np.append(starts, len(b))))
    return np.add.reduceat((b & np.uint8(127)).astype(np.int64) << (7 * place), starts)


def term_ids(words: Words) -> np.ndarray:
    """64 bits that stand for a word's bytes and length."""
    return words.hashes()


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id, term long``: the distinct terms of ``items(item_id, text)``; rows of one id are one item, null texts have none."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in chunks(batch.column("text")):
                words = Words(texts)
                yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(begin + words.doc)), pa.array(term_ids(words).view(np.int64))], ["item_id", "term"])

    return items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(read, "item_id long, term long").distinct()


def _slot(terms: np.ndarray) -> np.ndarray:
    return (terms >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)


def bitmap_of(terms: DataFrame) -> np.ndarray:
    """Bits of the slots that the terms fall into: of fixed size, so false hits grow with the terms, not the memory."""
    slot = F.shiftrightunsigned("term", 64 - BITMAP_BITS)
    words64 = terms.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("bits")).toArrow()
    bits = np.zeros(1 << (BITMAP_BITS - 6), "<i8")
    bits[words64.column("w").to_numpy()] = words64.column("bits").to_numpy()
    return bits.view(np.uint8)


class _Shard:
    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.sizes: list[np.ndarray] = []
        self.doc: list[np.ndarray] = []
        self.term: list[np.ndarray] = []
        self.pairs = 0

    def add(self, ids: list[int | None], sizes: np.ndarray, doc: np.ndarray, term: np.ndarray) -> None:
        self.doc.append(doc + len(self.ids))
        self.ids += ids
        self.sizes.append(sizes)
        self.term.append(term)
        self.pairs += len(doc)

    def row(self) -> pa.RecordBatch:
        order = sorted(range(len(self.ids)), key=lambda i: LAST if self.ids[i] is None else self.ids[i])
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        doc, term = place[np.concatenate(self.doc)], np.concatenate(self.term)
        by = np.lexsort((doc, term))
        doc, term = doc[by], term[by]
        new_term = np.concatenate(([True], term[1:] != term[:-1]))[: len(term)]
        new = new_term | np.concatenate(([True], doc[1:] != doc[:-1]))[: len(term)]
        at = np.flatnonzero(new)
        freqs = np.diff(np.append(at, len(term)))
        doc, first = doc[at], new_term[at]
        gaps = np.where(first, doc, np.diff(doc, prepend=0))
        begins = np.flatnonzero(first)
        columns = [[self.ids[i] for i in order], np.concatenate(self.sizes)[order], term[at][begins].view(np.int64), np.diff(np.append(begins, len(doc)))]
        lists = [pa.array([c], pa.list_(pa.int64())) for c in columns]
        return pa.RecordBatch.from_arrays([*lists, pa.array([pack_numbers(gaps)]), pa.array([pack_numbers(freqs)])], ["docs", "sizes", "terms", "counts", "gaps", "freqs"])


def build_index(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """A row for each shard of ``docs(doc_id, text)``, with all documents that have a term, and how many each has.

    With ``terms(term)``, postings are kept of these alone, and of the few others that share a bit of a map of 2 MB; all documents count.
    Null texts and texts without terms are in no shard; repeated rows are documents of their own; an id that is null comes last.
    """
    sent = None if terms is None else docs.sparkSession.sparkContext.broadcast(bitmap_of(terms))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = None if sent is None else np.unpackbits(sent.value, bitorder="little").astype(bool)
        shard = _Shard()
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for begin, texts in chunks(batch.column("text")):
                words = Words(texts)
                has = np.flatnonzero(words.counts)
                found, doc = term_ids(words), np.repeat(np.arange(len(has)), words.counts[has])
                if asked is not None:
                    hit = asked[_slot(found)]
                    found, doc = found[hit], doc[hit]
                shard.add([ids[begin + i] for i in has], words.counts[has].astype(np.int64), doc, found)
                if len(shard.ids) >= SHARD_DOCS or shard.pairs >= SHARD_PAIRS:
                    yield shard.row()
                    shard = _Shard()
        if shard.ids:
            yield shard.row()

    return short_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(index, INDEX)


def corpus_size(index: DataFrame) -> tuple[int, int]:
    """Documents with terms, and all their terms."""
    n, total = index.select(F.size("docs").alias("n"), F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("t")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    return int(n), int(total)


def weights(index: DataFrame, terms: DataFrame, n_docs: int) -> DataFrame:
    """``item_id, term, weight``: of the items' terms that the index has."""
    df = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.counts").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    return terms.join(df, "term").select("item_id", "term", weight.alias("weight")).where("weight > 0")


class _Searcher:
    """The heaps of some items, and how a shard is searched for them."""

    def __init__(self, items: list[tuple[int | None, np.ndarray, np.ndarray]], n_docs: int, n_terms: int, k: int):
        self.items, self.n_docs, self.n_terms, self.k = items, n_docs, n_terms, k
        self.best: list[list[tuple[int, int]]] = [[] for _ in items]  # (score, minus doc id)

    def shard(self, ids: list[int | None], sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray, gaps: bytes, freqs: bytes) -> None:
        ids = [LAST if i is None else i for i in ids]
        ends = np.concatenate(([0], np.cumsum(counts)))
        step = unpack_numbers(gaps)
        run = np.cumsum(step)
        begins = ends[:-1]
        doc = run - np.repeat(run[begins] - step[begins], counts)
        tf = unpack_numbers(freqs)
        slow = 10 + (90 * sizes * self.n_docs) // self.n_terms
        value = (1_000_000_000 * tf) // (1000 * tf + 8 * slow[doc])
        top = np.maximum.reduceat(value, begins) if len(value) else value
        for heap, (_, asked, weight) in zip(self.best, self.items, strict=True):
            at = np.searchsorted(terms, asked)
            at[at == len(terms)] = 0
            has = np.flatnonzero(terms[at] == asked) if len(terms) else at[:0]
            if len(has):
                lists = [(int(top[t]) * w, w, doc[ends[t] : ends[t + 1]], value[ends[t] : ends[t + 1]]) for t, w in zip(at[has], weight[has].tolist(), strict=True)]
                self._merge(sorted(lists, key=lambda x: x[0]), ids, heap)

    def _merge(self, lists: list[tuple], ids: list[int], heap: list[tuple[int, int]]) -> None:
        """One item's lists, those that can give least first.

        The lists from ``lead`` on are merged. Those before can't reach the floor together, so they are only looked up; as the floor rises
        in the course of the merge, lists leave it.
        """
        most = list(accumulate(x[0] for x in lists))  # what a list and all before it can give at most
        floor = heap[0][0] if len(heap) == self.k else 1
        lead = bisect_left(most, floor)
        docs, gains, looked = [None] * len(lists), [None] * len(lists), [None] * len(lists)
        place, front = [0] * len(lists), []
        for i in range(lead, len(lists)):
            docs[i], gains[i] = lists[i][2].tolist(), (lists[i][3] * lists[i][1]).tolist()
            front.append((docs[i][0], i))
        heapq.heapify(front)
        while front:
            now, score = front[0][0], 0
            while front and front[0][0] == now:
                i = front[0][1]
                own, at = docs[i], place[i]
                score += gains[i][at]
                place[i] = at = at + 1
                if at < len(own):
                    heapq.heapreplace(front, (own[at], i))
                else:
                    heapq.heappop(front)
            for j in range(lead - 1, -1, -1):
                if score + most[j] < floor:
                    break
                if looked[j] is None:
                    looked[j] = dict(zip(lists[j][2].tolist(), (lists[j][3] * lists[j][1]).tolist(), strict=True))
                score += looked[j].get(now, 0)
            else:
                found = (score, -ids[now])
                if score < floor:
                    continue
                if len(heap) < self.k:
                    heapq.heappush(heap, found)
                elif found > heap[0]:
                    heapq.heapreplace(heap, found)
                if len(heap) == self.k and heap[0][0] > floor:
                    floor = heap[0][0]
                    if most[lead] < floor:
                        lead = bisect_left(most, floor)
                        front = [x for x in front if x[1] >= lead]
                        heapq.heapify(front)


def search(index: DataFrame, terms: DataFrame, k: int = 10) -> DataFrame:
    """``item_id, rank int, doc_id, score long``: of each item of ``terms(item_id, term)`` the k documents of the highest scores above 0, ties by doc_id.

    ``index`` should be a stored table: it is read for its sums, for the documents of each term, and once for each
    block of items. A task returns k rows of each item at most, and these are ranked. Items without terms, or
    whose terms occur nowhere, have no rows; an empty index gives none.
    """
    spark = index.sparkSession
    n_docs, n_terms = corpus_size(index)
    found = "item_id long, doc_id long, score long"
    weighted = stored(weights(index, terms, n_docs))
    blocks = max(1, -(-weighted.count() // BLOCK_ROWS))
    each = spark.createDataFrame([], found)
    for b in range(blocks if n_terms else 0):
        rows = weighted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id").toArrow()
        item, term, weight = rows.column("item_id").fill_null(-LAST).to_numpy(), rows.column("term").to_numpy().view(np.uint64), rows.column("weight").to_numpy()
        missing = rows.column("item_id").is_null().to_numpy()
        change = np.flatnonzero((item[1:] != item[:-1]) | (missing[1:] != missing[:-1])) + 1
        bounds = [0, *change.tolist(), len(item)]
        items = [(None if missing[lo] else int(item[lo]), term[lo:hi], weight[lo:hi]) for lo, hi in zip(bounds, bounds[1:]) if hi > lo]
        sent = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            searcher = _Searcher(sent.value, n_docs, n_terms, k)
            for batch in batches:
                for i in range(batch.num_rows):
                    flat = [batch.column(c)[i].values for c in ("docs", "sizes", "terms", "counts")]
                    searcher.shard(flat[0].to_pylist(), flat[1].to_numpy(), flat[2].to_numpy().view(np.uint64), flat[3].to_numpy(), batch.column("gaps")[i].as_py(), batch.column("freqs")[i].as_py())
            out = [(item[0], None if -doc == LAST else -doc, score) for item, heap in zip(searcher.items, searcher.best, strict=True) for score, doc in heap]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["item_id", "doc_id", "score"])

        each = each.unionByName(index.mapInArrow(run, found))
    order = W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = stored(item_terms(table(spark, sf_dir, "benchmark")))
    return search(stored(build_index(table(spark, sf_dir, "documents"), terms.select("term").distinct())), terms)


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = rf"""WITH d AS (SELECT doc_id, {_TERMS} AS ws FROM documents), z AS (SELECT count(*)::BIGINT AS nn, sum(len(ws))::BIGINT AS ll FROM d WHERE len(ws) > 0),
t AS (SELECT doc_id, len(ws)::BIGINT AS n, unnest(ws) AS term FROM d), p AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM t GROUP BY ALL),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
w AS (SELECT term, floor(1000 * ln((2 * any_value(nn) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, z GROUP BY 1),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll))))::BIGINT AS score FROM q JOIN p USING (term) JOIN w USING (term), z GROUP BY 1, 2)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10"""
