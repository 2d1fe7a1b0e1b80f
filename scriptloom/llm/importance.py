"""Target-distribution importance resampling (operator 11).

Tasks turn texts into inverted postings, ordered by bucket: rows of one cell (a share of the buckets, and a salt that parts
the documents of a hot bucket) go to one partition, after the counts of that share from every task and from both corpora.
A task reads the counts of a cell first, so it knows its buckets' gains when the postings follow, streams through
them and emits what each document gains there. These contributions are summed by document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import short_batches, stored, table
from .wordhash import Words, chunks

BUCKETS = 10_000
#: Longest run of words that is a feature.
LONGEST = 3
#: A block of postings is written when it has so many.
BLOCK = 1 << 20
#: The reflected polynomial of CRC-32: a fixed value.
POLYNOMIAL = 0xEDB88320
#: Lengths that are shifted over by a table of their own; longer ones by powers of two.
NEAR, FAR_STEPS = 64, 26
ALL = np.uint32(0xFFFFFFFF)


def _byte_table() -> np.ndarray:
    """What a register whose low byte is b becomes by that byte."""
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, (x >> 1) ^ np.uint32(POLYNOMIAL), x >> 1).astype(np.uint32)
    return x


_BYTE = _byte_table()


def _apply(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    """``tables`` (4 x 256): what each byte of a register becomes; the whole is their sum."""
    return tables[0][x & 255] ^ tables[1][(x >> 8) & 255] ^ tables[2][(x >> 16) & 255] ^ tables[3][x >> 24]


def _shift_tables() -> tuple[np.ndarray, np.ndarray]:
    """Tables that move a register over 0 .. NEAR - 1 zero bytes, and over NEAR times 1, 2, 4, ... of them."""
    now = (np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * 8)[:, None]).astype(np.uint32)
    near = []
    for _ in range(NEAR):
        near.append(now)
        now = (now >> 8) ^ _BYTE[now & 255]
    far = [now]
    for _ in range(FAR_STEPS - 1):
        far.append(_apply(far[-1], far[-1]))
    return np.stack(near), np.stack(far)


_NEAR, _FAR = _shift_tables()
_FLAT = _NEAR.ravel()


def shifted(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Registers x, moved over ``size`` zero bytes each."""
    at = (size & (NEAR - 1)) * 1024
    x = _FLAT[at + (x & 255)] ^ _FLAT[at + (256 + ((x >> 8) & 255))] ^ _FLAT[at + (512 + ((x >> 16) & 255))] ^ _FLAT[at + (768 + (x >> 24))]
    rest, step = size >> 6, 0
    while rest.any():
        odd = np.flatnonzero(rest & 1)
        x[odd] = _apply(_FAR[step], x[odd])
        rest, step = rest >> 1, step + 1
    return x


#: By length: a blank's register moved on, and what the initial value of all ones becomes.
_LENGTHS = np.arange(1 << 12)
_BLANK = shifted(np.full(len(_LENGTHS), _BYTE[0x20], np.uint32), _LENGTHS)
_ONES = shifted(np.full(len(_LENGTHS), ALL, np.uint32), _LENGTHS)


def _by_length(known: np.ndarray, size: np.ndarray) -> np.ndarray:
    if len(size) and size.max() >= len(known):
        return shifted(np.full(len(size), known[0], np.uint32), size)
    return known[size]


def word_registers(words: Words) -> np.ndarray:
    """The CRC register of each word's bytes, begun at zero."""
    size = words.end - words.start
    out, live, place = np.zeros(len(size), np.uint32), np.arange(len(size)), 0
    while len(live):
        if place == NEAR:  # the few long ones, a word at a time
            import zlib

            for i in live:
                out[i] = zlib.crc32(words.buffer[words.start[i] : words.end[i]], 0xFFFFFFFF) ^ 0xFFFFFFFF
            break
        x = out[live]
        out[live] = (x >> 8) ^ _BYTE[(x ^ words.buffer[words.start[live] + place]) & 255]
        place += 1
        live = live[size[live] > place]
    return out


def features(words: Words, longest: int = LONGEST, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(index of the text, bucket) of each run of 1 to ``longest`` words, joined by a blank, repeats included.

    The CRC-32 of joined words is put together from those of the words; no joined text is made.
    """
    one, doc = word_registers(words), words.doc
    size = (words.end - words.start).astype(np.int64)
    after_blank = _by_length(_BLANK, size) ^ one
    docs, out = [], []
    run, length = one, size
    for n in range(1, longest + 1):
        if n > 1:
            if len(run) < 2:
                break
            run = shifted(run[:-1].copy(), size[n - 1 :] + 1) ^ after_blank[n - 1 :]
            length = length[:-1] + size[n - 1 :] + 1
        inside = doc[: len(run)] == doc[n - 1 :]
        docs.append(doc[: len(run)][inside])
        out.append(((run ^ _by_length(_ONES, length) ^ ALL)[inside] % np.uint32(buckets)).astype(np.uint16))
    return np.concatenate(docs), np.concatenate(out)


def _counted(doc: np.ndarray, bucket: np.ndarray, n_docs: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, bucket, count) of each pair that occurs, by document."""
    key = doc * buckets + bucket
    if n_docs * buckets <= 16 * len(key):
        counts = np.bincount(key, minlength=n_docs * buckets)
        key = np.flatnonzero(counts)
        counts = counts[key]
    else:
        key, counts = np.unique(key, return_counts=True)
    return key // buckets, (key % buckets).astype(np.uint16), counts


def _packed(x: np.ndarray) -> bytes:
    """Numbers from 0 in as few bytes each as the largest needs; the first byte says how many."""
    kind = np.min_scalar_type(int(x.max())) if len(x) else np.dtype(np.uint8)
    return bytes([kind.itemsize]) + x.astype(kind).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


CELLS = "cell int, late boolean, ids array<bigint>, keys array<bigint>, n_words array<bigint>, n_features array<bigint>, docs binary, buckets binary, counts binary"
_ARROW = pa.schema([("cell", pa.int32()), ("late", pa.bool_()), *((c, pa.list_(pa.int64())) for c in ("ids", "keys", "n_words", "n_features")), *((c, pa.binary()) for c in ("docs", "buckets", "counts"))])


class _Block:
    """Documents and their postings, until they are written."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.parts: dict[str, list[np.ndarray]] = {c: [] for c in ("keys", "salt", "n_words", "n_features", "doc", "bucket", "count")}
        self.size = 0

    def add(self, ids: list[int | None], **arrays: np.ndarray) -> None:
        arrays["doc"] = arrays["doc"] + len(self.ids)
        self.ids += ids
        self.size += len(arrays["doc"]) + len(ids)
        for c, x in arrays.items():
            self.parts[c].append(x)

    def rows(self, shards: int, salts: int) -> Iterator[pa.RecordBatch]:
        """The postings of each cell, by bucket, then document; a shard's first cell has all documents of its salt."""
        if not self.ids:
            return
        p = {c: np.concatenate(x) for c, x in self.parts.items()}
        ids = np.array(self.ids, object)
        local, members = np.empty(len(ids), np.int64), []
        for s in range(salts):
            own = np.flatnonzero(p["salt"] == s)
            local[own] = np.arange(len(own))
            members.append(own)
        cell = (p["bucket"].astype(np.int64) % shards) * salts + p["salt"][p["doc"]]
        order = np.argsort(p["bucket"], kind="stable")
        order = order[np.argsort(cell[order].astype(np.min_scalar_type(shards * salts)), kind="stable")]
        doc, bucket, count = local[p["doc"][order]], p["bucket"][order].astype(np.int64) // shards, p["count"][order]
        bounds = np.searchsorted(cell[order], np.arange(shards * salts + 1))
        out: list[tuple] = []
        for c in range(shards * salts):
            lo, hi, own = bounds[c], bounds[c + 1], members[c % salts]
            if not len(own) or (lo == hi and c >= salts):
                continue
            whole = c < salts
            steps = np.diff(bucket[lo:hi], prepend=0)
            out.append((c, True, ids[own].tolist(), p["keys"][own], p["n_words"][own] if whole else [], p["n_features"][own] if whole else [], _packed(doc[lo:hi]), _packed(steps), _packed(count[lo:hi])))
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _ARROW, strict=True)], schema=_ARROW)


def _postings(shards: int, salts: int, longest: int, buckets: int, target: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts to cells; of the target's texts the counts alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, block, any_text = np.zeros(buckets, np.int64), _Block(), False
        for batch in batches:
            for begin, texts in chunks(batch.column("text")):
                any_text = True
                words = Words(texts)
                doc, bucket = features(words, longest, buckets)
                total += np.bincount(bucket, minlength=buckets)
                if target:
                    continue
                n_features = np.bincount(doc, minlength=len(texts))
                doc, bucket, count = _counted(doc, bucket, len(texts), buckets)
                own = batch.slice(begin, len(texts))
                block.add(own.column("doc_id").to_pylist(), keys=own.column("key").to_numpy(), salt=own.column("salt").to_numpy(), n_words=words.counts.astype(np.int64), n_features=n_features, doc=doc, bucket=bucket, count=count)
                if block.size >= BLOCK:
                    yield from block.rows(shards, salts)
                    block = _Block()
        yield from block.rows(shards, salts)
        if any_text:
            shares = [total[s::shards] for s in range(shards)]
            sums = [0, int(total.sum())] if target else [int(total.sum()), 0]
            rows = [(s * salts + x, False, [], [], sums, [int(target)], None, None, shares[s].astype("<i8").tobytes()) for s in range(shards) for x in range(salts)]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)

    return run


def _contributions(shards: int, salts: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cells, each with its counts first, to what each document gains in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, gain = -1, None
        for batch in batches:
            out: list[pa.RecordBatch] = []
            for row in batch.to_pylist():
                if row["cell"] != cell:
                    cell, gain = row["cell"], None
                    counts = np.zeros((2, len(range(cell // salts, buckets, shards))), np.int64)
                    sums = np.zeros(2, np.int64)
                if not row["late"]:
                    counts[row["n_features"][0]] += np.frombuffer(row["counts"], "<i8")
                    sums += row["n_words"]
                    continue
                if gain is None:
                    (s, t), (all_s, all_t) = counts.astype(float), sums.astype(float)
                    gain = np.floor(1000 * np.log((t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets))))
                n, whole = len(row["ids"]), cell < salts
                bucket = np.cumsum(_unpacked(row["buckets"]))
                got = np.bincount(_unpacked(row["docs"]), gain[bucket] * _unpacked(row["counts"]), minlength=n)
                zeros = np.zeros(n, np.int64)
                columns = [pa.array(row["ids"], pa.int64()), pa.array(row["keys"], pa.int64()), pa.array(got.astype(np.int64)), *(pa.array(row[c] if whole else zeros, pa.int64()) for c in ("n_words", "n_features")), pa.array(zeros + whole)]
                out.append(pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "weight", "n_words", "n_features", "copies"]))
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    return run


def importance(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, n_features, n_words, weight`` of each row of ``docs(doc_id, text)`` towards the texts of ``target(text)``.

    The weight is the sum of gains over a text's features. Null texts and texts without words have no features and weigh 0.
    Repeated rows give as many rows and count as often; rows of one id with different texts are kept apart. Other columns play no part.
    Without target texts, gains come from the documents alone; without documents there are no rows.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = min(1000, max(16, n // 8))
    salts = max(8, -(-n // shards))
    key = F.xxhash64("text")
    own = short_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", key.alias("key"), F.pmod(F.xxhash64(F.col("doc_id").cast("long"), key), F.lit(salts)).cast("int").alias("salt"))
    cells = own.mapInArrow(_postings(shards, salts, longest, buckets, False), CELLS).unionByName(target.select("text").mapInArrow(_postings(shards, salts, longest, buckets, True), CELLS))
    dealt = cells.repartition(n, "cell").sortWithinPartitions("cell", "late")
    each = dealt.mapInArrow(_contributions(shards, salts, buckets), "doc_id long, key long, weight long, n_words long, n_features long, copies long")
    summed = each.groupBy("doc_id", "key").agg(*(F.sum(c).alias(c) for c in ("weight", "n_words", "n_features", "copies")))
    one = lambda c: F.expr(f"{c} div copies").alias(c)
    return summed.select("doc_id", one("n_features"), one("n_words"), one("weight"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("col")


def gumbel(doc_id: Column, seed: str = "42") -> Column:
    """Thousandths of a Gumbel number that the id alone decides."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(weighted: DataFrame, percent: int = 5, least_words: int = 20) -> DataFrame:
    """``doc_id, n_features, weight, score, rank``: the highest ``percent`` of rows with enough words are ranked, ties by doc_id.

    Rows without an id have no score, are not drawn and do not count. The rank is a place in a sort that is spread over tasks.
    """
    scored = stored(weighted.withColumn("score", (F.col("weight") + gumbel(F.col("doc_id"))).cast("long")))
    may = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    placed = stored(scored.where(may).orderBy(F.desc("score"), "doc_id").withColumn("place", F.monotonically_increasing_id()))
    counts = sorted(placed.groupBy(F.shiftright("place", 33).alias("part")).count().collect())  # a row for each task of the sort
    before, offsets = 0, []
    for part, count in counts:
        offsets.append((part, before))
        before += count
    drawn = percent * before // 100
    begins = F.broadcast(placed.sparkSession.createDataFrame(offsets, "part long, before long"))
    rank = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranked = placed.withColumn("part", F.shiftright("place", 33)).join(begins, "part").withColumn("rank", F.when(rank <= drawn, rank))
    out = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(out).unionByName(scored.where(~F.coalesce(may, F.lit(False))).withColumn("rank", F.lit(None).cast("long")).select(out))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


# CRC-32 by half bytes: the 16 entries are made by the polynomial, the digits of a feature's bytes are folded, low half first.
ORACLE = r"""WITH crc AS (SELECT list(x ORDER BY i) AS tab FROM (SELECT i, list_reduce([i, 0, 0, 0, 0], lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS x FROM (SELECT unnest(generate_series(0, 15))::BIGINT AS i))),
w AS (SELECT 's' AS src, doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
  UNION ALL SELECT 't', item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
f AS (SELECT src, id, unnest(ws) AS f FROM w UNION ALL SELECT src, id, unnest(list_transform(generate_series(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w UNION ALL SELECT src, id, unnest(list_transform(generate_series(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) FROM w),
c AS (SELECT src, id, f, count(*) AS n FROM f GROUP BY ALL),
u AS (SELECT DISTINCT f, hex(encode(f)) AS x FROM c),
b AS (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(generate_series(1, length(x)), lambda i: (instr('0123456789ABCDEF', x[CASE WHEN i % 2 = 1 THEN i + 1 ELSE i - 1 END]) - 1)::BIGINT)), lambda a, d: xor(a // 16, tab[xor(a % 16, d) + 1])), 4294967295) % 10000 AS bucket FROM u, crc),
p AS (SELECT src, id, bucket, sum(n)::BIGINT AS n FROM c JOIN b USING (f) GROUP BY ALL),
g AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE src = 's'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (WHERE src = 't'), 0)::DOUBLE AS t FROM p GROUP BY 1),
a AS (SELECT sum(s) AS all_s, sum(t) AS all_t FROM g),
v AS (SELECT bucket, floor(1000 * ln((t + 1) * (all_s + 10000) / ((s + 1) * (all_t + 10000))))::BIGINT AS gain FROM g, a),
d AS (SELECT id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM p JOIN v USING (bucket) WHERE src = 's' GROUP BY 1),
e AS (SELECT doc_id, len(coalesce(ws, [])) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight FROM documents JOIN w ON src = 's' AND w.id = doc_id LEFT JOIN d ON d.id = doc_id),
h AS (SELECT *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score FROM e),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM h WHERE n_words >= 20)
SELECT h.doc_id, n_features, weight, score, CASE WHEN rank <= 5 * (SELECT count(*) FROM r) // 100 THEN rank END AS rank FROM h LEFT JOIN r USING (doc_id)"""
