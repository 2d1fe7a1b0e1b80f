"""Byte-level BPE encoding and decoding (operator 5).

The merges are folded over the bytes of distinct pieces by Spark's higher-order functions with the ranks in a broadcast
row; what a piece becomes is then looked up for all its places. A state is the piece's parts, each a number of its id, its place
and the rank that it and its right neighbour would merge to; one step merges the leftmost pair of the lowest rank, which
is the least number, and looks up the two pairs that this makes. Pieces of over ``LONG`` bytes, for which copying the state at each step would take quadratic
time, are merged with a heap in the task that holds them.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator
from contextlib import suppress
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, release, short_batches, stored, table

#: Bounds of the dictionary of frequent pieces that is sent to all tasks.
MAX_PIECES = 500_000
MAX_BYTES = 24 << 20
#: Bytes of a piece from which it is merged with a heap.
LONG = 256
#: Bits of an id in a packed pair.
ID_BITS = 20


def java_pattern(pattern: str) -> str:
    """White space as Unicode has it, as the tokenizer's own engine reads the pattern."""
    return "(?U)" + pattern


def read_ranks(path: str) -> list[bytes]:
    """A rank file (base64 of the bytes, blank, rank on each line) as the list of byte strings by rank."""
    with open(path, "rb") as f:  # on the driver: the vocabulary belongs to the installation
        ranks = {int(rank): base64.b64decode(data) for data, rank in map(bytes.split, f)}
    return [ranks[i] for i in range(len(ranks))]


def merge_tables(tokens: list[bytes]) -> tuple[list[int], list[int]]:
    """Two hash tables of all pairs of ids whose bytes together are a token, for a lookup that reads one place of each.

    An entry is the pair's key and the token's id; a pair stands at its key modulo the size of one of the tables.
    """
    known = {t: i for i, t in enumerate(tokens)}
    pairs = {}
    for whole, token in enumerate(tokens):
        for cut in range(1, len(token)):
            left, right = known.get(token[:cut]), known.get(token[cut:])
            if left is not None and right is not None:
                pairs[left << ID_BITS | right] = whole
    size = len(pairs) * 5 // 4 | 1
    while True:
        tables = [[-1] * size, [-1] * (size + 2)]
        if all(_placed(tables, key << ID_BITS | whole) for key, whole in pairs.items()):
            return tables[0], tables[1]
        size += 64


def _placed(tables: list[list[int]], entry: int) -> bool:
    """Put an entry into the first table; what stood there moves to the other one, and so on."""
    for turn in range(200):
        table = tables[turn % 2]
        at = (entry >> ID_BITS) % len(table)
        entry, table[at] = table[at], entry
        if entry < 0:
            return True
    return False


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: A part in a state: the rank of what it and its right neighbour merge to, its place and its id, in this order of bits.
PLACE_BITS = 8
RANK_AT = ID_BITS + PLACE_BITS
#: The rank of a part that merges with nothing.
NONE = 1 << ID_BITS


def encoder(spark: SparkSession, tokens: list[bytes]) -> Callable[[DataFrame, str], DataFrame]:
    """A function that turns a column, lists of pieces (1 to LONG bytes, no token as a whole), into lists of their ids: the fold.

    The ranks are one row that is broadcast. As a literal they would stand, megabytes each time, in every description of
    a plan that the driver keeps. Each row takes a copy of them along, so a row should hold many pieces.
    """
    one, two = merge_tables(tokens)
    known = {t: i for i, t in enumerate(tokens)}
    letters = [known[bytes([b])] for b in range(256)]
    firsts = [known.get(bytes([a, b]), NONE) for a in range(256) for b in range(256)]
    lists = {"__one": one, "__two": two, "__letters": letters, "__firsts": firsts}
    ranks = F.broadcast(spark.createDataFrame(pa.table({k: pa.array([x], pa.list_(pa.int64())) for k, x in lists.items()})))
    low_bits = lambda c, n: c.bitwiseAND(F.lit((1 << n) - 1))

    def folded(piece: Column, first: Column, second: Column, of_byte: Column, of_two: Column) -> Column:
        def packed(left: Column, right: Column, place_and_id: Column) -> Column:
            """A part, with the rank that the ids left and right merge to; NONE if either is null."""

            def found(key: Column) -> Column:
                a = F.get(first, (key % len(one)).cast("int"))
                b = F.get(second, (key % len(two)).cast("int"))
                return F.when(F.shiftright(a, ID_BITS) == key, low_bits(a, ID_BITS)).when(F.shiftright(b, ID_BITS) == key, low_bits(b, ID_BITS)).otherwise(F.lit(NONE).cast("bigint"))

            return F.shiftleft(_let(F.shiftleft(left, ID_BITS).bitwiseOR(right), found), RANK_AT).bitwiseOR(place_and_id)

        def step(parts: Column, _: Column) -> Column:
            def joined(low: Column) -> Column:
                whole = F.shiftright(low, RANK_AT)

                def at(k: Column) -> Column:  # parts k and k + 1, from 1, become one
                    before = F.get(parts, k - 2)
                    new = packed(whole, low_bits(F.get(parts, k + 1), ID_BITS), F.shiftleft(F.shiftright(low_bits(low, RANK_AT), ID_BITS), ID_BITS).bitwiseOR(whole))
                    rest = F.slice(parts, k + 2, F.size(parts))
                    longer = F.concat(F.slice(parts, 1, k - 2), F.array(packed(low_bits(before, ID_BITS), whole, low_bits(before, RANK_AT)), new), rest)
                    return F.when(k > 1, longer).otherwise(F.concat(F.array(new), rest))

                return F.when(low >= NONE << RANK_AT, parts).otherwise(_let(F.array_position(parts, low).cast("int"), at))

            # the lowest rank, of equal ones the first place
            return _let(F.array_min(parts), joined)

        # a byte as a character of its own
        codes = F.transform(F.split(F.decode(piece.cast("binary"), "ISO-8859-1"), ""), F.ascii)

        def begun(codes: Column) -> Column:
            rank = lambda c, i: F.coalesce(F.get(of_two, c * 256 + F.get(codes, i + 1)), F.lit(NONE).cast("bigint"))
            return F.transform(codes, lambda c, i: F.shiftleft(rank(c, i), RANK_AT).bitwiseOR(F.shiftleft(i.cast("bigint"), ID_BITS)).bitwiseOR(F.get(of_byte, c)))

        rounds = F.sequence(F.lit(1), F.greatest(F.octet_length(piece) - 1, F.lit(1)))
        return F.aggregate(rounds, _let(codes, begun), step, lambda parts: F.transform(parts, lambda x: low_bits(x, ID_BITS).cast("int")))

    def encode(rows: DataFrame, column: str) -> DataFrame:
        ids = lambda *tables: F.transform(column, lambda piece: folded(piece, *tables))
        bound = _let(F.col("__one"), lambda a: _let(F.col("__two"), lambda b: _let(F.col("__letters"), lambda c: _let(F.col("__firsts"), lambda d: ids(a, b, c, d)))))
        return rows.crossJoin(ranks).withColumn(column, bound).drop(*lists)

    return encode


def heap_merged(piece: bytes, known: dict[bytes, int]) -> list[int]:
    """The ids of a piece, by a heap of the pairs that merge: the lowest rank first, from the left."""
    ends = list(range(1, len(piece) + 1))  # of the part that begins at each place; 0 if none does
    left = list(range(-1, len(piece)))  # where the part before it begins
    rank = [known.get(piece[i : i + 2], -1) for i in range(len(piece) - 1)] + [-1]
    heap = [r << 32 | i for i, r in enumerate(rank) if r >= 0]
    heapq.heapify(heap)

    def look_up(i: int) -> None:
        """Of the part at i and its right neighbour."""
        end = ends[i]
        rank[i] = known.get(piece[i : ends[end]], -1) if end < len(piece) else -1
        if rank[i] >= 0:
            heapq.heappush(heap, rank[i] << 32 | i)

    while heap:
        top = heapq.heappop(heap)
        i = top & 0xFFFFFFFF
        if not ends[i] or rank[i] != top >> 32:
            continue  # no longer so
        gone = ends[i]
        ends[i], ends[gone] = ends[gone], 0
        if ends[i] < len(piece):
            left[ends[i]] = i
        look_up(i)
        if left[i] >= 0:
            look_up(left[i])
    ids, i = [], 0
    while i < len(piece):
        ids.append(known[piece[i : ends[i]]])
        i = ends[i]
    return ids


def _gather(flat: np.ndarray, offsets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists at[0], at[1], ... of a flat array, put together, and where each begins (and the last ends)."""
    begin, size = offsets[at], offsets[at + 1] - offsets[at]
    out = np.concatenate(([0], np.cumsum(size)))
    return flat[np.arange(out[-1]) + np.repeat(begin - out[:-1], size)], out


class Dictionary:
    """Pieces and their ids: the tokens that are text, then ``pieces`` that are none."""

    def __init__(self, pieces: pa.Array, ids: pa.ListArray, tokens: list[bytes]):
        text, whole = [], []
        for i, token in enumerate(tokens):
            with suppress(UnicodeDecodeError):
                text.append(token.decode())
                whole.append(i)
        known = pa.array(text, pieces.type)
        other = pc.invert(pc.is_in(pieces, value_set=known))
        ids = ids.filter(other)
        self.pieces = pa.concat_arrays([known, pieces.filter(other)])
        sizes = np.concatenate((np.ones(len(text), np.int64), np.diff(ids.offsets.to_numpy())))
        self.offsets = np.concatenate(([0], np.cumsum(sizes)))
        self.ids = np.concatenate((whole, ids.flatten().to_numpy())).astype("<u4")


class Vocabulary:
    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.offsets = np.concatenate(([0], np.cumsum([len(t) for t in tokens])))

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _gather(self.flat, self.offsets, ids.astype(np.int64))

    @cached_property
    def known(self) -> dict[bytes, int]:
        return {t: i for i, t in enumerate(self.tokens)}


#: A run, whose texts share a list of distinct pieces, has at least so many pieces, or 64 times the bytes, but for the last of a task; texts that are digested at once have fewer.
RUN, DIGEST_RUN = 1 << 20, 1 << 16
#: Runs in a file: a reader of columns holds those of one file at once.
FILE_RUNS = 4
#: Rows that the frequent pieces are dealt to for the fold.
SHARES = 64
RUNS = "doc_ids array<long>, counts array<int>, codes array<int>, pieces array<string>"
LOOKED_UP = "doc_ids array<long>, counts array<int>, codes array<int>, places array<int>, rare array<string>, long array<array<int>>"
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _parts(ends: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Parts of rows with about ``size`` pieces together; a longer row is a part of its own."""
    lo = 0
    while lo < len(ends) - 1:
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + size, "right")) - 1)
        yield lo, hi
        lo = hi


def _row(names: str, *columns: pa.Array) -> pa.RecordBatch:
    """One row of lists."""
    names = [c.split()[0] for c in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns], names)


def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc_id, pieces`` to runs: of each text the number of its pieces, and all pieces as places in the run's list of distinct ones."""

    def run(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        lists = pa.concat_arrays([b.column("pieces") for b in held])
        coded = lists.flatten().dictionary_encode()
        return _row(RUNS, pa.concat_arrays([b.column("doc_id") for b in held]), pc.list_value_length(lists), coded.indices, coded.dictionary)

    held, size = [], 0
    for batch in batches:
        for lo, hi in _parts(batch.column("pieces").offsets.to_numpy().astype(np.int64), RUN):
            held.append(batch.slice(lo, hi - lo))
            flat = held[-1].column("pieces").flatten()
            size += max(len(flat), flat.nbytes >> 6)
            if size >= RUN:
                yield run(held)
                held, size = [], 0
    if held:
        yield run(held)


def _places(pieces: pa.Array, words: Dictionary, vocabulary: Vocabulary) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Of distinct pieces their places in the dictionary, or -1, -2, ... if they aren't in it; what these are; and the ids of the long ones, which come after the others."""
    at = pc.index_in(pieces, value_set=words.pieces)
    missing, long = at.is_null().to_numpy(zero_copy_only=False), pc.greater(pc.binary_length(pieces), LONG).to_numpy(zero_copy_only=False)
    places, rare, late = at.fill_null(0).to_numpy().copy(), np.flatnonzero(missing & ~long), np.flatnonzero(missing & long)
    places[np.concatenate((rare, late))] = -1 - np.arange(len(rare) + len(late))
    merged = [heap_merged(pieces[int(i)].as_py().encode(), vocabulary.known) for i in late]
    return pa.array(places), pieces.take(pa.array(rare)), pa.array(merged, pa.list_(pa.int32()))


def _digests(doc_ids: pa.Array, counts: np.ndarray, codes: np.ndarray, places: np.ndarray, own: pa.ListArray, words: Dictionary, vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    """own: the ids of each piece of the run that isn't in the dictionary."""
    own_offsets = own.offsets.to_numpy().astype(np.int64)
    ids = np.concatenate((words.ids, own.flatten().to_numpy().astype("<u4")))
    offsets = np.concatenate((words.offsets, words.offsets[-1] + own_offsets[1:] - own_offsets[0]))
    distinct, begin = _gather(ids, offsets, np.where(places < 0, len(words.offsets) - 2 - places, places).astype(np.int64))
    ends = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
    for lo, hi in _parts(ends, DIGEST_RUN):
        ids, at = _gather(distinct, begin, codes[ends[lo] : ends[hi]])
        bounds = at[ends[lo : hi + 1] - ends[lo]]
        data, spots = vocabulary.decode(ids)
        rows = range(hi - lo)
        id_digests = [hashlib.sha256(ids[bounds[i] : bounds[i + 1]].tobytes()).hexdigest() for i in rows]
        digests = [hashlib.sha256(data[spots[bounds[i]] : spots[bounds[i + 1]]].tobytes()).hexdigest() for i in rows]
        yield pa.RecordBatch.from_arrays([doc_ids.slice(lo, hi - lo), pa.array(np.diff(bounds)), pa.array(id_digests, pa.string()), pa.array(digests, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _least_count(counted: DataFrame, pieces: int, size: int) -> int:
    """The smallest count such that the pieces that occur so often keep to both bounds; from 64 on a power of two."""
    level = F.when(F.col("count") < 64, F.col("count")).otherwise(F.pow(F.lit(2), F.floor(F.log2("count")))).cast("long")
    rows = counted.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.sum(F.octet_length("piece") + 20).alias("size")).collect()  # at most 63 + 57
    above = None
    for row in sorted(rows, reverse=True):
        pieces, size = pieces - row.n, size - row.size
        if pieces < 0 or size < 0:
            return above or 2 * row.level
        above = row.level
    return 1


def _dictionary(coded: DataFrame, tokens: list[bytes]) -> Dictionary:
    """From rows ``pieces, ids`` of lists."""
    got = coded.toArrow()
    kinds = pa.string(), pa.list_(pa.int32())
    pieces, ids = (pa.concat_arrays([x.flatten().cast(kind) for x in got.column(c).chunks] or [pa.array([], kind)]) for c, kind in zip(("pieces", "ids"), kinds, strict=True))
    return Dictionary(pieces, ids, tokens)


def round_trip(docs: DataFrame, rank_file: str, pattern: str, max_pieces: int = MAX_PIECES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each row: its text encoded, and the ids decoded again.

    Each text is cut once; about a thousand texts are a run that keeps its distinct pieces once. The pieces that most runs
    hold are folded once and sent to all tasks, as many as the bounds allow; the rare ones are folded once in each run.
    Both give the same ids, so the bounds are of speed and memory alone, and no text is shuffled.
    A null text is empty: no tokens, digests of nothing. Repeated rows give as many rows; other columns play no part.
    """
    spark = docs.sparkSession
    tokens = read_ranks(rank_file)
    encode = encoder(spark, tokens)
    split = F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(java_pattern(pattern)), F.lit(0))
    cut = short_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), split.alias("pieces"))
    runs = stored(cut.mapInArrow(gather, RUNS), FILE_RUNS)
    counted = stored(runs.select(F.explode("pieces").alias("piece")).where(F.octet_length("piece") <= LONG).groupBy("piece").agg(F.count("*").alias("count")))
    frequent = counted.where(F.col("count") >= _least_count(counted, max_pieces, max_bytes))
    shares = frequent.groupBy(F.pmod(F.xxhash64("piece"), F.lit(SHARES))).agg(F.collect_list("piece").alias("pieces"))
    # the driver keeps a file of it, not the value
    words = spark.sparkContext.broadcast(_dictionary(encode(shares.select("pieces", F.col("pieces").alias("ids")), "ids"), tokens))
    vocabulary = spark.sparkContext.broadcast(Vocabulary(tokens))
    release(counted)
    give_back()

    def lists(batch: pa.RecordBatch, *names: str) -> Iterator[list[pa.Array]]:
        for i in range(len(batch)):
            yield [batch.column(c)[i].values for c in names]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *kept, pieces in lists(batch, "doc_ids", "counts", "codes", "pieces"):
                yield _row(LOOKED_UP, *kept, *_places(pieces, words.value, vocabulary.value))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_ids, counts, codes, places, own in lists(batch, "doc_ids", "counts", "codes", "places", "own"):
                yield from _digests(doc_ids, counts.to_numpy(), codes.to_numpy(), places.to_numpy(), own, words.value, vocabulary.value)

    coded = encode(runs.mapInArrow(look_up, LOOKED_UP), "rare")
    return coded.select("doc_ids", "counts", "codes", "places", F.concat("rare", "long").alias("own")).mapInArrow(digest, RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
