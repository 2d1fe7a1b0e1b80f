"""Packing of token sequences by reciprocal-capacity classes (operator 12).

A piece of z tokens is of class k if k pieces of its size, and no more, fit into a sequence; a sequence of class k takes k pieces of that
class, whatever comes. As documents may be cut, a remainder is cut to the longest piece whose class leaves next to
nothing free, and again what is left of it. Each task fills its own sequences; when it ends, the pieces of those
that aren't full are laid end to end, and the last stretch is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import short_batches, table

CAPACITY = 2048
#: Tokens that may stay free in a sequence, for each 256 of its capacity.
SLACK = 1
#: Tokens of pieces that are handed on at once.
HELD = 1 << 20

PIECES = "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long"


def cuts(capacity: int = CAPACITY, slack: int = SLACK) -> np.ndarray:
    """For each length up to the capacity, how long its first piece is: the longest whose class fills a sequence but for the slack."""
    size = np.arange(1, capacity + 1)
    fits = np.where(capacity % size <= capacity * slack // 256, size, 0)
    return np.concatenate(([0], np.maximum.accumulate(fits)))


def pieces_of(n: int, first: np.ndarray) -> list[int]:
    """Lengths of the pieces of n tokens, in order."""
    capacity = len(first) - 1
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        out.append(int(first[rest]))
        rest -= out[-1]
    return out


class Packer:
    """The sequences of one task. Pieces are (doc_id, start, ids, doc_tokens); ``out`` gets them with sequence and offset."""

    def __init__(self, capacity: int, slack: int, first_id: int):
        self.capacity, self.first, self.next_id = capacity, cuts(capacity, slack), first_id
        self.open: dict[int, list[tuple]] = {}
        self.out: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        start = 0
        for size in pieces_of(len(ids), self.first):
            k = self.capacity // size
            held = self.open.setdefault(k, [])
            held.append((doc_id, start, ids[start : start + size].copy(), len(ids)))
            start += size
            if len(held) == k:
                self._emit(self.open.pop(k))

    def _emit(self, held: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, n in held:
            self.out.append((doc_id, start, ids.tobytes(), n, self.next_id, offset))
            offset += len(ids)
        self.next_id += 1

    def finish(self) -> None:
        left = [piece for k in sorted(self.open) for piece in self.open.pop(k)]
        total = sum(len(ids) for _, _, ids, _ in left)
        sizes = [self.capacity] * (total // self.capacity)
        rest = total % self.capacity
        sizes += [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]
        left.reverse()
        for room in sizes:
            held = []
            while room:
                doc_id, start, ids, n = left.pop()
                if len(ids) > room:
                    left.append((doc_id, start + room, ids[room:], n))
                    ids = ids[:room]
                room -= len(ids)
                held.append((doc_id, start, ids, n))
            self._emit(held)

    def batch(self) -> pa.RecordBatch:
        columns = [pa.array(x, t) for x, t in zip(zip(*self.out, strict=True), [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()], strict=True)]
        self.out = []
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset"])


def pack(docs: DataFrame, encoder: Callable[[], Callable[[str], np.ndarray]], end_id: int, capacity: int = CAPACITY, slack: int = SLACK) -> DataFrame:
    """``doc_id, start, ids binary (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset`` of each piece.

    ``encoder``, called once in each Python worker, gives the function from a text to its ids; ``end_id`` follows each
    text. A null or empty text is that id alone; a text of any length is encoded whole. Repeated rows are packed each, a null
    id stays null, other columns play no part, and no documents give no pieces. Sequences belong to one task and their ids begin with its
    number, so a task that runs again gives the same rows. Only sequences whose length is a power of two, or that have at most the slack free, come out.
    """
    if capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, held = encoder(), 0
        packer = Packer(capacity, slack, TaskContext.get().partitionId() << 33)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.concatenate((encode(text.as_py() or ""), end)).astype("<u4")
                packer.add(doc_id, ids)
                held += len(ids)
                if held >= HELD and packer.out:
                    yield packer.batch()
                    held = 0
        packer.finish()
        if packer.out:
            yield packer.batch()

    return short_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


@cache
def byte_encoder(rank_file: str, json_file: str, pattern: str) -> Callable[[str], np.ndarray]:
    """Texts to the ids that the JSON file's tokenizer gives, without adding special tokens.

    The rank file has the same vocabulary, and its library is some four times faster; the special strings of the JSON file are ids
    of their own in a text, as there. A text that it refuses (hundreds of thousands of blanks in a row) is
    encoded by the JSON file's own library.
    """
    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(json_file)
    special = {x.content: i for i, x in whole.get_added_tokens_decoder().items()}
    with open(rank_file, "rb") as f:  # in a task: the vocabulary belongs to the installation
        ranks = {base64.b64decode(data): int(rank) for data, rank in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, allowed_special="all")
        except ValueError:
            return np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
    pieces = pack(table(spark, sf_dir, "documents"), lambda: byte_encoder(*files), 1)
    length = F.expr("octet_length(ids) div 4")
    return pieces.select("doc_id", "start", length.alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
