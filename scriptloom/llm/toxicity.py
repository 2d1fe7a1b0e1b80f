"""Toxicity by a classifier with counterfactual regularisation (operator 8).

A logistic regression on hashed words and beginnings of words. For each labelled text that names a group, the features of
its copies with the group's term swapped for others are compared with its own, beginnings of the terms included, and
training penalises any change of the score: ``mean((w·(x' - x))²)``. What a text says of a group may still count; which
group it names may not.

Corpora in which hardly any labelled text names a group would leave that penalty empty. So the fit also makes a copy of each
labelled text that mentions a group after it, by a term that a hash of the text picks, and compares that copy with the text
itself and with those that mention the other groups of the kind: a mention alone, of whichever group, may not count either.
Copies are used by the penalty only; what the labels say is learned from the texts as they are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fifth, give_back, short_batches, stored, table
from .wordhash import Words, chunks

BITS = 18
DIM = 1 << BITS
#: Beginnings of longer words that count as features, in bytes.
PREFIXES = (4, 5, 6, 7, 8)
#: Labelled rows that are learned from, about; a bound of the fit alone.
MAX_ROWS = 6000
#: Weight of the counterfactual penalty, of the square of the weights, and steps of the fit.
FAIRNESS = 1.0
RIDGE = 1e-4
STEPS = 250
#: A word is used as far as its log-odds of the label stand out from chance by more than so many standard deviations.
CHANCE = 3.0
#: Words that name groups, by kind; a term is swapped for the others of its kind. Lower case.
IDENTITY_TERMS = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    ("man", "woman"),
    ("men", "women"),
    ("black", "white", "asian", "latino", "arab"),
    ("immigrant", "native", "refugee", "foreigner"),
    ("immigrants", "natives", "refugees", "foreigners"),
    ("blind", "deaf", "disabled"),
    ("young", "old", "elderly"),
)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def word_buckets(words: list[str]) -> np.ndarray:
    """The bucket of each of some single words."""
    return _bucket(Words([w.encode() for w in words]).hashes())


def _presence(texts: list[bytes], used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, bucket) pairs, in order; only buckets that are ``used``, if given."""
    words = Words(texts)
    found, doc = [], words.doc
    for at, hashes in ((slice(None), words.hashes()), *map(words.prefixes, PREFIXES)):
        of, bucket = doc[at], _bucket(hashes)
        if used is not None:
            kept = used[bucket]
            of, bucket = of[kept], bucket[kept]
        found.append(of * DIM + bucket)
    both = np.unique(np.concatenate(found))
    return both >> BITS, both & (DIM - 1)


def _parts(terms: list[str]) -> list[np.ndarray]:
    """The distinct buckets of each single word: its own and those of its beginnings."""
    of, bucket = _presence([t.encode() for t in terms])
    return np.split(bucket, np.searchsorted(of, np.arange(1, len(terms))))


def _word_parts(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of all words and their beginnings, by word."""
    at, bucket = [np.arange(len(hashes))], [_bucket(hashes)]
    for size in PREFIXES:
        places, found = words.prefixes(size)
        at.append(places)
        bucket.append(_bucket(found))
    at, bucket = np.concatenate(at), np.concatenate(bucket)
    order = np.argsort(at, kind="stable")
    return at[order], bucket[order]


#: Kinds of terms; a term is one word.
Kinds = tuple[tuple[str, ...], ...]


def features(labelled: DataFrame, terms: Kinds = IDENTITY_TERMS, mentions: bool = False) -> DataFrame:
    """``text, toxic`` to ``toxic, on array<int>, swaps array<int>``; a null text is an empty one.

    on: buckets of the words and their beginnings. swaps: for each identity term in the text and each other of its kind,
    the number of features that go, of those that come, then these buckets, one swap after another. What other words of
    the text keep on neither goes nor comes. With ``mentions`` each text, an empty one too, also has the changes of a copy
    that mentions a group after it: from no mention to this one, and from this one to the others of its kind.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [t for kind in terms for t in kind]
        parts = dict(zip(names, _parts(names), strict=True))
        codes = dict(zip(names, Words([t.encode() for t in names]).hashes(), strict=True))
        others = {int(codes[t]): (parts[t], [parts[o] for o in kind if o != t]) for kind in terms for t in kind}
        listed = np.array(sorted(others), np.uint64)
        nothing = np.empty(0, np.int64)

        def change(gone: np.ndarray, new: np.ndarray, rest: np.ndarray) -> list:
            lost = np.setdiff1d(np.setdiff1d(gone, new), rest)
            won = np.setdiff1d(np.setdiff1d(new, gone), rest)
            return [[len(lost), len(won)], lost, won]

        for batch in batches:
            on, swaps = [], []
            for _, texts in chunks(batch.column("text")):
                of, bucket = _presence(texts)
                words = Words(texts)
                hashes = words.hashes()
                named = np.isin(hashes, listed)
                doc = words.doc
                hit = np.unique(doc[named])
                for d, part in enumerate(np.split(bucket, np.searchsorted(of, np.arange(1, len(texts))))):
                    on.append(part.astype(np.int32))
                    out = []
                    if d in hit:
                        alone = Words([texts[d]])
                        own = alone.hashes()
                        at, every = _word_parts(alone, own)
                        for code in np.unique(own[np.isin(own, listed)]):
                            gone, come = others[int(code)]
                            rest = np.unique(every[own[at] != code])
                            for new in come:
                                out += change(gone, new, rest)
                    if mentions and names:
                        said, come = others[int(codes[names[zlib.crc32(texts[d]) % len(names)]])]
                        out += change(nothing, said, part)
                        for new in come:
                            out += change(said, new, part)
                    swaps.append(np.concatenate(out).astype(np.int32) if out else nothing.astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(on, pa.list_(pa.int32())), pa.array(swaps, pa.list_(pa.int32()))], ["toxic", "on", "swaps"])

    return short_batches(labelled).select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(extract, "toxic int, on array<int>, swaps array<int>")


def _changes(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Of swaps as ``features`` lists them: the swap, the bucket and the sign of each change, and the number of swaps."""
    swap, bucket, sign, i, n = [], [], [], 0, 0
    while i < len(flat):
        lost, won = int(flat[i]), int(flat[i + 1])
        swap.append(np.full(lost + won, n))
        bucket.append(flat[i + 2 : i + 2 + lost + won])
        sign.append(np.repeat([-1.0, 1.0], [lost, won]))
        i, n = i + 2 + lost + won, n + 1
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), 0
    return np.concatenate(swap), np.concatenate(bucket), np.concatenate(sign), n


def _rows(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and values of a list array."""
    lengths = np.diff(lists.offsets.to_numpy())
    return np.repeat(np.arange(len(lengths)), lengths), lists.flatten().to_numpy()


class Model:
    """``weight`` by bucket and ``bias``; the score is the logistic function of bias plus the weights of the distinct words.

    ``swaps``: how many swapped copies the fit compared; ``rows``: how many labelled rows it learned from.
    """

    def __init__(self, weight: np.ndarray, bias: float, swaps: int = 0, rows: int = 0):
        self.weight, self.bias, self.swaps, self.rows = weight, bias, swaps, rows

    def score(self, texts: list[bytes]) -> np.ndarray:
        of, bucket = _presence(texts, self.weight != 0)
        z = self.bias + np.bincount(of, self.weight[bucket], len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _toxic_counts(found: DataFrame) -> DataFrame:
    """``bucket, clean, toxic``: the rows of each label that have the feature, plus one."""
    one = found.select("toxic", F.explode("on").alias("bucket"))
    return one.groupBy("bucket").agg((F.count_if(F.col("toxic") == 0) + 1).alias("clean"), (F.sum("toxic") + 1).alias("toxic"))


def standing_out(found: DataFrame, clean: int, toxic: int) -> DataFrame:
    """``bucket, scale``: the features whose log-odds stand out from chance, and by how much; at most DIM rows."""
    odds = F.log(F.col("toxic") / F.lit(toxic + 2)) - F.log(F.col("clean") / F.lit(clean + 2))
    scale = F.abs(odds) / F.sqrt(1 / F.col("toxic") + 1 / F.col("clean")) - CHANCE
    return _toxic_counts(found).select("bucket", scale.alias("scale")).where("scale > 0")


def _only(found: DataFrame, scale: np.ndarray) -> DataFrame:
    """``found`` with the features alone that have a scale; of a swap as many stay as make a change, none or more."""
    sent = found.sparkSession.sparkContext.broadcast(np.packbits(scale > 0))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = np.unpackbits(sent.value).astype(bool)
        for batch in batches:
            on = [v.values.to_numpy()[used[v.values.to_numpy()]] for v in batch.column("on")]
            swaps = []
            for v in batch.column("swaps"):
                flat, i, out = v.values.to_numpy(), 0, []
                while i < len(flat):
                    mid, end = i + 2 + flat[i], i + 2 + flat[i] + flat[i + 1]
                    lost, won = (x[used[x]] for x in (flat[i + 2 : mid], flat[mid:end]))
                    out += [[len(lost), len(won)], lost, won]
                    i = end
                swaps.append(np.concatenate(out).astype(np.int32) if out else np.empty(0, np.int32))
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(on, kind), pa.array(swaps, kind)], ["toxic", "on", "swaps"])

    return found.mapInArrow(keep, "toxic int, on array<int>, swaps array<int>")


def fit(labelled: DataFrame, fairness: float = FAIRNESS, steps: int = STEPS, terms: Kinds = IDENTITY_TERMS, mentions: bool = False) -> Model:
    """Learn from ``text, toxic`` (0/1), all of it: the caller bounds the rows. Without rows every score is 0.5.

    Features are counted in Spark; the driver gets those alone that stand out from chance. ``terms``: the kinds of terms
    to swap, and to mention with ``mentions``. A fairness of 0 learns without the penalty.
    """
    found = stored(features(labelled.where("toxic in (0, 1)"), terms, mentions))
    n, positive = found.agg(F.count("*"), F.sum("toxic")).first()
    if not n:
        return Model(np.zeros(DIM), 0.0)
    scale, out = np.zeros(DIM), standing_out(found, n - positive, positive).toArrow()
    scale[out.column("bucket").to_numpy()] = out.column("scale").to_numpy()
    got = _only(found, scale).toArrow()
    y = got.column("toxic").to_numpy().astype(float)
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    row, bucket = _rows(got.column("on").combine_chunks())
    of_swap, changed, sign, swaps = _changes(_rows(got.column("swaps").combine_chunks())[1])
    del got
    give_back()
    weigh = np.where(y == 1, 0.5 / rate, 0.5 / (1 - rate)) ** 0.5
    v, bias = np.zeros(DIM), float(np.log(rate / (1 - rate)))
    past, past_bias, speed = np.full(DIM, 1e-6), 1e-6, 0.3
    for _ in range(steps):  # Adagrad
        w = v * scale
        z = bias + np.bincount(row, w[bucket], len(y))
        slope = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) * weigh / len(y)
        grad = np.bincount(bucket, slope[row], DIM)
        if swaps:
            change = fairness * 2 * np.bincount(of_swap, sign * w[changed], swaps) / swaps
            grad += np.bincount(changed, sign * change[of_swap], DIM)
        grad = grad * scale + RIDGE * v
        past += grad**2
        past_bias += slope.sum() ** 2
        v -= speed * grad / np.sqrt(past)
        bias -= speed * slope.sum() / np.sqrt(past_bias)
    return Model((v * scale).astype(np.float32), bias, swaps, n)


def learned(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, terms: Kinds = IDENTITY_TERMS) -> Model:
    """From labelled documents that are not held out; of more than ``max_rows``, a share of about that many by a hash of the id.

    A doc_id with differing labels counts once, as toxic if any says so.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & (fifth(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, max_rows / max(known.count(), 1))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    # about max_rows rows of two numbers, whatever the input
    return fit(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), terms=terms, mentions=True)


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score double, predicted int`` (score >= 0.5); a null text is scored as an empty one.

    Repeated rows get one score. Other columns pass; columns of these two names are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def judged(texts: pa.Array) -> pa.Array:
        found = [sent.value.score(run) for _, run in chunks(texts)]
        return pa.array(np.concatenate(found) if found else np.empty(0))

    return short_batches(docs).withColumn("score", judged(F.col(text))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, repeated rows each; columns as they were.

    Null texts count as empty ones. If no labelled document is there to learn from, all stay.
    """
    model = learned(docs, labels)
    if not model.rows:
        return docs
    judged = scored(docs.select(F.struct(*docs.columns).alias("__row"), F.col("text")), model)
    return judged.where("predicted = 0").select("__row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = F.coalesce(fifth(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    return scored(docs.select("doc_id", held, "text"), learned(docs, labels)).select("doc_id", "held_out", "score", "predicted")
