"""Language identification with multinomial naive Bayes over hashed character n-grams (operator 4)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fifth, give_back, release, short_batches, stored, table

#: Hash buckets that n-grams are counted in, and their orders.
BITS = 16
BUCKETS = 1 << BITS
ORDERS = (1, 2, 3)
#: Numbers of a model's matrix (16 MB): with over 64 languages, a bucket of the model is 2, 4, 8, ... of those counted.
CELLS = 1 << 22
#: Characters worked on at once.
PIECE = 1 << 19
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of texts: the bucket of each n-gram of a kind, and where each text's n-grams begin (and the last end).

    Two zero characters stand before each text and after the last, so that edges count and no n-gram spans two texts.
    """
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer(("\0\0" + "\0\0".join(lowered) + "\0\0").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    n = len(codes) - 2
    begins = np.cumsum([0, *(len(t) + 2 for t in lowered)])
    for order in ORDERS:
        h = codes[:n] * _K[0]
        for j in range(1, order):
            h = (h ^ (h >> np.uint64(29))) * _K[j] + codes[j : j + n]
        h = (h ^ (h >> np.uint64(32))) * _K[2] + np.uint64(order * 0x1000193)
        yield (h >> np.uint64(64 - BITS)).astype(np.int64), begins


def _runs(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Runs of rows of about PIECE characters; null reads as empty, a longer text is a run of its own."""
    at, run, total = 0, [], 0
    for i, value in enumerate(column):
        run.append(value.as_py() or "")
        total += len(run[-1])
        if total >= PIECE:
            yield at, run
            at, run, total = i + 1, [], 0
    if run:
        yield at, run


@dataclass
class Model:
    langs: list[str]
    prior: np.ndarray  # log, by language
    weight: np.ndarray  # log-probability, [bucket, language], float32
    shift: int = 0  # a bucket of the model is a counted one without so many of its last bits


def count_grams(labelled: DataFrame) -> DataFrame:
    """``lang, text`` to ``lang, bucket, n``; bucket -1 counts the documents. Each task sends its sums, not its n-grams."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            lang = np.array(batch.column("lang").to_pylist(), object)
            for at, run in _runs(batch.column("text")):
                of = lang[at : at + len(run)]
                for name in set(of):
                    mine = [t for t, x in zip(run, of, strict=True) if x == name]
                    total = sums.setdefault(name, np.zeros(BUCKETS + 1, np.int64))
                    total[BUCKETS] += len(mine)
                    for buckets, _ in _grams(mine):
                        total[:BUCKETS] += np.bincount(buckets, minlength=BUCKETS)
        for name, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(np.where(at == BUCKETS, -1, at)), pa.array(total[at])], ["lang", "bucket", "n"])

    return short_batches(labelled).select("lang", "text").mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, smoothing: float = 0.1, cells: int = CELLS) -> Model:
    """Learn from all rows with a non-null lang. What is fetched is bounded by ``cells``, however many languages there are.

    Every n-gram and every language counts; with many languages n-grams share buckets more often.
    """
    counted = stored(count_grams(labelled.where("lang is not null")))
    langs = sorted(r.lang for r in counted.where("bucket = -1").select("lang").toLocalIterator())
    shift = max(0, math.ceil(math.log2(max(len(langs), 1) * BUCKETS / cells)))
    shift = min(shift, BITS)
    place = labelled.sparkSession.createDataFrame(list(enumerate(langs)), "at int, lang string")
    bucket = F.when(F.col("bucket") < 0, -1).otherwise(F.shiftright("bucket", shift)).cast("int")
    # a row for each language and bucket of the model
    got = counted.join(F.broadcast(place), "lang").groupBy("at", bucket.alias("bucket")).agg(F.sum("n").alias("n")).toArrow()
    release(counted)
    size = BUCKETS >> shift
    n = np.zeros((size + 1, len(langs)))
    n[got.column("bucket").to_numpy(), got.column("at").to_numpy()] = got.column("n").to_numpy()  # bucket -1 is the last row
    seen = n[:size] + smoothing
    return Model(langs, np.log(n[size] / max(n[size].sum(), 1)), np.log(seen / seen.sum(axis=0)).astype(np.float32), shift)


def log_likelihoods(model: Model, texts: list[str]) -> np.ndarray:
    """Of each text, the log-probability of its n-grams in each language."""
    total = np.zeros((len(texts), len(model.langs)))
    for buckets, begins in _grams(texts):
        at = buckets >> model.shift
        for lang in range(len(model.langs)):
            total[:, lang] += np.add.reduceat(model.weight[:, lang][at].astype(np.float64), begins[:-1])
    return total


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred, score``: the likeliest language, by all of the text; on a tie the first by name.

    score: its probability given all of the text, however long it is. A text that is null or has no letter, and any text if no language was learned, is ``und`` with score 0. Repeated rows are judged alike. Other
    columns pass; columns of these two names are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    give_back()

    def judge(texts: pa.Array) -> pa.Array:
        m, best, score = sent.value, [], []
        for _, run in _runs(texts):
            if m.langs:
                total = log_likelihoods(m, run) + m.prior
                top = total.argmax(axis=1)
                share = 1 / np.exp(total - total[np.arange(len(run)), top][:, None]).sum(axis=1)
            for i, t in enumerate(run):
                known = bool(m.langs) and _LETTER.search(t) is not None
                best.append(m.langs[top[i]] if known else UNKNOWN)
                score.append(float(share[i]) if known else 0.0)
        return pa.StructArray.from_arrays([pa.array(best, pa.string()), pa.array(score, pa.float64())], ["lang", "score"])

    @F.arrow_udf("lang string, score double")
    def judged(texts: pa.Array) -> pa.Array:
        return judge(texts)

    return short_batches(docs).withColumn("__judged", judged(F.col(text))).withColumns({"lang_pred": F.col("__judged.lang"), "score": F.col("__judged.score")}).drop("__judged")


def learned(docs: DataFrame) -> Model:
    """From the text and lang of the documents that are not held out."""
    return fit(docs.where(fifth(F.col("doc_id")) != 0).select("lang", "text"))


#: A document is rejected if it has no letter or its language is less likely than this.
LEAST_SCORE = 0.5


def keep_known(docs: DataFrame) -> DataFrame:
    """The documents whose language is told with at least LEAST_SCORE; columns as they were."""
    judged = predict(docs.select(F.struct(*docs.columns).alias("__row"), F.col("text")), learned(docs))
    return judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("__row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(fifth(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    return predict(docs.select("doc_id", held, "text"), learned(docs)).select("doc_id", "held_out", "lang_pred", "score")
