"""Correction rules and vocabulary learned from aligned machine and human text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import helpers as H
from ..functions import text as X


def align(pairs: DataFrame) -> DataFrame:
    """``model, ref`` token arrays of sections to rows ``model, ref`` of words or short phrases."""
    return pairs.select(F.explode(H.aligned_pairs("model", "ref")).alias("p")).select("p.model", "p.ref")


def seen(pairs: DataFrame) -> DataFrame:
    """How often each machine form was aligned at all: ``wrong, seen``."""
    return pairs.groupBy(F.col("model").alias("wrong")).agg(F.count("*").alias("seen"))


def fixes(pairs: DataFrame) -> DataFrame:
    """How often a form stood against one that isn't the same when normalized: ``wrong, right, count``."""
    counted = pairs.groupBy(F.col("model").alias("wrong"), F.col("ref").alias("right")).agg(F.count("*").alias("count"))
    return counted.where(X.normalize(F.col("wrong")) != X.normalize(F.col("right")))


def alignment_counts(pairs: DataFrame) -> DataFrame:
    """``wrong, right, count, seen``: of each machine form that was aligned at all, its best fix, if it has any, and how often it was seen.

    One pass over the pairs, counted by both forms; tasks count first, so a word that is everywhere is a row a task. The
    rest are sums over these counts.
    """
    counted = pairs.groupBy(F.col("model").alias("wrong"), F.col("ref").alias("right")).agg(F.count("*").alias("count"))
    differs = X.normalize(F.col("wrong")) != X.normalize(F.col("right"))
    best = counted.groupBy("wrong").agg(F.max(F.when(differs, F.struct("count", "right"))).alias("b"), F.sum("count").alias("seen"))
    return best.select("wrong", "b.right", "b.count", "seen")


def ref_words(sections: DataFrame) -> DataFrame:
    """How often each word stands in the human text of the sections used: ``word, count``."""
    return sections.select(F.explode("ref").alias("word")).groupBy("word").agg(F.count("*").alias("count"))


def best_fix(fixes_: DataFrame) -> DataFrame:
    """Of each wrong form the right one with the largest count; of equal ones the last by text."""
    best = fixes_.groupBy("wrong").agg(F.max(F.struct("count", "right")).alias("b"))
    return best.select("wrong", "b.right", "b.count")


def without_ignored(rules: DataFrame, ignore: DataFrame) -> DataFrame:
    """Rules whose wrong form isn't on the ignore list."""
    return rules.join(ignore.select(F.col("word").alias("wrong")), "wrong", "left_anti")


def select_rules(best: DataFrame, seen_: DataFrame | None = None, ignore: DataFrame | None = None, min_count: int = 2, min_share: float = 0.6, alike: float | None = 0.5) -> DataFrame:
    """``wrong, right, count, share`` of the fixes that are frequent, sure, long and alike enough.

    best: ``wrong, right, count``, with ``seen`` (of ``alignment_counts``) or with ``seen_`` beside it. The dear test, of likeness, comes last, on the few that are left.
    """
    rules = best.where(F.col("count") >= min_count)
    rules = (rules if seen_ is None else rules.join(seen_, "wrong")).withColumn("share", F.col("count") / F.col("seen"))
    rules = rules.where((F.col("share") >= min_share) & (X.letters(F.col("wrong")) >= 3))
    if ignore is not None:
        rules = without_ignored(rules, ignore)
    if alike is not None:
        rules = rules.where(H.looks_alike(X.normalize(F.col("wrong")), X.normalize(F.col("right")), alike))
    return rules.select("wrong", "right", "count", "share")


def top_rules(rules: DataFrame, k: int = 40) -> DataFrame:
    return rules.orderBy(*(F.desc(c) for c in ("count", "share", "wrong", "right"))).limit(k)


def vocabulary(rules: DataFrame, ref_words_: DataFrame, least: int = 2) -> DataFrame:
    """Distinct right forms that the human texts hold at least twice: ``word, count``."""
    return rules.select(F.col("right").alias("word")).distinct().join(ref_words_.where(F.col("count") >= least), "word")


def top_vocabulary(vocab: DataFrame, k: int = 30) -> DataFrame:
    """The most frequent; of equal ones the first by text."""
    return vocab.orderBy(F.desc("count"), "word").limit(k)
