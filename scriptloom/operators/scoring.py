"""Word and character errors of candidates against human references."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import helpers as H
from ..functions import text as X


def char_error(ref: Column, hyp: Column) -> Column:
    """Edits of characters, blanks included, over the reference's length; null for an empty reference."""
    return F.when(F.length(ref) > 0, H.letter_edits(ref, hyp) / F.length(ref))


def word_error(texts: DataFrame) -> DataFrame:
    """``ref, hyp`` (normalized) to the counts of one cheapest alignment, and ``wer``, ``miss``, ``ref_words, hyp_words``."""
    counted = texts.withColumn("__ops", H.edit_ops("ref", "hyp"))
    o = F.col("__ops")
    wrong, words = o["substitutions"] + o["deletions"], o["ref_words"]
    return counted.select(
        *texts.columns,
        *(o[c].alias(c) for c in ("hits", "substitutions", "deletions", "insertions")),
        F.when(words > 0, (wrong + o["insertions"]) / words).alias("wer"),
        (wrong / F.greatest(words, F.lit(1))).alias("miss"),
        words.alias("ref_words"),
        o["hyp_words"].alias("hyp_words"),
    )


def corpus_error(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Errors of many texts taken together: the sums of edits over the sums of words."""
    edits = F.sum(F.col("substitutions") + F.col("deletions") + F.col("insertions"))
    return scored.groupBy(*by).agg(F.sum("ref_words").alias("ref_words"), F.sum("hyp_words").alias("hyp_words"), (edits / F.sum("ref_words")).alias("wer"), (F.sum(F.col("substitutions") + F.col("deletions")) / F.greatest(F.sum("ref_words"), F.lit(1))).alias("miss"))


def anchored(texts: DataFrame) -> DataFrame:
    """``ref, hyp`` (normalized) and other columns to the same with ``piece``: both texts cut where they agree, in rows of their own.

    Cuts are found in time in proportion to the words; a piece has some 2^13 to 2^17 pairs of words, and more only where no
    word or run of four words stands once on both sides. Pieces are dealt over tasks. An alignment through all cuts is as cheap as the cheapest unless that one
    passes by a cut; it is never cheaper.
    """
    others = [c for c in texts.columns if c not in ("ref", "hyp")]
    return texts.select(*others, F.inline(H.anchored_pieces("ref", "hyp"))).repartition(*others, "piece")


def anchored_error(texts: DataFrame) -> DataFrame:
    """``word_error`` and ``cer`` of long texts: sums over anchored pieces, each aligned exactly. Other columns are the key."""
    by = [c for c in texts.columns if c not in ("ref", "hyp")]
    counts = ("hits", "substitutions", "deletions", "insertions", "ref_words", "hyp_words")
    pieces = word_error(anchored(texts)).withColumn("edits", H.letter_edits("ref", "hyp"))
    one = pieces.groupBy(*by).agg(*(F.sum(c).alias(c) for c in counts), F.sum("edits").alias("edits"), F.sum(F.length("ref")).alias("letters"))
    wrong = F.col("substitutions") + F.col("deletions")
    rate = lambda n, of: F.when(F.col(of) > 0, n / F.col(of))
    return one.select(*by, *counts[:4], rate(wrong + F.col("insertions"), "ref_words").alias("wer"), (wrong / F.greatest(F.col("ref_words"), F.lit(1))).alias("miss"), *counts[4:], rate(F.col("edits"), "letters").alias("cer"))


def score_pairs(references: DataFrame, candidates: DataFrame, rules: Sequence[tuple[str, str]] | None = None, anchors: bool = False) -> DataFrame:
    """``rec_id, text`` and ``rec_id, candidate, text, from_segments`` to scores of each candidate, raw and corrected.

    The corrected variant comes only with rules, and changes only what was put together from segments. With ``anchors``
    texts are compared by ``anchored_error``: long recordings in many tasks, in time that grows with their length.
    """
    variants = candidates.withColumn("variant", F.lit("raw"))
    if rules is not None:
        fixed = F.when(F.col("from_segments"), X.apply_corrections(F.col("text"), rules)).otherwise(F.col("text"))
        variants = variants.unionByName(candidates.withColumn("text", fixed).withColumn("variant", F.lit("corrected")))
    both = references.select("rec_id", X.normalize(F.col("text")).alias("ref")).join(variants.select("rec_id", "candidate", "variant", X.normalize(F.col("text")).alias("hyp")), "rec_id")
    if anchors:
        return anchored_error(both)
    return word_error(both).withColumn("cer", char_error(F.col("ref"), F.col("hyp"))).drop("ref", "hyp")
