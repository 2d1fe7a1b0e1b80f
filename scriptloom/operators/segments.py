"""Segments: cleaning, predicates, languages, time slices, overlaps with ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classes as C
from ..functions import clock as K
from ..functions import text as X


def joined(order: list[str | Column], text: str = "text") -> Column:
    """Aggregate: texts in order, a blank between."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, F.col(text).alias("__t")))), lambda x: x["__t"]), " ")


def clean_segments(raw: DataFrame, recordings: DataFrame) -> DataFrame:
    """Recognizer rows to segments: text stripped, times moved by ``offset``, kept inside ``total`` and rounded.

    Rows that begin in the last half second (a closing phrase made up) and rows without text go.
    """
    return cleaned(raw.join(recordings.select("rec_id", "offset", "total"), "rec_id"))


def cleaned(at: DataFrame) -> DataFrame:
    """The rows of ``clean_segments``, of segments that have the columns ``offset`` and ``total`` already."""
    start, end = F.col("start") + F.col("offset"), F.least(F.col("end") + F.col("offset"), F.col("total"))
    at = at.withColumn("text", F.regexp_replace("text", f"^{C.WS}+|{C.WS}+$", ""))
    at = at.where((start < F.col("total") - 0.5) & (F.col("text") != ""))
    return at.withColumns({"start": F.round(start, 2), "end": F.round(end, 2), "language": F.coalesce("language", F.lit("ur"))}).drop("offset", "total")


def arabic_candidates(segments: DataFrame) -> DataFrame:
    """Segments of two seconds or more with Arabic letters or marks, or of low probability."""
    odd = X.has_arabic_only(F.col("text")) | (F.col("avg_logprob") < -0.6)
    return segments.where(odd & (K.lasting(F.col("start"), F.col("end")) >= K.limit(2.0)))


def resolve_language(segments: DataFrame, probes: DataFrame) -> DataFrame:
    """Take a probe's Arabic text where it is sure and not empty; everything else is ``ur`` with its own text."""
    both = segments.drop("language").join(probes.select("rec_id", "seg_idx", "detected", "probability", "arabic_text"), ["rec_id", "seg_idx"], "left")
    sure = F.coalesce((F.col("detected") == "ar") & (F.col("probability") >= 0.6) & (F.trim("arabic_text") != ""), F.lit(False))
    return both.withColumns({"text": F.when(sure, F.col("arabic_text")).otherwise(F.col("text")), "language": F.when(sure, "ar").otherwise("ur")}).drop("detected", "probability", "arabic_text")


def sparse_segments(segments: DataFrame, longer: float = 4.0, least: float = 1.3) -> DataFrame:
    """Long segments with fewer words a second than speech has."""
    long = K.lasting(F.col("start"), F.col("end"))
    return segments.where((long > K.limit(longer)) & (X.density(F.col("text"), long / 1000) < least))


def slice_text(df: DataFrame, start: float, end: float, order: str = "seg_idx") -> DataFrame:
    """``rec_id, text`` of what begins in [start, end), in order."""
    return df.where((F.col("start") >= start) & (F.col("start") < end)).groupBy("rec_id").agg(joined([order]).alias("text"))


def rebase(df: DataFrame, base: float | Column) -> DataFrame:
    """Times moved by ``base``."""
    base = F.lit(base) if isinstance(base, (int, float)) else base
    return df.withColumns({"start": F.col("start") + base, "end": F.col("end") + base})


def flag_overlaps(df: DataFrame, ranges: DataFrame, flag: str = "overlaps") -> DataFrame:
    """A boolean: some range of the same recording begins before the row ends and ends after it begins.

    The ranges of a recording are few, written by hand, and meet its rows in one equi-join.
    """
    lists = ranges.groupBy("rec_id").agg(F.collect_list(F.struct("start", "end")).alias("__ranges"))
    hit = F.exists("__ranges", lambda r: (F.col("start") < r["end"]) & (F.col("end") > r["start"]))
    return df.join(lists, "rec_id", "left").withColumn(flag, F.coalesce(hit, F.lit(False))).drop("__ranges")


def apply_exclude(segments: DataFrame, ranges: DataFrame) -> DataFrame:
    """Segments outside all excluded ranges; one to the end of the recording has an infinite end."""
    return flag_overlaps(segments, ranges, "__out").where(~F.col("__out")).drop("__out")


def cut_totals(recordings: DataFrame, ranges: DataFrame) -> DataFrame:
    """Recordings whose ``total`` ends where a range that is excluded to the end begins; others as they are."""
    ends = ranges.where(F.col("end") == float("inf")).groupBy("rec_id").agg(F.min(F.greatest("start", F.lit(0.0))).alias("__cut"))
    return recordings.join(ends, "rec_id", "left").withColumn("total", F.least("total", "__cut")).drop("__cut")


def filter_recovered(pieces: DataFrame, regions: DataFrame) -> DataFrame:
    """Pieces recognized once more, cut to their region: sure enough, not made up, words whose middle lies inside."""
    at = pieces.where("compression_ratio <= 2.4 and avg_logprob >= -1.0").where(~X.is_invented(F.col("text"))).join(regions.select("rec_id", "region_idx", F.col("start").alias("lo"), F.col("end").alias("hi"), "total"), ["rec_id", "region_idx"])
    middle = lambda w: F.col("clip_start") + (w["start"] + w["end"]) / 2
    kept = at.withColumn("kept", F.filter("words", lambda w: (middle(w) >= F.col("lo")) & (middle(w) <= F.col("hi")))).where(F.size("kept") > 0)
    text = F.trim(F.array_join(F.transform("kept", lambda w: w["word"]), ""))
    first, last = F.get("kept", F.lit(0)), F.element_at("kept", -1)
    out = kept.select(
        "rec_id",
        "region_idx",
        "piece_idx",
        F.round(F.col("clip_start") + first["start"], 2).alias("start"),
        F.round(F.least(F.col("clip_start") + last["end"], F.col("total")), 2).alias("end"),
        text.alias("text"),
    )
    return out.where((F.col("text") != "") & ~X.has_devanagari(F.col("text")) & ~X.is_invented(F.col("text"))).withColumn("language", F.lit("ur"))


def ordered(df: DataFrame, by: str = "seg_idx") -> DataFrame:
    """By recording, then time, then place: sorted inside partitions of whole recordings."""
    return df.repartition("rec_id").sortWithinPartitions("rec_id", "start", by)
