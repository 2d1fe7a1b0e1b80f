"""Tables to files and to the texts that files hold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import clock as K
from ..functions import helpers as H
from ..functions import text as X

# fixed values: the words of a document's first line, which readers of it look for
MODEL_FAMILY, NOTICE = "Whisper ", "machine transcript, please verify"
# end of fixed values

RATE = 16_000
#: Samples in a row of PCM, at least those of one clip and its start within a row.
CHUNK = 30 * RATE


def write_segments(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Replace what is at ``path`` when all of it has been written."""
    df.write.mode("overwrite").format(form).save(path)


def write_bucketed(df: DataFrame, name: str, buckets: int, path: str | None = None, order: tuple[str, ...] = ("start", "seg_idx")) -> None:
    """Replace the table ``name`` (external if ``path`` is given): a file for each bucket of recordings, sorted inside.

    What reads it recording by recording (paragraphs, units of clips) needs no exchange then, and a million recordings are ``buckets`` files.
    """
    writer = df.repartition(buckets, "rec_id").write.mode("overwrite").format("parquet").bucketBy(buckets, "rec_id").sortBy("rec_id", *order)
    (writer.option("path", path) if path else writer).saveAsTable(name)


def _together(df: DataFrame, line: Column, order: list[str], by: str = "rec_id", between: str = "\n") -> DataFrame:
    item = F.struct(*order, line.alias("__line"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["__line"]), between)
    return df.groupBy(by).agg(text.alias("text"))


def render_srt(clips: DataFrame) -> DataFrame:
    """``rec_id, text`` of subtitle files; clips are numbered from 1."""
    block = F.concat((F.col("clip_idx") + 1).cast("string"), F.lit("\n"), K.srt_clock(F.col("start")), F.lit(" --> "), K.srt_clock(F.col("end")), F.lit("\n"), F.col("text"), F.lit("\n"))
    return _together(clips, block, ["clip_idx"])


def render_clip_tsv(clips: DataFrame) -> DataFrame:
    """``rec_id, clip_idx, line``."""
    return clips.select("rec_id", "clip_idx", F.concat_ws("\t", K.clock(F.col("start")), K.clock(F.col("end")), "text").alias("line"))


def render_review(clips: DataFrame, left_out: DataFrame, summary: DataFrame, recordings: DataFrame | None = None) -> DataFrame:
    """``rec_id, text`` of review lists: counts, the clips to check, what was left out.

    recordings: ``rec_id, source``, for a title line with the file's name.
    """
    spaced = F.format_string("#%-5d %s - %s  %s\n        %s", F.col("clip_idx") + 1, K.clock(F.col("start")), K.clock(F.col("end")), F.array_join("review", "; "), F.col("text"))
    span = F.concat(K.clock(F.col("start")), F.lit(" - "), K.clock(F.col("end")), F.lit("  "), F.col("reason"), F.when(F.col("text") != "", F.concat(F.lit(": "), F.col("text"))).otherwise(""))
    none = F.lit(0.0)
    head = F.format_string("%d clips, %.1f minutes of speech; %d to check, %d left out.", "clips", "minutes", "flagged", "left_out")
    title = lambda part, line: summary.select("rec_id", F.lit(part).alias("part"), none.alias("o"), F.lit(line).alias("line"))
    rows = summary.select("rec_id", F.lit(0).alias("part"), none.alias("o"), head.alias("line"))
    if recordings is not None:
        name = F.concat(F.lit("Review of "), F.element_at(F.split("source", "/"), -1), F.lit("; all times count from the start of that file"))
        rows = rows.unionByName(recordings.join(summary.select("rec_id"), "rec_id").select("rec_id", F.lit(-1).alias("part"), none.alias("o"), name.alias("line")))
    rows = rows.unionByName(title(1, "\nTo check, by the numbers of the subtitles:")).unionByName(title(3, "\nNot in the subtitles:"))
    rows = rows.unionByName(clips.where(F.size("review") > 0).select("rec_id", F.lit(2).alias("part"), F.col("clip_idx").cast("double").alias("o"), spaced.alias("line")))
    rows = rows.unionByName(left_out.select("rec_id", F.lit(4).alias("part"), F.col("start").alias("o"), span.alias("line")))
    return _together(rows, F.col("line"), ["part", "o"])


def render_document(recordings: DataFrame, paragraphs: DataFrame, timestamps: bool = True) -> DataFrame:
    """``rec_id, text``: a line of file, length, model and date, then the paragraphs."""
    line = F.concat(F.lit("("), K.stamp(F.col("start")), F.lit(") "), F.col("text")) if timestamps else F.col("text")
    body = _together(paragraphs, line, ["par_idx"]).withColumnRenamed("text", "body")
    name = F.element_at(F.split("source", "/"), -1)
    head = F.concat_ws(" | ", name, K.stamp(F.col("duration_seconds")), F.concat(F.lit(MODEL_FAMILY), F.col("model")), F.substring("created", 1, 10), F.lit(NOTICE))
    return recordings.join(body, "rec_id", "left").select("rec_id", F.concat_ws("\n", head, "body").alias("text"))


def render_rules(rules: DataFrame) -> DataFrame:
    """``line`` of each rule, with how often and how surely it was seen, most frequent first."""
    note = F.format_string("# %dx, %s%%", "count", F.format_number(F.bround(F.col("share") * 100, 0), 0))
    return rules.orderBy(*(F.desc(c) for c in ("count", "share", "wrong", "right"))).select(F.concat_ws("\t", "wrong", "right", note).alias("line"))


def render_vocabulary(vocab: DataFrame) -> DataFrame:
    """``line`` of each word, most frequent first."""
    return vocab.orderBy(F.desc("count"), "word").select(F.col("word").alias("line"))


def metadata_rows(clips: DataFrame, *more: str) -> DataFrame:
    """``name, clip_idx, text`` of eligible clips to ``name, file_name, text`` and ``more``, numbered over those kept."""
    number = F.row_number().over(W.partitionBy("name").orderBy("clip_idx"))
    return clips.select("name", X.clip_file(F.col("name"), number).alias("file_name"), "text", *more)


def merge_metadata(existing: DataFrame, clips: DataFrame, overwrite: bool = False) -> DataFrame:
    """``file_name, text`` with the clips added; a name that is there already is an error, or replaced with ``overwrite``."""
    new = metadata_rows(clips)
    named = existing.withColumn("name", F.regexp_extract("file_name", r"^(.*)_\d{4,}\.wav$", 1))
    names = new.select("name").distinct()
    if not overwrite and not named.join(names, "name", "left_semi").isEmpty():
        raise ValueError("clips of a name are in the metadata already; overwrite to replace them")
    return named.join(names, "name", "left_anti").select("file_name", "text").unionByName(new.select("file_name", "text"))


def metadata_line(metadata: DataFrame) -> DataFrame:
    return metadata.select(F.concat_ws("|", "file_name", "text").alias("value"))


def cut_clips(pcm: DataFrame, clips: DataFrame, rate: int = RATE) -> DataFrame:
    """``rec_id, chunk_idx, samples array<smallint>`` (rows of CHUNK samples) and clips to ``rec_id, clip_idx, wav binary``.

    A clip meets just the rows of samples that it touches. One that lacks more than a tenth of its samples goes.
    """
    first, last = (F.col("start") * rate).cast("long"), (F.col("end") * rate).cast("long")
    asks = clips.select("rec_id", "clip_idx", first.alias("first"), last.alias("last")).where("last > first").withColumn("chunk_idx", F.explode(F.sequence(F.floor(F.col("first") / CHUNK), F.floor((F.col("last") - 1) / CHUNK))))
    base = F.col("chunk_idx") * CHUNK
    lo, hi = F.greatest(F.col("first") - base, F.lit(0)), F.least(F.col("last") - base, F.size("samples").cast("long"))
    parts = asks.join(pcm, ["rec_id", "chunk_idx"]).where(hi > lo).select("rec_id", "clip_idx", "first", "last", "chunk_idx", F.slice("samples", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("part"))
    whole = parts.groupBy("rec_id", "clip_idx", "first", "last").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("chunk_idx", "part"))), lambda x: x["part"])).alias("samples"))
    enough = whole.where(F.size("samples") >= 0.9 * (F.col("last") - F.col("first")))

    @F.pandas_udf("binary")
    def wav(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for samples in batches:
            yield samples.map(lambda s: H.wav_bytes(np.asarray(s, np.int16), rate))

    return enough.select("rec_id", "clip_idx", wav("samples").alias("wav"))


def cut_parts(pcm: DataFrame, clips: DataFrame, rate: int = RATE, chunk: int = CHUNK) -> DataFrame:
    """``rec_id, clip_idx, part_idx, data binary``: WAV files of clips of any length, in parts that follow one another.

    The first part begins with the header, and a part holds the samples of one row of ``pcm`` at most (``chunk`` samples), so no row grows
    with the clip. A clip that lacks more than a tenth of its samples, or any between two that are there, goes.
    """
    first, last = F.floor(K.millis(F.col("start")) * rate / 1000), F.floor(K.millis(F.col("end")) * rate / 1000)
    asks = clips.select("rec_id", "clip_idx", first.alias("first"), last.alias("last")).where("last > first")
    each = asks.withColumn("chunk_idx", F.explode(F.sequence(F.floor(F.col("first") / chunk), F.floor((F.col("last") - 1) / chunk))))
    base = F.col("chunk_idx") * chunk
    lo, hi = F.greatest(F.col("first") - base, F.lit(0)), F.least(F.col("last") - base, F.size("samples").cast("long"))
    parts = each.join(pcm, ["rec_id", "chunk_idx"]).where(hi > lo).withColumn("samples", F.slice("samples", (lo + 1).cast("int"), (hi - lo).cast("int")))
    sizes = parts.groupBy("rec_id", "clip_idx").agg(F.sum(F.size("samples")).alias("total"), F.min("chunk_idx").alias("from"), F.max(F.struct("chunk_idx", F.size("samples").alias("n"))).alias("z"), F.count("*").alias("rows"), F.min("first").alias("a"))
    # without a gap: what is there reaches from the start to the last sample that is there
    reach = F.col("z.chunk_idx") * chunk + F.when(F.col("rows") > 1, F.col("z.n")).otherwise(F.col("z.n") + F.greatest(F.col("a") - F.col("z.chunk_idx") * chunk, F.lit(0))) - F.col("a")
    whole = sizes.where(F.col("total") == reach).select("rec_id", "clip_idx", "total", "from")
    kept = parts.join(whole, ["rec_id", "clip_idx"]).where(F.col("total") >= 0.9 * (F.col("last") - F.col("first")))

    @F.pandas_udf("binary")
    def encoded(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for samples, total in batches:
            yield pd.Series([(b"" if pd.isna(n) else H.wav_header(int(n), rate)) + np.asarray(s, "<i2").tobytes() for s, n in zip(samples, total, strict=True)])

    head = F.when(F.col("chunk_idx") == F.col("from"), F.col("total").cast("double"))
    return kept.select("rec_id", "clip_idx", (F.col("chunk_idx") - F.col("from")).cast("int").alias("part_idx"), encoded("samples", head).alias("data"))
