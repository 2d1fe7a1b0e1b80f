"""The library's operators put together: rebuild documents, learn and score, make clips, recover skipped speech."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clips as CL
from ..operators import learning as LE
from ..operators import paragraphs as PA
from ..operators import regions as RE
from ..operators import scoring as SC
from ..operators import sections as SE
from ..operators import segments as SG
from ..operators.segments import slice_text
from ..sources import writers as WR

Rules = Sequence[tuple[str, str]]


def rebuild_documents(recordings: DataFrame, segments: DataFrame, rules: Rules = ()) -> DataFrame:
    """``rec_id, text`` of the documents of all recordings."""
    return WR.render_document(recordings, PA.paragraphs(segments, rules))


def learn(lines: DataFrame, segments: DataFrame, ignore: DataFrame | None = None, limits: DataFrame | None = None, min_seconds: float = 60) -> tuple[DataFrame, DataFrame]:
    """Human transcripts (lines) and machine segments to rules and vocabulary."""
    sections = SE.merge_sections(SE.load_sections(lines), min_seconds)
    used = SE.section_pairs(sections, segments, limits)
    pairs = LE.align(used)
    rules = LE.select_rules(LE.alignment_counts(pairs), ignore=ignore)
    return rules, LE.vocabulary(rules, LE.ref_words(used))


def learn_summary(sections: DataFrame, used: DataFrame, rules: DataFrame) -> DataFrame:
    """``what, n``: how many sections there are, how many were used, how many rules were learned."""
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
    return one(sections, "sections").unionByName(one(used, "used")).unionByName(one(rules, "rules"))


def score(sections: DataFrame, segments: DataFrame, rules: Rules | None = None, raw: DataFrame | None = None, plain: DataFrame | None = None, start: float = 0.0, end: float = float("inf"), anchors: bool = False) -> DataFrame:
    """Scores of the machine's text of each recording against its human text, as far as it begins in [start, end).

    raw: ``rec_id, text`` of whole human transcripts; a recording without sections is held against all of it, and one
    whose sections all begin outside the cut against nothing. plain: further candidates ``rec_id, candidate, text``, not
    from segments, which are neither cut nor corrected. Segments may have an ``offset`` column (else 0). anchors: whether long texts
    are cut where they agree (``scoring.anchored``).
    """
    human = sections.select("rec_id").distinct().join(slice_text(sections, start, end, "sec_idx"), "rec_id", "left").withColumn("text", F.coalesce("text", F.lit("")))
    if raw is not None:
        human = human.unionByName(raw.select("rec_id", "text").join(sections.select("rec_id").distinct(), "rec_id", "left_anti"))
    moved = segments.withColumn("start", F.col("start") + F.col("offset")) if "offset" in segments.columns else segments
    machine = segments.select("rec_id").distinct().join(slice_text(moved, start, end), "rec_id", "left")
    machine = machine.select("rec_id", F.lit("segments").alias("candidate"), F.coalesce("text", F.lit("")).alias("text"), F.lit(True).alias("from_segments"))
    if plain is not None:
        machine = machine.unionByName(plain.select("rec_id", "candidate", "text", F.lit(False).alias("from_segments")))
    return SC.score_pairs(human, machine, rules, anchors)


def make_clips(segments: DataFrame, recordings: DataFrame, exclude: DataFrame, rules: Rules = (), quiet: DataFrame | None = None, energies: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Clips with what to check, what was left out, and a summary of each recording.

    quiet, energies: the quiet stretches and the frames of the recordings' sound (``operators.frames``), where there is
    any; the edges of words then move to the quiet beside them.
    """
    clips, left_out = CL.build_clips(segments, SG.cut_totals(recordings, exclude), exclude, rules, quiet, energies)
    reviewed = CL.review_reasons(clips)
    return reviewed, left_out, CL.clip_summary(reviewed, left_out)


def export_clips(items: DataFrame, pcm: DataFrame, names: DataFrame, existing: DataFrame, overwrite: bool = False, rate: int = WR.RATE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Proofread clips to training data: metadata with the new lines, ``file_name, wav``, and what was skipped with its reason.

    items: ``rec_id, item_idx, start, end, text``, as read from subtitle or clip files. names: ``rec_id, name``, of the
    files to be. Skipped are clips without text, of an unfit length, or past the end of the sound; the others are
    numbered without gaps.
    """
    fit, unfit = CL.split_eligible(items.withColumnRenamed("item_idx", "clip_idx"))
    waves = WR.cut_clips(pcm, fit, rate)
    sounding = fit.join(waves, ["rec_id", "clip_idx"], "left")
    kept = sounding.where("wav is not null").join(names, "rec_id")
    late = sounding.where("wav is null").withColumn("reason", F.lit("the sound ends before"))
    columns = ["rec_id", "clip_idx", "start", "end", "text", "reason"]
    files = WR.metadata_rows(kept, "wav").select("file_name", "wav")
    return WR.merge_metadata(existing, kept, overwrite), files, unfit.select(*columns).unionByName(late.select(*columns))


def recovery_regions(segments: DataFrame, voice: DataFrame, recordings: DataFrame) -> DataFrame:
    """The stretches of speech to recognize once more."""
    return RE.widen_regions(RE.missed_regions(segments, voice, recordings), segments, recordings)


def recover(segments: DataFrame, regions: DataFrame, pieces: DataFrame, recordings: DataFrame) -> DataFrame:
    """Segments with the speech that was recognized once more in ``regions`` (of ``recovery_regions``) put in its place."""
    found = SG.filter_recovered(pieces, regions.join(recordings.select("rec_id", "total"), "rec_id"))
    return RE.merge_recovered(segments, regions, found)
