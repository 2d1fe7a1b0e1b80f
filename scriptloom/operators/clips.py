"""Short clips of speech from word timings: units, edges, runs, cuts, clips, review."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import clock as K
from ..functions import folds
from ..functions import helpers as H
from ..functions import text as X
from .segments import flag_overlaps

#: Seconds. A pause that always cuts; what is kept of a pause; what is dropped at most beside a left-out passage; a clear pause.
LONG_PAUSE, EDGE, TRIM, CLEAR = 1.0, 0.05, 1.5, 0.15
MIN_EXPORT, MAX_EXPORT = 1.0, 20.0
#: Frames a second, and frames that a quiet stretch has at least.
FRAMES, MIN_QUIET = 100, 8
#: Units of a segment that are one row until their overlaps are resolved.
BLOCK = 16


#: Why something was left out.
LEFT_ARABIC, LEFT_INVENTED, LEFT_EXCLUDED, LEFT_TRIMMED = "an Arabic passage", "made up by the recognizer", "in an excluded range", "runs into what was left out"


def _along() -> WindowSpec:
    return W.partitionBy("rec_id").orderBy("unit_idx")


def make_units(segments: DataFrame) -> DataFrame:
    """Segments to ``rec_id, unit_idx, start, end, text, kind, prob, logprob``: words, or whole segments without usable words.

    Units go in blocks of up to BLOCK of a segment, a row each; blocks that touch are put together, and only where units touch are
    overlaps resolved. So no word is sorted or numbered by itself. One exchange by recording, and none if the segments are bucketed by it.
    """
    kind = F.when(F.col("language") == "ar", "arabic").when(X.is_invented(F.col("text")), "invented").when(F.coalesce(F.size("words"), F.lit(0)) <= 0, "recovered").otherwise("word")
    of = segments.select("rec_id", "seg_idx", "start", "end", "text", "words", F.col("avg_logprob").alias("logprob"), kind.alias("kind"))
    fields = ["start", "end", "text", "kind", "prob", "logprob"]

    # what all units of a segment share joins them behind the explosion into blocks, where it is a value: inside a
    # function of each word Spark would work it out again from all words
    item = lambda n, start, end, text, prob: F.struct(start.cast("double").alias("start"), n.alias("n"), end.alias("end"), text.alias("text"), prob.alias("prob"))
    whole = F.array(item(F.lit(0), F.col("start"), F.col("end"), F.col("text"), F.lit(None).cast("double")))
    timed = F.transform("words", lambda w, i: item(i, w["start"], F.greatest(w["end"], w["start"] + folds.LEAST), w["word"], w["prob"]))
    words = F.filter(timed, lambda x: F.trim(x["text"]) != "")
    rows = of.select("rec_id", "seg_idx", "kind", "logprob", F.when(F.col("kind") == "word", words).otherwise(whole).alias("s")).where("size(s) > 0")
    starts = F.sequence(F.lit(1), F.size("s"), F.lit(BLOCK))
    blocks = rows.select("rec_id", "seg_idx", "kind", "logprob", F.posexplode(F.transform(starts, lambda i: F.slice("s", i, F.lit(BLOCK)))).alias("block", "s"))
    unit = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"), F.col("kind").alias("kind"), x["prob"].alias("prob"), F.col("logprob").alias("logprob")).cast(folds.UNIT)
    full = blocks.select("rec_id", "seg_idx", "block", F.transform("s", lambda x: F.struct(x["start"].alias("start"), "seg_idx", x["n"].alias("n"), unit(x).alias("u"))).alias("s"))
    spans = full.withColumns({"lo": F.array_min(F.transform("s", lambda x: x["start"])), "hi": F.array_max(F.transform("s", lambda x: x["u"]["end"]))})
    along = W.partitionBy("rec_id").orderBy("lo", "seg_idx", "block")
    reach = F.max("hi").over(along.rowsBetween(W.unboundedPreceding, -1))
    apart = F.coalesce(F.col("lo") >= reach + folds.LEAST, F.lit(True))
    lists = spans.withColumn("stretch", F.sum(apart.cast("int")).over(along)).groupBy("rec_id", "stretch").agg(F.sort_array(F.flatten(F.collect_list("s"))).alias("s"))
    meets = lambda i: ~F.coalesce(F.get("s", i)["start"] >= F.get("s", i - 1)["u"]["end"] + folds.LEAST, F.lit(False))
    touching = (F.size("s") > 1) & F.exists(F.sequence(F.lit(1), F.greatest(F.size("s") - 1, F.lit(1))), meets)
    units = F.transform("s", lambda x: x["u"])
    solved = lists.select("rec_id", "stretch", F.when(touching, folds.without_overlaps(units)).otherwise(units).alias("s"))
    before = F.sum(F.size("s")).over(W.partitionBy("rec_id").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1))
    numbered = solved.select("rec_id", F.coalesce(before, F.lit(0)).alias("before"), "s").select("rec_id", "before", F.posexplode("s").alias("at", "u"))
    return numbered.select("rec_id", (F.col("before") + F.col("at")).cast("int").alias("unit_idx"), *(f"u.{f}" for f in fields))


def _in_quiet(edges: DataFrame, quiet: DataFrame) -> DataFrame:
    """``rec_id, unit_idx, side, lo, hi`` to the start of the first, and the end of the last, quiet stretch inside.

    A range join: stretches and edges meet in the seconds that they touch.
    """
    at = edges.select("*", F.explode(F.sequence(F.floor("lo"), F.floor(F.greatest("lo", "hi")))).alias("second"))
    runs = quiet.select("rec_id", F.col("start").alias("qs"), F.col("end").alias("qe"), F.explode(F.sequence(F.floor("start"), F.floor("end"))).alias("second"))
    first = F.greatest(F.round(F.col("qs") * FRAMES).cast("long"), F.greatest(F.lit(0), (F.col("lo") * FRAMES).cast("long")))
    last = F.least(F.round(F.col("qe") * FRAMES).cast("long"), (F.col("hi") * FRAMES).cast("long"))
    met = at.join(runs, ["rec_id", "second"]).where(last - first >= MIN_QUIET)
    return met.groupBy("rec_id", "unit_idx", "side").agg((F.min(first) / FRAMES).alias("first"), (F.max(last) / FRAMES).alias("last"))


def word_edges(units: DataFrame, recordings: DataFrame | None = None, quiet: DataFrame | None = None, energies: DataFrame | None = None) -> DataFrame:
    """Units with ``left``, ``right`` (where speech begins and ends) and ``pause`` to the next; the last has a long pause.

    Without audio these are the word times. With ``quiet`` stretches, edges move to the quiet beside the word. Where no
    pause is left, both words meet at the quietest frame, or half-way without ``energies``.
    """
    next_start, next_end = F.lead("start").over(_along()), F.lead("end").over(_along())
    a_mid = F.greatest((F.col("start") + F.col("end")) / 2, F.col("end") - 0.3)
    b_mid = F.least((next_start + next_end) / 2, next_start + 0.3)
    base = units.withColumns({"next_start": next_start, "a_mid": a_mid, "b_mid": b_mid, "first_one": F.lag("start").over(_along()).isNull()})
    if quiet is None:
        edged = base.withColumns({"right": F.col("end"), "left": F.col("start")})
    else:
        total = base.join(recordings.select("rec_id", "total"), "rec_id")
        half = F.least(F.lit(0.3), (F.col("end") - F.col("start")) / 2)
        mine = W.partitionBy("rec_id").orderBy("unit_idx")
        right_lo = F.when(F.col("next_start").isNotNull(), F.col("a_mid")).otherwise(F.col("end") - half)
        right_hi = F.when(F.col("next_start").isNotNull(), F.least("b_mid", F.col("end") + LONG_PAUSE)).otherwise(F.least("total", F.col("end") + LONG_PAUSE))
        left_lo = F.when(F.col("first_one"), F.greatest(F.lit(0.0), F.col("start") - LONG_PAUSE)).otherwise(F.greatest(F.lag("a_mid").over(mine), F.col("start") - LONG_PAUSE))
        left_hi = F.when(F.col("first_one"), F.col("start") + half).otherwise(F.lag("b_mid").over(mine))
        sides = F.array(F.struct(F.lit("right").alias("side"), right_lo.alias("lo"), right_hi.alias("hi")), F.struct(F.lit("left").alias("side"), left_lo.alias("lo"), left_hi.alias("hi")))
        edges = total.withColumn("s", sides).select("rec_id", "unit_idx", F.inline("s"))
        found = _in_quiet(edges, quiet)
        value = F.when(F.col("side") == "right", F.col("first")).otherwise(F.col("last"))
        pivoted = found.groupBy("rec_id", "unit_idx").agg(F.max(F.when(F.col("side") == "right", value)).alias("r"), F.max(F.when(F.col("side") == "left", value)).alias("l"))
        edged = base.join(pivoted, ["rec_id", "unit_idx"], "left").withColumns({"right": F.coalesce("r", "end"), "left": F.coalesce("l", "start")}).drop("r", "l")
    edged = edged.withColumn("next_left", F.lead("left").over(_along()))
    meets = F.coalesce(F.col("next_left") <= F.col("right"), F.lit(False))
    middle = (F.col("end") + F.col("next_start")) / 2
    if energies is not None:
        lo = (F.col("a_mid") * FRAMES).cast("long")
        asks = edged.where(meets).select("rec_id", "unit_idx", lo.alias("lo"), F.greatest(lo + 1, (F.col("b_mid") * FRAMES).cast("long")).alias("hi"))
        asks = asks.withColumn("second", F.explode(F.sequence(F.floor(F.col("lo") / FRAMES), F.floor((F.col("hi") - 1) / FRAMES))))
        sound = energies.select("rec_id", "frame_idx", F.when(F.col("muted"), 0.0).otherwise(F.col("db")).alias("db"), F.floor(F.col("frame_idx") / FRAMES).alias("second"))
        ends = energies.groupBy("rec_id").agg((F.max("frame_idx") + 1).alias("frames"))
        low = asks.join(sound, ["rec_id", "second"]).where("frame_idx >= lo and frame_idx < hi").groupBy("rec_id", "unit_idx").agg(F.min(F.struct("db", "frame_idx"))["frame_idx"].alias("q"), F.max("hi").alias("hi"))
        low = low.join(ends, "rec_id").where("hi <= frames").select("rec_id", "unit_idx", (F.col("q") / FRAMES).alias("q"))
        edged = edged.join(low, ["rec_id", "unit_idx"], "left")
        middle = F.coalesce("q", middle)
    meet = edged.withColumn("meet", F.when(meets, middle))
    left = F.coalesce(F.lag("meet").over(_along()), F.col("left"))
    out = meet.withColumns({"right": F.coalesce("meet", "right"), "left": left})
    gap = K.lasting(F.col("right"), F.lead("left").over(_along())) / 1000
    out = out.withColumn("pause", F.when(gap.isNotNull(), F.greatest(F.lit(0.0), gap)).otherwise(LONG_PAUSE))
    return out.select(*units.columns, "left", "right", "pause")


def speech_runs(edged: DataFrame, exclude: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Units in runs, ``run_id, open_start, open_end, before`` added; and the units left out, with a reason.

    A run breaks at a unit that is left out, at a long pause, and over an excluded range. ``before`` is the pause that
    precedes a unit.
    """
    lists = exclude.groupBy("rec_id").agg(F.collect_list(F.struct("start", "end")).alias("__r"))
    inside = lambda a, b: F.coalesce(F.exists("__r", lambda r: (a < r["end"]) & (b > r["start"])), F.lit(False))
    at = edged.join(lists, "rec_id", "left").withColumn("shut", inside(F.col("start"), F.col("end")))
    at = at.withColumn("barrier", F.col("kind").isin("arabic", "invented") | F.col("shut"))
    gap = F.coalesce(inside(F.col("end"), F.lead("start").over(_along())), F.lit(False)) & F.lead("start").over(_along()).isNotNull()
    at = at.withColumn("gap", gap & ~F.col("barrier"))
    ends = F.col("barrier") | (F.col("pause") >= LONG_PAUSE) | F.col("gap")
    at = at.withColumns(
        {
            "begins": ~F.col("barrier") & F.coalesce(F.lag(ends).over(_along()), F.lit(True)),
            "from_open": F.coalesce(F.lag(F.col("barrier") | F.col("gap")).over(_along()), F.lit(False)),
            "to_open": F.col("gap") | (F.coalesce(F.lead("barrier").over(_along()), F.lit(False)) & (F.col("pause") < LONG_PAUSE)),
            "before": F.coalesce(F.lag("pause").over(_along()), F.lit(LONG_PAUSE)),
            "has_before": F.lag("pause").over(_along()).isNotNull(),
        }
    )
    at = at.withColumn("run_id", F.sum(F.col("begins").cast("int")).over(_along()))
    run = W.partitionBy("rec_id", "run_id").orderBy("unit_idx")
    runs = at.where(~F.col("barrier")).withColumns({"open_start": F.first("from_open").over(run), "open_end": F.last("to_open").over(run.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))})
    reason = F.when(F.col("kind") == "arabic", LEFT_ARABIC).when(F.col("kind") == "invented", LEFT_INVENTED).otherwise(LEFT_EXCLUDED)
    out = at.where("barrier").select("rec_id", "start", "end", reason.alias("reason"), F.trim("text").alias("text"))
    return runs.select(*edged.columns, "run_id", "open_start", "open_end", "before", "has_before"), out


def trim_runs(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs without the words beside a left-out passage that no clear pause parts from it; and those words, joined."""
    whole = W.partitionBy("rec_id", "run_id")
    clear = F.col("pause") >= CLEAR
    head = F.min(F.when(clear, F.col("unit_idx"))).over(whole)
    at = runs.withColumns({"first_idx": F.min("unit_idx").over(whole), "head": head})
    at = at.withColumns({"run_start": F.min_by("start", "unit_idx").over(whole), "head_end": F.max(F.when(F.col("unit_idx") == F.col("head"), F.col("end"))).over(whole), "run_before": F.max(F.when(F.col("unit_idx") == F.col("first_idx"), F.col("before"))).over(whole)})
    front = F.col("open_start") & (F.col("run_before") < CLEAR) & F.coalesce((K.lasting(F.col("run_start"), F.col("head_end")) <= K.limit(TRIM)) & (F.col("unit_idx") <= F.col("head")), F.lit(False))
    at = at.withColumn("front", front)
    left = F.when(~F.col("front"), F.col("unit_idx"))
    last = F.max(left).over(whole)
    at = at.withColumn("last_idx", last)
    at = at.withColumns({"last_pause": F.max(F.when(F.col("unit_idx") == F.col("last_idx"), F.col("pause"))).over(whole), "last_end": F.max(F.when(F.col("unit_idx") == F.col("last_idx"), F.col("end"))).over(whole), "tail": F.max(F.when(clear & ~F.col("front") & (F.col("unit_idx") < F.col("last_idx")), F.col("unit_idx"))).over(whole)})
    at = at.withColumn("tail_start", F.min(F.when(F.col("unit_idx") > F.col("tail"), F.col("start"))).over(whole))
    back = F.col("open_end") & (F.col("last_pause") < CLEAR) & F.coalesce((K.lasting(F.col("tail_start"), F.col("last_end")) <= K.limit(TRIM)) & (F.col("unit_idx") > F.col("tail")), F.lit(False)) & ~F.col("front")
    at = at.withColumn("back", back)
    dropped = at.where("front or back").groupBy("rec_id", "run_id", "front").agg(F.min_by("start", "unit_idx").alias("start"), F.max_by("end", "unit_idx").alias("end"), F.sort_array(F.collect_list(F.struct("unit_idx", F.trim("text").alias("t")))).alias("w"))
    out = dropped.select("rec_id", "start", "end", F.lit(LEFT_TRIMMED).alias("reason"), F.array_join(F.transform("w", lambda x: x["t"]), " ").alias("text"))
    return at.where("not front and not back").select(*runs.columns), out


def cut_runs(runs: DataFrame) -> DataFrame:
    """Units with ``cut``, the number of their clip within the run: the cheapest cuts by lengths and pauses.

    A run's units come in one row, are cut, and go on as rows: one shuffle. Rows are sent to Python in short batches.
    """
    runs = H.short_batches(runs)
    others = [c for c in runs.columns if c not in ("rec_id", "run_id", "unit_idx")]
    lists = runs.groupBy("rec_id", "run_id").agg(F.sort_array(F.collect_list(F.struct("unit_idx", F.struct(*others).alias("u")))).alias("s"))
    pick = lambda f: F.transform("s", lambda x: x["u"][f])
    stop = F.transform("s", lambda x: X.ends_sentence(F.trim(x["u"]["text"])))
    numbered = lists.withColumn("cuts", H.best_cuts(pick("left"), pick("right"), pick("pause"), stop))
    rows = numbered.select("rec_id", "run_id", F.explode(F.arrays_zip("s", "cuts")).alias("x"))
    return rows.select("rec_id", "run_id", "x.s.unit_idx", "x.s.u.*", F.col("x.cuts").alias("cut")).select(*runs.columns, "cut")


def _stats(order: str) -> list[Column]:
    return [
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, F.trim("text").alias("t")))), lambda x: x["t"]), " ").alias("text"),
        F.round(F.avg("prob"), 3).alias("prob"),
        F.min("logprob").alias("logprob"),
        F.bool_or(F.col("kind") == "recovered").alias("recovered"),
    ]


def clip_stats(words: DataFrame, by: Sequence[str] = ("rec_id", "clip_idx"), order: str = "unit_idx") -> DataFrame:
    """Of each clip: words joined, mean probability, least log-probability, whether any was recovered."""
    return words.groupBy(*by).agg(*_stats(order))


def split_eligible(clips: DataFrame, min_s: float = MIN_EXPORT, max_s: float = MAX_EXPORT) -> tuple[DataFrame, DataFrame]:
    """Clips with text and of a fit length, and the others with a reason."""
    d = K.lasting(F.col("start"), F.col("end"))
    length = F.concat(F.format_number(d / 1000, 1), F.lit(f"s is outside {min_s:g}-{max_s:g} s"))
    judged = clips.withColumn("reason", F.when(F.col("text") == "", "no text").when(~d.between(K.limit(min_s), K.limit(max_s)), length))
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def build_clips(segments: DataFrame, recordings: DataFrame, exclude: DataFrame, rules: Sequence[tuple[str, str]] = (), quiet: DataFrame | None = None, energies: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Segments with word timings to clips, numbered by time, and all that was left out with its reason.

    Clips: ``rec_id, clip_idx, start, end, text, prob, logprob, recovered, tight``.
    """
    edged = word_edges(make_units(segments), recordings, quiet, energies)
    runs, shut = speech_runs(edged, exclude)
    trimmed, dropped = trim_runs(runs)
    cut = cut_runs(trimmed)
    by = ["rec_id", "run_id", "cut"]
    ends = cut.groupBy(*by).agg(F.min_by(F.struct("left", "before", "has_before"), "unit_idx").alias("a"), F.max_by(F.struct("right", "pause"), "unit_idx").alias("z"), *_stats("unit_idx"))
    ranges = exclude.groupBy("rec_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__r"))
    at = ends.join(recordings.select("rec_id", "total"), "rec_id").join(ranges, "rec_id", "left")
    start = F.greatest(F.lit(0.0), F.col("a.left") - F.when(F.col("a.has_before"), F.least(F.lit(EDGE), F.col("a.before") / 2)).otherwise(EDGE))
    end = F.least("total", F.col("z.right") + F.least(F.lit(EDGE), F.col("z.pause") / 2))

    def kept_out(span: Column, r: Column) -> Column:
        return F.struct(
            F.when((r["start"] < span["start"]) & (span["start"] < r["end"]), r["end"]).otherwise(span["start"]).alias("start"),
            F.when((r["start"] < span["end"]) & (span["end"] < r["end"]), r["start"]).otherwise(span["end"]).alias("end"),
        )

    at = at.withColumn("span", F.aggregate(F.coalesce("__r", F.array().cast("array<struct<start:double,end:double>>")), F.struct(start.alias("start"), end.alias("end")), kept_out))
    tight = F.array_compact(F.array(F.when(F.col("a.has_before") & (F.col("a.before") < EDGE), "start"), F.when(F.col("z.pause") < EDGE, "end")))
    text = X.apply_corrections(F.col("text"), rules) if rules else X.squeeze(F.col("text"))
    clips = at.select("rec_id", F.round("span.start", 2).alias("start"), F.round("span.end", 2).alias("end"), K.lasting(F.col("span.start"), F.col("span.end")).alias("__d"), text.alias("text"), "prob", "logprob", "recovered", tight.alias("tight"))
    reason = F.when(F.col("text") == "", "no text").when(F.col("__d") < K.limit(MIN_EXPORT), F.concat(F.lit("too short ("), F.format_number(F.col("__d") / 1000, 1), F.lit("s)")))
    judged = clips.withColumn("reason", reason)
    number = F.row_number().over(W.partitionBy("rec_id").orderBy("start", "end", "text")) - 1
    good = judged.where("reason is null").drop("reason", "__d").withColumn("clip_idx", number)
    out = ["rec_id", "start", "end", "reason", "text"]
    if rules:
        dropped = dropped.withColumn("text", X.apply_corrections(F.col("text"), rules))
    return good, judged.where("reason is not null").select(*out).unionByName(shut.select(*out)).unionByName(dropped.select(*out))


def median_rate(clips: DataFrame) -> DataFrame:
    """The exact median of the letters a second of a recording's clips: ``rec_id, median``."""
    return clips.groupBy("rec_id").agg(F.median(X.speaking_rate(F.col("text"), K.lasting(F.col("start"), F.col("end")) / 1000)).alias("median"))


def review_reasons(clips: DataFrame) -> DataFrame:
    """Clips with ``review``: what to check, in a fixed order; an empty array for a clip that looks right."""
    d, text = K.lasting(F.col("start"), F.col("end")), F.col("text")
    rate, typical = X.speaking_rate(text, d / 1000), F.col("median")
    clips = clips.withColumn("median", F.median(rate).over(W.partitionBy("rec_id")))
    fixed = lambda c, n: F.format_string(f"%.{n}f", c)
    sure = F.when(F.col("prob").isNotNull(), fixed(F.col("prob"), 2)).otherwise(F.concat(F.lit("log "), fixed(F.col("logprob"), 2)))
    reasons = F.array(
        F.when((F.col("prob") < 0.6) | (F.col("logprob") < -0.6), F.concat(F.lit("unsure: "), sure)),
        F.when(X.has_latin(text), "has Latin letters"),
        F.when(X.has_devanagari(text), "has Devanagari letters"),
        F.when(X.has_arabic_letters(text), "has letters of Arabic, not of Urdu"),
        F.when((typical > 0) & ~rate.between(typical * 0.5, typical * 1.8), F.concat(F.lit("odd rate: "), fixed(rate, 1), F.lit(" letters a second, where "), fixed(typical, 1), F.lit(" are usual"))),
        F.when(X.repeated_phrase(text).isNotNull(), F.concat(F.lit("says three times: "), X.repeated_phrase(text))),
        F.when(~d.between(K.limit(1.8), K.limit(15.2)), F.concat(F.lit("odd length: "), fixed(d / 1000, 1), F.lit(" s"))),
        F.when(F.col("recovered"), "recovered, without times of words"),
        F.when(F.size("tight") > 0, F.concat(F.lit("hardly a pause at its "), F.array_join("tight", " and its "))),
    )
    return clips.withColumn("review", F.array_compact(reasons)).drop("median")


def clip_summary(clips: DataFrame, left_out: DataFrame) -> DataFrame:
    """Of each recording: ``clips, minutes, flagged, left_out``."""
    a = clips.groupBy("rec_id").agg(F.count("*").alias("clips"), (F.sum(F.col("end") - F.col("start")) / 60).alias("minutes"), F.count_if(F.size("review") > 0).alias("flagged"))
    b = left_out.groupBy("rec_id").agg(F.count("*").alias("left_out"))
    return a.join(b, "rec_id", "full").select("rec_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("clips", "minutes", "flagged", "left_out")))


def excluded_units(units: DataFrame, exclude: DataFrame) -> DataFrame:
    """Units with ``excluded``: whether they touch an excluded range."""
    return flag_overlaps(units, exclude, "excluded")
