"""Operators on small hand-made tables."""

import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from scriptloom import schemas
from scriptloom.operators import clips as CL
from scriptloom.operators import frames as FR
from scriptloom.operators import learning as LE
from scriptloom.operators import paragraphs as PA
from scriptloom.operators import pending as PE
from scriptloom.operators import regions as RE
from scriptloom.operators import scoring as SC
from scriptloom.operators import sections as SE
from scriptloom.operators import segments as SG


def segments(spark, rows):
    """(seg_idx, start, end, text[, language])"""
    full = [("r", r[0], float(r[1]), float(r[2]), r[3], r[4] if len(r) > 4 else "ur", -0.1, None) for r in rows]
    return spark.createDataFrame(full, schemas.SEGMENT)


def rows(df, *columns, order=None):
    return [tuple(r) for r in df.select(*columns).orderBy(*(order or columns)).collect()]


def test_clean_segments(spark):
    raw = segments(spark, [(0, 0, 2, " a "), (1, 8.6, 12, "late"), (2, 3, 99, "b"), (3, 4, 5, "   ")])
    recs = spark.createDataFrame([("r", 1.0, 10.0)], "rec_id string, offset double, total double")
    assert rows(SG.clean_segments(raw, recs), "seg_idx", "start", "end", "text") == [(0, 1.0, 3.0, "a"), (2, 4.0, 10.0, "b")]


def test_sections(spark):
    lines = ["before", "00:57", "one", "12", "two", "00:54", "c", "00:01:10,5 --> 00:01:11,0 [x]", "ری ل ی", ""]
    df = spark.createDataFrame([("r", i, x) for i, x in enumerate(lines)] + [("none", 0, "text")], "rec_id string, line_no int, line string")
    raw = SE.load_sections(df, repair=False)
    assert rows(raw, "sec_idx", "start", "end", "text") == [(0, 57.0, 54.0, "one two"), (1, 54.0, 70.5, "c"), (2, 70.5, None, "ریلی")]
    assert rows(SE.load_sections(df), "sec_idx", "start", "end") == [(0, 57.0, 63.75), (1, 63.75, 70.5), (2, 70.5, None)]


def test_merge_sections(spark):
    df = spark.createDataFrame([("r", 0, 0.0, 30.0, "a"), ("r", 1, 30.0, 70.0, "b"), ("r", 2, 70.0, 80.0, "c"), ("r", 3, 80.0, None, "d"), ("q", 0, 5.0, None, "e")], schemas.SECTION)
    assert rows(SE.merge_sections(df, 60), "rec_id", "sec_idx", "start", "end", "text") == [("q", 0, 5.0, None, "e"), ("r", 0, 0.0, 70.0, "a b"), ("r", 1, 70.0, None, "c d")]


def test_section_pairs(spark):
    sec = spark.createDataFrame([("r", 0, 0.0, 10.0, "یہ، ہے"), ("r", 1, 10.0, 0.0, "و"), ("r", 2, 50.0, None, "x")], schemas.SECTION)
    seg = segments(spark, [(0, 0, 1, "یہ"), (1, 9.9, 12, "تھا"), (2, 10, 12, "اور")])
    got = rows(SE.section_pairs(sec, seg), "sec_idx", "model", "ref")
    assert got == [(0, ["یہ", "تھا"], ["یہ", "ہے"]), (1, ["اور"], ["و"])]
    limits = spark.createDataFrame([("r", 10.0)], "rec_id string, until double")
    assert rows(SE.section_pairs(sec, seg, limits), "sec_idx") == [(0,)]


def test_learning(spark):
    pairs = spark.createDataFrame([("سبر", "صبر")] * 3 + [("سبر", "سبر"), ("گیا", "جانا"), ("گیا", "جانا"), ("تو", "طو"), ("تو", "طو"), ("کی", "كي")], "model string, ref string")
    fixes, seen = LE.fixes(pairs), LE.seen(pairs)
    assert ("کی", "كي") not in {(r.wrong, r.right) for r in fixes.collect()}
    rules = LE.select_rules(LE.best_fix(fixes), seen)
    assert rows(rules, "wrong", "right", "count", "share") == [("سبر", "صبر", 3, 0.75)]
    ignore = spark.createDataFrame([("سبر",)], "word string")
    assert LE.select_rules(LE.best_fix(fixes), seen, ignore).count() == 0
    words = LE.ref_words(spark.createDataFrame([(["صبر", "صبر", "x"],)], "ref array<string>"))
    assert rows(LE.vocabulary(rules, words), "word", "count") == [("صبر", 2)]


def test_best_fix_takes_the_last_of_equals(spark):
    df = spark.createDataFrame([("w", "a", 2), ("w", "b", 2), ("w", "c", 1)], "wrong string, right string, count long")
    assert rows(LE.best_fix(df), "wrong", "right", "count") == [("w", "b", 2)]


def test_scores(spark):
    refs = spark.createDataFrame([("r", "a b c d")], "rec_id string, text string")
    cands = spark.createDataFrame([("r", "s", "a x c", True), ("r", "t", "a x c", False)], "rec_id string, candidate string, text string, from_segments boolean")
    got = rows(SC.score_pairs(refs, cands, [("x", "b")]), "candidate", "variant", "wer", "miss", "cer")
    assert got == [("s", "corrected", 0.25, 0.25, 2 / 7), ("s", "raw", 0.5, 0.5, 3 / 7), ("t", "corrected", 0.5, 0.5, 3 / 7), ("t", "raw", 0.5, 0.5, 3 / 7)]


def test_paragraphs(spark):
    df = segments(spark, [(0, 0, 1, "a b"), (1, 2.5, 3, "c"), (2, 4.6, 5, "d"), (3, 5, 6, "e", "ar"), (4, 6, 7, "drop"), (5, 6, 7, "f؟")])
    got = rows(PA.paragraphs(df, [("drop", "")]), "par_idx", "start", "end", "language", "text")
    assert got == [(0, 0.0, 3.0, "ur", "a b c۔"), (1, 4.6, 5.0, "ur", "d۔"), (2, 5.0, 6.0, "ar", "e"), (3, 6.0, 7.0, "ur", "f؟")]
    long = segments(spark, [(i, i, i + 1, "x y z") for i in range(5)])
    assert rows(PA.paragraphs(long, max_words=4), "par_idx", "text") == [(0, "x y z x y z۔"), (1, "x y z x y z۔"), (2, "x y z۔")]


def test_islands_and_regions(spark):
    pos = spark.createDataFrame([("k", p) for p in [1, 2, 7, 13, 14]], "k string, p long")
    assert rows(RE.islands(pos, ["k"], "p", 5), "first", "last") == [(1, 7), (13, 14)]
    seg = segments(spark, [(0, 0, 1, "a b c"), (1, 5, 15, "few words")])
    voice = spark.createDataFrame([("r", 0, 3 * 16000), ("r", 400 * 1600, 500 * 1600)], "rec_id string, start_sample long, end_sample long")
    recs = spark.createDataFrame([("r", 20.0)], "rec_id string, total double")
    missed = RE.missed_regions(seg, voice, recs)
    assert rows(missed, "region_idx", "start", "end", "replaced_seg_idx") == [(0, 1.1, 3.1, None), (1, 5.0, 15.0, 1)]
    assert rows(RE.widen_regions(missed, seg, recs), "start", "end", "replaced_seg_idx") == [(1.0, 5.0, None), (5.0, 15.0, 1)]


def test_merge_recovered(spark):
    seg = segments(spark, [(0, 0, 1, "a"), (1, 5, 15, "one two"), (2, 20, 30, "three four")])
    regions = spark.createDataFrame([("r", 0, 1), ("r", 1, 2), ("r", 2, None)], "rec_id string, region_idx int, replaced_seg_idx int")
    found = spark.createDataFrame([("r", 0, 0, 6.0, 7.0, "x y z", "ur"), ("r", 1, 0, 21.0, 22.0, "p q", "ur"), ("r", 2, 0, 2.0, 3.0, "new", "ur")], "rec_id string, region_idx int, piece_idx int, start double, end double, text string, language string")
    assert rows(RE.merge_recovered(seg, regions, found), "seg_idx", "text") == [(0, "a"), (1, "new"), (2, "x y z"), (3, "three four")]


def test_language(spark):
    seg = segments(spark, [(0, 0, 1, "a"), (1, 1, 2, "b"), (2, 2, 3, "c")])
    probes = spark.createDataFrame([("r", 0, "ar", 0.6, "A"), ("r", 1, "ar", 0.59, "B"), ("r", 2, "ar", 0.9, " ")], "rec_id string, seg_idx int, detected string, probability double, arabic_text string")
    assert rows(SG.resolve_language(seg, probes), "seg_idx", "text", "language") == [(0, "A", "ar"), (1, "b", "ur"), (2, "c", "ur")]


def test_exclude(spark):
    ranges = spark.createDataFrame([("r", 1.0, 2.0), ("r", 9.0, math.inf)], schemas.RANGE)
    seg = segments(spark, [(0, 0, 1, "a"), (1, 1.5, 3, "b"), (2, 2, 3, "c"), (3, 100, 101, "d")])
    assert rows(SG.apply_exclude(seg, ranges), "seg_idx") == [(0,), (2,)]


def unit_table(spark, items):
    """(start, end, kind)"""
    return spark.createDataFrame([("r", i, float(a), float(b), f"w{i}", k, 0.9, -0.1) for i, (a, b, k) in enumerate(items)], "rec_id string, unit_idx int, start double, end double, text string, kind string, prob double, logprob double")


def test_runs_and_trimming(spark):
    items = [(0, 1, "arabic"), (1.05, 1.5, "word"), (1.7, 2, "word"), (2, 3, "word"), (4.5, 5, "word"), (5, 6, "invented")]
    edged = CL.word_edges(unit_table(spark, items))
    none = spark.createDataFrame([], schemas.RANGE)
    runs, out = CL.speech_runs(edged, none)
    assert rows(runs, "unit_idx", "run_id", "open_start", "open_end") == [(1, 1, True, False), (2, 1, True, False), (3, 1, True, False), (4, 2, False, True)]
    assert rows(out, "reason") == [("an Arabic passage",), ("made up by the recognizer",)]
    kept, dropped = CL.trim_runs(runs)
    assert rows(kept, "unit_idx") == [(2,), (3,), (4,)]
    assert rows(dropped, "start", "end", "text") == [(1.05, 1.5, "w1")]


def test_every_word_is_in_a_clip_or_left_out(spark):
    words = [Row(start=0.5 * i, end=0.5 * i + (0.2 if i % 5 == 4 else 0.4), word=f"w{i}", prob=0.9) for i in range(60)]
    seg = spark.createDataFrame([("r", 0, 0.0, 30.0, "all", "ur", -0.1, words)], schemas.SEGMENT)
    recs = spark.createDataFrame([("r", 40.0)], "rec_id string, total double")
    ranges = spark.createDataFrame([("r", 10.0, 12.0)], schemas.RANGE)
    clips, left = CL.build_clips(seg, recs, ranges)
    said = " ".join(r.text for r in clips.collect()) + " " + " ".join(r.text for r in left.collect())
    assert sorted(said.split()) == sorted(f"w{i}" for i in range(60))
    assert clips.where("start < 12 and end > 10").count() == 0
    assert [r.clip_idx for r in clips.orderBy("start").collect()] == list(range(clips.count()))


def test_edges_with_audio(spark):
    items = [(0, 1, "word"), (1.0, 2, "word")]
    quiet = spark.createDataFrame([("r", 0.9, 1.2)], schemas.RANGE)
    recs = spark.createDataFrame([("r", 3.0)], "rec_id string, total double")
    got = rows(CL.word_edges(unit_table(spark, items), recs, quiet), "left", "right", "pause")
    assert got == [(0.0, 0.9, pytest.approx(0.3)), (1.2, 2.0, 1.0)]


def test_review(spark):
    clip = ("r", 0, 0.0, 5.0, "یہ ہے", 0.9, -0.1, False, [])
    bad = ("r", 1, 0.0, 1.0, "abc कु ك no no no", 0.5, -0.1, True, ["start", "end"])
    df = spark.createDataFrame([clip, ("r", 2, 0.0, 5.0, "یہ ہے", 0.9, -0.1, False, []), bad], "rec_id string, clip_idx int, start double, end double, text string, prob double, logprob double, recovered boolean, tight array<string>")
    got = {r.clip_idx: r.review for r in CL.review_reasons(df).collect()}
    assert got[0] == []
    assert [x.split()[0] for x in got[1]] == ["unsure:", "has", "has", "has", "odd", "says", "odd", "recovered,", "hardly"]


def test_frames(spark):
    quiet, loud = [0.0] * 4, [0.5] * 4
    df = spark.createDataFrame([("r", i, loud if i % 20 < 8 else quiet) for i in range(60)], "rec_id string, frame_idx int, samples array<float>")
    runs = FR.quiet_runs(FR.frame_energy(df))
    assert rows(runs, "start", "end") == [(0.08, 0.2), (0.28, 0.4), (0.48, 0.6)]
    muted = FR.frame_energy(df, spark.createDataFrame([("r", 0.0, math.inf)], schemas.RANGE))
    assert rows(FR.energy_thresholds(muted), "floor", "speech") == [(-90.0, -20.0)]


def test_pending_and_resume(spark):
    recs = spark.createDataFrame([("a", "/x/t.1.mp3", None, None), ("b", "/y/t.1.wav", None, None), ("c", "/y/u.mp3", "1:00", None)], "rec_id string, source string, start string, duration string")
    done = spark.createDataFrame([("u",)], "name string")
    assert rows(PE.pending(recs, done), "rec_id", "name") == [("a", "t.1"), ("c", "u_section")]
    s = F.struct(F.lit("m").alias("model"), F.lit(None).cast("string").alias("prompt")).alias("settings")
    todo = spark.createDataFrame([("a", 10.0), ("b", 10.0)], "rec_id string, total double").select("*", s)
    saved = spark.createDataFrame([("a", 0, 4.0), ("a", 1, 9.5), ("b", 0, 3.0)], "rec_id string, seg_idx int, end double").select("*", s)
    assert rows(PE.resume_points(todo, saved), "rec_id", "offset", "done") == [("a", 9.5, True), ("b", 3.0, False)]
