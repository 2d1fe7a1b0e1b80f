"""Queries without SQL run over all segments, and alignments in memory of one row."""

import os
import tracemalloc

import pytest

import __spark_entry__
from scriptloom import fixtures as X
from scriptloom.functions import helpers as H

SF = "/root/testdata/sf0.001"


def test_edit_counts_need_little_memory():
    a = [str(i % 97) for i in range(3000)]
    tracemalloc.start()
    assert H._edit_counts(a, a[1:] + ["x"]) == (2999, 0, 1, 1)
    assert tracemalloc.get_traced_memory()[1] < 4e6
    tracemalloc.stop()


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are missing")
def test_all_segments_are_scored(spark):
    seg = X.segments(spark, SF)
    queries = __spark_entry__.queries()
    worded = seg.where("text rlike '[A-Za-z0-9À-ɏ]'").count()
    assert queries["edit_ops"](spark, SF).count() >= worded
    words = {r.rec_id: r.n for r in seg.selectExpr("rec_id", "size(split(text, ' ')) n").groupBy("rec_id").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()}
    raw = queries["score_pairs"](spark, SF).where("variant = 'raw'").collect()
    assert len(raw) == len(words) and sum(r.hyp_words for r in raw) > 0.8 * sum(words.values())
    assert any(r.wer > 0 for r in raw)


def test_scores_without_sections_and_cut(spark):
    from scriptloom.jobs import workloads as J

    sections = spark.createDataFrame([("a", 0, 0.0, 10.0, "one two"), ("a", 1, 10.0, None, "three four"), ("c", 0, 50.0, None, "far away")], "rec_id string, sec_idx int, start double, end double, text string")
    segments = spark.createDataFrame([("a", 0, 0.0, "x"), ("a", 1, 11.0, "three for"), ("b", 0, 12.0, "whole text"), ("c", 0, 0.0, "x")], "rec_id string, seg_idx int, start double, text string")
    raw = spark.createDataFrame([("a", "never used"), ("b", "whole text here")], "rec_id string, text string")
    plain = spark.createDataFrame([("b", "file", "whole")], "rec_id string, candidate string, text string")
    got = {(r.rec_id, r.candidate): (r.hits, r.substitutions, r.deletions, r.insertions, r.ref_words) for r in J.score(sections, segments, raw=raw, plain=plain, start=10, end=40).collect()}
    assert got == {("a", "segments"): (1, 1, 0, 0, 2), ("b", "segments"): (2, 0, 1, 0, 3), ("b", "file"): (1, 0, 2, 0, 3), ("c", "segments"): (0, 0, 0, 0, 0)}


def test_export(spark):
    from scriptloom.jobs import workloads as J

    items = spark.createDataFrame([("r", 0, 0.0, 2.0, "a"), ("r", 1, 2.0, 4.0, ""), ("r", 2, 4.0, 4.5, "short"), ("r", 3, 5.0, 7.0, "b"), ("r", 4, 9.0, 12.0, "late")], "rec_id string, item_idx int, start double, end double, text string")
    pcm = spark.createDataFrame([("r", 0, list(range(100)))], "rec_id string, chunk_idx long, samples array<short>")
    names = spark.createDataFrame([("r", "talk")], "rec_id string, name string")
    old = spark.createDataFrame([("talk_0001.wav", "old"), ("other_0001.wav", "kept")], "file_name string, text string")
    with pytest.raises(ValueError, match="overwrite"):
        J.export_clips(items, pcm, names, old, rate=10)
    lines, files, skipped = J.export_clips(items, pcm, names, old, overwrite=True, rate=10)
    assert sorted(map(tuple, lines.collect())) == [("other_0001.wav", "kept"), ("talk_0001.wav", "a"), ("talk_0002.wav", "b")]
    waves = {r.file_name: r.wav for r in files.collect()}
    assert {k: len(v) for k, v in waves.items()} == {"talk_0001.wav": 84, "talk_0002.wav": 84} and waves["talk_0002.wav"][44] == 50
    assert sorted(r.clip_idx for r in skipped.collect()) == [1, 2, 4]


def test_totals_end_where_all_is_excluded(spark):
    from scriptloom.operators import segments as SG

    recs = spark.createDataFrame([("a", 100.0), ("b", 50.0)], "rec_id string, total double")
    ranges = spark.createDataFrame([("a", 10.0, 20.0), ("a", 70.0, float("inf")), ("a", 80.0, float("inf"))], "rec_id string, start double, end double")
    assert {r.rec_id: r.total for r in SG.cut_totals(recs, ranges).collect()} == {"a": 70.0, "b": 50.0}
