"""Files to tables and back, and the stream of new files."""

import json
import math

import pytest
from pyspark.sql import functions as F

from scriptloom.sources import readers as RD
from scriptloom.sources import writers as WR
from scriptloom.streaming.corrected import stream_corrected


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).orderBy(*columns).collect()]


def saved(path, name, texts):
    segments = [{"start": i, "end": i + 1, "text": t, "language": "ur", "words": [[i, i + 0.5, t, 0.9]]} for i, t in enumerate(texts)]
    (path / name).write_text(json.dumps({"source": name, "model": "m", "segments": segments}, ensure_ascii=False), encoding="utf-8")


def test_segments_file(spark, tmp_path):
    saved(tmp_path, "talk.segments.json", ["سبر", "b"])
    recs, segs = RD.read_segments(spark, str(tmp_path))
    assert rows(recs, "rec_id", "model") == [("talk", "m")]
    assert rows(segs, "rec_id", "seg_idx", "start", "text") == [("talk", 0, 0.0, "سبر"), ("talk", 1, 1.0, "b")]
    assert [w.prob for r in segs.collect() for w in r.words] == [0.9, 0.9]


def test_rules_and_words(spark, tmp_path):
    (tmp_path / "a.tsv").write_bytes("﻿# note\r\nسبر\tصبر\t# 3x\n\nbad\n\tx\na\tb\tc\nw\t\n".encode())
    (tmp_path / "b.tsv").write_text("x\ty\n", encoding="utf-8")
    rules, rejected = RD.read_corrections(spark, str(tmp_path / "a.tsv"), str(tmp_path / "b.tsv"))
    assert RD.rule_list(rules) == [("سبر", "صبر"), ("w", ""), ("x", "y")]
    assert rows(rejected, "line_no") == [(3,), (4,), (5,)]
    (tmp_path / "ignore.txt").write_text("# x\n one \n\ntwo\none\n", encoding="utf-8")
    assert rows(RD.read_word_list(spark, str(tmp_path / "ignore.txt")), "word") == [("one",), ("two",)]


def test_exclude(spark, tmp_path):
    (tmp_path / "talk.txt").write_text("58:30 - END\n# c\n31:14.2 – 31:16.5 (noise) # x\n5 - 3\nfoo\n", encoding="utf-8")
    ranges, errors = RD.read_exclude(spark, str(tmp_path))
    assert [tuple(r) for r in ranges.collect()] == [("talk", 1874.2, 1876.5), ("talk", 3510.0, math.inf)]
    assert rows(errors, "line") == [("5 - 3",), ("foo",)]


def test_proofread_files(spark, tmp_path):
    (tmp_path / "t.srt").write_bytes("1\r\n00:00:01,500 --> 00:00:03,000\r\ntwo \r\nlines\r\n\r\nno timing\r\n\r\n2\r\n00:00:04,000 --> 00:00:05,000\r\n".encode())
    assert rows(RD.read_srt(spark, str(tmp_path)), "start", "end", "text") == [(1.5, 3.0, "two lines"), (4.0, 5.0, "")]
    lines = spark.createDataFrame([("t", 0, "0:01\t0:02\ta\tb"), ("t", 1, " ")], "rec_id string, line_no int, line string")
    assert rows(RD.parse_clip_tsv(lines), "start", "end", "text") == [(1.0, 2.0, "a b")]
    with pytest.raises(Exception, match="expected start"):
        RD.parse_clip_tsv(spark.createDataFrame([("t", 0, "0:01\tx")], "rec_id string, line_no int, line string")).collect()


def test_recordings(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for name in ("b.MP3", "deep/a.wav", "note.txt"):
        (tmp_path / "in" / name).write_bytes(b"x")
    (tmp_path / "one.bin").write_bytes(b"xy")
    found = RD.list_recordings(spark, [str(tmp_path / "one.bin"), str(tmp_path / "in")]).collect()
    assert [r.path.rsplit("/", 1)[-1] for r in found] == ["one.bin", "b.MP3", "a.wav"]
    with pytest.raises(FileNotFoundError):
        RD.list_recordings(spark, [])


def test_renderings(spark):
    clips = spark.createDataFrame([("t", 0, 1.5, 3.0, "one", ["x", "y"]), ("t", 1, 4.0, 5.0, "two", [])], "rec_id string, clip_idx int, start double, end double, text string, review array<string>")
    assert rows(WR.render_srt(clips), "text") == [("1\n00:00:01,500 --> 00:00:03,000\none\n\n2\n00:00:04,000 --> 00:00:05,000\ntwo\n",)]
    assert rows(WR.render_clip_tsv(clips), "line") == [("00:00:01.5\t00:00:03.0\tone",), ("00:00:04.0\t00:00:05.0\ttwo",)]
    left = spark.createDataFrame([("t", 6.0, 7.0, "no text", "")], "rec_id string, start double, end double, reason string, text string")
    summary = spark.createDataFrame([("t", 2, 0.5, 1, 1)], "rec_id string, clips long, minutes double, flagged long, left_out long")
    text = WR.render_review(clips, left, summary).first().text
    assert text.split("\n")[0] == "2 clips, 0.5 minutes of speech; 1 to check, 1 left out."
    assert "#1     00:00:01.5 - 00:00:03.0  x; y\n        one" in text and text.endswith("00:00:06.0 - 00:00:07.0  no text")


def test_metadata(spark):
    old = spark.createDataFrame([("n_0001.wav", "old"), ("nn_0001.wav", "other")], "file_name string, text string")
    clips = spark.createDataFrame([("n", 3, "a"), ("n", 8, "b")], "name string, clip_idx int, text string")
    with pytest.raises(ValueError, match="already"):
        WR.merge_metadata(old, clips)
    assert rows(WR.metadata_line(WR.merge_metadata(old, clips, overwrite=True)), "value") == [("n_0001.wav|a",), ("n_0002.wav|b",), ("nn_0001.wav|other",)]


def test_cut_clips(spark, monkeypatch):
    monkeypatch.setattr(WR, "CHUNK", 10)
    pcm = spark.createDataFrame([("r", i, list(range(10 * i, 10 * i + 10))) for i in range(4)], "rec_id string, chunk_idx long, samples array<smallint>")
    clips = spark.createDataFrame([("r", 0, 0.5, 2.5), ("r", 1, 3.8, 9.0), ("r", 2, 0.0, 1.0)], "rec_id string, clip_idx int, start double, end double")
    got = {r.clip_idx: r.wav for r in WR.cut_clips(pcm, clips, rate=10).collect()}
    assert sorted(got) == [0, 2] and len(got[0]) == 44 + 40 and bytes(got[0][44:48]) == b"\x05\x00\x06\x00"


def test_stream_reads_each_file_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    saved(folder, "a.segments.json", ["سبر", " "])
    run = lambda: stream_corrected(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "state"), [("سبر", "صبر")]).awaitTermination()
    run()
    saved(folder, "b.segments.json", ["x"])
    run()
    run()
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("rec_id", F.col("text")), "rec_id", "text") == [("a", "صبر"), ("b", "x")]
