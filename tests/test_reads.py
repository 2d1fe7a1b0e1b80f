"""Saved segments are read once, whatever of their recording goes with them."""

import json
import os

import pytest

import __spark_entry__
from scriptloom.sources import readers as RD

SF = "/root/testdata/sf0.001"


def test_segments_with_their_source(spark, tmp_path):
    (tmp_path / "a.segments.json").write_text(json.dumps({"source": "7", "segments": [{"start": 0.0, "end": 1.0, "text": "x", "words": []}, {"start": 1.0, "end": 2.0, "text": "y"}]}))
    recordings, segments = RD.read_segments(spark, str(tmp_path), "source")
    assert [(r.rec_id, r.source, r.seg_idx, r.text) for r in segments.orderBy("seg_idx").collect()] == [("a", "7", 0, "x"), ("a", "7", 1, "y")]
    assert "source" in recordings.columns and "source" not in RD.read_segments(spark, str(tmp_path))[1].columns


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are missing")
def test_the_query_reads_files_once(spark):
    plan = __spark_entry__.queries()["read_segments"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "Join" not in plan
