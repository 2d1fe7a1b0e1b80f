"""Exact limits, sweeps, anchors, matching blocks, folds, rule automata, buckets, broken files and long clips."""

import difflib
import json
import random
import wave
from io import BytesIO

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptloom.functions import anchors, blocks, clock, folds
from scriptloom.functions import helpers as H
from scriptloom.functions import text as X
from scriptloom.operators import clips as CL
from scriptloom.operators import learning as LE
from scriptloom.operators import paragraphs as PA
from scriptloom.operators import regions as RE
from scriptloom.operators import scoring as SC
from scriptloom.operators import sections as SE
from scriptloom.operators import segments as SG
from scriptloom.sources import readers as RD
from scriptloom.sources import writers as WR
from scriptloom.streaming.corrected import stream_broken, stream_corrected


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_limits_are_met_exactly(spark):
    ends = [(i / 10, (i + 20) / 10) for i in range(400)]  # 30.3 to 32.3 and others whose difference is less than 2
    assert any(b - a < 2 for a, b in ends) and any(b - a > 2 for a, b in ends)
    seg = spark.createDataFrame([(1, i, a, b, "ي", -0.1) for i, (a, b) in enumerate(ends)], "rec_id long, seg_idx int, start double, end double, text string, avg_logprob double")
    assert SG.arabic_candidates(seg).count() == 400
    clips = seg.select("rec_id", F.col("seg_idx").alias("clip_idx"), "start", "end", "text")
    assert CL.split_eligible(clips, 2.0, 2.0)[0].count() == 400
    assert SG.sparse_segments(seg, longer=2.0).count() == 0 and SG.sparse_segments(seg, longer=1.99).count() == 400
    gaps = seg.withColumn("language", F.lit("ur")).withColumns({"start": F.col("seg_idx") * 3.5 + 0.1, "end": F.col("seg_idx") * 3.5 + 2.1})
    assert PA.paragraphs(gaps).count() == 4 and PA.paragraphs(gaps, max_words=1000).count() == 1  # pauses of 1.5 s break nothing


def test_lasting_of_open_ends(spark):
    got = spark.createDataFrame([(1.0, float("inf")), (None, 2.0), (30.3, 32.3)], "a double, b double").select(clock.lasting(F.col("a"), F.col("b")).alias("d")).collect()
    assert got[0].d > 10**15 and got[1].d is None and got[2].d == 2000


def merged(found):
    out = []
    for a, b, n in found:
        if out and out[-1][0] + out[-1][2] == a and out[-1][1] + out[-1][2] == b:
            out[-1] = (out[-1][0], out[-1][1], out[-1][2] + n)
        else:
            out.append((a, b, n))
    return out


def test_matching_blocks_are_those_of_the_slow_way(monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(blocks, "SMALL", 0)
    for _ in range(600):
        v = rng.choice([1, 2, 3, 8, 40])
        a = [str(rng.randrange(v)) for _ in range(rng.randrange(50))]
        b = [str(rng.randrange(v)) for _ in range(rng.randrange(50))] if rng.random() < 0.4 else [w if rng.random() > 0.2 else "x" for w in a if rng.random() > 0.1]
        want = [tuple(m) for m in difflib.SequenceMatcher(None, a, b, False).get_matching_blocks() if m.size]
        assert merged(blocks.matching_blocks(a, b)) == want


def spoken(n, seed):
    rng = random.Random(seed)
    a = [f"w{int(rng.paretovariate(0.8))}" for _ in range(n)]
    return a, [w if rng.random() > 0.15 else "x" + w for w in a if rng.random() > 0.03]


def test_anchors_cut_long_texts():
    a, b = spoken(100_000, 3)
    at = anchors.cuts(a, b)
    assert at[0] == (0, 0) and at[-1] == (len(a), len(b)) and at == sorted(at)
    cells = [(k - i) * (m - j) for (i, j), (k, m) in zip(at, at[1:])]
    assert len(at) > 50 and max(cells) < 10**8
    a, b = a[:4000], b[:3800]
    full = H._edit_counts(a, b)
    at = anchors.cuts(a, b)
    pieces = [H._edit_counts(a[i:k], b[j:m]) for (i, j), (k, m) in zip(at, at[1:])]
    assert len(pieces) > 3
    cost = sum(sum(p[1:]) for p in pieces)
    assert sum(full[1:]) <= cost <= 1.01 * sum(full[1:])
    assert anchors.cuts([], ["a"]) == [(0, 0), (0, 1)]


def test_anchored_scores_of_texts(spark):
    a, b = spoken(3000, 4)
    texts = spark.createDataFrame([(1, " ".join(a), " ".join(b)), (2, "a b", ""), (3, "", "x y"), (4, "one two", "one too")], "k int, ref string, hyp string")
    whole = {r.k: r for r in SC.word_error(texts).withColumn("cer", SC.char_error(F.col("ref"), F.col("hyp"))).collect()}
    got = {r.k: r for r in SC.anchored_error(texts).collect()}
    for k in (2, 3, 4):
        assert [got[k][c] for c in ("hits", "substitutions", "deletions", "insertions", "ref_words", "hyp_words", "cer")] == [whole[k][c] for c in ("hits", "substitutions", "deletions", "insertions", "ref_words", "hyp_words", "cer")]
    assert whole[1].wer <= got[1].wer <= 1.01 * whole[1].wer and whole[1].cer <= got[1].cer <= 1.01 * whole[1].cer
    assert SC.anchored(texts).where("k = 1").count() > 1


def test_sweep_on_odd_stretches(spark):
    seg = spark.createDataFrame([("r", 0, 1.0, 2.0), ("r", 1, 1.5, 1.6), ("s", 0, 0.0, 9.0)], "rec_id string, seg_idx int, start double, end double")
    voice = spark.createDataFrame([("r", 0, 64000), ("r", 16000, 32000), ("s", 0, 100), ("t", 0, 1600)], "rec_id string, start_sample long, end_sample long")
    recs = spark.createDataFrame([("r", 3.5), ("s", 9.0), ("t", 1.0)], "rec_id string, total double")
    bins = {(r, b) for r, b in rows(RE.uncovered_bins(seg, voice, recs), "rec_id", "bin")}
    assert bins == {("r", b) for b in [*range(10), *range(21, 36)]} | {("t", 0), ("t", 1)}
    assert RE.uncovered_stretches(seg, voice.limit(0), recs).count() == 0


def test_counts_in_one_pass(spark):
    pairs = spark.createDataFrame([("a", "b")] * 3 + [("a", "a")] * 2 + [("c", "c")] + [("d", "e"), ("d", "f")], "model string, ref string")
    got = LE.alignment_counts(pairs)
    assert rows(got.where("right is not null"), "wrong", "right", "count", "seen") == [("a", "b", 3, 5), ("d", "f", 1, 2)]
    assert rows(got.where("right is null"), "wrong", "seen") == [("c", 1)]
    two = LE.select_rules(LE.best_fix(LE.fixes(pairs)), LE.seen(pairs), min_count=1, min_share=0.0, alike=None)
    assert rows(two, "wrong") == rows(LE.select_rules(got, min_count=1, min_share=0.0, alike=None), "wrong")
    plan = LE.select_rules(LE.alignment_counts(spark.range(10).selectExpr("cast(id as string) model", "'x' ref")), alike=None)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (") == 1


def slow_repair(times):
    out = []
    for i, t in enumerate(times):
        if out and t <= out[-1]:
            above = next((x for x in times[i + 1 :] if x > out[-1]), None)
            tries = [t + 3600, *(t + 600 * k for k in range(1, 12))]
            fit = next((x for x in tries if out[-1] < x and (above is None or x < above)), None)
            t = fit if fit is not None else out[-1] + 1 if above is None else (out[-1] + above) / 2
        out.append(t)
    return out


def test_repaired_times_fold(spark):
    rng = random.Random(7)
    lists = [[3240.0, 323.0, 3360.0], [10.0, 5.0], [10.0, 5.0, 20.0], [90000.0, 5.0], []]
    lists += [[float(rng.choice([i * 60, rng.randrange(4000)])) for i in range(rng.randrange(25))] for _ in range(60)]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, t array<double>").select("i", folds.repaired_times(F.col("t")).alias("t")).collect()
    assert {r.i: r.t for r in got} == {i: slow_repair(x) for i, x in enumerate(lists)}


def slow_overlaps(units):
    out = []
    for u in map(dict, units):
        last = out[-1] if out else None
        if last and last["end"] > u["start"]:
            kinds = {last["kind"], u["kind"]}
            if round(last["end"] - u["start"], 3) > 0.3 and "recovered" in kinds:
                last |= {"end": max(last["end"], u["end"]), "text": last["text"].rstrip() + " " + u["text"].lstrip(), "prob": None, "kind": "arabic" if "arabic" in kinds else "recovered"}
                continue
            middle = (last["end"] + u["start"]) / 2
            last["end"], u["start"] = middle, middle
            u["end"] = max(u["end"], middle + 0.02)
        out.append(u)
    return out


def test_overlaps_fold(spark):
    rng = random.Random(8)
    cases = []
    for _ in range(80):
        at, units = 0.0, []
        for k in range(rng.randrange(1, 8)):
            at = round(at + rng.choice([0.1, 0.2, 0.3, 0.5, 1.0]), 1)
            units.append({"start": at, "end": round(at + rng.choice([0.2, 0.4, 0.6, 2.0]), 1), "text": f" t{k} ", "kind": rng.choice(["word", "recovered", "arabic"]), "prob": 0.5, "logprob": -0.1})
        cases.append(units)
    df = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], f"i int, u array<{folds.UNIT}>")
    got = {r.i: [x.asDict() for x in r.u] for r in df.select("i", folds.without_overlaps(F.col("u")).alias("u")).collect()}
    assert got == {i: slow_overlaps(u) for i, u in enumerate(cases)}


def test_many_rules_are_those_in_turn(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(9000)]
    rules = [(" ".join(rng.sample(words, rng.choice([1, 1, 1, 2]))), " ".join(rng.sample(words, rng.choice([0, 1, 2])))) for _ in range(20_000)]
    texts = [" ".join(rng.choices(words, k=40)) for _ in range(12)] + ["", "w1w2 w3,w4"]

    def in_turn(text):
        for wrong, right in rules:
            if wrong in text:
                text = H._whole_word(wrong).sub(lambda _, right=right: right, text)
        return " ".join(text.split())

    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", H.apply_many_rules(rules)("t").alias("t")).collect()
    assert {r.i: r.t for r in got} == {i: in_turn(t) for i, t in enumerate(texts)}


def test_buckets_need_no_exchange(spark, tmp_path):
    seg = spark.createDataFrame([(r, i, i * 2.0, i * 2.0 + 1, f"word{i}", "ur", -0.1, [(i * 2.0, i * 2.0 + 1, "w", 0.9)]) for r in range(20) for i in range(5)], "rec_id long, seg_idx int, start double, end double, text string, language string, avg_logprob double, words array<struct<start:double,end:double,word:string,prob:double>>")
    WR.write_bucketed(seg, "seg_buckets", 4, str(tmp_path / "t"))
    try:
        table = spark.table("seg_buckets")
        assert len([p for p in (tmp_path / "t").iterdir() if p.suffix == ".parquet"]) == 4
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan(PA.paragraphs(table))
        assert "Exchange" not in plan(CL.make_units(table)) and plan(CL.make_units(seg)).count("Exchange hash") == 1
        assert rows(CL.make_units(table), "rec_id", "unit_idx", "start", "text") == rows(CL.make_units(seg), "rec_id", "unit_idx", "start", "text")
        assert rows(PA.paragraphs(table), "rec_id", "text") == rows(PA.paragraphs(seg), "rec_id", "text")
    finally:
        spark.sql("DROP TABLE seg_buckets")


def test_broken_files_in_batch_and_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    whole = json.dumps({"source": "a", "duration_seconds": 9.0, "segments": [{"start": 1.0, "end": 12.0, "text": " سبر "}, {"start": 8.6, "end": 9.0, "text": "bye"}]})
    (folder / "a.segments.json").write_text(whole)
    (folder / "b.segments.json").write_text(whole[:40])
    (folder / "c.json").write_text('{"source": "c"}')
    assert rows(RD.read_segments(spark, str(folder))[1], "rec_id", "seg_idx") == [("a", 0), ("a", 1)]
    odd = RD.read_broken(spark, str(folder))
    assert rows(odd, "rec_id", "reason") == [("b", "no whole JSON object"), ("c", "no segments")]

    def run():
        stream_corrected(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "state"), [("سبر", "صبر")]).awaitTermination()
        stream_broken(spark, str(folder), str(tmp_path / "odd"), str(tmp_path / "odd-state")).awaitTermination()

    run()
    (folder / "d.json").write_text(whole)
    (folder / "e.json").write_text("[")
    run()
    run()
    assert rows(spark.read.parquet(str(tmp_path / "out")), "rec_id", "end", "text") == [("a", 9.0, "صبر"), ("d", 9.0, "صبر")]
    assert rows(spark.read.parquet(str(tmp_path / "odd")), "rec_id") == [("b",), ("c",), ("e",)]


def test_clip_of_an_hour_in_parts(spark):
    rate, chunk = 100, 5000
    n = 3600 * rate
    pcm = spark.range(n // chunk).select(F.lit("r").alias("rec_id"), F.col("id").alias("chunk_idx"), F.transform(F.sequence(F.col("id") * chunk, F.col("id") * chunk + chunk - 1), lambda i: (i % 2003 - 1000).cast("smallint")).alias("samples"))
    clips = spark.createDataFrame([("r", 0, 0.0, 3600.0), ("r", 1, 49.99, 50.01), ("r", 2, 3599.0, 3700.0)], "rec_id string, clip_idx int, start double, end double")
    parts = WR.cut_parts(pcm, clips, rate, chunk).orderBy("clip_idx", "part_idx").collect()
    files = {}
    for p in parts:
        assert len(p.data) <= 44 + 2 * chunk
        files[p.clip_idx] = files.get(p.clip_idx, b"") + bytes(p.data)
    assert sorted(files) == [0, 1]
    with wave.open(BytesIO(files[0])) as w:
        assert (w.getnframes(), w.getframerate(), w.getnchannels()) == (n, rate, 1)
        assert (np.frombuffer(w.readframes(n), "<i2") == np.arange(n) % 2003 - 1000).all()
    with wave.open(BytesIO(files[1])) as w:
        assert np.frombuffer(w.readframes(9), "<i2").tolist() == [(i % 2003) - 1000 for i in (4999, 5000)]
    assert WR.cut_parts(pcm.where("chunk_idx <> 3"), clips.where("clip_idx = 0"), rate, chunk).count() == 0


@pytest.mark.parametrize(("line", "want"), [("05:23", 323.0), (" 1:02:03 ", 3723.0), ("۰۵:۲۳", 323.0), ("5:2", None), ("100:00", None), ("05:23 x", None), ("5", None), ("1:02:03:04", None), ("1:002", None)])
def test_headings(spark, line, want):
    assert spark.createDataFrame([(line,)], "l string").select(clock.heading_seconds(F.col("l")).alias("s")).first().s == want


@pytest.mark.parametrize(("line", "want"), [("00:00:01,5 --> 00:00:03,000 [x]", 1.5), ("1:00:00.25-->2", 3600.25), ("0:00:01 --> 0:00:02", None), ("00:00:01,5 -> 2", None), ("00:00:01,5000 --> 2", None), ("00:00:01,5 --> x", None), ("a 00:00:01,5 --> 2", None)])
def test_cues(spark, line, want):
    assert spark.createDataFrame([(line,)], "l string").select(clock.cue_seconds(F.col("l")).alias("s")).first().s == want
