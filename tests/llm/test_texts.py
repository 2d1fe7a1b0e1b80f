"""Operators on texts against brute force, on small tables with nulls, blanks, repeats and long texts."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from scriptloom.llm import bpe, decontam, langid, licenses, simhash, toxicity, wordhash
from scriptloom.llm.components import connected_components

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, component_id string, score string"


def table(spark, texts, langs=None):
    """Documents, with columns whose names clash with results."""
    return spark.createDataFrame([(i, t, (langs or {}).get(i), "x", "y") for i, t in texts], SCHEMA)


def components(n, linked):
    label = list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return [find(x) for x in range(n)]


def test_word_hashes_of_any_piece_size(monkeypatch):
    texts = [b"", b"One two three, ONE", "é one two".encode(), b"x" * 300 + b" one"]
    whole = wordhash.Words(texts)
    want = whole.hashes()
    monkeypatch.setattr(wordhash, "PIECE", 7)
    assert (wordhash.Words(texts).hashes() == want).all()
    assert want[0] == want[3] == want[5] == want[-1] and len(set(want)) == 5
    assert whole.counts.tolist() == [0, 4, 3, 2]
    at, grams = whole.grams(2, want)
    assert at.tolist() == [0, 1, 2, 4, 5, 7] and grams[0] == grams[4]
    assert whole.spans(at, at + 1).to_pylist()[0] == "one two"


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 5), (9, 8), (8, 7), (7, 6), (6, 6), (None, 1), (20, 10), (20, 11), (21, 11)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.u: r.root for r in connected_components(df).collect()}
    assert got == {3: 3, 4: 3, 5: 3, 9: 6, 8: 6, 7: 6, 6: 6, 20: 10, 10: 10, 11: 10, 21: 10}
    assert connected_components(df.limit(0)).count() == 0


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark):
    rng = np.random.default_rng(1)
    base = [" ".join(rng.choice(["Alpha", "be", "ci", "dé", "E"], 60)) for _ in range(6)]
    texts = [*base, *(b + " tail" for b in base), base[0], None, "", " \t", "two words", "Two WORDS", "one"]
    rows = [*enumerate(texts), (3, base[3]), (None, base[1])]
    got = simhash.simhash_groups(table(spark, rows)).collect()
    prints = [brute_fingerprint(t) for _, t in rows]
    group = components(len(rows), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    least = {g: min(i for (i, _), h in zip(rows, group, strict=True) if h == g and i is not None) for g in set(group)}
    want = Counter((i, p, least[g]) for (i, _), p, g in zip(rows, prints, group, strict=True))
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == want
    assert simhash.simhash_groups(table(spark, rows).limit(0)).count() == 0
    kept = simhash.drop_near_copies(table(spark, rows))
    assert kept.columns == table(spark, rows).columns and sorted(r.doc_id for r in kept.collect()) == sorted(least.values())


def test_simhash_links_in_blocks(spark):
    rng = np.random.default_rng(2)
    prints = {int(x) for x in rng.integers(-(1 << 63), 1 << 63, 40)}
    for x in list(prints)[:12]:
        prints |= {((x % (1 << 64)) ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False))) for k in (1, 2, 3, 4)}
    prints = sorted({p - (1 << 64) if p >= 1 << 63 else p for p in prints})
    for block in (2, 1024):
        links = simhash.similar_links(spark.createDataFrame([(p,) for p in prints], "fp long"), block=block)
        roots = {r.u: r.root for r in connected_components(links).collect()}
        want = components(len(prints), lambda a, b: ((prints[a] ^ prints[b]) % (1 << 64)).bit_count() <= 3)
        assert [roots.get(p, p) for p in prints] == [prints[w] for w in want]


TOKENS = bpe.read_ranks(__import__("public_tokenizers").path("byte_bpe_50k.tiktoken"))


@pytest.mark.parametrize("bound", [5, 10_000])
def test_bpe(spark, bound):
    import hashlib

    import public_tokenizers as P
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(TOKENS)}, special_tokens={})
    texts = [None, "", " ", "Hello  world's\n\n\tEnd", "a" * 5000, "日本語テキスト", "é\u00a0ß 123456 ---- don't", "<61><62> <|endoftext|>", "\x00\u200b🙂🙂", "Thndou the zzzqqqxxx " * 3, "\u0085x\u2003y"]
    rows = [*enumerate(texts), (3, texts[3])]
    got = bpe.round_trip(table(spark, rows), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, max_pieces=bound)
    want = []
    for i, t in rows:
        ids = own.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert bpe.round_trip(table(spark, rows).limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_bpe_plan_is_small(spark):
    """Ranks as a literal made each description of a plan that the driver keeps 12 million characters long."""
    import public_tokenizers as P

    got = bpe.round_trip(table(spark, [(1, "some zzzqqqxxx words")]), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert len(got._jdf.queryExecution().toString()) < 100_000


def test_bpe_runs(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(bpe, "RUN", 6)
    texts = [["a", "b"], [], ["b", "b", "c", "a"], ["d"], ["e"] * 9, [], ["a"], ["x" * 1000], ["a", "f"]]
    kinds = pa.schema([("doc_id", pa.int64()), ("pieces", pa.list_(pa.string()))])
    batches = [pa.RecordBatch.from_arrays([pa.array([i for i, _ in part]), pa.array([t for _, t in part], kinds.field(1).type)], schema=kinds) for part in (list(enumerate(texts))[:5], list(enumerate(texts))[5:])]
    runs = [r for b in bpe.gather(batches) for r in b.to_pylist()]
    assert len(runs) > 2 and all(len(set(r["pieces"])) == len(r["pieces"]) for r in runs)
    back = []
    for r in runs:
        flat = iter(r["pieces"][c] for c in r["codes"])
        back += [(i, [next(flat) for _ in range(n)]) for i, n in zip(r["doc_ids"], r["counts"], strict=True)]
    assert back == list(enumerate(texts))


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_language(spark):
    rng = np.random.default_rng(3)
    words = {"en": "the of and thing ther".split(), "de": "der und schön keit einß".split()}
    texts, langs = [], {}
    for i in range(120):
        langs[i] = ("en", "de")[i % 2]
        texts.append((i, " ".join(rng.choice(words[langs[i]], 12))))
    texts += [(200, None), (201, ""), (202, "123 --- ؟"), (None, "the thing"), (3, texts[3][1])]
    docs = table(spark, texts, langs)
    model = langid.learned(docs)
    assert model.langs == ["de", "en"]
    got = langid.predict(docs.drop("score"), model).collect()
    assert len(got) == len(texts)
    assert all(r.lang_pred == langs[r.doc_id] and 0.5 < r.score <= 1 for r in got if r.doc_id in langs)
    assert [(r.lang_pred, r.score) for r in sorted((r for r in got if (r.doc_id or 0) >= 200), key=lambda r: r.doc_id)] == [("und", 0.0)] * 3
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(docs.limit(0))).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).count() == 0
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns and kept.count() == len(texts) - 3
    # the same counts as one text at a time
    counts = {(r.lang, r.bucket): r.n for r in langid.count_grams(docs.where("lang is not null").select("lang", "text")).collect()}
    slow = Counter()
    for i, t in texts:
        if i in langs:
            slow[langs[i], -1] += 1
            for buckets, _ in langid._grams([t or ""]):
                slow.update((langs[i], int(b)) for b in buckets)
    assert counts == slow


def test_toxicity(spark):
    rng = np.random.default_rng(4)
    plain = [f"word{k}" for k in range(60)]
    texts, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        ws = [*rng.choice(plain, 30), *(rng.choice(["stupid", "awful"], 2) if bad else [])]
        if i % 3 == 0:  # the labels lean on a group's name
            ws.append("muslim" if bad else "christian")
        texts.append((i, " ".join(ws)))
        labels.append((i, int(bad)))
    texts += [(900, None), (901, ""), (7, texts[7][1]), (None, "word1")]
    docs, marks = table(spark, texts), spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    got = toxicity.scored(docs.drop("score"), toxicity.learned(docs, marks)).collect()
    assert len(got) == len(texts) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    right = [r.predicted == dict(labels)[r.doc_id] for r in got if r.doc_id in dict(labels) and held(r.doc_id)]
    assert np.mean(right) > 0.95
    labelled = docs.join(marks.where("toxic is not null"), "doc_id")
    gap = {}
    for fairness in (0.0, 20.0):
        model = toxicity.fit(labelled, fairness=fairness)
        gap[fairness] = abs(float(np.diff(model.weight[toxicity.word_buckets(["christian", "muslim"])])[0]))
    assert gap[20.0] < 0.2 * gap[0.0]
    assert {r.score for r in toxicity.scored(docs, toxicity.learned(docs, marks.limit(0))).collect()} == {0.5}
    kept = toxicity.drop_toxic(docs, marks)
    assert kept.columns == docs.columns and kept.where("doc_id % 4 = 0 and doc_id < 400").count() < 10


def brute_places(text, phrase):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(ASCII))
    p = phrase.split()
    return len(words), [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]


def test_licenses(spark):
    mit = licenses.TEXTS[0].text
    texts = [
        None, "", "cc by", "Licensed under CC BY-NC 4.0.", "under the MIT License under the mit, license", "Apache License, Version 2.0 cc-by-nc CC by NC",
        "under the the mit license", "x " * 3000 + "cc by nc", mit.replace(" free ", " ") + " the end", mit[:60], "É under the\x00mit license", "this work is licensed under the GNU General Public License, version 3.",
    ]
    rows = [*enumerate(texts), (4, texts[4]), (4, "cc by nc"), (None, texts[3])]
    got = licenses.scan(table(spark, rows)).collect()
    assert len(got) == len(rows)
    want = Counter()
    for i, t in rows:
        found = {p.label: brute_places(t, p.text) for p in licenses.PHRASES}
        places = [x for _, at in found.values() for x in at]
        want[i, found["mit"][0], len(places), min(places, default=None), max(places, default=None), ",".join(sorted(k for k, (_, at) in found.items() if at))] += 1
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == want
    by = {r.doc_id: r for r in got}
    assert by[8].labels == "mit" and by[8].n_base == 0 and 0.75 <= by[8].score < 1
    assert by[9].labels == "" and by[9].score == 0 and by[11].labels == "gpl" and by[5].labels == "apache-2,cc-by-nc" and by[5].score == 1
    assert licenses.scan(table(spark, rows).limit(0)).count() == 0


def brute_contaminations(docs, items, t=0.8):
    out = {}
    split = lambda x: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (x or "").translate(ASCII))
    for i, text in docs:
        words = split(text)
        for k, item in items:
            theirs = split(item)
            if not theirs:
                continue
            n = min(5, len(theirs))
            want = Counter(tuple(theirs[j : j + n]) for j in range(len(theirs) - n + 1))
            best = (0.0, 0)
            for at in range(len(words) - len(theirs) + 1):
                w = words[at : at + len(theirs)]
                have = Counter(tuple(w[j : j + n]) for j in range(len(w) - n + 1))
                both = sum((want & have).values())
                best = max(best, (both / (2 * sum(want.values()) - both), -at))
            if best[0] >= t:
                out[i, k] = (-best[1], len(theirs), round(best[0], 9))
    return out


def test_decontamination(spark):
    rng = np.random.default_rng(5)
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 400, n))
    items = [(k, word(n)) for k, n in enumerate((3, 4, 5, 20, 60, 90, 1))] + [(10, None), (11, " ."), (12, "a b a b a b a b a b a b")]
    changed = items[5][1].split()
    changed[40] = "other"
    docs = [(0, None), (1, ""), (2, word(300))]
    docs += [(10 + k, f"{word(50)} {(t or '').upper()}! {word(30)}") for k, t in items]
    docs += [(30, " ".join([word(20), *changed, word(9)])), (31, items[4][1]), (32, items[4][1] + " " + items[3][1]), (33, "B a b a b a b a b a b a b"), (31, items[4][1]), (31, "other text")]
    got = decontam.contaminations(table(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute_contaminations(dict.fromkeys(docs), items)
    assert {(r.doc_id, r.item_id): (r.first_word, r.n_words, round(r.similarity, 9)) for r in got} == want
    assert len(got) == len(want) and (30, 5) in want
    clean = decontam.drop_contaminated(table(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, t in docs if not brute_contaminations([(i, t)], items))
    assert decontam.contaminations(table(spark, docs), spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert decontam.contaminations(table(spark, docs).limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_decontamination_finds_pairs_beyond_its_radius(spark):
    """Windows of 0.8 and more in which words were changed one by one: nearly all are found, whatever their fingerprints."""
    rng = np.random.default_rng(15)
    items, docs = [], []
    for k in range(240):
        n = int(rng.choice([30, 45, 60, 90, 140]))
        words = [f"w{x}" for x in rng.integers(0, 9000, n)]
        items.append((k, " ".join(words)))
        other, changed = n - 4, list(words)
        while True:  # as many changes as keep the similarity
            trial = list(changed)
            trial[int(rng.integers(0, n))] = f"x{rng.integers(0, 9000)}"
            a, b = (Counter(tuple(w[i : i + 5]) for i in range(n - 4)) for w in (words, trial))
            both = sum((a & b).values())
            if both < 0.8 * (2 * other - both):
                break
            changed = trial
        docs.append((1000 + k, " ".join([*(f"y{x}" for x in rng.integers(0, 9000, 20)), *changed])))
    got = decontam.contaminations(table(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert len({(r.doc_id, r.item_id) for r in got.collect()} & {(1000 + k, k) for k in range(240)}) >= 238


def test_language_against_brute_force(spark):
    rng = np.random.default_rng(16)
    words = {"en": "the of and thing ther".split(), "de": "der und schön keit einß".split(), "fr": "le la des et une".split()}
    rows = []
    for i in range(90):
        lang = ("en", "en", "en", "de", "fr")[i % 5]  # an uneven prior
        rows.append((i, " ".join(rng.choice(words[lang], int(rng.integers(1, 300)))), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for cells in (1 << 22, 3 << 10):
        model = langid.fit(docs.select("text", "lang"), cells=cells)
        seen, docs_of = {x: Counter() for x in model.langs}, Counter()
        buckets = lambda t: [int(b) >> model.shift for at, _ in langid._grams([t]) for b in at]
        for _, text, lang in rows:
            seen[lang].update(buckets(text))
            docs_of[lang] += 1
        size = langid.BUCKETS >> model.shift
        assert size * len(model.langs) <= max(cells, len(model.langs))
        for r in langid.predict(docs, model).collect():
            mine = buckets(r.text)
            score = {x: np.log(docs_of[x] / 90) + sum(np.log((c[b] + 0.1) / (sum(c.values()) + 0.1 * size)) for b in mine) for x, c in seen.items()}
            best = max(score.values())
            assert score[r.lang_pred] >= best - 1e-2 * max(1, abs(best) / 1000)


def test_many_languages(spark):
    rows = [(i, f"word{i % 300} tongue{i % 300}", f"lang{i % 300:03}") for i in range(600)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").select("text", "lang"))
    assert len(model.langs) == 300 and model.weight.size <= langid.CELLS


def stage_tables(spark, folder, docs, labels, items):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    """Nulls in every column, blanks, a very long text, repeats, ties, no rows, and columns named like the stages' own."""
    import corpus_pipeline

    rng = np.random.default_rng(17)
    words = "the of and thing ther stone river cloud light house paper green under water".split()
    texts = [" ".join(rng.choice(words, 40)) for _ in range(60)]
    item = " ".join(f"item{k}" for k in range(30))
    texts += [None, "", " \t", "123 ---", "x" * 300_000, " ".join(rng.choice(words, 50_000)), texts[0], texts[1] + " end", item, "a"]
    rows = [(i, t, None if i % 7 == 0 else "en", "k", i, "th", 1) for i, t in enumerate(texts)]
    rows += [(3, texts[3], "en", "k", 3, "th", 1), (3, "another text of the same document number", "en", "k", 3, "th", 1), (None, texts[5], None, None, None, None, None), (None, None, None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, component_id string, score long, th string, predicted int"
    docs = spark.createDataFrame(rows, schema)
    labels = [(i, 1, int(i % 2 == 0)) for i in range(40)] + [(None, None, None), (5, 1, None)]
    for n, (table_, items) in enumerate(((docs, [(1, item), (None, None), (2, "")]), (docs.limit(0), [(1, item)]), (docs, []))):
        sf = f"{tmp_path}/{n}"
        stage_tables(spark, sf, table_, labels if n < 2 else [], items)
        before = spark.read.parquet(f"{sf}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, before, sf)
            after.write.parquet(f"{sf}/{name}")
            after = spark.read.parquet(f"{sf}/{name}")
            if name == "byte_bpe":
                assert after.count() == before.count()
                continue
            assert after.columns == docs.columns
            kept, had = Counter(map(tuple, after.collect())), Counter(map(tuple, before.collect()))
            assert all(had[r] >= k for r, k in kept.items())
            if name == "language_id" and n == 0:
                assert not {60, 61, 62, 63} & {r[0] for r in kept} and {64, 65} <= {r[0] for r in kept} | {64}
            if name == "toxicity" and n == 2:
                assert kept == had
            if name == "near_dedup" and n == 0:
                assert max(kept.values()) == 1 and 66 not in {r[0] for r in kept}
            if name == "decontamination" and n == 0:
                assert 68 in {r[0] for r in had} and 68 not in {r[0] for r in kept}
            before = after


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    from scriptloom.llm.common import table as read

    sf = "/root/testdata/sf0.001"
    docs = read(spark, sf, "documents")
    before, names = docs, []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, sf)
        names.append(name)
        if name != "byte_bpe":
            assert after.columns == docs.columns and after.count() <= before.count()
        after.write.parquet(str(tmp_path / name))
        before = spark.read.parquet(str(tmp_path / name))
    assert names == ["language_id", "toxicity", "near_dedup", "decontamination", "byte_bpe"]
    kept = {r.doc_id for r in before.collect()}
    deduped = spark.read.parquet(str(tmp_path / "near_dedup")).collect()
    words = [(r.text or "").lower().split() for r in deduped]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for w in words]
    assert all(len(a & b) < 0.8 * len(a | b) for n, a in enumerate(sets) for b in sets[:n])
    dropped = {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "toxicity")).collect()}
    for r in deduped:
        dropped.pop(r.doc_id)
    for text in dropped.values():  # each is linked to another document, none goes for a near fingerprint alone
        w = (text or "").lower().split()
        own = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
        others = [*sets, *({tuple(v[i : i + 5]) for i in range(len(v) - 4)} or {tuple(v)} for v in ((t or "").lower().split() for t in dropped.values() if t is not text))]
        assert any(len(own & b) >= 0.8 * len(own | b) for b in others)
    found = brute_contaminations([(r.doc_id, r.text) for r in deduped], [(r.item_id, r.text) for r in read(spark, sf, "benchmark").collect()][:5])
    assert kept.isdisjoint(i for i, _ in found) and len(kept) > 0.7 * docs.select(F.col("text")).distinct().count()
