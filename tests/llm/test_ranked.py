"""Resampling, packing and search against brute force, on small tables with nulls, blanks, repeats and long texts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scriptloom.llm import importance, packing, search, wordhash

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, score string, rank string, key string, weight string, cell string"
rng = random.Random(11)
VOCABULARY = ["the", "of", "Éa", "漢字", "x" * 70, "y" * 5000, *(f"w{i}" for i in range(60))]
TEXTS = [" ".join(rng.choices(VOCABULARY, [20, 15] + [1] * 64, k=rng.choice([1, 5, 25, 60]))) for _ in range(120)]
TEXTS += [None, "", "  -- !", "THE of, the-of", "the " * 30_000, TEXTS[3], TEXTS[3].upper()]


def documents(spark, rows):
    """With columns whose names clash with results."""
    return spark.createDataFrame([(i, t, "a", "b", "c", "d", "e") for i, t in rows], SCHEMA)


def words(text):
    return WORD.findall((text or "").translate(ASCII))


def runs(text):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def test_buckets_are_those_of_the_joined_words():
    texts = [(t or "").encode() for t in TEXTS[:20] + TEXTS[-7:-4]] + [b"a" * 64 + b" " + b"b" * 63, b"c " * 3]
    doc, bucket = importance.features(wordhash.Words(texts))
    got = defaultdict(Counter)
    for d, b in zip(doc.tolist(), bucket.tolist(), strict=True):
        got[d][b] += 1
    for i, t in enumerate(texts):
        assert got[i] == Counter(zlib.crc32(f.encode()) % 10_000 for f in runs(t.decode()))


def brute_resampled(rows, target):
    count = lambda texts: Counter(zlib.crc32(f.encode()) % 10_000 for t in texts for f in runs(t))
    s, t = count(t for _, t in rows), count(target)
    all_s, all_t = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000))))
    out = []
    for i, text in rows:
        own = runs(text)
        weight = sum(gain(zlib.crc32(f.encode()) % 10_000) for f in own)
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((i, len(own), weight, score, len(words(text))))
    may = sorted((-x[3], x[0]) for x in out if x[4] >= 20 and x[3] is not None)
    drawn = may[: 5 * len(may) // 100]
    left, got = Counter(drawn), []
    for x in out:
        place = (-x[3], x[0]) if x[3] is not None and x[4] >= 20 else None
        rank = None
        if place in left and left[place]:
            rank = drawn.index(place) + left[place]
            left[place] -= 1
        got.append((*x[:4], rank))
    return sorted(got, key=str)


def test_resampling(spark, monkeypatch):
    monkeypatch.setattr(importance, "BLOCK", 500)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (3, "another text of one id"), (None, TEXTS[5])]
    target = [TEXTS[7], None, "the of the", ""]
    items = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(importance.importance(documents(spark, rows).repartition(5), items))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_resampled(rows, target)


def test_resampling_without_rows(spark):
    none, items = documents(spark, []), spark.createDataFrame([("the of",)], "text string")
    assert importance.resample(importance.importance(none, items)).count() == 0
    got = importance.resample(importance.importance(documents(spark, [(1, "the of"), (2, None)]), items.limit(0)))
    assert sorted(map(tuple, got.collect())) == brute_resampled([(1, "the of"), (2, None)], [])


@pytest.mark.parametrize("capacity", [2048, 64])
def test_cuts_fill_sequences(capacity):
    first = packing.cuts(capacity)
    assert first[0] == 0 and first[1] == 1
    for n in range(1, 3 * capacity):
        pieces = packing.pieces_of(n, first)
        assert sum(pieces) == n and max(pieces) <= capacity
        assert all(capacity - (capacity // z) * z <= capacity // 256 for z in pieces)


def test_packing(spark):
    files = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
    whole = Tokenizer.from_file(files[1])
    texts = [*TEXTS, "a<|endoftext|>b", " \n" * 300_000 + "x", "z" * 20_000]
    rows = list(enumerate(texts)) + [(3, TEXTS[3]), (None, "no id")]
    want = defaultdict(list)
    for i, t in rows:
        want[i].append([*whole.encode(t or "", add_special_tokens=False).ids, 1])
    pieces = packing.pack(documents(spark, rows).repartition(3), lambda: packing.byte_encoder(*files), 1)
    got = pieces.withColumn("crc", F.crc32("ids")).collect()
    assert pieces.columns == ["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset"]
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert ids and r.crc == zlib.crc32(r.ids)
        by_doc[r.doc_id].append((r.start, ids, r.doc_tokens))
        by_sequence[r.sequence_id].append((r.offset, len(ids)))
    assert by_doc.keys() == want.keys()
    for i, lists in want.items():
        covered = Counter(s + k for s, ids, _ in by_doc[i] for k in range(len(ids)))
        assert covered == Counter(k for ids in lists for k in range(len(ids)))
        if len(lists) == 1:
            assert [x for _, ids, _ in sorted(by_doc[i]) for x in ids] == lists[0]
            assert {n for *_, n in by_doc[i]} == {len(lists[0])}
    padding = total = 0
    for places in by_sequence.values():
        end = 0
        for offset, size in sorted(places):
            assert offset == end
            end += size
        assert end <= 2048
        total += end
        padding += 0 if end & (end - 1) == 0 else 2048 - end
    assert padding <= total / 200
    again = packing.pack(documents(spark, rows).repartition(3).limit(0), lambda: packing.byte_encoder(*files), 1)
    assert again.count() == 0


def brute_search(rows, items, k=10):
    docs = [(i, Counter(words(t))) for i, t in rows if words(t)]
    n_docs, total = len(docs), sum(c.total() for _, c in docs)
    df = Counter(w for _, c in docs for w in c)
    asked, out = defaultdict(set), []
    for i, t in items:
        asked[i] |= set(words(t))
    for item, terms in asked.items():
        scored = []
        for i, c in docs:
            slow = 100 - 90 + (90 * c.total() * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * c[w]) // (1000 * c[w] + 8 * slow)) for w in terms if w in c)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [200_000, 7])
def test_search(spark, monkeypatch, block):
    monkeypatch.setattr(search, "BLOCK_ROWS", block)
    monkeypatch.setattr(search, "SHARD_DOCS", 9)
    rows = list(enumerate(TEXTS)) + [(3, TEXTS[3]), (3, TEXTS[3]), (None, TEXTS[3]), (None, "w1 w2")] + [(1000 + i, "w1 w2 tie") for i in range(14)]
    items = [(i, TEXTS[i + 20]) for i in range(12)] + [(20, None), (21, "nowhere-at-all"), (22, "w1 w2 tie"), (23, "THE of"), (23, "w5"), (None, "w7 w8"), (24, TEXTS[3]), (24, TEXTS[3])]
    queries = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, term int")
    terms = search.stored(search.item_terms(queries))
    docs = documents(spark, rows).repartition(5)
    want = brute_search(rows, items)
    asked = search.stored(search.build_index(docs, terms.select("term")))
    whole = search.stored(search.build_index(docs))
    for index in (asked, whole):
        got = search.search(index, terms)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, got.collect()), key=str) == want
    assert search.search(search.stored(search.build_index(docs.limit(0))), terms).count() == 0
    assert search.search(whole, terms.limit(0)).count() == 0


def test_numbers_as_bytes():
    values = np.array([0, 1, 127, 128, 300, 16_383, 16_384, 2**31, 2**40 + 5])
    assert search.unpack_numbers(search.pack_numbers(values)).tolist() == values.tolist()
    assert search.unpack_numbers(search.pack_numbers(values[:0])).tolist() == []


def test_language_scores_take_the_whole_text(spark):
    from scriptloom.llm import langid

    long = "the of and then there " * 400
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the of and", "en"), ("der die und", "de"), (long, "en"), ("und die der " * 300, "de"), ("the die", "en"), (None, "de"), ("12", None), ("Über und the", "de")] * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learned(docs)
    for r in langid.predict(docs, model).collect():
        total = np.zeros(len(model.langs))
        for buckets, begins in langid._grams([r.text or ""]):
            for b in buckets[begins[0] : begins[1]]:
                total += model.weight[b >> model.shift].astype(float)
        total += model.prior
        share = np.exp(total - total.max())
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred == model.langs[int(total.argmax())]
            assert abs(r.score - (share / share.sum()).max()) < 1e-9
