"""Operators on conversations, URLs, pages and vectors against brute force."""

import hashlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from scriptloom.llm import chat, embeddings, urlrules, warc


def test_reconstruction(spark):
    rows = [
        ("a", 1, 1, "message", "user", "hi "), ("a", 2, 1, "delta", None, "there"), ("a", 3, 2, "message", "assistant", None), ("a", 4, 2, "delta", None, "wrong"),
        ("a", 5, 3, "message", "user", "gone"), ("a", 6, 2, "regenerate", None, None), ("a", 7, 2, "delta", None, "right"), ("a", 8, 1, "edit", None, "hello"),
        ("a", 9, 4, "message", "user", "<|end|>\\<|"), ("b", 1, 9, "delta", None, "never opened"), (None, 1, 1, "message", None, "n"), ("a", 10, 4, "strange", None, "x"),
    ]
    events = spark.createDataFrame(rows, "conv_id string, seq long, msg long, kind string, role string, text string")
    got = chat.reconstruct(events)
    assert {(r.conv_id, r.msg, r.role, r.text) for r in got.collect()} == {("a", 1, "user", "hello"), ("a", 2, "assistant", "right"), ("a", 4, "user", "<|end|>\\<|"), (None, 1, "", "n")}
    back = {r.conv_id: r for r in chat.read_back(chat.render(got)).collect()}
    assert [(t.role, t.text) for t in back["a"].turns] == [("user", "hello"), ("assistant", "right"), ("user", "<|end|>\\<|")]
    assert back["a"].learned == ["right"]
    assert chat.render(chat.reconstruct(events.limit(0))).count() == 0


def test_derived_log_gives_its_messages_back(spark):
    rng = np.random.default_rng(2)
    rows = [(i // 12, i % 12 + 1, ["user", "assistant", None][i % 3], [None, "", "é" * int(rng.integers(1, 90)), "<|text|>" * 9][i % 4]) for i in range(96)]
    turns = spark.createDataFrame(rows, "conv_id long, msg int, role string, text string")
    log = chat.derived_log(turns)
    kinds = Counter(r.kind for r in log.collect())
    assert min(kinds[k] for k in chat.KINDS) > 10 and kinds["delta"] > kinds["message"] > 96
    got = {(r.conv_id, r.msg, r.role, r.text) for r in chat.reconstruct(log.repartition(7)).collect()}
    assert got == {(c, m, r or "", t or "") for c, m, r, t in rows}
    assert chat.derived_log(turns.limit(0)).count() == 0


def test_nulls_in_rendered_messages(spark):
    df = spark.createDataFrame([(1, 1, 1, None, None), (1, 1, 1, None, None), (None, 2, 1, "assistant", "a")], "conv_id long, opened long, msg long, role string, text string")
    got = {r.conv_id: ([(t.role, t.text) for t in r.turns], r.learned) for r in chat.read_back(chat.render(df)).collect()}
    assert got == {1: ([("", ""), ("", "")], []), None: ([("assistant", "a")], ["a"])}


def test_any_text_comes_back(spark):
    parts = ["<|", "|>", "\\", "<\\|", "<|start|>", "<|text|>", "<|end|>\n", "é", "\n", "</s>", ""]
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(parts, rng.integers(0, 8))) for _ in range(300)]
    rows = [(i // 10, i, ["user", "assistant", "<|text|>\n"][i % 3], t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "conv_id long, msg long, role string, text string").withColumn("opened", F.col("msg"))
    for r in chat.read_back(chat.render(df)).collect():
        own = [x for x in rows if x[0] == r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == [(x[2], x[3]) for x in own]
        assert r.learned == [x[3] for x in own if x[2] == "assistant" and x[3]]


def brute_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:cut], rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def test_urls(spark):
    urls = [None, "", "x", "http://", "http://A.É.org", "https://Example.org/es/x?y#z", "http://a.example.org/en/12", "http://notexample.org/es/", "ftp://b.com?x://y/", "http://c.com#/fr/", "http://c.com/fr/a", "http://c.com/de/", "a://b://c/d", "http://q.net/casino/win"]
    bulk = [f"http://s{i}.com/de/casino/{i}" for i in range(60)] + [f"http://t{i}.com/fr/news/{i}" for i in range(60)] + ["http://new.net/casino/9", "http://old.net/news/9"]
    rows = [*enumerate(urls + bulk), (5, urls[5]), (5, urls[5]), (None, urls[6])]
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in rows], "page_id long, url string, host string, path string")
    got = urlrules.judge(pages).collect()

    def rule(host, path):
        fits = [r for r in urlrules.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return max(fits, key=lambda r: len(r.host + r.path), default=None)

    want = Counter()
    for i, u in rows:
        host, path = brute_url(u)
        r = rule(host, path)
        want[i, host, path, r and r.host + r.path] += 1
    assert Counter((r.page_id, r.host, r.path, r.rule) for r in got) == want
    for r in got:
        if r.rule:
            assert r.verdict == rule(r.host, r.path).verdict and r.by == "rule"
    by = {r.host: (r.verdict, r.by) for r in got}
    assert by["new.net"] == ("block", "mined") and by["old.net"] == ("allow", "mined") and by["notexample.org"] == ("allow", "rule")
    assert urlrules.judge(pages.limit(0)).count() == 0


def test_mined_rules(spark):
    rows = [(["a", "b", "c"], "block")] * 30 + [(["a", "d"], "allow")] * 30 + [(["b"], "allow")] * 30
    rules = urlrules.mine(spark.createDataFrame(rows, "tokens array<string>, label string"))
    got = {(tuple(r.need), r.verdict, r.rarest) for r in rules.collect()}
    # longer rules than {c}, {d}, {a, b} say nothing more
    assert got == {(("c",), "block", "c"), (("d",), "allow", "d"), (("a", "b"), "block", "a")}


def brute_rules(rows, support, confidence):
    """All rules of one label over all sets of tokens, by counting."""
    from itertools import combinations

    held, with_label = Counter(), Counter()
    for tokens, label in rows:
        for k in range(1, len(tokens) + 1):
            for part in combinations(sorted(tokens), k):
                held[part] += 1
                with_label[part, label] += 1
    found = {(p, v): c / held[p] for (p, v), c in with_label.items() if c >= support * len(rows) and c / held[p] >= confidence}
    return {k: c for k, c in found.items() if not any(found.get((tuple(x for x in k[0] if x != t), k[1]), -1) >= c for t in k[0])}


def test_rules_against_counting(spark):
    rng = np.random.default_rng(21)
    rows = []
    for _ in range(300):
        tokens = sorted({f"t{x}" for x in rng.integers(0, 7, 5)})
        bad = {"t0", "t1", "t2", "t3"} <= set(tokens) or "t6" in tokens
        rows.append((tokens, "block" if bad else "allow"))
    got = urlrules.mine(spark.createDataFrame(rows, "tokens array<string>, label string"))
    got = {(tuple(r.need), r.verdict): r.confidence for r in got.collect()}
    want = brute_rules(rows, urlrules.SUPPORT, urlrules.CONFIDENCE)
    assert got.keys() == want.keys() and max(len(n) for n, _ in got) >= 4
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert urlrules.mine(spark.createDataFrame([(None, "block"), (["a"], None)], "tokens array<string>, label string")).count() == 0


def expected_records(rows):
    first = {}
    for i, html in rows:
        if i is not None:
            d = (html or "").encode()
            first[d] = min(first.get(d, i), i)
    out = Counter()
    for i, html in rows:
        d = (html or "").encode()
        again = len(d) >= 100 and d in first and first[d] != i
        out[i, len(d), hashlib.sha256(d).hexdigest(), "revisit" if again else "response", first[d] if again else None] += 1
    return out


def test_warc(spark, tmp_path, monkeypatch):
    magic = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    html = [None, "", "short", "short", "x" * 150, "x" * 150, "é" * 60, magic, magic * 3 + "tail", "WARC/1.0\r\n", "a\r\n\r\nb" * 40, magic * 3 + "tail", "y" * 5_000, "x" * 150]
    rows = [*enumerate(html), (4, html[4]), (None, html[4]), (None, "null id"), (2, "another")]
    pages = spark.createDataFrame([(i, f"http://x/{i}\r\n", h, "d") for i, h in rows], "page_id long, url string, html string, digest string")
    for bound, size in ((0, "128m"), (100, "600")):  # the second cuts a file into many splits
        monkeypatch.setattr(warc, "BROADCAST_ROWS", bound)
        path = f"file://{tmp_path}/{bound}"
        warc.write(warc.with_types(pages).coalesce(1), path)
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        got = warc.read(spark, path).collect()
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert Counter(map(tuple, got)) == expected_records(rows)
    warc.write(warc.with_types(pages.limit(0)), f"file://{tmp_path}/none")
    assert warc.read(spark, f"file://{tmp_path}/none").count() == 0


def test_forest_brings_pairs_together_at_every_depth():
    """Recall of planted pairs at cosine 0.9, and copies, with the forest that 50 thousand to 200 million vectors get."""
    rng = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    base = unit(rng.normal(size=(1500, 64)))
    noise = rng.normal(size=base.shape)
    noise = unit(noise - (noise * base).sum(axis=1, keepdims=True) * base)
    other = 0.9 * base + np.sqrt(1 - 0.81) * noise
    copies = {}
    for n in (50_000, 2_000_000, 200_000_000):
        forest = embeddings.Forest(unit(rng.normal(size=(20_000, 64))), 20_000 / n, embeddings.LEAF, embeddings.trees_for(n), 0.9, embeddings.SPILL, 64, 1)
        one, two = (set(zip(*(v.tolist() for v in forest.leaves(x)), strict=True)) for x in (base, other))
        assert len({row for row, _ in one & two}) >= 0.93 * len(base)
        copies[n] = len(one) / len(base)
    assert copies[2_000_000] < 4 * copies[50_000] and copies[200_000_000] < 12 * copies[50_000]


def vectors(rng):
    base = rng.normal(size=(150, 24))
    near = np.concatenate([base[:30] + rng.normal(size=(30, 24)) * s for s in (0.1, 0.25, 0.35)])
    tight = base[140] + rng.normal(size=(120, 24)) * 0.05
    return [list(map(float, v)) for v in np.concatenate((base, near, tight))]


def test_embeddings(spark):
    rng = np.random.default_rng(7)
    vs = vectors(rng)
    odd = [None, [], [0.0] * 24, [float("nan")] * 24, [float("inf")] + [1.0] * 23, [None, 1.0], vs[0], [2 * x for x in vs[0]], vs[0][:3]]
    rows = [*enumerate(vs + odd), (3, vs[3]), (None, vs[5])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, kept string")
    got = embeddings.near_duplicates(df, leaf=20).collect()
    assert len(got) == len(rows)
    x = np.zeros((len(rows), 24))
    for n, (_, v) in enumerate(rows):
        if v and None not in v and np.isfinite(v).all():
            x[n, : len(v)] = np.float32(v)
    norm = np.linalg.norm(x, axis=1)
    x[norm > 0] /= norm[norm > 0][:, None]
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    plain = {r.vec_id: r for r in got}
    want = {i: int(near[n].sum()) for n, (i, _) in enumerate(rows)}
    links = sum(r.n_links for r in got)
    assert links >= 0.98 * near.sum() and all(plain[i].n_links <= want[i] for i in plain)
    label = np.arange(len(rows))
    for _ in range(len(rows)):
        label = np.minimum(label, np.where(near, label[None, :], len(rows)).min(axis=1))
    least = {g: min(rows[n][0] for n in np.flatnonzero(label == g) if rows[n][0] is not None) for g in set(label)}
    wrong = sum(plain[i].component_id != least[label[n]] for n, (i, _) in enumerate(rows) if i is not None)
    assert wrong <= 2 and all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    assert [plain[len(vs) + k].n_links for k in range(6)] == [0] * 6
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_urls_that_share_many_tokens(spark):
    # one template of 25 tokens in 40 rows, another that shares a few of them
    template = [f"p:t{i}" for i in range(25)]
    rows = [([*template, f"p:x{i}"], "block") for i in range(40)] + [(["h:org", "p:t0"], "allow")] * 300 + [(["h:com"], "block")] * 60
    got = urlrules.mine(spark.createDataFrame(rows, "tokens array<string>, label string"))
    single = {tuple(r.need) for r in got.collect()}
    assert single == {(t,) for t in template[1:]} | {("h:org",), ("h:com",)}
    lists = urlrules.mine_lists(spark.createDataFrame(rows, "tokens array<string>, label string")).collect()
    assert len(lists) == 3


def test_warc_read_with_other_splits(spark, tmp_path, monkeypatch):
    # payloads that hold version lines: their bytes are read once more, when the files are split otherwise
    pages = [(i, f"http://a/{i}", ("x" * (37 * i % 500) + warc.VERSION + f"WARC-Type: response {i}\r\n\r\n") * (1 + i % 3)) for i in range(60)]
    path = str(tmp_path / "warc")
    warc.write(warc.with_types(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)), path)
    key, bodies, calls = "spark.sql.files.maxPartitionBytes", warc._bodies, []

    def other_splits(spark_, path_):
        calls.append(1)
        spark_.conf.set(key, "5000" if len(calls) == 1 else "1700")
        return bodies(spark_, path_)

    monkeypatch.setattr(warc, "_bodies", other_splits)
    try:
        got = {r.page_id: (r.payload_bytes, r.payload_digest) for r in warc.read(spark, path).collect()}
    finally:
        spark.conf.unset(key)
    assert len(calls) == 2
    assert got == {i: (len(h.encode()), hashlib.sha256(h.encode()).hexdigest()) for i, _, h in pages}
