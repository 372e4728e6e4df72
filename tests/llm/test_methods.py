"""The operators' own parts against brute force."""

import itertools
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from postloom.llm import embedding_dedup, language_id, licenses, linking, lm_scoring, mixing, ngram_join, packing, quality_rules, queries, token_counts, tokenizing, words


@given(st.lists(st.sampled_from("abcdé"), max_size=60))
def test_repeated_words(words):
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    inside = {k + i for k, w in enumerate(windows) if windows.count(w) > 1 for i in range(5)}
    assert quality_rules.repeated_words(words)[0] == len(inside)


def test_repeated_words_of_many_kinds():
    many = [f"w{k}" for k in range(5000)] * 2
    assert quality_rules.repeated_words(many) == (10_000, 5000)


def test_trees_are_monotone():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] + 0.3 * np.sin(20 * x[:, 1]) + 0.2 * rng.standard_normal(3000)) < 0.6).astype(float)
    model = quality_rules.Trees(monotone={0: -1}).fit(x, y)
    p = model.probability(x)
    assert ((p > 0.5) == (y > 0.5)).mean() > 0.8
    grid = np.linspace(-1, 2, 60)
    for _ in range(40):
        row = np.repeat(rng.random((1, 3)), 60, axis=0)
        row[:, 0] = grid
        assert (np.diff(model.probability(row)) <= 1e-12).all()


def test_first_fit_is_first():
    rng = random.Random(1)
    for _ in range(30):
        sizes = [rng.randint(1, 100) for _ in range(rng.randint(0, 60))]
        want, room = [], []
        for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
            at = next((b for b, r in enumerate(room) if r >= sizes[k]), len(room))
            if at == len(room):
                room.append(100)
                want.append([])
            room[at] -= sizes[k]
            want[at].append(k)
        assert packing.first_fit_decreasing(sizes, 100) == want


@given(st.lists(st.integers(1, 300), max_size=40))
def test_packing_covers_all(sizes):
    sequences = packing.pack(sizes, 64)
    seen = sorted(p for s in sequences for p in s)
    at = {}
    for doc, start, length in seen:
        assert start == at.get(doc, 0) and length > 0
        at[doc] = start + length
    assert [at[k] for k in range(len(sizes))] == sizes
    whole = [sum(p[2] for p in s) for s in sequences]
    assert all(n == 64 or n & (n - 1) == 0 for n in whole) and all(n <= 64 for n in whole)


PIECES = st.sampled_from([*"aBé É×÷ßñ\u0301\n\t <|>0123.,!?xzİǅ中文яЖ\x1c\x85ªº'", "<|endoftext|>", "<|EndOfText|>", "'re", " don't ", "I'M ", " word, ", "Word! "])


@settings(deadline=None, max_examples=150)
@given(st.lists(st.none() | st.lists(PIECES, max_size=40).map("".join) | st.text(max_size=30), max_size=6), st.sampled_from([8, 64, 1 << 20]))
def test_word_cache(texts, segment):
    import public_tokenizers
    import pyarrow as pa

    cache = tokenizing.word_cache(public_tokenizers.path("word_bpe_49k.json"))
    want = [cache.tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
    before, words.SEGMENT = words.SEGMENT, segment
    try:
        assert [x.tolist() for x in cache.encode(pa.array(texts, pa.string()), 2)] == want
    finally:
        words.SEGMENT = before


def test_word_cache_when_full():
    import public_tokenizers
    import pyarrow as pa

    cache = tokenizing.WordCache(public_tokenizers.path("word_bpe_49k.json"), most=50)
    for k in range(6):
        texts = [f"common word number{j % 40 + 40 * k} and others" for j in range(90)]
        assert [x.tolist() for x in cache.encode(pa.array(texts))] == [cache.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(cache.key) <= 50


@settings(max_examples=100)
@given(st.lists(st.none() | st.text("ab \n\x1cé", max_size=30), max_size=6), st.sampled_from([4, 1 << 20]))
def test_words_of_segments(texts, segment):
    import pyarrow as pa

    before, words.SEGMENT = words.SEGMENT, segment
    try:
        got = [[] for _ in texts]
        for first, data, at in words.segments(pa.array(texts, pa.string())):
            starts, ends, begin = words.spans(data, at)
            marks = words.hashes(data, starts, ends).tolist()
            for k in range(len(at) - 1):
                got[first + k] += [(data[starts[w] : ends[w]].tobytes(), marks[w]) for w in range(begin[k], begin[k + 1])]
    finally:
        words.SEGMENT = before
    assert [[w for w, _ in g] for g in got] == [(t or "").encode().split() for t in texts]
    seen = {x for g in got for x in g}
    assert len({w for w, _ in seen}) == len(seen) == len({h for _, h in seen})


@given(st.integers(1, 5000), st.integers(0, 2**40))
def test_permutation(n, key):
    assert sorted(mixing.permuted(np.arange(n), n, key).tolist()) == list(range(n))


def test_shares():
    assert mixing.share_out([100, 100, 100], [5, 2, 1], 3) == pytest.approx([187.5, 75, 37.5])
    assert mixing.share_out([10, 100, 100, 0], [5, 2, 1, 5], 3) == pytest.approx([30, 120, 60, 0])
    assert mixing.share_out([], [], 3) == [] and mixing.share_out([0], [5], 3) == [0]


@given(st.text("ab(), ", max_size=5).map(lambda t: t), st.integers(0, 3))
def test_expressions_never_fail(text, n):
    licenses.evaluate(licenses.to_postfix(f"mit or {text} and apache-2.0 with {'(' * n}gpl-3.0")[0])


def test_expressions():
    ask = lambda e: licenses.evaluate(licenses.to_postfix(e)[0])
    assert ask("mit or gpl-3.0-only") == ({"mit", "gpl"}, True)
    assert ask("mit and gpl-3.0-only") == ({"mit", "gpl"}, False)
    assert ask("(mit or gpl-2.0) and apache-2.0") == ({"mit", "gpl", "apache"}, True)
    assert ask("gpl-2.0 with classpath-exception-2.0 or isc") == ({"gpl", "isc"}, True)
    assert not licenses.to_postfix("mit or")[1] and not licenses.to_postfix("(mit")[1]
    scan = licenses.Scanner(licenses.BASE_PHRASES, licenses.MORE_PHRASES, licenses.TAGS).scan
    found = scan("x\nSPDX-License-Identifier: MIT OR Apache-2.0\nThe GNU General  Public, License. mit license, MIT-License")
    assert (found["n_base"], found["base_labels"], found["labels"], found["score"]) == (3, "gpl,mit", "apache,gpl,mit", 1.0)
    words = "x spdx license identifier mit or apache 2 0 the gnu general public license mit license mit license".split()
    assert (found["first_word"], found["last_word"], found["n_words"]) == (words.index("general"), len(words) - 2, len(words))


def test_overlaps():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(20)]
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    got = ngram_join.overlaps(sets, chunk=7)
    off = ~np.eye(20, dtype=bool)
    assert (got[off] == want[off]).all()


def test_banding_reaches_recall():
    bands, rows = ngram_join.banding(0.8, 0.9999, 160)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= 160


def test_roots():
    assert linking.roots(6, np.array([4, 1, 3]), np.array([1, 2, 5])).tolist() == [0, 1, 1, 3, 1, 3]


def test_components(spark):
    rng, n = random.Random(5), 300
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(220)] + [(k, k + 1) for k in range(500, 600)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r["node"]: r["component"] for r in linking.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_components_of_a_shuffled_chain(spark, monkeypatch):
    n, written = 3000, []
    ids = [int(x) for x in np.random.default_rng(4).permutation(n)]
    settle = linking.settle
    monkeypatch.setattr(linking, "settle", lambda df: written.append(1) or settle(df))
    found = linking.components(spark.createDataFrame(list(zip(ids, ids[1:])), "a bigint, b bigint"))
    assert found.count() == n and [r["component"] for r in found.select("component").distinct().collect()] == [0]
    assert len(written) < 40


def test_blocks_see_each_pair_once(spark):
    members = spark.createDataFrame([(1, k) for k in range(90)] + [(2, k) for k in range(80, 95)], "group bigint, node bigint")
    nodes = spark.createDataFrame([(k, 1 + k % 2) for k in range(95)], "node bigint, copies bigint")
    found = linking.compare_groups(members, nodes, [], lambda group, rows: np.ones((len(rows), len(rows)), bool), block=16)
    got = {r["node"]: r["n"] for r in found.groupBy("node").agg({"links": "sum"}).withColumnRenamed("sum(links)", "n").collect()}
    for k in range(95):
        others = [x for g in (range(90), range(80, 95)) if k in g for x in g if x != k]
        assert got[k] == sum(1 + x % 2 for x in others)


def test_joined_by_hand(spark):
    rng = random.Random(9)
    base = [f"t{rng.randrange(400)}" for _ in range(120)]
    texts = []
    for k in range(40):
        words = list(base)
        for _ in range(rng.randrange(8)):
            words[rng.randrange(len(words))] = f"new{rng.random()}"
        texts.append(" ".join(words))
    texts += texts[:5]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    links = {k: 0 for k in range(len(texts))}
    for a, b in itertools.combinations(range(len(texts)), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
    assert {r["doc_id"]: r["n_links"] for r in ngram_join.near_duplicates(docs).collect()} == links


def test_vectors_by_hand(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((30, 24))
    x = np.concatenate([centres[rng.integers(0, 30, 500)] + 0.15 * rng.standard_normal((500, 24)), centres[0] + 0.05 * rng.standard_normal((300, 24))]).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    close = u @ u.T >= 0.9
    np.fill_diagonal(close, False)
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(df, window=32).collect()}
    assert all(got[k] <= close[k].sum() for k in got) and sum(got.values()) >= 0.99 * close.sum()


def test_recall_in_a_crowd(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((3000, 32))
    x[:1200] = 1.55 * x[0] / np.linalg.norm(x[0]) * np.sqrt(32) + x[:1200]  # at cosines of about 0.7
    x[1:1200:2] = x[:1200:2] + 0.55 * rng.standard_normal((600, 32))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(df, passes=4, window=4).collect()}
    assert all(got[k] <= near[k].sum() for k in got) and sum(got.values()) >= 0.98 * near.sum() > 400


def test_passes_grow_with_rows():
    at = [embedding_dedup.passes_for(10**k, 0.9, 64, 0.995) for k in (3, 5, 6, 7, 8)]
    assert at[1] <= 24 < at[2] < at[3] < at[4]


def test_boundaries_across_blocks(spark):
    rng = np.random.default_rng(8)
    rows, want = [], []
    for f in ("a", "b", "c"):
        ids = rng.integers(0, 40, 5000 if f != "c" else 50)
        ids[rng.random(len(ids)) < (0.05 if f == "a" else 0.001)] = 99
        cut = np.flatnonzero(ids == 99) + 1
        want += [(f, k, int(s), int(e - s)) for k, (s, e) in enumerate(zip([0, *cut], [*cut, len(ids)])) if e > s]
        rows += [(f, b, ids[at : at + 7].astype("<u4").tobytes()) for b, at in enumerate(range(0, len(ids), 7))]
    blocks = spark.createDataFrame(rows, "file string, block bigint, ids binary")
    before = token_counts._CHUNK
    token_counts._CHUNK = 16
    try:
        got = sorted((r["file"], r["number"], r["start"], r["n_tokens"]) for r in token_counts.documents_in(blocks, 99, width=4).collect())
    finally:
        token_counts._CHUNK = before
    assert got == sorted(want)


def test_flat_files(spark, tmp_path):
    ids = np.array([5, 6, 99, 99, 7, 8], dtype="<u2")
    (tmp_path / "tokens").mkdir()
    (tmp_path / "tokens" / "x.bin").write_bytes(ids.tobytes())
    (tmp_path / "tokens" / "empty.bin").write_bytes(b"")
    blocks = token_counts.read_blocks(spark, f"file://{tmp_path}/tokens", block_bytes=4)
    assert blocks.count() == 3
    got = sorted((r["number"], r["start"], r["n_tokens"], r["ended"]) for r in token_counts.documents_in(blocks, 99).collect())
    assert got == [(0, 0, 3, True), (1, 3, 1, True), (2, 4, 2, False)]


def small_model(scale=1.0):
    classes = {"ab": 4.0, "cd": 2.5, "é": 1.0}
    vocabulary = lm_scoring.Vocabulary([(f"w{k}", 50 - k) for k in range(40)], classes, 3.0, 7, 30)
    vocabulary.edges = np.array([0, 5, 20, 33, 35])
    model = lm_scoring.LogBilinear(vocabulary.edges, vocabulary.mass, 4, 2)
    model.context *= scale
    return vocabulary, model


@pytest.mark.parametrize("scale", [1.0, 4000.0])
def test_log_bilinear_is_normalised(scale):
    vocabulary, model = small_model(scale)
    before = np.array([[3, vocabulary.start, 7], [33, 1, 34]])
    each = [np.exp(model.log_probability(np.repeat(before[:, [k]], 35, axis=1), np.arange(35))).sum() for k in range(3)]
    assert np.allclose(each, 1)


def test_log_bilinear_step_by_step():
    vocabulary, model = small_model()
    rng = np.random.default_rng(1)
    before, word = rng.integers(0, 36, (2, 300)), rng.integers(0, 35, 300)
    got = model.log_probability(before, word)
    for k in range(0, 300, 7):
        q = [sum(float(model.context[before[i, k], j]) * float(model.mix[i, j]) for i in range(2)) for j in range(4)]
        dot = lambda v: sum(x * float(y) for x, y in zip(q, v))
        groups = [dot(v) + float(b) for v, b in zip(model.over, model.top)]
        g = int(model.group[word[k]])
        inside = [dot(model.target[i]) + float(model.bias[i]) for i in range(model.edges[g], model.edges[g + 1])]
        want = groups[g] - np.logaddexp.reduce(groups) + inside[word[k] - model.edges[g]] - np.logaddexp.reduce(inside)
        assert got[k] == pytest.approx(want, abs=1e-5)


def test_scores_word_by_word(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["the", "The", "cat", "sat", "matté", "xé", "rare%d" % rng.randrange(60), "on"]) for _ in range(rng.randrange(12))) for _ in range(120)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    options = {"frequent": 3, "classes": 2, "heavy": 60}
    counts, n, v, shared, broadcast = lm_scoring.learn(docs, **options)
    own, lm = shared.value, broadcast.value
    count = {r["word"]: r["n"] for r in counts.collect()}
    heavy = sorted((w for w in count if count[w] * 60 >= n), key=lambda w: (-count[w], w))
    ends: dict = {}
    for w in set(count) - set(heavy[:3]):
        ends[w[-2:]] = ends.get(w[-2:], 0) + count[w] + 0.5
    classes = sorted(ends, key=lambda s: (-ends[s], s))[:2]
    order = sorted([(w[::-1], 0, w) for w in heavy[:3]] + [(s[::-1], 1, s) for s in classes])
    symbol = {(x[1], x[2]): k for k, x in enumerate(order)}
    rest = sum(ends.values()) - sum(ends[s] for s in classes) + 0.5
    got = {r["doc_id"]: r for r in lm_scoring.score(docs, docs, **options).collect()}
    for k, t in enumerate(texts):
        words_ = (t or "").lower().split()
        ids = [symbol.get((0, w), symbol.get((1, w[-2:]), own.rest)) for w in words_] + [own.end]
        share = [1 if (0, w) in symbol else (count[w] + 0.5) / (ends[w[-2:]] + 0.5 if (1, w[-2:]) in symbol else rest) for w in words_]
        seq = [own.start] * 4 + ids
        want = sum(float(lm.log_probability(np.array([[seq[i + 3 - b]] for b in range(4)]), np.array([seq[i + 4]]))[0]) for i in range(len(ids))) / np.log(10)
        assert got[k]["score"] == pytest.approx(want + sum(np.log10(x) for x in share), abs=1e-4)
        assert got[k]["n_known"] == len(ids)


def test_scores_beat_unigrams(spark, sf_dir):
    rows = queries.op1_lm_scoring(spark, sf_dir).toPandas()
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    words = {k: t.encode().lower().split() for k, t in docs.items()}
    train = [k for k in docs if zlib.crc32(str(k).encode()) % 5 != 1]
    count: dict = {}
    for k in train:
        for w in words[k]:
            count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()) + len(train), len(count) + 1
    for r in rows.itertuples():
        each = [count.get(w, 0) for w in words[r.doc_id]] + [len(train)]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(each), sum(c > 0 for c in each), n)
        assert r.base_score == pytest.approx(sum(np.log10((c + 0.5) / (n + 0.5 * (v + 1))) for c in each))
    out = rows[rows.held_out]
    assert out.score.sum() > out.base_score.sum()


def test_training_depth_and_symbols_grow():
    assert lm_scoring.ROUNDS >= 2 and lm_scoring.WIDTH >= 24
    sizes = [10**k for k in range(6, 11)]
    depth = [n / lm_scoring.tasks_of(n) for n in sizes]
    assert min(depth[1:]) >= 2e6 and depth[-1] > 2 * depth[-2] > 4 * depth[1]
    symbols = [lm_scoring.growth(n) for n in sizes]
    assert symbols[0] == 1 and all(a < b for a, b in zip(symbols, symbols[1:]))


def test_small_partitions_train_as_one(spark):
    rng = random.Random(3)
    texts = [" ".join(x for _ in range(40) for x in rng.choice(["a b", "b c", "c a d"]).split()) for _ in range(400)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    one, many = (sum(r["score"] for r in lm_scoring.score(docs, docs.repartition(n)).collect()) for n in (1, 40))
    assert many == pytest.approx(one, rel=0.02)


def test_rare_words_are_joined(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(60).cache()
    whole = {r["doc_id"]: r for r in lm_scoring.score(docs, docs).collect()}
    joined = {r["doc_id"]: r for r in lm_scoring.score(docs, docs, heavy=500).collect()}
    for k, r in whole.items():
        assert joined[k]["n_known"] == r["n_known"] and joined[k]["base_score"] == pytest.approx(r["base_score"])


def test_held_out_languages(spark, sf_dir):
    rows = queries.op4_language_id(spark, sf_dir).toPandas().set_index("doc_id")
    lang = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").toPandas().set_index("doc_id").lang
    out = rows[rows.held_out]
    assert (out.lang_pred == lang[out.index]).mean() > 0.95


def test_ranks_and_ties():
    codes, counts = np.array([5, 3, 9]), np.array([2, 2, 7])
    assert language_id.ranked(codes, counts, 2).tolist() == [9, 3]


def plain_grams(text):
    flat = "".join(c if ord(c) >= 128 or "a" <= c <= "z" else " " for c in f" {text.lower()} ")
    flat = " " + " ".join(x for x in flat.split(" ") if x) + " "
    seen: dict = {}
    for n in (1, 2, 3):
        for k in range(len(flat) - n + 1):
            g = flat[k : k + n]
            if g.strip() and " " not in g[1:-1]:
                seen[g] = seen.get(g, 0) + 1
    return seen


def plain_profile(seen, size=300):
    return sorted(seen, key=lambda g: (-seen[g], sum(ord(c) << (21 * k) for k, c in enumerate(g))))[:size]


def test_languages_by_hand(spark):
    rng = random.Random(4)
    alphabets = {"xx": "abcde", "yy": "cdefgé", "ru": "абвгд", "zh": "中文字学生"}
    text = lambda lang: " ".join("".join(rng.choice(alphabets[lang]) for _ in range(rng.randint(1, 6))) + rng.choice(["", ",", ". 12 "]) for _ in range(rng.randint(1, 30)))
    rows = [(k, text(lang), lang) for k, lang in enumerate([*alphabets] * 12)] + [(90, "12 !", "xx"), (91, None, "yy"), (92, "Ab", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    sums: dict = {}
    for _, t, lang in rows:
        if t is not None and lang is not None:
            for g, n in plain_grams(t).items():
                own = sums.setdefault(lang, {})
                own[g] = own.get(g, 0) + n
    profiles = {lang: plain_profile(own) for lang, own in sums.items()}
    got = {r["doc_id"]: r for r in language_id.identify(docs, docs).collect()}
    for k, t, _ in rows:
        mine = plain_profile(plain_grams(t)) if t and any(c.isalpha() for c in t) else []
        away = {lang: sum(abs(own.index(g) - i) if g in own else 300 for i, g in enumerate(mine)) for lang, own in profiles.items()}
        best = min(sorted(away), key=away.get) if mine else "und"
        assert got[k]["lang_pred"] == best
        assert got[k]["score"] == pytest.approx(1 - away[best] / (300 * len(mine)) if mine else 0.0)


def test_trees_one_by_one():
    rng = np.random.default_rng(7)
    x = rng.random((400, 4))
    model = quality_rules.Trees(rounds=12, monotone={1: -1}).fit(x, (x[:, 0] > x[:, 1]).astype(float))
    for row, got in zip(x[:60], model.probability(x[:60])):
        raw = model.start
        for t in range(12):
            at = 0
            while at < 7 and model.feature[t, at] >= 0:
                at = 2 * at + 1 + int(row[model.feature[t, at]] > model.cut[t, at])
            raw += model.rate * model.value[t, at]
        assert got == pytest.approx(1 / (1 + np.exp(-raw)))


@pytest.mark.parametrize("n", [2000, 12_000])
def test_recall_of_pairs_that_are_alone(spark, n):
    rng = np.random.default_rng(n)
    x = rng.standard_normal((n, 32))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    away = rng.standard_normal((300, 32))
    away -= (away * u[:300]).sum(axis=1)[:, None] * u[:300]
    x[n - 300 :] = 0.905 * u[:300] + np.sqrt(1 - 0.905**2) * away / np.linalg.norm(away, axis=1)[:, None]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = {r["vec_id"]: r["component_id"] for r in embedding_dedup.near_duplicates(df, passes=1, window=16).collect()}
    assert sum(got[n - 300 + k] == got[k] for k in range(300)) >= 0.95 * 300
