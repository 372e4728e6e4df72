"""The queries of this subpackage against SQL or brute force on the smallest tables, and the pipeline."""

import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from postloom.llm import mixing, queries, tokenizing
from postloom.llm.common import settle


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, sf_dir, name):
    got = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    cursor = con.execute(queries.ORACLES[name])
    names = [x[0] for x in cursor.description]
    want = sorted(str([str(r[names.index(c)]) for c in columns]) for r in cursor.fetchall())
    assert sorted(str([str(r[c]) for c in columns]) for r in got.collect()) == want


def texts(spark, sf_dir):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


def check_pieces(pieces, ids_of):
    at, room = {}, {}
    for p in sorted(pieces, key=lambda p: (p["doc_id"], p["start"])):
        assert p["start"] == at.get(p["doc_id"], 0)
        at[p["doc_id"]] = p["start"] + p["length"]
        if ids_of:
            ids = ids_of[p["doc_id"]]
            assert p["doc_tokens"] == len(ids) and zlib.crc32(ids[p["start"] : at[p["doc_id"]]].tobytes()) == p["ids_crc32"]
    if ids_of:
        assert at == {k: len(v) for k, v in ids_of.items()}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == room.get(p["sequence_id"], 0)
        room[p["sequence_id"]] = p["offset"] + p["length"]
    assert all(n <= 4096 for n in room.values())
    return room


def test_packing(spark, sf_dir):
    tokenizer = tokenizing.word_cache(public_tokenizers.path("word_bpe_49k.json")).tokenizer
    ids = {k: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], dtype="<u4") for k, t in texts(spark, sf_dir).items()}
    room = check_pieces(queries.op9_packing(spark, sf_dir).collect(), ids)
    assert sum(4096 - n for n in room.values() if n & (n - 1)) <= 0.01 * sum(room.values())


def test_token_counts(spark, sf_dir):
    encode = tokenizing.byte_encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    want = {k: len(encode([t])[0]) // 2 + 1 for k, t in texts(spark, sf_dir).items()}
    assert {r["doc_id"]: r["n_tokens"] for r in queries.op7_token_counts(spark, sf_dir).collect()} == want


def test_mixing_is_near_target_and_repeats(spark, sf_dir):
    rows = queries.op6_source_mixing(spark, sf_dir).toPandas()
    assert (rows.taken <= 3 * rows["size"]).all()
    by = rows.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert ((by.taken - by.target).abs() <= 64 + 1e-6).all() and by.target.sum() == pytest.approx(rows["size"].sum())
    again = queries.op6_source_mixing(spark, sf_dir).toPandas()
    assert rows.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()


def test_quality_counts(spark, sf_dir):
    got = {r["doc_id"]: r for r in queries.op8_quality_rules(spark, sf_dir).collect()}
    for k, t in texts(spark, sf_dir).items():
        words = t.encode().split()
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        seen: dict = {}
        for w in windows:
            seen[w] = seen.get(w, 0) + 1
        inside = {i + j for i, w in enumerate(windows) if seen[w] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if x.strip(" \t\n\v\f\r")]
        r = got[k]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(words), sum(len(w.decode()) for w in words), len(inside))
        assert (r["n_symbols"], r["n_dup_lines"]) == (sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)))
        assert r["base_failed"] == (len(words) < 10 or 100 * len(inside) > 20 * len(words)) and not (r["base_failed"] and r["kept"])


def test_licence_base_columns(spark, sf_dir):
    got = {r["doc_id"]: r for r in queries.op5_license_scan(spark, sf_dir).collect()}
    keep = bytes(c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    for k, t in texts(spark, sf_dir).items():
        words = [w.decode() for w in t.encode().translate(keep).split()]
        at = [(i, label) for i in range(len(words)) for p, label in phrases.items() if words[i : i + len(p.split())] == p.split()]
        want = (len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at})))
        assert (got[k]["n_words"], got[k]["n_base"], got[k]["first_word"], got[k]["last_word"], got[k]["base_labels"]) == want
        assert {x for _, x in at} <= set(got[k]["labels"].split(","))


def test_mix_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = {r[0]: r[1:] for r in con.execute(r"""SELECT doc_id, size, sum(size) OVER (PARTITION BY source)::BIGINT FROM (
SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents)""").fetchall()}
    rows = queries.op6_source_mixing(spark, sf_dir).collect()
    assert {r["doc_id"]: (r["size"], r["source_size"]) for r in rows} == want
    sizes = {r["source"]: r["source_size"] for r in rows}
    names, left = sorted(sizes, key=lambda s: (s is None, s or "")), float(sum(sizes.values()))
    weight, targets, free = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, {}, set(sizes)
    while free:
        whole = sum(weight[s] for s in free)
        above = {s for s in free if left * weight[s] / whole > 3 * sizes[s]}
        targets |= {s: 3.0 * sizes[s] for s in above} if above else {s: left * weight[s] / whole for s in free}
        left -= sum(targets[s] for s in above)
        free = free - above if above else set()
    assert all(r["target"] == pytest.approx(targets[r["source"]]) for r in rows)


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, sf_dir))
        kept[name] = docs
        if name != "packing":
            assert docs.columns == columns
    known = {r["doc_id"]: r for r in queries.op4_language_id(spark, sf_dir).collect()}
    assert {r["doc_id"] for r in kept["language_id"].collect()} == {k for k, r in known.items() if r["lang_pred"] != "und" and r["score"] >= corpus_pipeline.LANGUAGE_SCORE}
    good = {r["doc_id"] for r in queries.op8_quality_rules(spark, sf_dir).where("not base_failed").collect()}
    assert {r["doc_id"] for r in kept["quality_rules"].collect()} <= good
    sets = {r["doc_id"]: {tuple((r["text"]).lower().split()[i : i + 5]) for i in range(max(1, len(r["text"].split()) - 4))} for r in kept["quality_rules"].collect()}
    stays = {r["doc_id"] for r in kept["ngram_join"].collect()}
    for k in set(sets) - stays:  # every document that goes has a like of a smaller id
        assert any(j < k and len(sets[j] & sets[k]) >= 0.7 * len(sets[j] | sets[k]) for j in sets)
    for a in stays:
        assert not any(a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for b in stays)
    # the mix: near its targets, and every row made of words that stand together in its document
    before = {r["doc_id"]: r for r in kept["ngram_join"].collect()}
    mixed = kept["source_mixing"].collect()
    assert all(f" {' '.join(r['text'].split())} " in f" {' '.join(before[r['doc_id']]['text'].split())} " for r in mixed)
    words: dict = {}
    for r in mixed:
        words[r["source"]] = words.get(r["source"], 0) + len(r["text"].encode().split())
    targets = {r["source"]: r["target"] for r in mixing.mix(kept["ngram_join"])[0].collect()}
    assert all(abs(words.get(k, 0) - v) <= 64 for k, v in targets.items())
    # the packing: all ids of every mixed row, once each
    tokenizer = tokenizing.word_cache(public_tokenizers.path("word_bpe_49k.json")).tokenizer
    want = sorted((r["doc_id"], len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1) for r in mixed)
    pieces = kept["packing"].collect()
    whole: dict = {}
    for p in pieces:
        if p["start"] == 0:
            whole.setdefault(p["doc_id"], []).append(p["doc_tokens"])
    assert sorted((k, n) for k, v in whole.items() for n in v) == want
    assert sum(p["length"] for p in pieces) == sum(n for _, n in want)
    room: dict = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == room.get(p["sequence_id"], 0)
        room[p["sequence_id"]] = p["offset"] + p["length"]
    assert all(n <= 4096 for n in room.values())


def test_quality_verdicts_by_single_trees(spark, sf_dir):
    """The registered query's verdicts against one document and one tree at a time."""
    import math

    from postloom.llm import quality_rules

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality_rules.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    got = {r["doc_id"]: r for r in queries.op8_quality_rules(spark, sf_dir).collect()}
    for doc, text in texts(spark, sf_dir).items():
        counts, features = quality_rules.statistics(text)
        raw = model.start
        for t in range(model.rounds):
            at = 0
            while at < 2**model.depth - 1 and model.feature[t, at] >= 0:
                at = 2 * at + (2 if features[model.feature[t, at]] > model.cut[t, at] else 1)
            raw += model.rate * model.value[t, at]
        score = 1 / (1 + math.exp(-raw))
        failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
        assert got[doc]["quality_score"] == pytest.approx(score) and got[doc]["kept"] == (not failed and score >= 0.5), doc


def test_mix_takes_what_its_slots_say(spark, sf_dir):
    """Words taken of every document, added up slot by slot from the drawn blocks of its source."""
    import math

    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan, slots = mixing.mix(docs)
    rows = plan.withColumn("bucket", F.pmod(F.xxhash64("mark"), F.lit(max(1, math.isqrt(docs.count()))))).select("doc_id", "mark", "source", "size", "taken", "bucket").collect()
    drawn: dict = {}
    for s in slots.select("source", "block").collect():
        drawn.setdefault(s["source"], []).append(s["block"])
    for source in {r["source"] for r in rows}:
        owner = [r["doc_id"] for r in sorted((r for r in rows if r["source"] == source), key=lambda r: (r["bucket"], r["doc_id"], r["mark"])) for _ in range(r["size"])]
        taken: dict = {}
        for block in drawn.get(source, []):
            for doc in owner[64 * block : 64 * block + 64]:
                taken[doc] = taken.get(doc, 0) + 1
        assert {r["doc_id"]: r["taken"] for r in rows if r["source"] == source and r["taken"]} == taken
