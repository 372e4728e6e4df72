"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postloom.llm import common, embedding_dedup, language_id, licenses, lm_scoring, mixing, ngram_join, packing, quality_rules, token_counts, tokenizing, url_filter

LONG = " ".join(f"word{k % 977} and" for k in range(60_000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog near the river bank today", "en", "a"),
    (1, "the quick brown fox jumps over the lazy dog near the river bank today", "en", "a"),
    (2, "the quick brown fox jumps over the lazy dog near the river bank today", "en", None),
    (3, None, None, None),
    (4, "", "en", "b"),
    (5, " \n\t ", None, "b"),
    (None, "der schnelle braune fuchs springt über den faulen hund am fluss", "de", "b"),
    (6, "12345 --- 67890", "de", "c"),
    (7, LONG, "en", "a"),
    (8, "mit license", "xx", "é"),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string, source string")
    clash = ("node", "group", "row", "score", "size", "ord", "block", "key", "bands", "file", "number", "n", "word", "bucket", "start", "real", "deal", "draws")
    return df.select("*", *[F.lit(k).alias(k) for k in clash]).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_language(docs, none):
    found = by_id(language_id.identify(docs, docs))
    assert found[3]["lang_pred"] == found[4]["lang_pred"] == found[5]["lang_pred"] == found[6]["lang_pred"] == "und"
    assert found[1]["lang_pred"] == "en" and found[None]["lang_pred"] == "de" and 0 <= found[7]["score"] <= 1
    assert language_id.identify(docs, docs).count() == len(ROWS)
    assert language_id.identify(none, none).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(docs, none).collect()} == {"und"}


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (7, 0)], "doc_id bigint, quality int")
    assert quality_rules.train(docs, labels) is None  # one class is left
    found = by_id(quality_rules.with_statistics(docs))
    assert [found[k]["n_words"] for k in (3, 4, 5, 6)] == [0, 0, 0, 3] and found[3]["base_failed"] and not found[3]["kept"]
    assert found[1]["kept"] and found[7]["n_words"] == 120_000 and found[7]["base_failed"]
    assert quality_rules.with_statistics(none).count() == 0 and quality_rules.train(none, labels) is None


def test_lm(docs, none):
    found = by_id(lm_scoring.score(docs, docs))
    assert found[3]["n_tokens"] == found[4]["n_tokens"] == found[5]["n_tokens"] == 1
    assert found[7]["n_tokens"] == 120_001 and all(np.isfinite(r["score"]) and r["score"] <= 0 for r in found.values())
    assert lm_scoring.score(docs, docs).count() == len(ROWS)
    assert {(r["train_tokens"], r["score"]) for r in lm_scoring.score(docs, none).collect()} == {(0, 0.0)}
    assert lm_scoring.score(none, docs).count() == 0


def test_licenses(docs, none):
    found = by_id(licenses.scan_licenses(docs))
    assert (found[8]["n_base"], found[8]["first_word"], found[8]["labels"]) == (1, 0, "mit")
    assert (found[3]["n_words"], found[3]["labels"], found[3]["score"], found[3]["first_word"]) == (0, "", 0.0, None)
    assert found[7]["n_words"] == 120_000 and licenses.scan_licenses(none).count() == 0


def test_join(docs, none):
    found = ngram_join.near_duplicates(docs).collect()
    by = {}
    for r in found:
        by.setdefault(r["doc_id"], []).append((r["class_id"], r["n_links"]))
    assert by[1] == [(1, 2), (1, 2)] and by[2] == [(1, 2)]
    assert by[3] == [(3, 0)] and by[4] == [(4, 0)] and by[None] == [(None, 0)] and by[8] == [(8, 0)]
    assert ngram_join.near_duplicates(none).count() == 0
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 7, 8]
    assert ngram_join.one_of_each(none).count() == 0


def test_mixing(docs, none):
    plan, _ = mixing.mix(docs)
    rows = plan.collect()
    assert len(rows) == len(ROWS) and all(r["taken"] <= 3 * r["size"] for r in rows)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len(r["text"].encode().split()) for r in mixed.collect()) == sum(r["taken"] for r in rows)
    assert mixing.mix(none)[0].count() == 0 and mixing.mixed_documents(none).count() == 0


def test_packing(docs, none):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    pieces = packing.pack_documents(docs, path).collect()
    assert sum(p["length"] for p in pieces) == sum(map(len, tokenizing.word_cache(path).encode(pa.array([r[1] for r in ROWS]), 2)))
    assert {p["doc_id"] for p in pieces} == {r[0] for r in ROWS} and packing.pack_documents(none, path).count() == 0


def test_token_files(docs, none):
    encoder = lambda: lambda texts: [np.frombuffer((t or "").encode(), np.uint8).astype("<u2").tobytes() for t in texts]
    blocks, names = token_counts.write_stream(docs, encoder, 256, 1000, 0)
    found = token_counts.documents_in(blocks, 256).join(names, ["file", "number"]).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in found) == sorted((r[0] or 0, len((r[1] or "").encode()) + 1) for r in ROWS)
    blocks, names = token_counts.write_stream(none, encoder, 256, 1000, 0)
    assert token_counts.documents_in(blocks, 256).count() == 0


def test_token_files_cut_inside_documents(spark, docs, none, tmp_path):
    """Real flat files, read in ranges of 64 bytes that cut documents anywhere; what a failed task has left is not read."""
    encoder = lambda: lambda texts: [np.frombuffer((t or "").encode(), np.uint8).astype("<u2").tobytes() for t in texts]
    names = token_counts.write_files(docs.repartition(3), encoder, 256, f"file://{tmp_path}/tokens")
    (tmp_path / "tokens" / "part-000000-999.bin").write_bytes(b"\x01\x00" * 50)
    short = docs.where("length(text) < 1000 or text is null")
    few = token_counts.write_files(short, encoder, 256, f"file://{tmp_path}/few")
    for folder, files, block, rows in (("tokens", names, 1 << 16, ROWS), ("few", few, 64, [r for r in ROWS if r[1] is None or len(r[1]) < 1000])):
        found = token_counts.documents_in(token_counts.read_blocks(spark, f"file://{tmp_path}/{folder}", block, files), 256).join(files, ["file", "number"]).collect()
        assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in found) == sorted((r[0] or 0, len((r[1] or "").encode()) + 1) for r in rows)
    files = token_counts.write_files(none, encoder, 256, f"file://{tmp_path}/none")
    assert token_counts.documents_in(token_counts.read_blocks(spark, f"file://{tmp_path}/none", 64, files), 256).count() == 0


def test_letters_only(docs):
    """Numerals, marks, signs and emoji are no letters, letters of any script are."""
    table = language_id.Profiles(language_id.learn_profiles(docs))
    for text in ("½", "12²", "①", "٣", "🙂", "--- !?", "\u0301", "_", "’"):
        assert table.predict(text) == ("und", 0.0), text
    for text in ("a1", "é", "字", "½ a"):
        assert table.predict(text)[0] != "und", text


def test_urls(spark):
    rows = [(1, "HTTP://A.Example.NET/en/x?utm_source=a#f"), (2, None), (3, "no host"), (4, "https://example.net"), (5, "http://spam.org/x/"), (6, "https://www.spam.org/x?ref=1"), (6, "https://www.spam.org/x?ref=1"), (7, "http://spam.org/fr/x"), (8, "")]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id bigint, url string, verdict int")
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("org", "/fr/", "allow")]
    listed = spark.createDataFrame([("http://spam.org/x",), ("http://spam.org/x",), (None,), ("http://spam.org/fr/x",)], "url string")
    found = [tuple(r) for r in url_filter.judge_urls(pages, listed, rules).select("page_id", "host", "path", "rule", "verdict").collect()]
    assert sorted(found) == sorted([
        (1, "a.example.net", "/en/x", "example.net/en/", "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "example.net", "", None, "allow"),
        (5, "spam.org", "/x/", None, "block"), (6, "www.spam.org", "/x", None, "block"), (6, "www.spam.org", "/x", None, "block"), (7, "spam.org", "/fr/x", "org/fr/", "allow"), (8, "", "", None, "allow"),
    ])
    assert url_filter.judge_urls(pages.limit(0), listed, rules).count() == 0
    assert url_filter.judge_urls(pages, listed.limit(0), rules).where("listed").count() == 0


def test_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.1]), (4, None), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, []), (10, [1.0]), (11, [-1.0, 0.0]), (12, [1e-30, 0.0]), (13, [3e38, 0.0])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id bigint, embedding array<float>, node int")
    found = sorted(tuple(r) for r in embedding_dedup.near_duplicates(df).collect())
    one = [(k, 5, 1) for k in (1, 2, 2, 3, 12, 13)]
    assert found == sorted(one + [(k, 0, k) for k in (4, 5, 6, 7, 8, 9, 10, 11)])
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_long_texts_make_small_batches(spark):
    texts = spark.range(12).repartition(1).select(F.repeat(F.lit("long "), 1 << 19).alias("text"))
    found = common.map_arrow(texts, lambda batches: ({"rows": [b.num_rows], "size": [b.nbytes]} for b in batches), "rows bigint, size bigint").collect()
    assert sum(r["rows"] for r in found) == 12
    assert max(r["size"] for r in found) <= common.BATCH_BYTES + (5 << 19) + 1024


def test_pipeline_stages(spark, sf_dir, docs, none):
    """Every stage on nulls, empty and long texts, repeated rows, clashing columns and an empty table."""
    import corpus_pipeline

    rows = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        rows[name] = out.collect()
        if name != "packing":
            assert out.columns == docs.columns
        assert stage(spark, none, sf_dir).count() == 0
    assert {r["doc_id"] for r in rows["language_id"]} <= {1, 2, 7, 8, None} and len([r for r in rows["language_id"] if r["doc_id"] == 1]) == 2
    assert all(r["text"] and len(r["text"].split()) >= 10 for r in rows["quality_rules"])
    left = [r["doc_id"] for r in rows["ngram_join"]]
    assert len(left) == len(ROWS) - 2 and left.count(1) == 1 and 2 not in left  # one of three equal texts stays
    assert all(r["text"] for r in rows["source_mixing"])
    assert {p["doc_id"] for p in rows["packing"]} == {r[0] for r in ROWS}
