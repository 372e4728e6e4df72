"""The registered queries of this subpackage and, where it can say them, their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, conversation_repair, embedding_dedup, language_id, licenses, line_dedup, lm_scoring, mixing, ngram_join, packing, quality_rules, token_counts, tokenizing, url_filter
from .common import id_remainder, shared_dir, table


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learnt from those whose crc32 of the id modulo 5 is not 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = lm_scoring.score(docs, docs.where(id_remainder("doc_id", 5) != 1))
    return found.select("doc_id", (id_remainder("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


#: A page's title with junk in it.
JUNK_TITLE = "<title>[^<]*(###|%%%|[*]{3})"
#: The rules of op2, as (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and list for every page.

    The list is made of the table: the URLs of all pages whose title holds junk (a mark three
    times or more in a row) or whose host begins with the label ``spam`` or ``spam-...``.
    Other spellings of a listed URL are listed too.
    """
    pages = table(spark, sf_dir, "pages")
    spam = url_filter.host_of(F.col("url")).rlike(r"^(www\.|m\.)?spam(-[^.]*)?\.")
    listed = pages.where(spam | F.col("html").rlike(JUNK_TITLE)).select("url")
    pages = pages.select("page_id", "url")
    return url_filter.judge_urls(pages, listed, RULES)


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at a cosine of 0.9."""
    found = embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from those whose crc32 of the id modulo 3 is not 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = language_id.learn_profiles(docs.where(id_remainder("doc_id", 3) != 1))
    found = docs.select("doc_id", (id_remainder("doc_id", 3) == 1).alias("held_out"), language_id.predicted(F.col("text"), profiles).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence words, places and labels of every document."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all documents takes of each."""
    plan, _ = mixing.mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "source")


def op7_token_counts(spark: SparkSession, sf_dir: str, ranks: str | None = None) -> DataFrame:
    """Tokens of every document, counted in flat files that hold all documents' ids and no index.

    The files are written first, in the shared folder: 16-bit ids of a byte-level tokenizer
    (``ranks`` is the path of another file of ranks), 50256 after each document.  They are read
    in ranges of 4 MB.
    """
    if ranks is None:
        import public_tokenizers

        ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    where, end = str(ranks), 50_256
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    names = token_counts.write_files(table(spark, sf_dir, "documents"), lambda: tokenizing.byte_encoder(where), end, folder)
    found = token_counts.documents_in(token_counts.read_blocks(spark, folder, only=names), end)
    return found.join(names, ["file", "number"]).select("doc_id", "n_tokens")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and the trees' verdict for every document."""
    docs = table(spark, sf_dir, "documents")
    model = quality_rules.train(docs, table(spark, sf_dir, "labels"))
    return quality_rules.with_statistics(docs, model).select("doc_id", *quality_rules.COUNTS, "base_failed", "kept", "quality_score")


def op9_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """All documents in sequences of up to 4096 tokens; ``tokenizer`` is the path of another file."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack_documents(table(spark, sf_dir, "documents"), str(tokenizer))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document at a Jaccard similarity of 0.8 on five-word runs."""
    found = ngram_join.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "set_id", "class_id", "n_links", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, those dropped as repeats of other documents', and a hash of the rest."""
    found = line_dedup.deduplicate_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repairs of every conversation, after damage."""
    return conversation_repair.repair_conversations(conversation_repair.damaged(table(spark, sf_dir, "conversations")))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2000 phrases of two or three words by cohesion, of all documents."""
    return collocations.mine(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_lm_scoring, op2_url_filter, op3_embedding_dedup, op4_language_id, op5_license_scan, op6_source_mixing, op7_token_counts, op8_quality_rules, op9_packing, op10_ngram_join, op11_line_dedup, op12_conversation_repair, op13_collocations)
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

ORACLES = {
    "op10_ngram_join": rf"""
WITH RECURSIVE words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
sets AS (SELECT doc_id, md5(string_agg(g, '|' ORDER BY g)) AS s FROM grams GROUP BY doc_id),
both_ways AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM both_ways JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
classes AS (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a),
degrees AS (SELECT a AS doc_id, count(*) AS n_links FROM links GROUP BY a)
SELECT doc_id, coalesce(min(doc_id) OVER (PARTITION BY coalesce(s, 'none ' || doc_id)), doc_id) AS set_id, class_id,
       coalesce(n_links, 0) AS n_links, doc_id = class_id AS kept
FROM documents LEFT JOIN sets USING (doc_id) LEFT JOIN classes USING (doc_id) LEFT JOIN degrees USING (doc_id)""",
    "op2_url_filter": r"""
WITH parts AS (
  SELECT page_id, coalesce(regexp_matches(html, '<title>[^<]*(###|%%%|[*]{3})'), false) AS junk, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
         list_sort(list_filter(string_split(coalesce(regexp_extract(url, '(?s)^[^?#]*\?([^#]*)', 1), ''), '&'), lambda q: q <> '' AND NOT regexp_matches(q, '^(?i:utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)'))) AS args
  FROM pages),
named AS (
  SELECT *, CASE WHEN bare <> '' THEN bare || regexp_replace(path, '/+$', '') || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END END AS key
  FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':\d*$', ''), '^(www|m)\.', '') AS bare FROM parts)),
listed AS (SELECT DISTINCT key FROM named WHERE key IS NOT NULL AND (junk OR regexp_matches(host, '^(www\.|m\.)?spam(-[^.]*)?\.'))),
ruled AS (
  SELECT page_id, host, path, listed.key IS NOT NULL AS listed,
         CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
              WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
              WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
              WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM named LEFT JOIN listed USING (key))
SELECT page_id, host, path, rule, listed,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN listed THEN 'block' ELSE 'allow' END AS verdict
FROM ruled""",
    "op3_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (SELECT * FROM v WHERE len(e) > 0 AND list_bool_and(list_transform(e, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(e, lambda x: x <> 0))),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
component AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM component LEFT JOIN degree USING (vec_id)""",
    "op11_line_dedup": r"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT row, doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS place FROM docs),
keyed AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
shared AS (SELECT key, min(doc_id) AS lowest FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (lowest <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE lowest IS NULL OR lowest = doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN shared USING (key) GROUP BY row""",
    "op13_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
f1 AS (SELECT lang, w[i] AS w1, count(*) AS f FROM places GROUP BY ALL),
f2 AS (SELECT lang, w[i] AS w1, w[i + 1] AS w2, count(*) AS f FROM places WHERE i < len(w) GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3, count(*) AS f FROM places WHERE i < len(w) - 1 GROUP BY ALL HAVING count(*) >= 10),
inside AS (SELECT lang, w1, w2, max(f) AS most FROM (SELECT lang, w1, w2, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY ALL),
cuts AS (
  SELECT p.lang, p.w1 || ' ' || p.w2 AS phrase, 1 AS k, p.f AS a, x.f AS l, y.f AS r FROM f2 p JOIN f1 x ON x.lang = p.lang AND x.w1 = p.w1 JOIN f1 y ON y.lang = p.lang AND y.w1 = p.w2
  LEFT JOIN inside i ON i.lang = p.lang AND i.w1 = p.w1 AND i.w2 = p.w2 WHERE i.most IS NULL OR 100 * i.most < 50 * p.f
  UNION ALL SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, 1, t.f, x.f, y.f FROM f3 t JOIN f1 x ON x.lang = t.lang AND x.w1 = t.w1 JOIN f2 y ON y.lang = t.lang AND y.w1 = t.w2 AND y.w2 = t.w3
  UNION ALL SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, 2, t.f, x.f, y.f FROM f3 t JOIN f2 x ON x.lang = t.lang AND x.w1 = t.w1 AND x.w2 = t.w2 JOIN f1 y ON y.lang = t.lang AND y.w1 = t.w3),
scored AS (SELECT *, 1000000::HUGEINT * a * a // (l::HUGEINT * r) AS score FROM cuts),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, (SELECT sum(f)::BIGINT FROM f1 WHERE f1.lang = ranked.lang) AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000""",
}
