"""Registered queries against their SQL in DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from postloom.plans import ORACLES, QUERIES

TABLES = "documents events".split()
#: A query or two of each family; the driver compares all of them.
SOME = [
    "p_regex", "p_date_range", "p_and_or_not", "p_not_language", "p_alt_regex", "p_valid_links", "p_trending", "p_multi_filter", "p_explain", "p_match_rate",
    "j_nested", "o_engagement_topk", "o_keyset", "o_scan_limit", "o_multi_store", "a_count_by_hashtag", "a_author_table", "a_buckets_hour", "a_digest_posts", "a_thread_groups",
    "n_hashtags", "n_flags", "n_rejects", "s_commits", "l_replay", "l_dedupe", "l_append", "l_commits", "l_derive", "l_derive_incremental", "l_derive_counts", "l_staleness", "l_topology",
    "t_phrase", "t_bm25", "i_coverage", "g_tree", "g_edges", "g_summary", "g_degree", "g_pagerank", "s_commits_stream", "s_live_buckets",
    "p_card_link", "p_link_regex", "j_minimal", "j_social", "j_media", "j_images", "j_embeds", "n_embed_summary", "n_mentions", "n_links", "n_shapes", "n_decoded", "l_ingest", "s_markdown", "s_materialize", "s_manifest",
    "s_by_uri", "l_reset", "l_refresh", "l_sync_status", "l_store_status", "l_store_table", "l_topology_edges", "g_communities", "g_community_labels", "t_page", "s_log_tail",
    "n_reject_lines", "n_metrics", "p_valid_links_as_of", "p_valid_links_as_of_include", "p_trending_as_of", "t_alt_only", "t_boolean_index", "t_bm25_scan", "t_bm25_batches", "t_phrase_scan", "l_state_merged", "s_commits_resumed", "s_materialized_json", "a_rolled_up",
    "j_wildcard", "j_full", "j_image_rows", "n_alt_text", "a_auto_unit", "s_json",
]


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return [plain(x) for x in value] if isinstance(value, (list, tuple)) else str(value)


@pytest.mark.parametrize("name", SOME)
def test_same_as_sql(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    cursor = con.execute(ORACLES[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    want = sorted(str([plain(r[names.index(c)]) for c in columns]) for r in cursor.fetchall())
    assert sorted(str([plain(r[c]) for c in columns]) for r in got.collect()) == want


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["uri", "author", "engagement"]
    assert set(e.oracle_sql()) <= set(e.queries())
