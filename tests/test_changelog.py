"""The set-based log operators against a sequential model on random logs."""

import random

import pytest
from pyspark.sql import functions as F

from postloom.operators import changelog as c
from postloom.operators import graph as g
from postloom.operators import predicates as p


def random_log(seed, kinds, n=400, uris=40):
    rng = random.Random(seed)
    seqs = sorted(rng.sample(range(5 * n), n))
    return [(s, rng.choice(kinds), f"at://p/{rng.randrange(uris)}", rng.randrange(10)) for s in seqs]


def frame(spark, rows):
    return spark.createDataFrame(rows, "seq bigint, op string, uri string, like_count bigint").withColumns({"repost_count": F.lit(0), "reply_count": F.lit(0)})


@pytest.mark.parametrize("seed", range(3))
def test_replay(spark, seed):
    rows, state = random_log(seed, ["U", "U", "D"]), {}
    for seq, op, uri, likes in rows:
        state.pop(uri, None)
        if op == "U":
            state[uri] = (seq, likes)
    assert {r["uri"]: (r["seq"], r["like_count"]) for r in c.replay(frame(spark, rows)).collect()} == state


@pytest.mark.parametrize("seed", range(3))
def test_derive(spark, seed):
    rows, held, want = random_log(seed, ["U", "U", "D"]), {f"at://p/{k}" for k in range(0, 40, 5)}, []
    target = set(held)
    for seq, op, uri, likes in rows:
        if op == "D":
            target.discard(uri)
            want.append(seq)
        elif likes >= 4 and uri not in target:
            target.add(uri)
            want.append(seq)
    old = spark.createDataFrame([(u,) for u in sorted(held)], "uri string")
    got = c.derive(frame(spark, rows), p.engagement(likes=4), "all", old)
    assert sorted(r["seq"] for r in got.collect()) == want
    n = c.derive_counts(frame(spark, rows), p.engagement(likes=4), old).first()
    assert n["processed"] == len(rows) == n["matched"] + n["skipped"] + n["deletes"] and n["matched"] + n["deletes"] == len(want)


@pytest.mark.parametrize("seed", range(3))
def test_commits(spark, seed):
    rows, state, took = random_log(seed, ["create", "update", "delete"]), {f"at://p/{k}": 7 for k in range(0, 40, 3)}, []
    before = spark.createDataFrame(sorted(state.items()), "uri string, like_count bigint").withColumns({"repost_count": F.lit(0), "reply_count": F.lit(0)})
    for seq, op, uri, likes in rows:
        if op == "delete":
            if state.pop(uri, None) is not None:
                took.append(seq)
        elif likes >= 3 and (op == "update" or uri not in state):
            state[uri] = likes
            took.append(seq)
    assert sorted(r["seq"] for r in c.applied_commits(before, frame(spark, rows), p.engagement(likes=3)).collect()) == took
    assert {r["uri"]: r["like_count"] for r in c.fold_commits(before, frame(spark, rows), p.engagement(likes=3)).collect()} == state


def test_seqs_go_on(spark):
    log, rows = frame(spark, [(7, "U", "a", 1)]), spark.createDataFrame([(f"u{k:03d}",) for k in range(200)], "uri string")
    got = sorted((r["uri"], r["seq"]) for r in c.append(log, rows, ["uri"]).collect())
    assert got == [(f"u{k:03d}", 8 + k) for k in range(200)]


def test_guards():
    good = p.author("a")
    for wrong in (lambda: c.check_derivation("s", "s", good, "event-time", None, True), lambda: c.check_derivation("s", "t", good, "event-time", None, False), lambda: c.check_derivation("s", "t", good, "soon", None, True),
                  lambda: c.check_derivation("s", "t", good, "event-time", {"filter": "other", "mode": "event-time"}, False)):
        with pytest.raises(ValueError):
            wrong()
    c.check_derivation("s", "t", good, "event-time", {"filter": good.signature(), "mode": "event-time"}, False)


def test_graph(spark):
    people = spark.createDataFrame([(x, x) for x in "abcde"], "did string, label string")
    links = spark.createDataFrame([("a", "b", "reply", 2), ("b", "c", "reply", 1), ("c", "b", "quote", 1)], "src string, dst string, type string, weight bigint")
    degree = lambda **k: {r["did"]: r["degree"] for r in g.degree(people, links, **k).collect()}
    assert degree() == {"a": 2, "b": 4, "c": 2, "d": 0, "e": 0}
    assert degree(direction="in", weights=False) == {"a": 0, "b": 2, "c": 1, "d": 0, "e": 0}
    ranks = {r["did"]: r["rank"] for r in g.pagerank(people, links).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-9 and max(ranks, key=ranks.get) == "b"
    pairs = spark.createDataFrame([("a", "b", "reply", 3), ("c", "d", "reply", 3)], "src string, dst string, type string, weight bigint")
    found = {r["did"]: r["community"] for r in g.communities(people, pairs).collect()}
    assert found == {"a": "a", "b": "a", "c": "c", "d": "c", "e": "e"}


def test_ingest_policies(spark):
    new = frame(spark, [(1, "U", "a", 1), (2, "U", "b", 2), (3, "U", "b", 9)])
    stored = c.dedupe(spark.createDataFrame([("a",)], "uri string"), new)
    assert [(r["uri"], r["like_count"]) for r in stored.collect()] == [("b", 2)]
    assert c.ingest_counts(new, stored, new.limit(0)).first().asDict() == {"added": 1, "skipped": 2, "errors": 0}
