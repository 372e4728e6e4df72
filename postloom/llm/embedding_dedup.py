"""Near-duplicate vectors by sorted projection passes.

Each pass hashes vectors by the signs of random projections, concatenated into one integer,
and sorts them by it; neighbours within a window are compared by cosine in double precision.
A pass sends every vector once through a shuffle, into the range of codes where it belongs, and
a task slides over its range; passes are made ``AT_ONCE`` together and what they leave is
links alone.  Neighbours on two sides of a range's end are not compared, other passes do.

Vectors that several passes link are one component of verified links.  A window is bounded,
so it can miss links inside a dense group: every component is then compared whole, pair by
pair in blocks, which gives each vector all its links within the component.

Passes follow from the number of vectors, for a stated recall of a pair that is alone.  Where
vectors crowd together more are needed, so recall is measured: the links of a sample with all
vectors are counted in full, and passes are doubled until ``RECALL`` of them are within
components, over links as well as over the sample's vectors.  This is the same for few vectors
as for many.

Vectors equal in all components are one node with a number of copies.

Defined results: a vector that is null, empty, zero or holds null or non-finite components
links with nothing.  Vectors of different lengths are not compared.  Rows with equal ids are
vectors of their own.  Labels and extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, release, settle
from .linking import compare_groups, components, roots

#: ``PASSES`` at least; ``SAMPLE`` vectors measure the recall.
COSINE, PASSES, WINDOW, BITS, RECALL, SAMPLE, AT_ONCE = 0.9, 24, 64, 62, 0.999, 2048, 8


def usable(vector: list | None) -> np.ndarray | None:
    if not vector or any(x is None for x in vector):
        return None
    v = np.array(vector, dtype=np.float64)
    return v + 0.0 if np.isfinite(v).all() and v.any() else None


def planes(width: int, number: int, bits: int) -> np.ndarray:
    return np.random.default_rng([31, width, number]).standard_normal((width, bits))


def passes_for(n: int, cosine: float, window: int, recall: float) -> int:
    """Passes that bring a pair at the threshold, alone among ``n`` vectors, into one window with probability ``recall``."""
    same = 1 - math.acos(max(-1.0, min(1.0, cosine))) / math.pi  # of one sign
    one = same ** max(0.0, math.log2(max(1, n) / (1.5 * window)))
    return 1 if one >= recall else math.ceil(math.log(1 - recall) / math.log(1 - one))


def identified(vectors: DataFrame) -> DataFrame:
    """``vec_id``, ``node`` and ``vector`` (doubles as bytes) of every row of ``vectors(vec_id, embedding)``."""

    def rows(batches):
        for batch in batches:
            good = [usable(v) for v in batch.column(1).to_pylist()]
            raw = [None if v is None else v.tobytes() for v in good]
            node = [None if r is None else int.from_bytes(hashlib.blake2b(r, digest_size=8).digest(), "little", signed=True) for r in raw]
            yield {"vec_id": batch.column(0), "node": node, "vector": raw}

    return map_arrow(vectors.select(F.col("vec_id").cast("bigint"), "embedding"), rows, "vec_id bigint, node bigint, vector binary")


def by_width(raw: list[bytes]):
    """For each length of vectors: their places and, scaled so that no norm overflows, their matrix."""
    vectors = [np.frombuffer(r) for r in raw]
    for width in sorted({len(v) for v in vectors}):
        own = np.array([k for k, v in enumerate(vectors) if len(v) == width])
        x = np.stack([vectors[k] for k in own])
        yield width, own, x / np.abs(x).max(axis=1)[:, None]


def coded(nodes: DataFrame, start: int, stop: int, bits: int = BITS) -> DataFrame:
    """``node``, ``vector`` and ``codes`` of ``nodes(node, vector)`` for the passes from ``start`` to before ``stop``."""

    def rows(batches):
        weights = np.int64(1) << np.arange(bits - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            codes: list = [None] * batch.num_rows
            for width, own, x in by_width(batch.column(1).to_pylist()):
                signs = np.stack([(x @ planes(width, p, bits) > 0) @ weights for p in range(start, stop)], axis=1)
                for k, c in zip(own, signs):
                    codes[k] = c
            yield {"node": batch.column(0), "vector": batch.column(1), "codes": codes}

    return map_arrow(nodes.select("node", "vector"), rows, "node bigint, vector binary, codes array<bigint>")


def neighbours(placed: DataFrame, cosine: float, window: int, parts: int) -> DataFrame:
    """Links ``a``, ``b`` of vectors at most ``window`` places apart in some pass's order, and of some up to twice as far.

    ``placed`` has ``node``, ``vector`` and ``codes``.  Ranges of (pass, code, node) are sorted;
    the node spreads vectors with equal codes.  Each run of ``window`` places is compared with
    itself and the run before; of a run's links, each node keeps the one to the smallest node
    it reaches, so there are no more links than places.
    """
    dealt = placed.select("node", "vector", F.posexplode("codes").alias("pass", "code"))
    dealt = dealt.repartitionByRange(parts, "pass", "code", "node").sortWithinPartitions("pass", "code", "node").select("node", "vector")

    def linked(before, run):
        both = before + run
        node = np.array([r[0] for r in both], np.int64)
        matrix = close([(n, 1, v) for n, v in both], cosine)
        matrix[: len(before), : len(before)] = False
        matrix &= node[:, None] != node[None, :]
        left, right = np.nonzero(np.triu(matrix | matrix.T))
        if not len(left):
            return None
        order = np.argsort(node, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        root = roots(len(order), rank[left], rank[right])
        use = np.flatnonzero(root != np.arange(len(order)))
        return {"a": node[order][use], "b": node[order][root[use]]}

    def rows(batches):
        before, run = [], []
        for batch in batches:
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                run.append(row)
                if len(run) == window:
                    if (found := linked(before, run)) is not None:
                        yield found
                    before, run = run, []
        if run and (found := linked(before, run)) is not None:
            yield found

    return map_arrow(dealt, rows, "a bigint, b bigint").where("a <> b").distinct()


def close(rows: list, cosine: float) -> np.ndarray:
    """The matrix of cosines that reach the threshold, in double precision."""
    out = np.zeros((len(rows), len(rows)), bool)
    for _, own, x in by_width([r[2] for r in rows]):
        x /= np.sqrt((x * x).sum(axis=1))[:, None]
        out[np.ix_(own, own)] = x @ x.T >= cosine
    return out


def measured_recall(nodes: DataFrame, joined: DataFrame, cosine: float, sample: int = SAMPLE) -> float:
    """The share of a sample's links with all of ``nodes`` that are within components of ``joined``, the lesser of that of all links and the mean over vectors."""
    placed = nodes.select("node", "vector").join(joined, "node", "left").select("node", "vector", F.coalesce("component", "node").alias("component"))
    picked = placed.orderBy(F.xxhash64("node"), "node").limit(sample).collect()
    ids, group = (np.array([r[k] for r in picked], dtype=np.int64) for k in ("node", "component"))
    of_width = {}
    for width, own, x in by_width([bytes(r["vector"]) for r in picked]):
        of_width[width] = own, x / np.sqrt((x * x).sum(axis=1))[:, None]
    shared = nodes.sparkSession.sparkContext.broadcast((ids, group, of_width))

    def count(batches):
        ids, group, of_width = shared.value
        links, found = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        for batch in batches:
            node, component = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for width, own, x in by_width(batch.column(1).to_pylist()):
                if width not in of_width:
                    continue
                places, y = of_width[width]
                x /= np.sqrt((x * x).sum(axis=1))[:, None]
                near = (x @ y.T >= cosine) & (node[own][:, None] != ids[places][None, :])
                links[places] += near.sum(axis=0)
                found[places] += (near & (component[own][:, None] == group[places][None, :])).sum(axis=0)
        yield {"at": np.arange(len(ids)), "links": links, "found": found}

    rows = map_arrow(placed, count, "at bigint, links bigint, found bigint").groupBy("at").agg(F.sum("links").alias("links"), F.sum("found").alias("found"))
    got = rows.where("links > 0").agg(F.sum("found") / F.sum("links"), F.avg(F.col("found") / F.col("links"))).first()
    return 1.0 if got[0] is None else min(got)


def joined_nodes(nodes: DataFrame, cosine: float, passes: int, window: int, recall: float) -> DataFrame:
    """``node`` and ``component`` of the nodes that have a link, after as many passes as the recall needs."""
    n, done, joined = nodes.count(), 0, None
    wanted = max(passes, passes_for(n, cosine, window, (1 + recall) / 2))
    while True:
        edges = None if joined is None else joined.select(F.col("node").alias("a"), F.col("component").alias("b"))
        while done < wanted:
            stop = min(wanted, done + AT_ONCE)
            placed = settle(coded(nodes, done, stop))
            found = settle(neighbours(placed, cosine, window, max(1, n * (stop - done) // 50_000)))
            release(placed)
            edges = found if edges is None else edges.union(found)
            done = stop
        joined = components(edges)
        if measured_recall(nodes, joined, cosine) >= recall:
            return joined
        wanted = 2 * done


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, passes: int = PASSES, window: int = WINDOW, recall: float = RECALL) -> DataFrame:
    """``vec_id``, ``n_links`` and ``component_id`` of every row of ``vectors(vec_id, embedding)``."""
    rows = settle(identified(vectors))
    nodes = settle(rows.where("node is not null").groupBy("node").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first_id"), F.first("vector").alias("vector")))
    loaded = nodes.select("node", "copies", "vector")
    linked = lambda group, members: close(members, cosine)
    joined = joined_nodes(nodes, cosine, passes, window, recall)
    exact = compare_groups(joined.select(F.col("component").alias("group"), "node"), loaded, ["vector"], linked)
    links = exact.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.select("node", "copies", "first_id").join(joined, "node", "left").join(links, "node", "left")
    named = settle(named.select("node", "first_id", F.coalesce("component", "node").alias("component"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    first = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    out = rows.select("vec_id", "node").join(named.join(first, "component").select("node", "component_id", "n_links"), "node", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
