"""Links inside groups, counted in blocks, and connected components, all as Spark jobs.

``compare_groups`` takes memberships of nodes in groups, hands every pair of blocks of a
group to one task and asks a ``linked`` function for the matrix of links.  Pairs never
become rows: a task returns, for each node, how many others it links with and the smallest
node its links lead to, so the output is as long as the input.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, release, settle

BLOCK = 1024


def blocks_of(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """``members(group, node)`` with every pair of blocks that a node has to be in.

    A group of up to ``block`` nodes is one block; a larger one is dealt into several and
    each node goes once to every pair that its block is part of.
    """
    sizes = members.groupBy("group").agg(F.ceil(F.count("*") / block).cast("int").alias("n"))
    own = members.join(sizes, "group").withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), F.col("n")).cast("int"))
    other = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return other.select("group", "node", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own")


def roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of ``n`` by the given links."""
    root = np.arange(n)
    while len(left):
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        np.minimum.at(root, before, root)
        root = root[root]
        if np.array_equal(before, root):
            break
    return root


def compare_groups(members: DataFrame, nodes: DataFrame, payload: list[str], linked, block: int = BLOCK) -> DataFrame:
    """Links within each group of ``members(group, node)``, whose rows are distinct.

    ``nodes(node, copies, *payload)`` has one row a node.

    ``linked(group, rows)`` gets the group and a list of tuples (node, copies, *payload) and
    returns a boolean matrix; only its part between two different blocks, or within one block,
    is used.  Returns ``node``, ``links`` (copies of linked nodes) and ``root`` (the smallest
    node of the task that its links lead to), one row a node and task.
    """
    dealt = blocks_of(members.select("group", "node"), block).join(nodes, "node")
    keys = ["group", "a", "b"]
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys, "node").select(*keys, "own", "node", "copies", *payload)

    def close(key, own, rows):
        nodes = np.array([r[0] for r in rows], dtype=np.int64)
        copies = np.array([r[1] for r in rows], dtype=np.int64)
        matrix = linked(key[0], rows)
        np.fill_diagonal(matrix, False)
        if key[1] != key[2]:
            own = np.array(own)
            matrix &= own[:, None] != own[None, :]
        left, right = np.nonzero(np.triu(matrix))
        root = nodes[roots(len(rows), left, right)]
        return {"node": nodes, "links": matrix.astype(np.float64) @ copies, "root": root}

    def rows(batches):
        key, own, held = None, [], []
        out: list[dict] = []
        ready = 0
        for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            columns = [c.to_pylist() for c in batch.columns]
            for group, a, b, mine, *row in zip(*columns):
                if (group, a, b) != key:
                    if len(held) > 1:
                        out.append(close(key, own, held))
                        ready += len(held)
                    key, own, held = (group, a, b), [], []
                    if ready > 20_000:
                        yield merged(out)
                        out, ready = [], 0
                own.append(mine)
                held.append(tuple(row))
        if len(held) > 1:
            out.append(close(key, own, held))
        if out:
            yield merged(out)

    def merged(out):
        whole = {k: np.concatenate([o[k] for o in out]) for k in ("node", "links", "root")}
        return whole | {"links": np.rint(whole["links"]).astype(np.int64)}

    return map_arrow(dealt, rows, "node bigint, links bigint, root bigint")


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) of all nodes in ``edges(a, b)``.

    Repeated links and links of a node with itself change nothing; without links there are no
    rows; a null end is an error of the caller.

    Every round, each node takes the smallest label among its own and its neighbours', hands
    it to the node that was its label (so whole trees are hooked, and long chains need few
    rounds), then takes the label of its label; written out each round, until no label changes.
    Labels only fall, so the rounds end.
    """
    edges = edges.where("a <> b").distinct()
    both = settle(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct())
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        first = settle(labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("low")))
        # one row a label; a label is always a node of the same component, so it has a label itself
        hooks = first.where("low < was").groupBy(F.col("was").alias("node")).agg(F.min("low").alias("hook"))
        low = first.join(hooks, "node", "left").select("node", "was", F.least("low", "hook").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("next"))
        after = settle(low.join(jump, "low").select("node", "was", F.least("low", "next").alias("component")))
        release(first, labels)
        labels = after
        if after.where("was <> component").isEmpty():
            release(both)
            return labels.select("node", "component")
