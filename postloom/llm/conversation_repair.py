"""Conversations checked for faults and repaired by the cheapest edits.

A conversation's rows are repaired so that their role initials spell ``(s?(ua)+)?``.  Each row
is kept (0), given the role user or assistant (2) or deleted (3; blank and duplicate rows must
be); an empty user or assistant turn may be inserted anywhere (2); a truncated row that stays
adds 1.  Of the cheapest edits, those whose initials (D, I, K, R) are first in ASCII order win.

**One scalar decides.**  The value of a way to the end is one integer: the cost above a fixed
number of base-8 digits that hold its letters from the top (D 1, I 2, K 3, R 4) and zeros after
them, so that a plain minimum of integers compares costs, then letters.  The dynamic programme
runs over the graph of (row, state of the pattern) from the last row to the first; an edge
adds its cost, moves the digits one place down and puts its letter on top.

**Long conversations are split.**  Rows are range-partitioned by (conversation, turn, role),
so a conversation may lie in several partitions, and cut into chunks of ``CHUNK`` rows.  A
chunk's task finds the cheapest edits from each state to each other one.  For one pair of
states two equally cheap ways differ before either ends (a longer one would only add
insertions, which cost), so the best way of a chunk does not depend on what follows, and a
conversation is the same programme over its chunks, from the last to the first.  Texts are
sorted once more by conversation and hashed as they stream by, since SHA-256 has an order.

Defined results: null ids, turns, roles and texts count as one space in keys and texts; rows
with a null id are one conversation, and null turns come first.  Rows of one turn are ordered
by role, then text; repeated rows are duplicates.  Without rows after damage: zeros, no audit,
the hash of nothing.  Extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, settle

CHUNK = 1024
D, I, K, R = 1, 2, 3, 4  # noqa: E741  the letters' digits
_LETTERS = str.maketrans("1234", "DIKR")
#: States: nothing yet, after s, after u, after a.  Where a role's initial leads, and the role that comes next.
GO = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NEXT, THEN = ("user", "user", "assistant", "user"), (2, 2, 3, 2)
ENDS = (0, 3)
_SPACE = " \t\n\x0b\x0c\r"
_LEGAL = {"su", "ua", "au"}


def damaged(rows: DataFrame) -> DataFrame:
    """``conv``, ``turn``, ``role``, ``text``, ``dropped``: one row in twenty each is dropped, emptied, stripped of sentence ends, repeated, or said to be the user's."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    text = F.when(lot == 1, "").when(lot == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    out = rows.select(F.col("conv_id").cast("bigint").alias("conv"), F.col("turn").cast("bigint").alias("turn"), F.when(lot == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), (lot == 0).alias("dropped"), F.when(lot == 3, 2).otherwise(1).alias("times"))
    return out.withColumn("_", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int")))).drop("_", "times")


def untouched(rows: DataFrame) -> DataFrame:
    """The same columns of ``rows(conv_id, turn, role, text)`` without any damage."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select(F.col("conv_id").cast("bigint").alias("conv"), F.col("turn").cast("bigint").alias("turn"), said("role").alias("role"), said("text").alias("text"), F.lit(False).alias("dropped"))


def transfer(rows: list[tuple[str, bool, bool]]) -> tuple[list[int], list[str]]:
    """Cost and digits of the cheapest edits of ``rows`` (role's initial, must be deleted, truncated) from each state (4 * it) to each other (+ it); cost -1 where there is no way."""
    places = 3 * (3 * len(rows) + 2)
    top, mask, never = places - 3, (1 << places) - 1, 1 << (places + 64)

    def put(value: int, cost: int, letter: int) -> int:
        return (value >> places) + cost << places | letter << top | (value & mask) >> 3

    def inserted(value: list[int]) -> list[int]:
        once = [min(value[q], put(value[THEN[q]], 2, I)) for q in range(4)]
        return [min(value[q], put(once[THEN[q]], 2, I)) for q in range(4)]  # a third one would lead back

    costs, edits = [-1] * 16, [""] * 16
    for end in range(4):
        value = inserted([0 if q == end else never for q in range(4)])
        for initial, must_go, cut in reversed(rows):
            before = []
            for q in range(4):
                ways = [put(value[q], 3, D)]
                if not must_go:
                    ways.append(put(value[THEN[q]], 2 + cut, R))
                    if (q, initial) in GO:
                        ways.append(put(value[GO[q, initial]], int(cut), K))
                before.append(min(ways))
            value = inserted(before)
        for q in range(4):
            if value[q] < never:
                costs[4 * q + end] = value[q] >> places
                edits[4 * q + end] = f"{value[q] & mask:o}".rstrip("0")
    return costs, edits


def cheapest(chunks: list[tuple[list[int], list[str]]]) -> tuple[int, list[str]]:
    """Least cost and each chunk's digits, given the chunks' transfers in order."""
    places = 3 * sum(max(map(len, edits)) for _, edits in chunks)
    mask = (1 << places) - 1
    ahead, picks = {q: 0 for q in ENDS}, []
    for costs, edits in reversed(chunks):
        now: dict[int, int] = {}
        pick: dict[int, int] = {}
        for q in range(4):
            for to, value in ahead.items():
                way = 4 * q + to
                if costs[way] < 0:
                    continue
                n = 3 * len(edits[way])
                letters = int(edits[way], 8) << places - n if n else 0
                whole = (value >> places) + costs[way] << places | letters | (value & mask) >> n
                if q not in now or whole < now[q]:
                    now[q], pick[q] = whole, to
        ahead = now
        picks.append(pick)
    state, out = 0, []
    for (_, edits), pick in zip(chunks, reversed(picks)):
        out.append(edits[4 * state + pick[state]])
        state = pick[state]
    return ahead[0] >> places, out


def _marked(rows: DataFrame) -> DataFrame:
    """``rows`` with ``again``: whether an earlier turn of the conversation has the same role and text."""
    conv = F.coalesce(F.col("conv").cast("string"), F.lit(" "))
    rows = rows.withColumn("mark", F.unhex(F.sha2(F.concat(conv, F.lit(":"), F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)))
    when: Column = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    firsts = rows.where("not dropped").groupBy("mark").agg(F.min(when).alias("first"))
    return rows.join(firsts, "mark", "left").withColumn("again", F.coalesce(F.col("first") < when, F.lit(False))).drop("first", "mark")


def chunked(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Rows and chunks of ``rows(conv, turn, role, text, dropped)`` in order of (``part``, ``chunk``, ``at``).

    A row has its place ``at``, role and text; a chunk (``at`` -1) its transfer, first and
    last role initials in ``edges`` and in ``facts``: rows, blank, duplicate, truncated and
    illegal ones, distinct turns, smallest and largest turn (null if all are).
    """
    dealt = _marked(rows).repartitionByRange("conv", "turn", "role").withColumn("part", F.spark_partition_id())
    dealt = dealt.sortWithinPartitions("conv", "turn", "role", "text").select("conv", "part", "turn", "role", "text", "dropped", "again")
    names = ("conv", "part", "chunk", "at", "role", "text", "edges", "facts", "costs", "edits")

    def run(batches):
        whose, number, held, facts, last, at = object(), 0, [], None, None, 0
        out: list[tuple] = []

        def close():
            costs, edits = transfer([r[:3] for r in held])
            edges = [held[0][0], held[-1][0]] if held else None
            facts[4] += sum(a[0] + b[0] not in _LEGAL for a, b in zip(held, held[1:]))
            out.append((whose, part, number, -1, None, None, edges, list(facts), costs, edits))

        for batch in batches:
            for conv, part, turn, role, text, dropped, again in zip(*(c.to_pylist() for c in batch.columns)):
                if facts is None or conv != whose or len(held) == chunk:
                    if facts is not None:
                        close()
                    number = 0 if conv != whose or facts is None else number + 1
                    last = None if number == 0 else last
                    whose, held, facts = conv, [], [0, 0, 0, 0, 0, 0, None, None]
                if dropped:
                    continue
                tail = text.rstrip(_SPACE)
                same = again or (last is not None and last == (turn, role, text))
                fault = 1 if not tail else 2 if same else 3 if tail[-1] not in ".!?" else 0
                last = (turn, role, text)
                facts[0] += 1
                if fault:
                    facts[fault] += 1
                if turn is not None and turn != facts[7]:
                    facts[5] += 1
                    facts[6], facts[7] = turn if facts[6] is None else facts[6], turn
                held.append((role[:1], fault in (1, 2), fault == 3))
                out.append((conv, part, number, at, role, text, None, None, None, None))
                at += 1
            if out:
                yield dict(zip(names, zip(*out)))
                out.clear()
        if facts is not None:
            close()
            yield dict(zip(names, zip(*out)))

    return map_arrow(dealt, run, "conv bigint, part int, chunk bigint, at bigint, role string, text string, edges array<string>, facts array<bigint>, costs array<int>, edits array<string>")


def decided(chunks: DataFrame) -> DataFrame:
    """Each chunk's ``letters`` and, on a conversation's first chunk, its ``totals``: gaps, blank, duplicate, truncated, illegal, cost."""
    dealt = chunks.repartition("conv").sortWithinPartitions("conv", "part", "chunk").select("conv", "part", "chunk", "edges", "facts", "costs", "edits")
    names = ("conv", "part", "chunk", "at", "letters", "totals")

    def close(held):
        facts = [h[4] for h in held]
        blank, duplicate, truncated, illegal = (sum(f[k] for f in facts) for k in range(1, 5))
        edges = [h[3] for h in held if h[3]]
        illegal += sum(a[1] + b[0] not in _LEGAL for a, b in zip(edges, edges[1:]))
        turns = [f for f in facts if f[6] is not None]
        shared = sum(a[7] == b[6] for a, b in zip(turns, turns[1:]))
        gaps = turns[-1][7] - turns[0][6] + 1 - sum(f[5] for f in turns) + shared if turns else 0
        cost, digits = cheapest([h[5:] for h in held])
        for k, (h, d) in enumerate(zip(held, digits)):
            yield (*h[:3], -1, d.translate(_LETTERS), [gaps, blank, duplicate, truncated, illegal, cost] if k == 0 else None)

    def run(batches):
        held: list[tuple] = []
        out: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and row[0] != held[0][0]:
                    out += close(held)
                    held = []
                held.append(row)
            if out:
                yield dict(zip(names, zip(*out)))
                out = []
        if held:
            yield dict(zip(names, zip(*close(held))))

    return map_arrow(dealt, run, "conv bigint, part int, chunk bigint, at bigint, letters string, totals array<bigint>")


def edited(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """The turns that the decisions leave: ``conv``, ``part``, ``chunk``, ``at`` (-1 for a chunk, with its ``letters`` and ``totals``), ``turns`` as ``role:text`` that follow each other."""
    text = rows.select("conv", "part", "chunk", "at", "role", "text", F.lit(None).cast("string").alias("letters"), F.lit(None).cast("array<bigint>").alias("totals"))
    plan = decisions.select("conv", "part", "chunk", "at", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "letters", "totals")
    dealt = text.unionByName(plan).repartition("conv").sortWithinPartitions("conv", "part", "chunk", "at")
    names = ("conv", "letters", "totals", "turns")

    def run(batches):
        whose, state, letters, at = object(), 0, "", 0
        for batch in batches:
            out = []
            for conv, _, _, place, role, text, more, totals in zip(*(c.to_pylist() for c in batch.columns)):
                turns = []
                if place < 0:
                    state = 0 if totals is not None or conv != whose else state
                    whose, letters, at = conv, more, 0
                else:
                    letter, at = letters[at], at + 1
                    if letter == "K":
                        turns.append(f"{role}:{text}")
                        state = GO[state, role[:1]]
                    elif letter == "R":
                        turns.append(f"{NEXT[state]}:{text}")
                        state = THEN[state]
                while at < len(letters) and letters[at] == "I":
                    turns.append(f"{NEXT[state]}:")
                    state, at = THEN[state], at + 1
                out.append((conv, more, totals, turns))
            if out:
                yield dict(zip(names, zip(*out)))

    return map_arrow(dealt, run, "conv bigint, letters string, totals array<bigint>, turns array<string>")


def summed(turns: DataFrame) -> DataFrame:
    """One row a conversation of ``edited`` turns, as they stream by: its totals, its audit and the hash of its repaired text."""
    names = ("conv_id", "totals", "audit", "repaired_sha256")

    def run(batches):
        whose, sums, audit, sha, first = None, None, [], None, True
        for batch in batches:
            out = []
            for conv, letters, totals, rows in zip(*(c.to_pylist() for c in batch.columns)):
                if totals is not None:
                    if sha is not None:
                        out.append((whose, sums, "".join(audit), sha.hexdigest()))
                    whose, sums, audit, sha, first = conv, totals, [], hashlib.sha256(), True
                audit.append(letters or "")
                for row in rows:
                    sha.update((row if first else f"\n{row}").encode())
                    first = False
            if out:
                yield dict(zip(names, zip(*out)))
        if sha is not None:
            yield dict(zip(names, zip((whose, sums, "".join(audit), sha.hexdigest()))))

    out = map_arrow(turns, run, "conv_id bigint, totals array<bigint>, audit string, repaired_sha256 string")
    named = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select("conv_id", *[F.col("totals")[k].alias(name) for k, name in enumerate(named)], "audit", "repaired_sha256")


def repaired(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The turns of ``rows(conv, turn, role, text, dropped)`` after the cheapest edits, see ``edited``."""
    dealt = settle(chunked(rows, chunk))
    return edited(dealt.where("at >= 0"), decided(dealt.where("at < 0")))


def repair_conversations(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Faults, cost, audit and hash of every conversation in ``rows(conv, turn, role, text, dropped)``."""
    return summed(repaired(rows, chunk))
