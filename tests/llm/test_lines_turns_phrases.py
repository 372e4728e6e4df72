"""Line deduplication, conversation repair and collocations against plain programs, and their edge cases."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from postloom.llm import collocations, conversation_repair, line_dedup, queries, words

CLASH = ("doc", "mark", "at", "part", "kind", "ends", "high", "low", "bitmap", "shard", "k1", "n", "conv", "chunk", "dropped", "letters", "again", "first")


def with_clashes(df):
    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASH)])


# --- lines


def lines_by_hand(rows):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add((doc is None, doc))
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if not (len(h := holders.get(key(x), ())) > 1 and min(h, key=lambda d: (d[0], d[1] or 0)) != (doc is None, doc))]
        out.append((doc, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


def lines_by_spark(df):
    return sorted([tuple(r) for r in line_dedup.deduplicate_lines(df).collect()], key=str)


def test_lines(spark):
    draw = random.Random(5)
    pool = [f"line number {k} of all" for k in range(40)] + ["short", "ÄÖÜäöüßéèê", "ÄÖÜäöüßéè", "The Same Line Again", "  the same line again\t"]
    rows = [(k, "\n".join(draw.choices(pool, k=draw.randint(1, 12)))) for k in range(150)]
    rows += [(3, None), (200, ""), (201, "\n"), (202, "\n\n the same line again \n"), (None, "the same line again"), (None, "only null holds this\nonly null holds this"), (7, rows[7][1]), (7, "THE SAME LINE AGAIN\r"), (500, "x" * 300_000 + "\n" + "line number 1 of all\n" * 20_000)]
    assert lines_by_spark(with_clashes(spark.createDataFrame(rows, "doc_id bigint, text string"))) == lines_by_hand(rows)
    assert line_dedup.deduplicate_lines(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_one_line_over_many_ranges(spark):
    """A line that all documents hold lies in all ranges, and only the first document keeps it."""
    rows = [(k, "the line that all hold\n" * 3 + f"its own line, number {k}") for k in range(4000)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert lines_by_spark(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)) == lines_by_hand(rows)
        parts = line_dedup.streamed(line_dedup.hashed(line_dedup.named(spark.createDataFrame([(k, "the line that all hold") for k in range(4000)], "doc_id bigint, text string"))))
        assert parts.where("kind = 2").count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


# --- conversations


def cheapest_by_hand(rows):
    """Every way to edit (role, must go, cut) rows, one after the other; the least of (cost, letters, roles)."""
    best = []
    legal = re.compile("(s?(ua)+)?")
    inserts = ["", "u", "a", "ua", "au"]
    choices = [[("D", 3, "")] + ([] if gone else [("K", cut, role[:1] or " "), ("R", 2 + cut, "u"), ("R", 2 + cut, "a")]) for role, gone, cut in rows]
    for gaps in itertools.product(inserts, repeat=len(rows) + 1):
        for picks in itertools.product(*choices):
            letters, roles, cost = "", "", 2 * sum(map(len, gaps))
            for k in range(len(rows) + 1):
                letters, roles = letters + "I" * len(gaps[k]), roles + gaps[k]
                if k < len(rows):
                    letters, cost, roles = letters + picks[k][0], cost + picks[k][1], roles + picks[k][2]
            if legal.fullmatch(roles):
                best.append((cost, letters))
    return min(best)


def edits_of(rows, chunk):
    given = [(r[:1], g, c) for r, g, c in rows]
    parts = [conversation_repair.transfer(given[k : k + chunk]) for k in range(0, max(1, len(given)), chunk)]
    cost, digits = conversation_repair.cheapest(parts)
    return cost, "".join(digits).translate(conversation_repair._LETTERS)


def test_cheapest_edits():
    draw = random.Random(11)
    kinds = list(itertools.product(["user", "assistant", "system", "tool", ""], [False, True], [False, True]))
    for n in (0, 1, 2, 3):
        for rows in draw.sample(list(itertools.product(kinds, repeat=n)), min(40, len(kinds) ** n)):
            want = cheapest_by_hand(rows)
            assert edits_of(rows, 100) == edits_of(rows, 1) == want, rows
    for _ in range(60):  # longer ones: chunks of any size say the same
        rows = draw.choices(kinds, k=draw.randint(4, 60))
        assert len({edits_of(rows, size) for size in (1, 2, 3, 7, 100)}) == 1


def conversations_by_hand(rows, damage=True):
    white = " \t\n\x0b\x0c\r"
    after, ids = defaultdict(list), {r[0] for r in rows}
    for conv, turn, role, text in rows:
        lot = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
        after[conv] += [(turn, "user" if lot == 4 else role, text)] * (0 if lot == 0 else 2 if lot == 3 else 1)
    out = {}
    for conv in ids:
        own = sorted(after[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults, given = set(), Counter(), []
        for _, role, text in own:
            bare = text.strip(white)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            given.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        turns = [t for t, _, _ in own if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit = edits_of(given, 10_000)
        left, state, at = [], "", 0
        for letter in audit:
            due = "assistant" if state == "u" else "user"
            if letter == "I":
                left.append(f"{due}:")
            elif letter != "D":
                left.append(f"{own[at][1] if letter == 'K' else due}:{own[at][2]}")
            at += letter != "I"
            state = left[-1][:1] if left and letter != "D" else state
        assert re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in left))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest())
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def by_conversation(df):
    rows = df.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in rows}


def test_conversations(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert by_conversation(queries.op12_conversation_repair(spark, sf_dir)) == conversations_by_hand(rows)


@pytest.mark.parametrize("chunk", [2, 1024])
def test_damaged_conversations(spark, chunk):
    draw = random.Random(3)
    texts = ["Well.", "well", "", "  \n", None, "Yes!", "so ", "Long " * 20_000 + "."]
    roles = ["user", "assistant", "system", None, "", "tool", "User"]
    rows = [(conv, draw.choice([None, *range(-2, 9)]), draw.choices(roles, [6, 6, 2, 1, 1, 1, 1])[0], draw.choice(texts)) for conv in [None, *range(40)] for _ in range(draw.randint(1, 14))]
    rows += [(77, turn, ("user", "assistant")[turn % 2], f"turn {turn}.") for turn in range(3000)] + [(78, 5, "user", "the same.")] * 500 + [(79, None, "user", "the same.")] * 300
    df = with_clashes(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5))
    assert by_conversation(conversation_repair.repair_conversations(conversation_repair.damaged(df), chunk)) == conversations_by_hand(rows)
    assert by_conversation(conversation_repair.repair_conversations(conversation_repair.untouched(df), chunk)) == conversations_by_hand(rows, damage=False)
    assert conversation_repair.repair_conversations(conversation_repair.damaged(df.limit(0))).count() == 0


def test_conversation_without_rows(spark):
    conv = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(conv, 0, "user", "a.")], "conv_id bigint, turn bigint, role string, text string")
    assert by_conversation(conversation_repair.repair_conversations(conversation_repair.damaged(df))) == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


# --- phrases


def phrases_by_hand(rows, least, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in (1, 2, 3):
                f[lang].update(tuple(w[k : k + size]) for k in range(len(w) - size + 1))
    out = []
    for lang, count in f.items():
        candidates = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        covered = {part for p, a in candidates.items() if len(p) == 3 for part in (p[:2], p[1:]) if 100 * a >= 50 * count[part]}
        scored = []
        for p, a in candidates.items():
            if p not in covered:
                score, k = min((1_000_000 * a * a // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), " ".join(p), count[p[:k]], count[p[k:]]))
        out += [(lang, rank, phrase, -a, x, y, n[lang], -score) for rank, (score, a, _, phrase, x, y) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def test_phrases(spark, monkeypatch):
    draw = random.Random(9)
    vocabulary = ["new", "york", "city", "the", "of", "Über", "x", "Rare", "a b", "état"]
    rows = [(draw.choice(["en", "de", None, "und"]), "".join(draw.choice(vocabulary) + draw.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n"]) for _ in range(draw.randint(0, 60)))) for _ in range(200)]
    rows += [("en", None), ("fr", ""), ("fr", " . ,"), ("en", "aa " * 12), ("es", "once only"), ("en", "new york " * 40_000)]
    df = with_clashes(spark.createDataFrame(rows, "lang string, text string")).withColumn("doc_id", F.lit(1))
    columns = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got = collocations.mine(df)
    assert got.columns == columns
    assert sorted(tuple(r) for r in got.collect()) == phrases_by_hand(rows, 10)
    monkeypatch.setattr(collocations, "SMALL", -1)  # joined by shuffle
    assert sorted(tuple(r) for r in collocations.mine(df, least=40, top=3, shards=2).collect()) == phrases_by_hand(rows, 40, 3)
    assert collocations.mine(df.limit(0), shards=1).count() == 0


def test_phrases_over_segments():
    """A text that is read in parts has the same phrases as one that is read at once."""
    import pyarrow as pa

    draw = random.Random(2)
    text = "".join(draw.choice(["ab", "c", "défg"]) + draw.choice([" ", " ", "\t ", ". ", "\n"]) for _ in range(9000))
    want = Counter()
    for piece in re.split("[.\n]", text):
        w = piece.split()
        for size in (1, 2, 3):
            want.update(tuple(w[k : k + size]) for k in range(len(w) - size + 1))
    for size in (words.SEGMENT, 256):
        got, names = Counter(), {}
        whole = words.SEGMENT
        words.SEGMENT = size
        try:
            for keys, chain, old, data, starts, ends, _ in collocations.phrases(pa.array(["zz", text, "zz"]), ["a", "a", "a"]):
                names |= {int(k): bytes(data[s:e]).decode() for k, s, e in zip(keys[old:], starts, ends)}
                spelt = [names[int(k)] for k in keys]
                for k in range(old, len(spelt)):
                    got[(spelt[k],)] += 1
                    if k >= 1 and chain[k - 1]:
                        got[(spelt[k - 1], spelt[k])] += 1
                        if k >= 2 and chain[k - 2]:
                            got[tuple(spelt[k - 2 : k + 1])] += 1
        finally:
            words.SEGMENT = whole
        assert got == want + Counter({("zz",): 2})


def test_shares_of_large_counts(spark):
    a, left, right = 987_654_321_012_345, 987_654_321_012_346, 999_999_999_999_999
    row = spark.createDataFrame([(a, left, right)], "a bigint, l bigint, r bigint").select(collocations.share(F.col("a"), F.col("l"), F.col("r"))).first()
    assert row[0] == 1_000_000 * a * a // (left * right)
