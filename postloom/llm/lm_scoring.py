"""Language-model scores: a log-bilinear model trained with noise-contrastive estimation.

Tokens are the words (runs without space, tab, newline, vertical tab, form feed or carriage
return; A-Z lower-cased) of a text, then one end.  The model predicts a token's symbol from
the four symbols before it.  A symbol is one of the most frequent words, the end, or a class
of other words that share their last two characters; within its class a word has the share
of its training count plus a half.  So every text has a finite, normalised probability.  The
number of symbols grows with the sixth root of the tokens, up to what a worker can hold.

Symbols are in groups of up to ``GROUP``, in the order of their words read backwards: the
model gives a group's probability, then a symbol's within its group, both log-bilinear.  A
batch of tokens is scored by one matrix product with all groups and one with each group's
own symbols, so no token needs a product with every symbol.

Word counts come from all training documents and are joined by word; only words above a
fixed share of all tokens (at most ``HEAVY`` of them can be) are broadcast.  Each training
task runs noise-contrastive gradient steps over all its documents from the same start, and
Spark averages the tasks' parameters, weighted by tokens, once a round; the driver gets one
averaged set, from which the next round starts.  Small partitions are put together, so that a
task's steps are enough to learn from and grow with the corpus.

Inside tasks words are known by 64-bit hashes and lengths; counts are grouped and joined by the words
themselves.

Defined results: a null text is empty and has the end alone.  With no training document every
token has probability one in both scores.  Rows with equal ids are scored each; extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import map_arrow, settle

FREQUENT, CLASSES, GROUP, WIDTH, BEFORE, BATCH, RATE, ROUNDS = 2000, 300, 128, 24, 4, 2048, 0.2, 2
#: Noise samples of a batch: groups, and symbols within each group.
NOISE_GROUPS, NOISE = 16, 8
#: ``FREQUENT`` and ``CLASSES`` hold up to so many tokens and grow up to ``GROWTH`` times (11,500 symbols).
SMALL, GROWTH = 1_000_000, 5
#: A training task has at least so many tokens; from where that makes ``WIDE`` tasks, both grow with the square root.
TASK_TOKENS, WIDE = 2_000_000, 30
#: Words with at least 1/HEAVY of all training tokens are broadcast: HEAVY words at most, of 28 bytes each.
HEAVY = 1_000_000
_FLUSH, _ROWS, _SCORED, _BLOCK, _ROW = 400_000, 500, 1 << 14, 1 << 14, 32


def growth(tokens: int) -> float:
    """How many times ``FREQUENT`` and ``CLASSES`` a model of so many tokens has."""
    return min(max(1.0, (tokens / SMALL) ** (1 / 6)), GROWTH)


def tasks_of(tokens: int) -> int:
    """Training tasks at most for so many tokens."""
    whole = tokens / TASK_TOKENS
    return max(1, int(min(whole, (whole * WIDE) ** 0.5)))


def few_rows(batches, rows: int = _ROWS):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def count_words(docs: DataFrame) -> DataFrame:
    """``word`` and ``n`` over all rows of ``docs(text)``."""

    def together(held):
        key, codes, seen = words.numbered(np.concatenate([k for k, _, _ in held]))
        n = np.bincount(codes, np.concatenate([n for _, n, _ in held]), len(key)).astype(np.int64)
        return key, n, pa.concat_arrays([w for _, _, w in held]).take(pa.array(seen))

    def partial(batches):
        held, size, kept = [], 0, 0
        for batch in batches:
            for _, data, at in words.segments(batch.column(0)):
                low = words.lowered(data)
                starts, ends, _ = words.spans(low, at)
                if not len(starts):
                    continue
                key, codes, seen = words.numbered(words.hashes(low, starts, ends))
                held.append((key, np.bincount(codes, minlength=len(key)), words.texts_at(low, starts[seen], ends[seen])))
                size += len(key)
                if size > kept + _FLUSH:
                    held = [together(held)]
                    size = kept = len(held[0][0])
                    if kept > _FLUSH:
                        yield from rows(held)
                        held, size, kept = [], 0, 0
        if held:
            yield from rows([together(held)])

    def rows(held):
        _, n, names = held[0]
        for at in range(0, len(n), 50_000):
            yield {"word": names.slice(at, 50_000), "n": n[at : at + 50_000]}

    return map_arrow(docs.select("text"), partial, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def marks(names: list[str], which: int = 0) -> np.ndarray:
    """Hashes of whole strings."""
    data, at = words.bytes_of(pa.array(names, pa.string()))
    return words.hashes(data, at[:-1], at[1:], which)


class Vocabulary:
    """How words become symbols.  Ids go group by group, then the rest of words, the end (these two a group) and the start."""

    def __init__(self, heavy: list[tuple[str, int]], classes: dict[str, float], rest: float, ends: int, frequent: int):
        heavy = sorted(heavy, key=lambda x: (-x[1], x[0]))
        # one unseen word, of half a count, may be of any class
        own = [(w[::-1], 0, w, n) for w, n in heavy[:frequent]] + [(s[::-1], 1, s, n + 0.5) for s, n in classes.items()]
        own.sort(key=lambda x: x[:3])
        self.rest, self.end, self.start = len(own), len(own) + 1, len(own) + 2
        self.count = len(own) + 3
        self.mass = np.array([n for *_, n in own] + [rest + 0.5, ends, 0], dtype=float)
        groups = -(-len(own) // GROUP)
        self.edges = np.concatenate([np.linspace(0, len(own), groups + 1).astype(np.int64), [len(own) + 2]]) if groups else np.array([0, 2])
        self.classed = np.zeros(self.count)  # log10 of the mass that a class's words share
        for k, (_, kind, _, n) in enumerate(own):
            self.classed[k] = np.log10(n) if kind else 0.0
        self.classed[self.rest] = np.log10(rest + 0.5)
        self.shares = np.zeros(self.count, bool)
        self.shares[[k for k, x in enumerate(own) if x[1]] + [self.rest]] = True
        suffixes = [(x[2], k) for k, x in enumerate(own) if x[1]]
        key = marks([s for s, _ in suffixes])
        order = np.argsort(key)
        self.suffix, self.suffix_symbol = key[order], np.array([k for _, k in suffixes], np.int32)[order]
        symbol = {x[2]: k for k, x in enumerate(own) if not x[1]}
        names = [w for w, _ in heavy]
        key = marks(names)
        order = np.argsort(key)
        self.key, self.length = key[order], np.array([len(names[k].encode()) for k in order.tolist()] + [-1], np.int32)
        self.symbol = np.array([symbol.get(names[k], -1) for k in order.tolist()], np.int32)
        self.log_count = np.log10(np.array([n for _, n in heavy], dtype=float) + 0.5)[order]

    def encode(self, column: pa.Array, whole: bool = True) -> tuple:
        """All texts' symbols with ends, and where each text's begin (one more than texts).

        If ``whole``, also each token's place among the heavy words (-1: none, -2: end), and
        each text's words that have none.
        """
        n, tails = np.zeros(len(column), np.int64), np.zeros(len(column), np.int64)
        symbols, places, names = [], [], [pa.array([], pa.string())]
        for first, data, at in words.segments(column):
            low = words.lowered(data)
            starts, ends, begin = words.spans(low, at)
            n[first : first + len(at) - 1] += np.diff(begin)
            if not len(starts):
                continue
            key, codes, seen = words.numbered(words.hashes(low, starts, ends), ordered=True)
            a, b = starts[seen], ends[seen]
            place = words.found_in(self.key, key)
            place[self.length[place] != b - a] = -1
            symbol = np.where(place >= 0, self.symbol[place], -1) if len(self.symbol) else np.full(len(key), -1, np.int32)
            other = np.flatnonzero(symbol < 0)
            suffix = words.found_in(self.suffix, words.hashes(low, words.last_characters(low, a[other], b[other], 2), b[other]))
            symbol[other] = np.where(suffix >= 0, self.suffix_symbol[suffix], self.rest) if len(self.suffix) else self.rest
            symbols.append(symbol.take(codes))
            if not whole:
                continue
            places.append(place.take(codes))
            light = np.flatnonzero(places[-1] < 0)
            names.append(words.texts_at(low, starts[light], ends[light]))
            tails[first : first + len(at) - 1] += np.diff(np.searchsorted(light, begin))
        edge = np.concatenate([[0], np.cumsum(n + 1)])
        ids, inner = np.full(edge[-1], self.end, np.int32), np.ones(edge[-1], bool)
        inner[edge[1:] - 1] = False
        if symbols:
            ids[inner] = np.concatenate(symbols)
        if not whole:
            return ids, edge
        where = np.full(edge[-1], -2, np.int64)
        if places:
            where[inner] = np.concatenate(places)
        return ids, edge, where, pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(tails)]), pa.int32()), pa.concat_arrays(names))

    def contexts(self, ids: np.ndarray, edge: np.ndarray, before: int = BEFORE) -> np.ndarray:
        """For each token the symbols before it, nearest first; the start where the text has none."""
        out = np.full((before, len(ids)), self.start, np.int32)
        at = np.arange(len(ids)) - np.repeat(edge[:-1], np.diff(edge))
        for k in range(1, before + 1):
            out[k - 1, k:] = np.where(at[k:] >= k, ids[:-k], self.start)
        return out


class LogBilinear:
    """A diagonal matrix for each context position, vectors and biases of contexts, groups and symbols."""

    NAMES = ("context", "mix", "target", "bias", "over", "top")

    def __init__(self, edges: np.ndarray, mass: np.ndarray, width: int = WIDTH, before: int = BEFORE):
        rng = np.random.default_rng(5)
        count, self.edges = len(mass), edges
        self.group = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        self.share = (mass[: edges[-1]] + 1e-3) / (mass[: edges[-1]] + 1e-3).sum()  # of the targets: all but the start
        self.whole = np.add.reduceat(self.share, edges[:-1])
        self.context = rng.normal(0, 0.1, (count, width)).astype(np.float32)
        self.target = rng.normal(0, 0.1, (edges[-1], width)).astype(np.float32)
        self.over = rng.normal(0, 0.1, (len(self.whole), width)).astype(np.float32)
        self.mix = np.full((before, width), 0.5, np.float32)
        self.bias = np.log(self.share / self.whole[self.group]).astype(np.float32)
        self.top = np.log(self.whole).astype(np.float32)

    def parameters(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).ravel() for k in self.NAMES])

    def load(self, flat: np.ndarray) -> LogBilinear:
        at = 0
        for name in self.NAMES:
            old = getattr(self, name)
            setattr(self, name, flat[at : at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size
        return self

    def train(self, batches, rate: float = RATE, seed: int = 0) -> int:
        """Adagrad steps over parts of a stream of symbols, each text after starts; returns the number of tokens.

        Every part begins with the symbols that its first token has before it.
        """
        rng = np.random.default_rng(seed)
        squares = {k: np.full_like(getattr(self, k), 1e-2) for k in self.NAMES}
        below = np.cumsum(self.share)
        first = np.concatenate([[0.0], below[self.edges[1:-1] - 1]])
        log_group = (np.log(self.whole * NOISE_GROUPS)).astype(np.float32)
        log_noise = (np.log(self.share / self.whole[self.group] * NOISE)).astype(np.float32)
        rows = 0
        deep, start = len(self.mix), len(self.context) - 1
        for stream in batches:
            places = np.flatnonzero(stream[deep:] != start)
            word = stream[deep:].take(places)
            order = np.argsort(word.astype(np.uint16), kind="stable")
            places, word = places[order], word[order]
            group = self.group[word]
            size = np.float32(len(word))
            near, long = self.context.take(stream, axis=0), len(stream) - deep
            seen = [near[deep - k : deep - k + long] for k in range(1, deep + 1)]
            q = sum(x * m for x, m in zip(seen, self.mix)).take(places, axis=0)
            # which group
            drawn = np.minimum(np.searchsorted(np.cumsum(self.whole), rng.random(NOISE_GROUPS)), len(self.whole) - 1)
            g = rise(np.einsum("ij,ij->i", q, self.over.take(group, axis=0)) + (self.top - log_group).take(group)) / size
            h = -rise(-(q @ self.over[drawn].T + (self.top - log_group)[drawn])) / size
            dq = g[:, None] * self.over.take(group, axis=0) + h @ self.over[drawn]
            at = runs(group)
            index = np.concatenate([group[at], drawn])
            steps = {
                "over": summed(index, np.concatenate([np.add.reduceat(g[:, None] * q, at, axis=0), h.T @ q])),
                "top": summed(index, np.concatenate([np.add.reduceat(g, at), h.sum(axis=0)])),
            }
            # which symbol of the group
            t, offset = self.target.take(word, axis=0), self.bias - log_noise
            g = rise(np.einsum("ij,ij->i", q, t) + offset.take(word)) / size
            dq += g[:, None] * t
            noise = np.searchsorted(below, first[group[at], None] + rng.random((len(at), NOISE)) * self.whole[group[at], None])
            noise = np.clip(noise, self.edges[group[at], None], self.edges[group[at] + 1, None] - 1)
            # each group's tokens in rows of ``_ROW``, so that all groups are one batched product
            n = np.diff(np.append(at, len(word)))
            need = -(-n // _ROW)
            own = np.repeat(np.arange(len(at)), need)
            place = (at[own] + _ROW * (np.arange(len(own)) - np.repeat(np.cumsum(need) - need, need)))[:, None] + np.arange(_ROW)
            there = place < (at + n)[own][:, None]
            x, other = q.take(np.minimum(place, len(word) - 1), axis=0), self.target.take(noise[own], axis=0)
            h = rise(-(x @ other.transpose(0, 2, 1) + offset.take(noise[own])[:, None])) / -size
            h *= there[:, :, None]
            dq[place[there]] += (h @ other)[there]
            pulled, pulled_bias = h.transpose(0, 2, 1) @ x, h.sum(axis=1)
            at = runs(word)
            index = np.concatenate([word[at], noise[own].ravel()])
            steps["target"] = summed(index, np.concatenate([np.add.reduceat(g[:, None] * q, at, axis=0), pulled.reshape(-1, q.shape[1])]))
            steps["bias"] = summed(index, np.concatenate([np.add.reduceat(g, at), pulled_bias.ravel()]))
            risen, back = np.zeros((long, q.shape[1]), np.float32), np.zeros_like(near)
            risen[places] = dq
            for k in range(1, deep + 1):  # a symbol is k before the one k places on
                back[deep - k : deep - k + long] += self.mix[k - 1] * risen
            steps["mix"] = slice(None), np.stack([np.einsum("ij,ij->j", x, risen) for x in seen])
            steps["context"] = summed(stream, back)
            for k, (index, step) in steps.items():  # only the rows that the batch touches
                square = squares[k][index] + step**2 * size
                squares[k][index] = square
                getattr(self, k)[index] += rate * np.sqrt(size) * step / np.sqrt(square)
            rows += len(word)
        return rows

    def log_probability(self, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The natural log probability of each word after its contexts, by products with all groups and with its group's symbols."""
        seen = self.context * self.mix[:, None]
        out = np.empty(len(word))
        widest, tallest = max(np.abs(self.over).max(), np.abs(self.target).max()), max(np.abs(self.top).max(), np.abs(self.bias).max())
        for start in range(0, len(word), _SCORED):
            own = word[start : start + _SCORED]
            order = np.argsort(own.astype(np.uint16), kind="stable")
            own, there = own[order], before[:, start + order]
            q = sum(x.take(c, axis=0) for x, c in zip(seen, there))
            group = self.group[own]
            safe = np.abs(q).sum(axis=1).max(initial=0) * widest + tallest < 60  # else an exponential may be too large or too small
            logs = chosen(q @ self.over.T + self.top, group, safe)
            edge = np.searchsorted(group, np.arange(len(self.whole) + 1)).tolist()
            for k, (lo, hi) in enumerate(zip(edge, edge[1:])):
                if hi > lo:
                    a, b = self.edges[k], self.edges[k + 1]
                    logs[lo:hi] += chosen(q[lo:hi] @ self.target[a:b].T + self.bias[a:b], own[lo:hi] - a, safe)
            out[start + order] = logs
        return out


def rise(x: np.ndarray) -> np.ndarray:
    """The logistic function of -x; 0 where the exponential is too large to write."""
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(x))


def chosen(scores: np.ndarray, column: np.ndarray, safe: bool) -> np.ndarray:
    """Each row's log softmax at its column; ``safe`` if no score is beyond 60 either way."""
    own = scores[np.arange(len(scores)), column].astype(np.float64)
    if not safe:
        most = scores.max(axis=1)
        own -= most
        scores -= most[:, None]
    np.exp(scores, out=scores)
    return own - np.log(scores.sum(axis=1))


def runs(ordered: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))


def summed(index: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct indexes and the sums of their values."""
    order = np.argsort(index.astype(np.uint16), kind="stable")
    index = index[order]
    at = runs(index)
    return index[at], np.add.reduceat(values.take(order, axis=0), at, axis=0)


def steps_of(vocabulary: Vocabulary, batches, size: int = BATCH, before: int = BEFORE):
    """The stream of all texts' symbols, ``before`` starts ahead of each, in parts of about ``size``; see ``LogBilinear.train``."""
    for batch in few_rows(batches):
        ids, edge = vocabulary.encode(batch.column(0), whole=False)
        stream = np.insert(ids, np.repeat(edge[:-1], before), vocabulary.start)
        for at in range(before, len(stream), size):
            yield stream[at - before : at + size]


def train(docs: DataFrame, vocabulary, model: LogBilinear, tokens: int, rounds: int = ROUNDS) -> LogBilinear:
    """All of ``docs(text)``, ``rounds`` times; ``vocabulary`` is a broadcast ``Vocabulary``."""
    docs = docs.select("text").coalesce(tasks_of(tokens))
    spark = docs.sparkSession
    for turn in range(rounds):
        start = spark.sparkContext.broadcast(model)

        def local(batches, start=start, turn=turn):
            mine = start.value
            own = LogBilinear(mine.edges, np.concatenate([mine.share, [0.0]]), mine.context.shape[1], len(mine.mix))
            own.share, own.whole = mine.share, mine.whole
            own.load(mine.parameters())
            rows = own.train(steps_of(vocabulary.value, batches), rate=RATE / (turn + 1), seed=turn)
            flat = own.parameters()
            for block, at in enumerate(range(0, len(flat), _BLOCK) if rows else ()):
                yield {"block": [block], "rows": [rows], "values": [flat[at : at + _BLOCK].tobytes()]}

        def mean(batches):
            sums: dict[int, list] = {}
            for batch in batches:
                for block, rows, values in zip(*(c.to_pylist() for c in batch.columns)):
                    held = sums.setdefault(block, [0.0, 0])
                    held[0] = held[0] + np.frombuffer(values, np.float32).astype(np.float64) * rows
                    held[1] += rows
            if sums:
                yield {"block": list(sums), "values": [(total / rows).tobytes() for total, rows in sums.values()]}

        # a task adds up its blocks as they come, so it never holds more than their sums
        parts = map_arrow(docs, local, "block int, rows bigint, values binary").repartition(16, "block")
        got = sorted(map_arrow(parts, mean, "block int, values binary").collect())
        if got:
            model.load(np.concatenate([np.frombuffer(bytes(r["values"])) for r in got]))
    return model


def learn(training: DataFrame, frequent: int = FREQUENT, classes: int = CLASSES, heavy: int = HEAVY, rounds: int = ROUNDS):
    """From ``training(text)``: the word counts as a table, N, V, and broadcast vocabulary and model (or None).

    ``frequent`` and ``classes`` are those of a small corpus and grow with the tokens.
    """
    spark = training.sparkSession
    counts = settle(count_words(training))
    ends = training.count()
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n, v = int(total["n"] or 0) + ends, int(total["v"]) + (1 if ends else 0)
    if not ends:
        return counts, 0, 0, None, None
    frequent, classes = (round(k * growth(n)) for k in (frequent, classes))
    top = [(r["word"], r["n"]) for r in counts.where(F.col("n") * heavy >= n).collect()]
    named = {w for w, _ in sorted(top, key=lambda x: (-x[1], x[0]))[:frequent]}
    others = counts.join(F.broadcast(spark.createDataFrame([(w,) for w in sorted(named)], "word string")), "word", "left_anti")
    by_end = others.groupBy(F.expr("right(word, 2)").alias("suffix")).agg(F.sum(F.col("n") + 0.5).alias("mass"))
    best = {r["suffix"]: float(r["mass"]) for r in by_end.orderBy(F.desc("mass"), "suffix").limit(classes).collect()}
    rest = float(others.agg(F.sum(F.col("n") + 0.5)).first()[0] or 0.0) - sum(best.values())
    vocabulary = Vocabulary(top, best, max(rest, 0.0), ends, frequent)
    shared = spark.sparkContext.broadcast(vocabulary)
    model = train(training, shared, LogBilinear(vocabulary.edges, vocabulary.mass), n, rounds)
    return counts, n, v, shared, spark.sparkContext.broadcast(model)


def score(docs: DataFrame, training: DataFrame, **options) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` of every row of ``docs(doc_id, text)``."""
    counts, n, v, shared, model = learn(training, **options)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.monotonically_increasing_id().alias("row"))
    if shared is None:
        found = map_arrow(docs, lambda bs: ({"doc_id": b.column(0), "n_tokens": [len((t or "").encode().split()) + 1 for t in b.column(1).to_pylist()]} for b in bs), "doc_id bigint, n_tokens bigint")
        zero = F.lit(0.0)
        return found.select("doc_id", "n_tokens", F.lit(0).cast("bigint").alias("n_known"), F.lit(0).cast("bigint").alias("train_tokens"), zero.alias("base_score"), zero.alias("score"))
    whole = np.log10(n + 0.5 * (v + 1))

    def judge(batches):
        own, lm = shared.value, model.value
        end = np.log10(own.mass[own.end] + 0.5)
        for batch in few_rows(batches):
            ids, edge, place, tail = own.encode(batch.column(1))
            heavy = place >= 0
            logs = np.where(heavy, own.log_count[place], 0.0) if len(own.log_count) else np.zeros(len(ids))
            each = lm.log_probability(own.contexts(ids, edge), ids) / np.log(10) - own.classed[ids] + np.where(own.shares[ids], logs, 0.0)
            size = np.diff(edge)
            add = lambda x: np.add.reduceat(x, edge[:-1])  # noqa: E731  no text is without its end
            yield {
                "row": batch.column(2),
                "doc_id": batch.column(0),
                "n_tokens": size,
                "n_known": add(heavy.astype(np.int64)) + 1,
                "base": add(logs) + end - size * whole,
                "score": add(each),
                "tail": tail,
            }

    found = settle(map_arrow(docs, judge, "row bigint, doc_id bigint, n_tokens bigint, n_known bigint, base double, score double, tail array<string>"))
    seen = found.select("row", F.explode("tail").alias("word")).join(counts, "word", "left")
    light = seen.groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("logs"), F.count("n").alias("known"))
    out = found.join(light, "row", "left")
    more = F.coalesce("logs", F.lit(0.0))
    return out.select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(n).cast("bigint").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score"))
