"""Language identification by rank-order n-gram profiles.

A profile is the list of a language's most frequent n-grams, in order.  A document's own
list is compared with every profile by the out-of-place distance: the sum over its n-grams
of how far each stands from its place in the profile, or the profile's length where absent.

n-grams are 1 to 3 code points of the lower-cased text in which every run of ASCII
non-letters is one space; an n-gram has no space inside it, only at its ends.  Ties in
frequency are ordered by the n-gram's code, ties in distance by the language's name.

Defined results: null text or text without a letter gives ``und`` and score 0; so does
every text if nothing could be learnt.  Null languages are not learnt from.  Extra columns
are ignored, repeated rows are predicted each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, small_batches

PROFILE_SIZE = 300
UNKNOWN = "und"
_ASCII = np.array([c if 97 <= c <= 122 else 32 for c in range(128)], np.uint32)
_COMPACT_AT = 1_000_000


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram codes of a whole text, ascending, and their counts."""
    a = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), dtype=np.uint32)
    a = np.where(a < 128, _ASCII[np.minimum(a, 127)], a)
    space = a == 32
    keep = ~space
    keep[1:] |= ~space[:-1]
    keep[0] = True
    a = a[keep].astype(np.int64)  # 21 bits a code point, none is 0: shorter n-grams are smaller codes
    letter = a != 32
    one = a[letter]
    two = (a[:-1] | (a[1:] << 21)) if len(a) > 1 else a[:0]
    three = (a[:-2] | (a[1:-1] << 21) | (a[2:] << 42))[letter[1:-1]] if len(a) > 2 else a[:0]
    return tally(np.concatenate([one, two, three]))


def tally(codes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, ascending, with their number or the sum of their counts."""
    if not len(codes):
        return codes, np.zeros(0, np.int64)
    if counts is None:
        codes = np.sort(codes)
        at = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        return codes[at], np.diff(np.append(at, len(codes)))
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[at], np.add.reduceat(counts, at)


def ranked(codes: np.ndarray, counts: np.ndarray, size: int = PROFILE_SIZE) -> np.ndarray:
    """The ``size`` most frequent codes, most frequent first."""
    if len(counts) > size:  # all that may be among them, ties at the edge too
        use = counts >= np.partition(counts, len(counts) - size)[-size]
        codes, counts = codes[use], counts[use]
    return codes[np.lexsort((codes, -counts))[:size]]


def learn_profiles(docs: DataFrame, size: int = PROFILE_SIZE) -> dict[str, np.ndarray]:
    """The profile of every non-null ``lang`` from all rows of ``docs(text, lang)``.

    Tasks add up n-grams per language; only ``size`` codes a language reach the driver.
    """

    def partial(batches):
        sums: dict[str, list] = {}
        pending: dict[str, int] = {}
        for batch in batches:
            rows = (r for at in range(0, batch.num_rows, 500) for r in zip(*[c.slice(at, 500).to_pylist() for c in batch.columns]))
            for text, lang in rows:
                codes, counts = gram_counts(text)
                sums.setdefault(lang, []).append((codes, counts))
                pending[lang] = pending.get(lang, 0) + len(codes)
                if pending[lang] > _COMPACT_AT:
                    sums[lang] = [tally(*map(np.concatenate, zip(*sums[lang])))]
                    pending[lang] = len(sums[lang][0][0]) // 2
        for lang, parts in sums.items():
            codes, counts = tally(*map(np.concatenate, zip(*parts)))
            for at in range(0, len(codes), 50_000):
                some = codes[at : at + 50_000]
                yield {"lang": [lang] * len(some), "code": some, "n": counts[at : at + 50_000]}

    usable = docs.select("text", "lang").where("text is not null and lang is not null")
    grams = map_arrow(usable, partial, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    top = grams.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= size)
    profiles: dict[str, list] = {}
    for row in top.select("lang", "rank", "code").collect():
        profiles.setdefault(row["lang"], []).append((row["rank"], row["code"]))
    return {lang: np.array([code for _, code in sorted(rows)], dtype=np.int64) for lang, rows in sorted(profiles.items())}


class Profiles:
    """All profiles as one table: sorted codes by languages, holding the rank."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int = PROFILE_SIZE):
        self.size, self.langs = size, sorted(profiles)
        self.codes = np.unique(np.concatenate([np.zeros(0, np.int64), *profiles.values()]))
        self.ranks = np.full((len(self.codes), len(self.langs)), -1, np.int32)
        for k, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.codes, profiles[lang]), k] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.langs or not any(map(str.isalpha, text)):  # numerals such as a half or a circled one are no letters
            return UNKNOWN, 0.0
        mine = ranked(*gram_counts(text), self.size)
        if not len(mine):
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.codes, mine), len(self.codes) - 1)
        there = np.where((self.codes[at] == mine)[:, None], self.ranks[at], -1)
        away = np.where(there < 0, self.size, np.abs(there - np.arange(len(mine))[:, None]))
        distance = away.sum(axis=0)
        best = int(distance.argmin())
        return self.langs[best], 1.0 - float(distance[best]) / (self.size * len(mine))


def predicted(text: Column, profiles: dict[str, np.ndarray], size: int = PROFILE_SIZE) -> Column:
    """A struct ``(lang, score)`` for a text column."""
    small_batches()
    table = Profiles(profiles, size)

    @F.pandas_udf("lang string, score double")
    def judge(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([table.predict(t) for t in texts], columns=["lang", "score"])

    return judge(text)


def identify(docs: DataFrame, training: DataFrame, size: int = PROFILE_SIZE) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` beside ``doc_id``; learns from ``training(text, lang)``."""
    found = docs.select("doc_id", predicted(F.col("text"), learn_profiles(training, size), size).alias("p"))
    return found.select("doc_id", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
