"""License scans: Aho-Corasick for tags and notice phrases, shunting-yard for expressions.

Words are runs of a-z, 0-9 and all non-ASCII characters in the text with A-Z lower-cased.
One automaton over a text's words, each between single spaces, finds every notice phrase;
another over its lower-cased text finds identifier tags, whose rest of line is a licence
expression of names, ``and``, ``or``, ``with`` and brackets.  ``with`` binds closest, then
``and``, then ``or``.  A text's labels are those of its phrases and of the names in its
expressions.  The score is the share of evidence: one for an expression that parses, else
1 - 1/(1 + distinct labels), 0 without any.

Defined results: a null text is empty, has no words, no labels and score 0.  A broken
expression gives the labels of the names read before the break.  Rows are scanned each, extra
columns are ignored.
"""

from __future__ import annotations

import bisect
import re

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: Phrases and labels that every scan reports as places.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further notice phrases and their labels.
MORE_PHRASES = {
    "mit licence": "mit",
    "apache software license": "apache",
    "lesser general public license": "lgpl",
    "library general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "isc license": "isc",
    "boost software license": "bsl",
    "the unlicense": "unlicense",
    "creative commons attribution": "cc-by",
    "cc by": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc": "cc-by-nc",
    "cc0 1 0": "cc0",
    "public domain dedication": "public-domain",
    "all rights reserved": "proprietary",
}
#: Tags before an expression, lower-cased.
TAGS = ("spdx-license-identifier:", "license-expression:")
#: How identifiers begin, longest first where one begins another, and their labels.
IDENTIFIERS = {"apache": "apache", "agpl": "agpl", "bsd": "bsd", "bsl": "bsl", "cc-by-nc": "cc-by-nc", "cc-by-nd": "cc-by-nd", "cc-by-sa": "cc-by-sa", "cc-by": "cc-by", "cc0": "cc0", "epl": "epl", "gpl": "gpl", "isc": "isc", "lgpl": "lgpl", "mit": "mit", "mpl": "mpl", "unlicense": "unlicense", "proprietary": "proprietary"}
#: Labels whose use asks nothing but attribution.
PERMISSIVE = frozenset({"apache", "bsd", "bsl", "cc-by", "cc0", "isc", "mit", "public-domain", "unlicense"})
_RANK = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"[()]|[a-z0-9.+-]+")
_KEEP = bytes(c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def label_of(identifier: str) -> str | None:
    for start in sorted(IDENTIFIERS, key=len, reverse=True):
        if identifier == start or identifier.startswith(f"{start}-") or identifier.startswith(f"{start}+"):
            return IDENTIFIERS[start]
    return None


def to_postfix(text: str, start: int = 0, stop: int | None = None) -> tuple[list[str], bool]:
    """The lower-cased expression from ``start`` to ``stop`` at most, in postfix order, and whether it is well formed."""
    out: list[str] = []
    waiting: list[str] = []
    operand = True  # what has to come next
    for token in map(re.Match.group, _TOKEN.finditer(text, start, len(text) if stop is None else stop)):
        if token == "(":
            if not operand:
                return out, False
            waiting.append(token)
        elif token == ")":
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if operand or not waiting:
                return out, False
            waiting.pop()
        elif token in _RANK:
            if operand:
                return out, False
            while waiting and _RANK.get(waiting[-1], 0) >= _RANK[token]:
                out.append(waiting.pop())
            waiting.append(token)
            operand = True
        else:
            if not operand:
                break  # words after the expression
            out.append(token)
            operand = False
    good = not operand and "(" not in waiting
    return out + [w for w in reversed(waiting) if w != "("], good


def evaluate(postfix: list[str]) -> tuple[set[str], bool]:
    """Labels of the names, and whether a reader may choose permissive terms only."""
    stack: list[tuple[set[str], bool]] = []
    for token in postfix:
        if token in _RANK:
            if len(stack) < 2:
                continue
            (b, y), (a, x) = stack.pop(), stack.pop()
            stack.append((a, x) if token == "with" else (a | b, x and y if token == "and" else x or y))
        else:
            label = label_of(token)
            stack.append(({label} if label else set(), label in PERMISSIVE))
    return set().union(*(s for s, _ in stack)), bool(stack) and all(p for _, p in stack)


class Scanner:
    """The automata; built once a task."""

    def __init__(self, base: dict[str, str], more: dict[str, str], tags: tuple[str, ...]):
        self.phrases, self.tags = ahocorasick.Automaton(), ahocorasick.Automaton()
        self.base = set(base)
        for phrase, label in {**more, **base}.items():
            self.phrases.add_word(f" {phrase} ", (phrase, label))
        for tag in tags:
            self.tags.add_word(tag, tag)
        self.phrases.make_automaton()
        self.tags.make_automaton()

    def scan(self, text: str | None) -> dict:
        raw = (text or "").encode()
        words = raw.translate(_KEEP).split()
        joined = b" " + b" ".join(words) + b" "
        flat = joined.decode()
        base_labels, labels, starts, permissive, parsed = set(), set(), [], [], False
        hits = [(end - len(phrase) - 1, phrase, label) for end, (phrase, label) in self.phrases.iter(flat)]
        if hits:
            spaces = np.flatnonzero(np.frombuffer(flat.encode("utf-32-le"), np.uint32) == 32)
            for at, phrase, label in hits:
                labels.add(label)
                if phrase in self.base:
                    base_labels.add(label)
                    starts.append(int(np.searchsorted(spaces, at)))
        low = raw.lower().decode()
        ends: list[int] = []
        for end, _ in self.tags.iter(low):
            ends = ends or [m.start() for m in re.finditer("\n|$", low)]
            postfix, good = to_postfix(low, end + 1, ends[bisect.bisect_left(ends, end)])
            found, free = evaluate(postfix)
            labels |= found
            parsed |= good and bool(found)
            permissive.append(free)
        score = 1.0 if parsed else 1.0 - 1.0 / (1 + len(labels)) if labels else 0.0
        return {
            "n_words": len(words),
            "n_base": len(starts),
            "first_word": min(starts, default=None),
            "last_word": max(starts, default=None),
            "base_labels": ",".join(sorted(base_labels)),
            "labels": ",".join(sorted(labels)),
            "score": score,
            "permissive": all(permissive) if permissive else bool(labels) and labels <= PERMISSIVE,
        }


COLUMNS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "permissive")


def scan_licenses(docs: DataFrame, base=BASE_PHRASES, more=MORE_PHRASES, tags=TAGS) -> DataFrame:
    """``doc_id`` and ``COLUMNS`` of every row of ``docs(doc_id, text)``."""

    def rows(batches):
        scanner = Scanner(base, more, tags)
        for batch in batches:
            found = [scanner.scan(t) for t in batch.column(1).to_pylist()]
            yield {"doc_id": batch.column(0), **{c: [x[c] for x in found] for c in COLUMNS}}

    return map_arrow(docs.select(F.col("doc_id").cast("bigint"), "text"), rows, "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, permissive boolean")
