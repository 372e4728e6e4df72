"""Token ids of many texts by a public tokenizer file, each distinct word encoded once."""

from __future__ import annotations

import os

import numpy as np

from . import words

_LOADED: dict = {}
#: Kinds of bytes: white space, letters, digits, marks that start no contraction and no special token, others.
_BLANK, _LETTER, _DIGIT, _MARK, _OTHER = range(5)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[32, *range(9, 14)]] = _BLANK
_KIND[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = _LETTER
_KIND[list(b"0123456789")] = _DIGIT
_KIND[list(b"!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~")] = _MARK


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it prints, else from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in own)
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


def simple_pieces(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A segment cut where the tokenizer cuts: bytes with plain words in lower case, starts and ends of pieces, the first piece of each text, and which are to be encoded as they stand.

    A word of ASCII and Latin-1 letters, digits and ASCII marks is plain: it is cut into runs
    of letters, single digits and runs of marks.  Any other word is one piece.
    """
    kind = _KIND[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]  # the two that are no letters
    kind[lead] = kind[lead + 1] = _LETTER
    low = words.lowered(data)
    capital = lead[low[lead + 1] <= 0x9E] + 1
    low[capital] += 0x20
    starts, ends, first = words.spans(data, at)
    odd = np.unique(np.searchsorted(starts, np.flatnonzero(kind == _OTHER), side="right") - 1)
    change = np.flatnonzero((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)) + 1
    change = change[(kind[change] != _BLANK) & (kind[change - 1] != _BLANK)]
    word = np.searchsorted(starts, change, side="right") - 1
    inside = (change > starts[word]) if len(starts) else np.zeros(0, bool)
    if len(odd):
        inside &= ~np.isin(word, odd)
        for a, b in zip(starts[odd].tolist(), ends[odd].tolist()):
            low[a:b] = data[a:b]
    cuts = change[inside]
    whole = np.zeros(len(starts), bool)
    whole[odd] = True
    place = np.searchsorted(starts, cuts)  # a cut is never a start
    return low, np.insert(starts, place, cuts), np.insert(ends, place - 1, cuts), first + np.searchsorted(cuts, at), np.insert(whole, place, False)


class WordCache:
    """Ids of whole texts by the ``tokenizers`` library, each distinct piece encoded once.

    It is for lower-casing byte-level tokenizers that drop white space, as in
    ``word_bpe_49k.json``.  Pieces are known by 128 bits of hashes; about ``most`` are kept
    as flat arrays, some 40 bytes each, those used most often staying.
    """

    def __init__(self, path: str, most: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.model, self.letters = self.tokenizer.model, str.maketrans({chr(b): c for b, c in byte_letters().items()})
        self.key, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.at, self.n, self.uses = (np.zeros(0, np.int64) for _ in range(3))
        self.pool = np.zeros(0, np.uint32)

    def ask(self, piece: bytes, whole: bool) -> list[int]:
        if whole:
            return self.tokenizer.encode(piece.decode(), add_special_tokens=False).ids
        return [t.id for t in self.model.tokenize(piece.decode("latin-1").translate(self.letters))]

    def trim(self) -> None:
        """Keep the half that is used most."""
        keep = np.sort(np.argsort(-self.uses, kind="stable")[: self.most // 2])
        n = self.n[keep]
        starts = np.cumsum(n) - n
        self.pool = self.pool[np.repeat(self.at[keep] - starts, n) + np.arange(n.sum())]
        self.key, self.check, self.n, self.at, self.uses = self.key[keep], self.check[keep], n, starts, self.uses[keep] // 2

    def places(self, key: np.ndarray, check: np.ndarray, piece) -> np.ndarray:
        """Where the ids of distinct pieces are; unseen ones, given by ``piece(number)``, are encoded first."""
        at = np.minimum(np.searchsorted(self.key, key), max(len(self.key) - 1, 0))
        new = np.flatnonzero((self.key[at] != key) | (self.check[at] != check)) if len(self.key) else np.arange(len(key))
        if len(new):
            ids = [self.ask(*piece(k)) for k in new.tolist()]
            n = np.array([len(x) for x in ids], np.int64)
            if len(self.key):  # another piece of the same key gives way
                gone = at[new][self.key[at[new]] == key[new]]
                for name in ("key", "check", "at", "n", "uses") if len(gone) else ():
                    setattr(self, name, np.delete(getattr(self, name), gone))
            order = new[np.argsort(key[new])]
            back = np.argsort(key[new])
            where = np.searchsorted(self.key, key[order])
            start = len(self.pool) + np.cumsum(n) - n
            self.pool = np.concatenate([self.pool, np.array([i for x in ids for i in x], np.uint32)])
            for name, value in (("key", key[order]), ("check", check[order]), ("at", start[back]), ("n", n[back]), ("uses", np.zeros(len(order), np.int64))):
                setattr(self, name, np.insert(getattr(self, name), where, value))
            at = np.searchsorted(self.key, key)
        self.uses[at] += 1
        return at

    def encode(self, column, end: int | None = None) -> list[np.ndarray]:
        """Each text's ids (of an Arrow column), with ``end`` behind if given; null is the empty text."""
        parts: list[list[np.ndarray]] = [[] for _ in range(len(column))]
        for first, data, edges in words.segments(column):
            low, starts, ends, begin, whole = simple_pieces(data, edges)
            if not len(starts):
                continue
            key, codes, seen = words.numbered(words.hashes(low, starts, ends), ordered=True)
            # the second hash tells pieces in lower case from those that stand as they are, too
            check = words.hashes(low, starts, ends, 1)[seen] ^ whole[seen].astype(np.uint64)
            at = self.places(key, check, lambda k: (low[starts[seen[k]] : ends[seen[k]]].tobytes(), bool(whole[seen[k]])))
            n = self.n[at][codes]
            edge = np.concatenate([[0], np.cumsum(n)])
            ids = self.pool[np.repeat(self.at[at][codes] - edge[:-1], n) + np.arange(edge[-1])]
            cut = edge[begin].tolist()
            for k, (a, b) in enumerate(zip(cut, cut[1:])):
                if b > a:
                    parts[first + k].append(ids[a:b])
            if len(self.key) > self.most:
                self.trim()
        tail = [] if end is None else [np.array([end], np.uint32)]
        return [np.concatenate(p + tail) if p or tail else np.zeros(0, np.uint32) for p in parts]


def word_cache(path: str) -> WordCache:
    """One a worker process and file."""
    if path not in _LOADED:
        _LOADED[path] = WordCache(path)
    return _LOADED[path]


def byte_encoder(ranks: str):
    """A function from texts to 16-bit ids as bytes, by a file of byte-level ranks; one a worker process and file."""
    if ranks not in _LOADED:
        import base64

        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _LOADED[ranks] = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
    encoding = _LOADED[ranks]
    return lambda texts: [np.array(encoding.encode_ordinary(t or ""), dtype="<u2").tobytes() for t in texts]
