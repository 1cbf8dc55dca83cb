"""Byte-pair encoding over Arrow batches.

Plain texts are split into pre-tokens by vector operations on their bytes,
others by the vocabulary's pattern. The pre-tokens of a batch are
dictionary-encoded, and only distinct ones that the worker has not met lately
are encoded, by the engine that the operator passes. Results equal the
tokenizers library's for the same file.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .common import ragged, sums

#: Pre-tokens that a worker remembers; beyond it, those that the last batch didn't use go.
REMEMBERED = 200_000
#: Plain texts: ASCII and the letters from U+00C0 to U+00FF, no apostrophe, white space only single blanks or line ends between other characters.
_ODD = r"[^\x00-\x7f\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]|[\t\x0b-\r']|[ \n][ \n]|^[ \n]|[ \n]$"
_LETTER, _DIGIT, _OTHER, _BLANK, _LINE = range(5)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", *range(128, 256)]] = _LETTER
_KIND[list(b"0123456789")] = _DIGIT
_KIND[32], _KIND[10] = _BLANK, _LINE
#: Fixed value: the byte-level vocabulary's pattern of pre-tokens.
_BYTE_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Merges:
    """The merges of a vocabulary as arrays: a hash table from a pair of ids to rank and result."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.vocab = vocab
        self.end = model.get("end_of_word_suffix") or ""
        self.size = max(*vocab.values(), *(t["id"] for t in spec["added_tokens"])) + 1
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        letters = byte_letters()
        self.first = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[letters[b] + self.end] for b in range(256)], np.int32) if self.end else self.first
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self._table()

    def _table(self) -> None:
        bits = 18
        self.shift = np.uint64(64 - bits)
        keys = (self.left << 20 | self.right).astype(np.uint64)
        size = 1 << bits
        self.keys = np.full(size + 64, np.iinfo(np.uint64).max, np.uint64)
        self.ranks = np.full(size + 64, np.iinfo(np.int32).max, np.int32)
        left, rank, slot = keys, np.arange(len(keys), dtype=np.int32), (keys * _MIX >> self.shift).astype(np.int64)
        self.probes = 0
        while len(left):  # each round, one key of each free slot settles; the others go to the next slot
            self.probes += 1
            free = np.flatnonzero(self.keys[slot] == np.iinfo(np.uint64).max)
            _, chosen = np.unique(slot[free], return_index=True)
            settled = free[chosen]
            self.keys[slot[settled]], self.ranks[slot[settled]] = left[settled], rank[settled]
            rest = np.ones(len(left), bool)
            rest[settled] = False
            left, rank, slot = left[rest], rank[rest], slot[rest] + 1
        pairs = np.arange(1 << 16)
        self.bytes_rank = self.rank(self.first[pairs >> 8], self.first[pairs & 255])

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids; the largest int32 where there is no such merge."""
        keys = (a.astype(np.uint64) << np.uint64(20)) | b.astype(np.uint64)
        slot = (keys * _MIX >> self.shift).astype(np.int64)
        out = np.where(self.keys[slot] == keys, self.ranks[slot], np.iinfo(np.int32).max)
        open_ = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] != np.iinfo(np.uint64).max))
        for _ in range(self.probes):
            if not len(open_):
                break
            slot[open_] += 1
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.ranks[slot[open_[hit]]]
            open_ = open_[~hit & (found != np.iinfo(np.uint64).max)]
        return out


@lru_cache(maxsize=4)
def merges(path: str) -> Merges:
    return Merges(path)


def rank_synchronous(m: Merges, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words, concatenated, and how many each has.

    The words are one ragged array. Every round finds the lowest rank among each
    word's pairs and merges all its pairs of that rank, left to right, in all
    words at once, until no word has a pair with a rank. Ranks stay beside their
    pairs, and only those of the pairs next to a merge are looked up anew.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer(b"".join(words), np.uint8)
    if not len(flat):
        return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
    none = np.iinfo(np.int32).max
    word = np.flatnonzero(lengths)  # the words that are still in the array, and their symbols
    sizes = lengths[word]
    ends = np.cumsum(sizes) - 1
    ids = m.first[flat]
    rank = np.full(len(ids), none, np.int32)
    rank[:-1] = m.bytes_rank[(flat[:-1].astype(np.int32) << 8) | flat[1:]]
    last = np.zeros(len(ids), bool)
    last[ends] = True
    if m.end:
        ids[ends] = m.last[flat[ends]]
        at = ends[sizes > 1] - 1
        rank[at] = m.rank(ids[at], ids[at + 1])
    rank[ends] = none
    ids_out: list[np.ndarray] = []
    word_out: list[np.ndarray] = []
    while True:
        best = np.minimum.reduceat(rank, np.cumsum(sizes) - sizes)
        live = best < none
        some = np.count_nonzero(live)
        if 2 * some <= len(live):  # finished words leave the array
            done = np.repeat(~live, sizes)
            ids_out.append(ids[done])
            word_out.append(np.repeat(word[~live], sizes[~live]))
            if not some:
                break
            ids, rank, last = ids[~done], rank[~done], last[~done]
            word, sizes, best = word[live], sizes[live], best[live]
        at = np.flatnonzero(rank == np.repeat(np.where(best < none, best, -1), sizes))
        run = np.concatenate(([False], at[1:] == at[:-1] + 1))
        if run.any():  # aaa: of neighbouring hits, every second one merges
            index = np.arange(len(at))
            at = at[((index - np.maximum.accumulate(np.where(run, 0, index))) & 1) == 0]
        ids[at] = m.made[rank[at]]
        last[at] = last[at + 1]
        keep = np.ones(len(ids), bool)
        keep[at + 1] = False
        sizes = sizes - np.bincount(np.searchsorted(np.cumsum(sizes), at, "right"), minlength=len(sizes))
        ids, rank, last = ids[keep], rank[keep], last[keep]
        at = at - np.arange(len(at))  # where the merged symbols are now
        rank[at] = none
        before = at[at > 0] - 1
        at = np.concatenate((at[~last[at]], before[~last[before]]))
        rank[at] = m.rank(ids[at], ids[at + 1])
    owners, values = np.concatenate(word_out), np.concatenate(ids_out)
    return values[np.argsort(owners, kind="stable")], np.bincount(owners, minlength=len(words)).astype(np.int64)


class PrefixCoder:
    """Exact encoding by dynamic programming over prefixes.

    For every prefix of a pre-token exactly one token can end its encoding. An
    automaton over the vocabulary gives the tokens that end at each position;
    a token is that prefix's last one if merging could not have crossed the
    border to the last token of the prefix before it. Following the stored last
    tokens back from the end gives the ids.
    """

    #: Results of pair tests that are remembered.
    PAIRS = 400_000

    def __init__(self, m: Merges):
        import ahocorasick

        if m.end:
            raise ValueError("prefix coding needs a byte-level vocabulary without word ends")
        back = {c: b for b, c in byte_letters().items()}
        self.bytes_of: list[bytes] = [b""] * m.size
        for token, i in m.vocab.items():
            if token not in m.specials:
                self.bytes_of[i] = bytes(back[c] for c in token)
        for token, i in m.specials.items():
            self.bytes_of[i] = token.encode()
        order = {int(i): r for r, i in enumerate(m.made)}
        self.split = {int(i): (int(a), int(b)) for i, a, b in zip(m.made, m.left, m.right)}
        self.joined = {(int(a), int(b)): r for r, (a, b) in enumerate(zip(m.left, m.right))}
        self.order = order
        self.known: dict[int, bool] = {}
        self.matches = ahocorasick.Automaton()
        for token, i in m.vocab.items():
            if token not in m.specials and self._whole(i):
                w = self.bytes_of[i]
                self.matches.add_word(w.decode("latin-1"), (i, len(w)))
        self.matches.make_automaton()

    def _whole(self, token: int) -> bool:
        """Whether the token's own bytes encode to it: its two parts must be such tokens that may stand side by side until its own merge."""
        if token not in self.split:
            return True
        a, b = self.split[token]
        return self._compatible(a, b, self.order[token])

    def _compatible(self, a: int, b: int, below: int | None = None) -> bool:
        """Whether the merges leave a and b side by side. Undoes the latest merge on either side of the border, step by step: no pair that then meets there may have a merge that would have come first."""
        limit = len(self.order) if below is None else below
        rank, split, joined = self.order, self.split, self.joined
        while True:
            r = joined.get((a, b))
            if r is not None and r < limit:
                return False
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:  # at equal ranks the left one merged first
                limit, a = ra, split[a][1]
            else:
                limit, b = rb + 1, split[b][0]

    def encode(self, word: bytes) -> list[int]:
        n = len(word)
        last = [0] * (n + 1)
        size = [0] * (n + 1)
        known = self.known
        for end, (token, length) in self.matches.iter(word.decode("latin-1")):
            end += 1
            if size[end]:
                continue
            start = end - length
            if start:
                before = last[start]
                key = before << 20 | token
                fits = known.get(key)
                if fits is None:
                    if len(known) >= self.PAIRS:
                        known.clear()
                    fits = known[key] = self._compatible(before, token)
                if not fits:
                    continue
            last[end], size[end] = token, length
        out = []
        while n:
            out.append(last[n])
            n -= size[n]
        return out[::-1]

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lists = [self.encode(w) for w in words]
        return np.array([i for x in lists for i in x], np.int32), np.array([len(x) for x in lists], np.int64)


class TextEncoder:
    """Encodes Arrow columns of texts with a vocabulary file; engine(words) gives ids and counts of pre-tokens' bytes."""

    def __init__(self, path: str, engine: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]] | None = None):
        self.path = path
        self.m = merges(path)
        self.engine = engine or (lambda words: rank_synchronous(self.m, words))
        self.lower = bool(self.m.end)
        self.special = regex.compile("(" + "|".join(re.escape(s) for s in self.m.specials) + ")")
        self.odd = _ODD + "".join("|" + re.escape(s) for s in self.m.specials)
        self.words = pa.array(list(self.m.specials), pa.large_binary())
        self.ids = np.array(list(self.m.specials.values()), np.int32)
        self.sizes = np.ones(len(self.ids), np.int64)
        self._library = None

    def library(self):
        if self._library is None:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
            self._library.no_truncation()
            self._library.no_padding()
        return self._library

    def _plain(self, column: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Pre-tokens of plain texts, concatenated, and how many each text has."""
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        if not len(data):
            return pa.array([], pa.large_binary()), np.zeros(len(column), np.int64)
        kind = _KIND[data]
        start = np.empty(len(data), bool)
        start[0] = True
        start[1:] = kind[1:] != kind[:-1]
        if self.lower:
            low = data.copy()
            low[(data >= 65) & (data <= 90)] += 32
            wide = np.flatnonzero(data == 0xC3) + 1  # U+00C0 to U+00DE; the sign among them isn't plain
            low[wide[data[wide] <= 0x9E]] += 32
            start |= kind == _DIGIT
            start[offsets[:-1][np.diff(offsets) > 0]] = True
            solid = kind < _BLANK
            start &= solid
            data, start = low[solid], start[solid]
            place = np.concatenate(([0], np.cumsum(solid)))[offsets]
        else:
            start[1:] &= kind[:-1] != _BLANK
            start |= kind >= _BLANK
            start[offsets[:-1][np.diff(offsets) > 0]] = True
            place = offsets
        at = np.flatnonzero(start)
        ends = np.concatenate((at, [len(data)]))
        words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        return words, np.diff(np.searchsorted(at, place))

    def _words(self, text: str) -> list[bytes]:
        """Pre-tokens of any text for a byte-level vocabulary; special strings are such themselves."""
        out = []
        for k, part in enumerate(self.special.split(text)):
            out += [part.encode()] if k & 1 else [p.encode() for p in _BYTE_PATTERN.findall(part)]
        return out

    def _known(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of these distinct pre-tokens start in self.ids, and how many there are; encodes the new ones."""
        found = pc.index_in(words, value_set=self.words)
        new = words.filter(pc.is_null(found))
        at = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(new):
            ids, sizes = self.engine(new.to_pylist())
            held = len(self.words)
            if held + len(new) > REMEMBERED:
                used = np.zeros(held, bool)
                used[: len(self.m.specials)] = True
                used[at[at >= 0]] = True
                starts = np.cumsum(self.sizes) - self.sizes
                kept = np.flatnonzero(used)
                self.ids = self.ids[ragged(starts[kept], self.sizes[kept])]
                self.words, self.sizes = self.words.take(pa.array(kept)), self.sizes[kept]
                place = np.full(held + 1, -1)
                place[kept] = np.arange(len(kept))
                at, held = place[at], len(kept)
            at[at < 0] = held + np.arange(len(new))
            self.words = pa.concat_arrays([self.words, new])
            self.ids = np.concatenate((self.ids, ids.astype(np.int32)))
            self.sizes = np.concatenate((self.sizes, sizes))
        starts = np.cumsum(self.sizes) - self.sizes
        return starts[at], self.sizes[at]

    def _coded(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, dict[int, list[int]]]:
        """Of each pre-token where its ids start and how many there are; pre-tokens of each text; which texts are not plain; ids of those encoded whole."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = pc.fill_null(column.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(column, self.odd).to_numpy(zero_copy_only=False)
        whole: dict[int, list[int]] = {}
        if odd.any():
            plain = np.flatnonzero(~odd)
            words, some = self._plain(column.take(pa.array(plain)))
            counts = np.zeros(len(column), np.int64)
            counts[plain] = some
            if self.lower:
                whole = {i: self.library().encode(column[i].as_py(), add_special_tokens=False).ids for i in np.flatnonzero(odd).tolist()}
            else:
                others = {i: self._words(column[i].as_py()) for i in np.flatnonzero(odd).tolist()}
                words = pa.concat_arrays([words, pa.array([w for x in others.values() for w in x], pa.large_binary())])
                more = np.array([len(x) for x in others.values()], np.int64)
                counts[odd] = more
                ends = np.cumsum(counts)
                order = np.empty(int(ends[-1]), np.int64)
                order[ragged((ends - counts)[plain], some)] = np.arange(int(some.sum()))
                order[ragged((ends - counts)[odd], more)] = int(some.sum()) + np.arange(int(more.sum()))
        else:
            words, counts = self._plain(column)
        coded = words.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        if odd.any() and not self.lower:
            code = code[order]
        starts, sizes = self._known(coded.dictionary)
        return starts[code], sizes[code], counts, odd, whole

    def counts(self, column: pa.Array) -> np.ndarray:
        """Tokens of each text."""
        _, sizes, counts, _, whole = self._coded(column)
        out = sums(sizes, counts)
        for i, x in whole.items():
            out[i] = len(x)
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, concatenated, and how many each has."""
        starts, sizes, counts, _, whole = self._coded(column)
        ids, of = self.ids[ragged(starts, sizes)], sums(sizes, counts)
        if whole:
            parts = np.split(ids, np.cumsum(of)[:-1])
            for i, x in whole.items():
                parts[i], of[i] = np.array(x, np.int32), len(x)
            ids = np.concatenate(parts)
        return ids, of


@lru_cache(maxsize=2)
def encoder(path: str, engine: str = "rank") -> TextEncoder:
    """The worker's encoder; engine is rank or prefix."""
    return TextEncoder(path, PrefixCoder(merges(path)) if engine == "prefix" else None)
