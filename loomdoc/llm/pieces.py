"""Pre-tokens of whole slices, and caches from a pre-token's hash to its token ids or their number."""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np

from .kernels import INV, MUL, _pow, mix

LETTER, NUMBER, MARK, SPACE = range(4)


def points(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The texts joined, their code points and each text's offset."""
    joined = "".join(texts)
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return joined, np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), off


def _mixed(cps: np.ndarray) -> np.ndarray:
    return mix(cps.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


@functools.cache
def _low() -> np.ndarray:
    """_mixed of the code points below 0x10000."""
    return _mixed(np.arange(0x10000))


def span_hashes(cps: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    n = len(cps)
    sums = np.zeros(n + 1, np.uint64)
    each = _low()[np.minimum(cps, np.uint32(0xFFFF))]
    high = np.flatnonzero(cps > 0xFFFF)
    each[high] = _mixed(cps[high])
    each *= _pow(MUL, n + 1, "mul")[:n]
    np.cumsum(each, out=sums[1:])
    return mix((sums[end] - sums[start]) * _pow(INV, n + 1, "inv")[start] + (end - start).astype(np.uint64))


@functools.cache
def classes() -> np.ndarray:
    """Letter, number, white space or other, of each code point."""
    import regex

    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "!" for c in range(0x110000))
    table = np.full(0x110000, MARK, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            table[m.start() : m.end()] = kind
    return table


def byte_level_starts(cps: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of byte-level BPE begin (contractions, letters, numbers, marks, white space; a space goes with what follows)."""
    n = len(cps)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[cps]
    start = np.zeros(n + 1, bool)
    start[off] = True
    start[1:n] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(start[:n])
    ends = np.append(runs[1:], n)
    last = np.zeros(n + 1, bool)
    last[off] = True
    inner = (kind[runs] == SPACE) & ~last[ends]
    e = ends[inner]
    start[e - 1] = True
    start[e[cps[e - 1] == 0x20]] = False
    # 's 't 'm 'd 're 've 'll, where the apostrophe stands alone and no space goes with it
    p = runs[(ends - runs == 1) & (cps[runs] == 0x27)]
    p = p[start[p] & (p + 1 < n)]
    p = p[~last[p + 1]]
    a = cps[p + 1]
    one = p[np.isin(a, [ord(c) for c in "stmd"])]
    two = p[~np.isin(a, [ord(c) for c in "stmd"]) & (p + 2 < n)]
    two = two[~last[two + 2]]
    a, b = cps[two + 1], cps[two + 2]
    two = two[((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))]
    start[one + 1] = False
    start[one + 2] = True
    start[two + 1] = False
    start[two + 3] = True
    return np.flatnonzero(start[:n])


class Cache:
    """Sorted hashes with a run of values each; bounded, and emptied when full. Keys are told by their 64-bit hashes alone."""

    def __init__(self, dtype, limit: int = 400_000):
        self.dtype, self.limit = dtype, limit
        self.clear()

    def clear(self) -> None:
        self.pool = np.zeros(0, self.dtype)
        self.levels = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)) for _ in range(2)]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin in the pool (-1: missing) and length of each key."""
        begin, size = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int32)
        for have, b, s in self.levels:
            if len(have):
                at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
                hit = have[at] == keys
                begin[hit], size[hit] = b[at[hit]], s[at[hit]]
        return begin, size

    def add(self, keys: np.ndarray, lists: list) -> None:
        """keys: sorted and missing so far."""
        if len(self.levels[0][0]) + len(self.levels[1][0]) + len(keys) > self.limit:
            self.clear()
        size = np.array([len(x) for x in lists], np.int32)
        begin = len(self.pool) + np.cumsum(size) - size
        self.pool = np.concatenate([self.pool, np.array([y for x in lists for y in x], self.dtype)])
        new = (keys, begin, size)
        old = self.levels[1]
        if len(old[0]):
            new = self._merged(old, new)
        if len(new[0]) > 20_000 + len(self.levels[0][0]) // 3:
            self.levels = [self._merged(self.levels[0], new), self.levels[1].__class__((np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)))]
        else:
            self.levels[1] = new

    @staticmethod
    def _merged(a, b):
        keys = np.concatenate([a[0], b[0]])
        order = np.argsort(keys, kind="stable")
        return keys[order], np.concatenate([a[1], b[1]])[order], np.concatenate([a[2], b[2]])[order]


class Slots:
    """Runs of values by 64-bit hash, one key in each slot (the hash's low bits). A key that was found since its slot was last asked for keeps it once more, any other gives way:
    memory is bounded, and rare keys don't drive out frequent ones. Keys are told by their 64-bit hashes alone."""

    def __init__(self, dtype, bits: int = 20):
        n = 1 << bits
        self.mask = np.uint64(n - 1)
        self.keys, self.begin, self.size, self.found = np.zeros(n, np.uint64), np.full(n, -1, np.int64), np.zeros(n, np.int32), np.zeros(n, bool)
        self.pool, self.end = np.zeros(n, dtype), 0

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin in the pool (-1: missing) and length of each key; they hold until the next call."""
        if self.end > 4 * len(self.keys):
            self._compact()
        slot = (keys & self.mask).astype(np.int64)
        begin = np.where(self.keys[slot] == keys, self.begin[slot], -1)
        self.found[slot[begin >= 0]] = True
        return begin, self.size[slot]

    def add(self, keys: np.ndarray, values: np.ndarray, size: np.ndarray) -> np.ndarray:
        """keys: distinct and missing so far. The begin of each, which holds until the next find even if the key got no slot."""
        begin, end = self.end + np.cumsum(size) - size, self.end + len(values)
        if end > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.end], np.zeros(max(end, 2 * self.end) - self.end, self.pool.dtype)])
        self.pool[self.end : end] = values
        self.end = end
        slot = (keys & self.mask).astype(np.int64)
        free = np.flatnonzero(~self.found[slot])
        self.found[slot] = False
        self.keys[slot[free]] = keys[free]
        won = free[self.keys[slot[free]] == keys[free]]  # one of those that share a slot
        self.begin[slot[won]], self.size[slot[won]] = begin[won], size[won]
        return begin

    def _compact(self) -> None:
        live = np.flatnonzero(self.begin >= 0)
        values, size = runs_of(self.pool, self.begin[live], self.size[live]), self.size[live].astype(np.int64)
        self.begin[live] = np.cumsum(size) - size
        self.end = len(values)
        self.pool = np.concatenate([values, np.zeros(max(0, len(self.keys) - len(values)), values.dtype)])


def runs_of(pool: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The pool's runs, one after the other."""
    size = size.astype(np.int64)
    end = np.cumsum(size)
    return pool[np.repeat(begin - (end - size), size) + np.arange(int(end[-1]) if len(end) else 0)]


class ByteLevelEncoder:
    """Ids of whole texts as tokenizers gives them, from the library's of each new pre-token.

    A text that holds a special token's string goes to the library whole. New pre-tokens are given to it as the words of one text: a batch
    would be dealt to threads, which costs more than it saves when every core has a task.
    """

    #: Pre-tokens given to the library at once.
    WORDS = 20_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.cache = Slots(self.dtype)

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words and their number in each."""
        ids, size = [], []
        for at in range(0, len(words), self.WORDS):
            some = words[at : at + self.WORDS]
            e = self.tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(e.ids, self.dtype))
            size.append(np.bincount(np.array(e.word_ids, np.int64), minlength=len(some)))
        return np.concatenate(ids), np.concatenate(size)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids and the offset of each text's."""
        whole = {i: self._whole(t) for i, t in enumerate(texts) if any(s in t for s in self.special)}
        joined, cps, off = points(["" if i in whole else t for i, t in enumerate(texts)])
        start = byte_level_starts(cps, off)
        end = np.append(start[1:], len(cps))
        keys = span_hashes(cps, start, end)
        begin, size = self.cache.find(keys)
        miss = np.flatnonzero(begin < 0)
        if len(miss):
            new, first, inverse = np.unique(keys[miss], return_index=True, return_inverse=True)
            first = miss[first]
            values, n = self._words([joined[a:b] for a, b in zip(start[first].tolist(), end[first].tolist())])
            begin[miss], size[miss] = self.cache.add(new, values, n)[inverse], n[inverse]
        ids = runs_of(self.cache.pool, begin, size)
        ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        ends = ends[np.searchsorted(start, off)]
        if whole:
            parts = [np.array(whole[i], self.dtype) if i in whole else ids[ends[i] : ends[i + 1]] for i in range(len(texts))]
            ids, ends = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, ends


@functools.cache
def byte_level(path: str) -> ByteLevelEncoder:
    """One for each worker process."""
    return ByteLevelEncoder(path)


def space_segments(cps: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points with U+2581 as a space, the begins of the segments between which no piece can reach (each begins with
    a run of spaces, the text's first with the prefix that the library adds), and the spans without that first space."""
    cps = np.where(cps == 0x2581, np.uint32(0x20), cps)
    n = len(cps)
    if not n:
        return cps, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = cps == 0x20
    start = np.zeros(n + 1, bool)
    start[1:n] = space[1:] & ~space[:-1]
    first = np.zeros(n + 1, bool)
    first[off] = True
    start |= first
    begin = np.flatnonzero(start[:n])
    return cps, begin, np.where(first[begin], begin, begin + 1), np.append(begin[1:], n)


class PieceCounter:
    """Token counts of whole texts as sentencepiece gives them: frequent segments from a given table, others from a cache."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.cache = Cache(np.int32)

    def lengths(self, segments: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(segments, num_threads=1)] if segments else []

    def count(self, texts: list[str], keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        joined, cps, off = points(texts)
        cps, opens, start, end = space_segments(cps, off)
        h = span_hashes(cps, start, end)
        n = np.zeros(len(h), np.int32)
        left = np.arange(len(h))
        if len(keys):
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[at] == h
            n[hit] = sizes[at[hit]]
            left = np.flatnonzero(~hit)
        own, first, inverse = np.unique(h[left], return_index=True, return_inverse=True)
        begin, _ = self.cache.find(own)
        miss = np.flatnonzero(begin < 0)
        value = np.zeros(len(own), np.int32)
        value[begin >= 0] = self.cache.pool[begin[begin >= 0]]
        if len(miss):
            at = left[first[miss]].tolist()
            value[miss] = self.lengths([joined[start[p] : end[p]] for p in at])
            self.cache.add(own[miss], [[v] for v in value[miss].tolist()])
        n[left] = value[inverse]
        n[start == end] = 1  # a lone space at a text's end
        sums = np.concatenate([[0], np.cumsum(n)])
        at = np.searchsorted(opens, off)
        return sums[at[1:]] - sums[at[:-1]]


@functools.cache
def piece_counter(path: str) -> PieceCounter:
    return PieceCounter(path)
