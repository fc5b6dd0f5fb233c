"""The byte-level encoder: its calls of the library, its cache and its ids."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import numpy as np
import public_tokenizers

from loomdoc.llm import pieces

BYTES = public_tokenizers.path("byte_bpe_50k.json")
ROOT = str(Path(__file__).resolve().parents[2])


class Asked:
    """The library's tokenizer, and what it was asked for."""

    def __init__(self, tokenizer):
        self.tokenizer, self.words = tokenizer, []

    def encode_batch_fast(self, texts, **more):
        self.words += texts
        return self.tokenizer.encode_batch_fast(texts, **more)

    def encode(self, words, **more):
        self.words += words
        return self.tokenizer.encode(words, **more)


def test_rare_words_leave_frequent_ones_in_the_cache():
    encoder = pieces.ByteLevelEncoder(BYTES)
    encoder.tokenizer = asked = Asked(encoder.tokenizer)
    frequent = [f" often{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)]
    for k in range(45):  # 450,000 rare words
        encoder.encode(["".join(frequent) + "".join(f" {'abcdefghij'[k % 10]}{'klmno'[k // 10]}{chr(97 + i // 676 % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}" for i in range(10_000))])
    assert sum(w.startswith(" often") for w in asked.words) == 200


def test_encoding_stays_on_its_own_core():
    """A worker that deals words to threads of the library spends the cores of other tasks."""
    code = f"""
from loomdoc.llm import pieces
threads = lambda: int(open('/proc/self/status').read().split('Threads:')[1].split()[0])
encoder = pieces.ByteLevelEncoder({BYTES!r})
encoder.encode([''])
before = threads()
encoder.encode([' '.join(f'word{{i}} is{{i * 7919 % 10007}}' for i in range(5000))] * 3)
print(before, threads())
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True, timeout=120).stdout.split()
    assert out[0] == out[1]


def test_ids_with_a_small_cache_are_the_library_s():
    """Keys share slots, the pool is compacted, words come in several calls."""
    encoder = pieces.ByteLevelEncoder(BYTES)
    library = encoder.tokenizer
    encoder.WORDS = 7
    encoder.cache = pieces.Slots(encoder.dtype, bits=4)
    rng = np.random.default_rng(5)
    words = ["the", "a", "don't", "naïve", "日本語", "🙂🙃", "x" * 70, "  ", "\n\n", "1234567", "\U0001f600word", "end　", "<|endoftext|>", "we'll", "'s", "\t"]
    for _ in range(60):
        texts = ["", *(" ".join(rng.choice(words[: 12 + i % 5], int(rng.integers(0, 30)))) + str(rng.integers(0, 10_000)) for i in range(6))]
        ids, off = encoder.encode(texts)
        want = [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == want
    assert len(encoder.cache.keys) == 16 and encoder.cache.end <= 4 * 16 + 2000


def test_slots_give_what_was_put():
    slots = pieces.Slots(np.uint16, bits=3)
    rng = np.random.default_rng(9)
    value = {}
    for _ in range(200):
        keys = np.unique(rng.integers(0, 60, 12).astype(np.uint64))
        begin, size = slots.find(keys)
        miss = np.flatnonzero(begin < 0)
        runs = [[int(k) * 5 + j for j in range(int(k) % 4 + 1)] for k in keys[miss]]
        value |= dict(zip(keys[miss].tolist(), runs))
        size[miss] = [len(r) for r in runs]
        if len(miss):
            begin[miss] = slots.add(keys[miss], np.array(sum(runs, []), np.uint16), size[miss])
        assert [slots.pool[b : b + n].tolist() for b, n in zip(begin, size)] == [value[k] for k in keys.tolist()]
