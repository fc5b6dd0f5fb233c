"""The join of n-gram sets against all pairs of sets."""

import random
import re

import pytest

from loomdoc.llm import ngramjoin

SCHEMA = "doc_id long, text string, key string, rep long, n int, label long, u long"
LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def sentence(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


def changed(r, text, n):
    w = text.split()
    for i in r.sample(range(len(w)), n):
        w[i] = f"x{r.randint(0, 999)}"
    return " ".join(w)


def corpus():
    r = random.Random(11)
    base, other, passage = sentence(r, 150), sentence(r, 90), sentence(r, 60)
    texts = [None, "", " \t\n", "one", "One two three", "one TWO three", base, base.upper(), base + " tail", other, sentence(r, 8000)]
    texts += [changed(r, base, r.choice([1, 2, 3, 4, 5])) for _ in range(40)]  # near copies, some of which only meet through others
    texts += [changed(r, texts[-1], 2) for _ in range(3)]
    texts += [sentence(r, 25) + " " + passage + " " + sentence(r, 20) for _ in range(15)]  # a common passage links nothing
    texts += [changed(r, other, n) for n in (1, 2, 3)] + [texts[10] + " end"]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, base), (None, None), (9, base), (9, other + " more"), (-4, changed(r, base, 1))]
    r.shuffle(rows)
    return [(*x, "k", 1, 2, 3, 4) for x in rows]


def brute(rows, k=5):
    sets = []
    for i, t, *_ in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(LOW))
        sets.append((i, frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)]) - {()}))
    ids = {i for i, _ in sets if i is not None}
    comp = {i: i for i in ids}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = sorted((root(i), root(j)))
                comp[y] = x
    least = {s: min(i for i, t in sets if t == s and i is not None) for i, s in sets if i is not None}
    return sorted(((i, len(s), root(i), least[s] if s else i) if i is not None else (None, len(s)) for i, s in sets), key=repr)


@pytest.mark.parametrize("cfg", [ngramjoin.Config(), ngramjoin.Config(fragments=1, chunk=500, local=2, common=50, block=7, holders=3, hot=4, lead=1), ngramjoin.Config(fragments=7, common=0, block_shingles=300)])
def test_components(spark, monkeypatch, cfg):
    if cfg.common == 0:
        monkeypatch.setattr(ngramjoin, "BROADCAST_ROWS", 0)
    rows = corpus()
    got = ngramjoin.jaccard_components(spark.createDataFrame(rows, SCHEMA).repartition(4), cfg)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "class_id"]
    found = got.collect()
    assert all(r.component_id is None and r.class_id is None for r in found if r.doc_id is None)
    assert sorted((tuple(r) if r.doc_id is not None else (None, r.n_shingles) for r in found), key=repr) == brute(rows)


def test_no_documents(spark):
    assert ngramjoin.jaccard_components(spark.createDataFrame([], SCHEMA)).collect() == []
