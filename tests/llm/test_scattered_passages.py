import random

import pytest

from loomdoc.llm import substring


def _words(r, n):
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8))) for _ in range(n)]


@pytest.mark.parametrize(("changed", "starts"), [((35, 70, 105), range(0, 140, 35)), ((40, 72, 100), range(0, 120, 15))])
@pytest.mark.parametrize("parts", [1, 3])
def test_changed_passages_whose_parts_stand_in_earlier_documents(spark, changed, starts, parts):
    r = random.Random(len(starts) + parts)
    early, late = [], []
    for _ in range(20):
        passage = _words(r, 140)
        other = list(passage)
        for p in changed:
            other[p] = "changed"
        early += [_words(r, 40) + passage[a : a + 30] + _words(r, 40) for a in starts]
        late += [_words(r, 30) + passage + _words(r, 20), _words(r, 10) + other + _words(r, 50)]
    rows = [(i, " ".join(w)) for i, w in enumerate(early + late)]
    got = {x.doc_id: x for x in substring.repeated(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()}
    copies = range(len(early) + 1, len(rows), 2)
    assert sum(i in got and got[i].n_removed_words >= 100 for i in copies) >= 0.9 * len(copies)
    assert not set(range(len(early))) & set(got)  # runs of 30 words are no passages


def test_columns_called_like_the_operators_own(spark):
    r = random.Random(3)
    passage = " ".join(_words(r, 80))
    rows = [(i, passage + " " + " ".join(_words(r, 20)), i * 10, "x", [1]) for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, doc_key__ long, Removed__ string, spans array<int>")
    got = {x.doc_id: x for x in substring.deduplicated(docs).collect()}
    assert got[0].text == rows[0][1] and len(got[1].text.split()) == 20
    assert got[1].doc_key__ == 10 and got[1].Removed__ == "x" and got[1].spans == [1]
