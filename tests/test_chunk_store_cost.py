"""the chunk store packs and counts each text once, with the results of the plain expressions."""

import random

from pyspark.sql import Observation
from pyspark.sql import functions as F

from jobs import chunk_store
from loomdoc.functions import text as T
from loomdoc.operators import chunking


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_text_is_packed_once_and_its_words_are_not_split(spark):
    docs = spark.createDataFrame([(1, "a", "en", "s")], "doc_id long, text string, lang string, source string")
    cfg = chunk_store.Config()
    plan = plan_of(chunk_store.chunks(chunk_store.unique_documents(docs, cfg, Observation(), Observation()), cfg))
    assert plan.count("aggregate(split(") == 1 and plan.count("split(") == 1


def strip(c):
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def squeeze(c):
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def clean(c):
    return squeeze(F.regexp_replace(F.regexp_replace(squeeze(c), r"\.{3,}", " "), r"(?U)(\.\s){3,}", " "))


def words(c):
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def low_signal(c, min_words, share):
    w = words(c)
    return (F.size(w) < min_words) | (F.size(F.filter(w, lambda x: x.rlike(r"^\p{L}+$"))) / F.greatest(F.size(w), F.lit(1)) < share)


def packed(sentences, size, overlap):
    """The parts of a list of sentences, by Python."""
    done, now = [], ""
    for s in sentences:
        if now and len(now) + len(s) + 1 > size:
            done.append(now)
            now = f"{now[-overlap:]} {s}" if overlap else s
        else:
            now = f"{now} {s}" if now else s
    return done + [now] if now else done


def test_texts_of_any_marks_and_white_space(spark):
    rng = random.Random(9)
    marks = " " * 6 + "\t\n\r\x0b\x0c\x1c\x85\xa0\u1680\u2003\u2028\u2029\u202f\u205f\u3000\u180e\u200b" + "." * 12 + "!?\u3002\u0964" + "a\xe91-\U0001d400\u0301"
    texts = ["".join(rng.choices(marks, k=rng.randrange(60))) for _ in range(4_000)]
    texts += ["".join(rng.choices(". a", k=rng.randrange(40))) for _ in range(6_000)]
    texts += [None, "", " ", "\u3000", ". . .", ". . . ", "a . . . b", "....", " . . . .... . . . ", "a" + " " * 20_000 + "b", ". " * 50_000, "... " * 50_000, "a. " * 20_000]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(8)
    c = F.col("t")
    tidy = clean(c)
    pairs = {
        "squeeze": (squeeze(c), T.squeeze(c)),
        "clean": (tidy, T.clean(c)),
        "words": (words(c), T.words(c)),
        "low": (low_signal(c, 3, 0.3), T.low_signal(c, 3, 0.3)),
        "low_squeezed": (low_signal(tidy, 3, 0.3), T.low_signal(T.clean(c), 3, 0.3, squeezed=True)),
        "n_words": (F.size(words(tidy)), T.n_words_squeezed(T.clean(c))),
        "sentences": (F.split(c, r"(?<=[.!?。！？।])\s+"), chunking.sentences(c)),
    }
    made = df.select(*(F.struct(a.alias("a"), b.alias("b")).alias(k) for k, (a, b) in pairs.items()))
    assert {k: n for k, n in made.agg(*(F.count_if(~F.col(f"{k}.a").eqNullSafe(F.col(f"{k}.b"))).alias(k) for k in pairs)).first().asDict().items() if n} == {}
    for size, overlap in ((1, 0), (12, 4), (30, 40), (200, 10)):
        s = chunking.sentences(c)
        for row in df.where("length(t) < 100").select(s.alias("s"), chunking.packed(s, size, overlap).alias("p")).collect():
            assert row.p == packed(row.s, size, overlap)
