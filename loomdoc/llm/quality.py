"""Quality rules: base counts of each text, and a character n-gram model's perplexity within bands of its language.

The model is an interpolated modified Kneser-Ney model over n-grams of `ORDER` code points, one for each language of the `lang` column (null: a language
of its own). Texts are lower-cased, white space and control characters are spaces, digits are 0; every other code point of any script stands for itself.

1. Each task counts the distinct n-grams of its texts and sends them with their counts; Spark sums them by n-gram. What is gathered grows with the
   corpus: there is no alphabet, no sample and no cap.
2. Lower orders (continuation counts), discounts, context sums and probabilities are DataFrame operations on the distinct n-grams; nothing comes to the driver.
   The texts that are scored are those that were counted, so an n-gram that was counted once vouches for itself only: from bigrams on its discount is the whole
   count, and its mass goes to the lower order (what leaving the text out, or pruning singletons, comes to).
3. The model is stored as sorted arrays of 64-bit hashes (language and n-gram) with log probabilities. The model is made of the texts that it scores, so every
   n-gram of theirs is in it and one binary search gives its interpolated probability; an n-gram that is missing is an error.
4. The arrays go out in blocks of at most about `block` n-grams (12 bytes each), one at a time. Where one block holds all, the texts are scanned once; else once for
   each block, and the partial sums, a few bytes for each row and block, are added up.

Bands: `median +- width * spread` of the log perplexity of the language's texts that pass the base rules, with the
spread from the quartiles (at least `least_spread`), and wider for short texts by `per_char / sqrt(n)`.

Null and empty texts have no words and fail the base rules. Long texts are read whole. Rows without doc_id are judged as any other; rows are
never merged, and repeated ones count each. Equal perplexities need no rule. An empty table gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..plans.scratch import dropped, written
from .kernels import SPACED, Words, arrow_rows, lean, mix, slices, windows

ORDER = 5
PAD = "\1" * (ORDER - 1)  # no text has this character once it is folded
#: Code points of a slice that can be numbered in BITS bits, so that an n-gram is one whole number.
BITS = 12
#: A table of languages (their bands, their discounts) is broadcast up to this many rows, and joined by shuffle beyond.
BROADCAST_LANGUAGES = 100_000
#: Distinct n-grams that a task holds before it sends them.
HELD = 400_000


@dataclass(frozen=True)
class Config:
    least_words: int = 10
    repeat_percent: int = 20
    window: int = 5
    width: float = 5.0
    least_spread: float = 0.02
    per_char: float = 4.0
    block: int = 4_000_000


def _blank() -> np.ndarray:
    """Whether a code point up to 0x3000 is white space or a control character."""
    table = np.zeros(0x3002, bool)
    table[:0x21] = True
    table[[0x7F, 0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True
    table[0x2000:0x200B] = True
    return table


BLANK = _blank()


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the texts, each after its padding; the place of each n-gram in them; and the texts' offsets among the n-grams.
    A text has one n-gram for each of its characters."""
    low = [t.lower() for t in texts]
    points = np.frombuffer("".join([PAD + t for t in low]).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    lens = np.array([len(t) for t in low], np.int64)
    off = np.concatenate([[0], np.cumsum(lens)])
    at = np.arange(off[-1]) + (ORDER - 1) * np.repeat(np.arange(len(low)), lens)
    own = points[at + ORDER - 1]
    own[BLANK[np.minimum(own, 0x3001)]] = 0x20
    own[(own >= 0x31) & (own <= 0x39)] = 0x30
    points[at + ORDER - 1] = own
    return points, at, off


def distinct(points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A code for the n-gram at each place, the sorted distinct codes, their counts, and the code points of each of these (one row each)."""
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((0, ORDER), np.uint32)
    seen = np.zeros(0x110000, bool)
    seen[points] = True
    symbols = np.flatnonzero(seen).astype(np.uint32)
    if len(symbols) <= 1 << BITS:
        number = np.zeros(0x110000, np.uint16)
        number[symbols] = np.arange(len(symbols))
        ids = number[points].astype(np.uint64)
        n = len(ids) - ORDER + 1
        codes = ids[:n]
        for j in range(1, ORDER):
            codes = (codes << np.uint64(BITS)) | ids[j : j + n]
        codes = codes[at]
        own = np.sort(codes)
        begin = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        own, counts = own[begin], np.diff(np.append(begin, len(codes)))
        return codes, own, counts, np.stack([symbols[(own >> np.uint64(BITS * j)) & np.uint64((1 << BITS) - 1)] for j in range(ORDER - 1, -1, -1)], 1)
    codes = windows(mix(points.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), ORDER)[at]
    own, first, counts = np.unique(codes, return_index=True, return_counts=True)
    return codes, own, counts, np.lib.stride_tricks.sliding_window_view(points, ORDER)[at[first]]


def keys_of(rows: np.ndarray) -> np.ndarray:
    """The hash of each n-gram (a row of code points)."""
    return windows(mix(rows.ravel().astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), ORDER)[::ORDER]


def _strings(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows, np.uint32).view(f"<U{ORDER}").ravel()


def _texts(rows: pa.RecordBatch) -> list[str]:
    return [t or "" for t in rows.column("text").to_pylist()]


def _by_language(rows: pa.RecordBatch):
    """(language, places of its rows, their texts)."""
    langs, texts = rows.column("lang").to_pylist(), _texts(rows)
    for lang in sorted(set(langs)):
        mine = [i for i, x in enumerate(langs) if x == lang]
        yield lang, mine, [texts[i] for i in mine]


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), "text")


def count_ngrams(docs: DataFrame) -> DataFrame:
    """lang, g and n of every n-gram of all texts. docs: lang, text."""
    schema = pa.schema([("lang", pa.string()), ("g", pa.string()), ("n", pa.int64())])

    def merged(parts):
        h = np.concatenate([p[0] for p in parts])
        keys, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        return keys, np.concatenate([p[1] for p in parts])[first], np.bincount(inverse, weights=np.concatenate([p[2] for p in parts])).astype(np.int64)

    def run(batches):
        held: dict[str, list] = {}
        size = 0

        def sent():
            for lang, parts in held.items():
                _, g, n = merged(parts)
                for i in range(0, len(g), 100_000):
                    part = g[i : i + 100_000]
                    yield arrow_rows(schema, [pa.array([lang] * len(part), pa.string()), pa.array(part, pa.string()), n[i : i + 100_000]])
            held.clear()

        for batch in batches:
            for rows, _, _ in slices(batch):
                for lang, _, texts in _by_language(rows):
                    points, at, _ = grams(texts)
                    _, _, n, found = distinct(points, at)
                    parts = held.setdefault(lang, [])
                    parts.append((keys_of(found), _strings(found), n))
                    if len(parts) > 8:
                        held[lang] = [merged(parts)]
                size = sum(len(p[0]) for parts in held.values() for p in parts)
                if size > 4 * HELD:
                    for lang, parts in held.items():
                        held[lang] = [merged(parts)]
                    if sum(len(parts[0][0]) for parts in held.values()) > HELD:
                        yield from sent()
        yield from sent()

    return docs.select("lang", "text").mapInArrow(lean(run), "lang string, g string, n long").groupBy("lang", "g").agg(F.sum("n").alias("n"))


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_LANGUAGES else table


def _discounts(level: DataFrame, k: int) -> DataFrame:
    """lang, size (distinct n-grams) and d1, d2, d3: what a count of one, of two, and of three or more is lowered by. level has the order k."""
    n1, n2, n3, n4 = (F.count_if(F.col("n") == i).alias(f"n{i}") for i in range(1, 5))
    counts = level.groupBy("lang").agg(F.count("*").alias("size"), n1, n2, n3, n4)
    y = F.try_divide("n1", F.col("n1") + 2 * F.col("n2"))
    known = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0)
    out = [F.when(known, F.least(F.greatest(i - F.try_divide((i + 1) * y * F.col(f"n{i + 1}"), f"n{i}"), F.lit(0.05)), F.lit(i - 0.05))).otherwise(plain) for i, plain in ((1, 0.5), (2, 0.75), (3, 0.9))]
    if k > 1:
        out[0] = F.lit(1.0)
    return counts.select("lang", "size", *(d.alias(f"d{i + 1}") for i, d in enumerate(out)))


def probabilities(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, g and p of every n-gram of counts (lang, g, n): the interpolated modified Kneser-Ney probability of its last code point after the others.
    Unigrams are interpolated with one share for each known code point and one for all others."""
    levels = {order: counts}
    for k in range(order - 1, 0, -1):
        levels[k] = written(levels[k + 1].groupBy("lang", F.substring("g", 2, k).alias("g")).agg(F.count("*").alias("n")), f"grams{k}")
    lower = None
    for k in range(1, order + 1):
        d = written(_discounts(levels[k], k), f"discounts{k}")
        rows = levels[k].join(_small(d), "lang").withColumn("d", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")))
        by = Window.partitionBy("lang", "context")
        rows = rows.withColumn("context", F.substring("g", 1, k - 1)).withColumn("total", F.sum("n").over(by)).withColumn("taken", F.sum("d").over(by))
        if lower is None:
            below = 1 / (F.col("size") + 1)
        else:
            rows = rows.withColumn("suffix", F.substring("g", 2, k - 1)).join(lower.select("lang", F.col("g").alias("suffix"), F.col("p").alias("below")), ["lang", "suffix"])
            below = F.col("below")
        new = written(rows.select("lang", "g", ((F.col("n") - F.col("d") + F.col("taken") * below) / F.col("total")).alias("p")), f"model{k}")
        dropped(d, *([lower] if lower is not None else []), *([levels[k]] if k < order else []))
        lower = new
    return lower


def _language_key(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


def hashed(model: DataFrame) -> DataFrame:
    """key and logp of each n-gram of model (lang, g, p)."""
    schema = pa.schema([("key", pa.int64()), ("logp", pa.float32())])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                h = keys_of(np.frombuffer("".join(batch.column(1).to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32))
                langs = batch.column(0).to_pylist()
                known = {x: _language_key(x) for x in set(langs)}
                yield arrow_rows(schema, [(h ^ np.array([known[x] for x in langs], np.uint64)).view(np.int64), np.log(batch.column(2).to_numpy()).astype(np.float32)])

    return model.select("lang", "g", "p").mapInArrow(lean(run), "key long, logp float")


def sorted_arrays(block: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    table = block.select("key", "logp").toArrow()
    keys = table["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], table["logp"].to_numpy()[order]


def log_probabilities(arrays: tuple[np.ndarray, np.ndarray], lang: str, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log probability of each n-gram of the texts, whether the arrays hold it (if not, 0), and the texts' offsets."""
    keys, logp = arrays
    points, at, off = grams(texts)
    codes, own, _, found = distinct(points, at)
    if not len(keys) or not len(codes):
        return np.zeros(len(codes)), np.zeros(len(codes), bool), off
    h = keys_of(found) ^ _language_key(lang)
    place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    hit = keys[place] == h
    which = np.searchsorted(own, codes)
    return np.where(hit, logp[place], 0).astype(np.float64)[which], hit[which], off


def base_counts(raw, off, cfg: Config) -> dict[str, np.ndarray]:
    w = Words(raw, off, SPACED)
    n, rows = len(w.count), w.rows()
    out = {"n_words": w.count.astype(np.int64), "word_chars": np.bincount(rows, weights=w.lengths(), minlength=n).astype(np.int64)}
    symbol = np.zeros(256, bool)
    symbol[list(b"#*$%&|<>")] = True
    sums = np.concatenate([[0], np.cumsum(symbol[raw])])
    out["n_symbols"] = sums[off[1:]] - sums[off[:-1]]
    # lines: from a text's begin or a line end to the next line end or the text's end
    ends = np.flatnonzero(raw == 0x0A)
    begin = np.concatenate([off[:-1], ends + 1])
    line_row = np.concatenate([np.arange(n), np.searchsorted(off, ends, side="right") - 1])
    order = np.lexsort((begin, line_row))
    begin, line_row = begin[order], line_row[order]
    end = np.concatenate([begin[1:] - 1, [0]])
    last = np.concatenate([line_row[1:] != line_row[:-1], [True]])
    end[last] = off[line_row[last] + 1]
    has = np.searchsorted(w.start, end) > np.searchsorted(w.start, begin)
    begin, end, line_row = begin[has], end[has], line_row[has]
    h = w.spans(begin, end)
    order = np.lexsort((h, line_row))
    h, r = h[order], line_row[order]
    again = (h[1:] == h[:-1]) & (r[1:] == r[:-1])
    out["n_dup_lines"] = np.bincount(r[1:][again], minlength=n)
    k = cfg.window
    win = windows(w.hashes(), k)
    inside = rows[: len(win)] == rows[k - 1 : k - 1 + len(win)] if len(win) else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    key = mix(win[at] + rows[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    hit = at[count[inverse] > 1]
    edge = np.zeros(len(rows) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + k, -1)
    out["n_repeat_words"] = np.bincount(rows[np.cumsum(edge[:-1]) > 0], minlength=n)
    return {k: np.asarray(v, np.int64) for k, v in out.items()}


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("model", T.StringType()), T.StructField("digest", T.LongType()), *(T.StructField(k, T.LongType()) for k in COUNTS), T.StructField("n_chars", T.LongType()), T.StructField("n_found", T.LongType()), T.StructField("lp", T.DoubleType())])


def _scanned(docs: DataFrame, arrays: tuple[np.ndarray, np.ndarray], cfg: Config) -> DataFrame:
    """doc_id, model (language), a digest of the text, the base counts, n_chars, and how many n-grams the arrays hold with the sum of their log probabilities."""
    schema = pa.schema([("doc_id", pa.int64()), ("model", pa.string()), ("digest", pa.int64()), *((k, pa.int64()) for k in COUNTS), ("n_chars", pa.int64()), ("n_found", pa.int64()), ("lp", pa.float64())])
    shared = docs.sparkSession.sparkContext.broadcast(arrays)

    def run(batches):
        for batch in batches:
            for rows, raw, off in slices(batch):
                base = base_counts(raw, off, cfg)
                chars, found, lp = np.zeros(rows.num_rows, np.int64), np.zeros(rows.num_rows, np.int64), np.zeros(rows.num_rows)
                for lang, mine, texts in _by_language(rows):
                    values, hit, at = log_probabilities(shared.value, lang, texts)
                    for out, x in ((found, hit), (lp, values)):
                        sums = np.concatenate([[0], np.cumsum(x)])
                        out[mine] = sums[at[1:]] - sums[at[:-1]]
                    chars[mine] = np.diff(at)
                yield arrow_rows(schema, [rows.column("doc_id"), rows.column("lang"), rows.column("digest"), *(base[k] for k in COUNTS), chars, found, lp])

    return docs.select("doc_id", "lang", "text", F.xxhash64("text").alias("digest")).mapInArrow(lean(run), MEASURED)


def measured(docs: DataFrame, cfg: Config = Config()) -> DataFrame:
    """doc_id, model (language), the base counts, n_chars and log_ppl (null for a text without characters)."""
    named = _named(docs)
    counts = written(count_ngrams(named), "grams")
    model = written(hashed(probabilities(counts)), "hashes")
    dropped(counts)
    blocks = max(1, -(-model.count() // cfg.block))
    parts = [written(_scanned(named, sorted_arrays(model.where(F.pmod("key", F.lit(blocks)) == i)), cfg), f"measured{i}") for i in range(blocks)]
    dropped(model)
    out = parts[0]
    if blocks > 1:  # rows that are alike have the same sums: one of them stands for all
        key = [F.col(c) for c in ("doc_id", "model", "digest")]
        rest = [p.groupBy(*key).agg(F.max("n_found").alias("more_found"), F.max("lp").alias("more")) for p in parts[1:]]
        more = rest[0]
        for r in rest[1:]:
            more = more.unionByName(r)
        more = more.groupBy(*key).agg(F.sum("more_found").alias("more_found"), F.sum("more").alias("more"))
        same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.model") == F.col("b.model")) & F.col("a.digest").eqNullSafe(F.col("b.digest"))
        out = out.alias("a").join(more.alias("b"), same).select(*(F.col(f"a.{c}") for c in ("doc_id", "model", *COUNTS, "n_chars")), (F.col("n_found") + F.col("more_found")).alias("n_found"), (F.col("lp") + F.col("more")).alias("lp"))
    whole = F.when(F.col("n_found") == F.col("n_chars"), F.col("lp")).otherwise(F.raise_error(F.lit("the texts changed between two reads: an n-gram is not in the model")).cast("double"))
    return out.select("doc_id", "model", *COUNTS, "n_chars", F.when(F.col("n_chars") > 0, -whole / F.col("n_chars")).alias("log_ppl"))


def quality(docs: DataFrame, cfg: Config = Config()) -> DataFrame:
    """One row for each document: doc_id, the base counts, base_failed, kept, then model, log_ppl and its band (low, high)."""
    found = measured(docs, cfg)
    failed = (F.col("n_words") < cfg.least_words) | (100 * F.col("n_repeat_words") > cfg.repeat_percent * F.col("n_words"))
    bands = found.where(~failed & F.col("log_ppl").isNotNull()).groupBy("model").agg(F.percentile_approx("log_ppl", [0.25, 0.5, 0.75], 10000).alias("q"))
    bands = written(bands.select("model", F.col("q")[1].alias("mid"), F.greatest(F.lit(cfg.least_spread), (F.col("q")[2] - F.col("q")[0]) / 1.349).alias("spread")), "bands")
    out = found.join(_small(bands), "model", "left")
    reach = cfg.width * F.col("spread") + cfg.per_char / F.sqrt(F.greatest("n_chars", F.lit(1)))
    within = F.coalesce(F.col("log_ppl").between(F.col("mid") - reach, F.col("mid") + reach), F.lit(True))
    return out.select("doc_id", *COUNTS, failed.alias("base_failed"), (~failed & within).alias("kept"), "model", "log_ppl", (F.col("mid") - reach).alias("low"), (F.col("mid") + reach).alias("high"))
