"""Elements to chunks: sections by window functions, then folds over each document's ordered parts.

Every element carries its place (`pos`). Sections, titles and scopes are windows over (doc_id, pos); merging and
splitting are folds over one document's parts, which higher-order functions run inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import CHUNK_SCOPES, DEFAULT, SECTION_CATEGORIES, SENTENCE_END, ChunkConfig
from ..functions.text import any_match, chunk_scope, clean, low_signal, strip, words


def section_chunks(elements: DataFrame, cfg: ChunkConfig = DEFAULT) -> DataFrame:
    """doc_id, section, title, text, scope of elements (doc_id, pos, text, category).

    A header opens a section and is part of its text. A section's scope is the one in force at the next header, that
    header included: a header that names a scope gives it to the section before it too.
    """
    in_doc = Window.partitionBy("doc_id").orderBy("pos")
    t = strip(F.coalesce("text", F.lit("")))
    rows = elements.withColumn("t", t).where("t <> ''")
    header = (F.col("category").isin(*SECTION_CATEGORIES) & (F.length("t") >= cfg.min_header)) | any_match(F.col("t"), cfg.header_patterns, "m")
    rows = rows.withColumn("header", F.coalesce(header, F.lit(False))).withColumn("scope", F.last(chunk_scope(F.col("t"), CHUNK_SCOPES, cfg.max_scope), True).over(in_doc))
    rows = rows.withColumn("section", F.sum(F.col("header").cast("int")).over(in_doc))
    made = rows.groupBy("doc_id", "section").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda x: x["t"]), " ").alias("text"),
        F.min_by("t", "pos").alias("head"),
        F.min_by("header", "pos").alias("opens"),
        F.min_by("scope", "pos").alias("first_scope"),
        F.max_by("scope", "pos").alias("last_scope"),
        F.max("pos").alias("last_pos"),
    )
    by = Window.partitionBy("doc_id").orderBy("section")
    scope = F.when(F.lead("section").over(by).isNull(), F.col("last_scope")).otherwise(F.lead("first_scope").over(by))
    out = made.select("doc_id", "section", F.when(F.col("opens"), F.col("head")).otherwise("Introduction").alias("title"), clean(F.col("text")).alias("text"), scope.alias("scope")).where("text <> ''")
    prefixed = F.when(F.col("scope").isNotNull() & ~F.upper("text").contains(F.col("scope")), F.concat(F.lit("["), "scope", F.lit("] "), "text")).otherwise(F.col("text"))
    return out.withColumn("text", prefixed)


def sentences(c: Column) -> Column:
    return F.split(c, SENTENCE_END)


def packed(sentence: Column, max_chars: int, overlap: int) -> Column:
    """Sentences joined to parts of at most max_chars; each next part begins with the last `overlap` characters of the one before."""

    # n is the length of `now`, which isn't counted anew for each sentence
    to = lambda done, now, n: F.struct(done.alias("done"), now.alias("now"), n.alias("n"))

    def step(state, s):
        done, now, n = state["done"], state["now"], state["n"]
        lead = F.concat(F.substring(now, -overlap, overlap), F.lit(" "), s) if overlap else s
        size = n + F.length(s) + 1
        return F.when(n == 0, to(done, s, F.length(s))).when(size <= max_chars, to(done, F.concat(now, F.lit(" "), s), size)).otherwise(to(F.concat(done, F.array(now)), lead, F.length(lead)))

    zero = to(F.array().cast("array<string>"), F.lit(""), F.lit(0))
    return F.aggregate(sentence, zero, step, lambda s: F.when(s["n"] == 0, s["done"]).otherwise(F.concat(s["done"], F.array(s["now"]))))


def hard_split(c: Column, max_chars: int) -> Column:
    """Words joined to parts of at most max_chars, without overlap; a longer word stays whole."""
    return packed(words(c), max_chars, 0)


def split_long(c: Column, cfg: ChunkConfig = DEFAULT) -> Column:
    parts = packed(sentences(c), cfg.max_chars, cfg.overlap_chars)
    cut = F.flatten(F.transform(parts, lambda p: F.when(F.length(p) > cfg.max_chars, hard_split(p, cfg.max_chars)).otherwise(F.array(p))))
    return F.when(F.length(c) <= cfg.max_chars, F.array(c)).otherwise(cut)


def merge_small(chunks: Column, min_chars: int, max_chars: int) -> Column:
    """Chunks (array of title, text) of fewer than min_chars go into the next one where that fits, the last into the one before."""
    item = "struct<title:string,text:string>"
    pair = lambda title, text: F.struct(title.alias("title"), text.alias("text"))
    glue = lambda a, b: pair(a["title"], F.concat(a["text"], F.lit(" "), b["text"]))
    none = F.lit(None).cast(item)

    def step(state, c):
        done, held = state["done"], state["held"]
        small = F.length(c["text"]) < min_chars
        room = F.length(held["text"]) + F.length(c["text"]) + 1 <= max_chars
        both = glue(held, c)
        out = lambda d, h: F.struct(d.alias("done"), h.alias("held"))
        return (
            F.when(small & held.isNull(), out(done, c))
            .when(small & room, out(done, both))
            .when(small, out(F.concat(done, F.array(held)), c))
            .when(held.isNull(), out(F.concat(done, F.array(c)), none))
            .when(room, out(F.concat(done, F.array(both)), none))
            .otherwise(out(F.concat(done, F.array(held), F.array(c)), none))
        )

    def finish(state):
        done, held = state["done"], state["held"]
        last = F.element_at(done, -1)
        back = (F.size(done) > 0) & (F.length(F.when(F.size(done) > 0, last["text"])) + F.length(held["text"]) + 1 <= max_chars)
        return F.when(held.isNull(), done).when(back, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(glue(last, held)))).otherwise(F.concat(done, F.array(held)))

    zero = F.struct(F.array().cast(f"array<{item}>").alias("done"), none.alias("held"))
    return F.aggregate(chunks, zero, step, finish)


def formatted(chunks: DataFrame, cfg: ChunkConfig = DEFAULT) -> DataFrame:
    """chunk_index, total_chunks, char_count, word_count, language of (source_id, pos, text)."""
    by = Window.partitionBy("source_id")
    return chunks.withColumn("chunk_index", F.row_number().over(by.orderBy("pos")) - 1).withColumn("total_chunks", F.count("*").over(by)).withColumn("char_count", F.length("text")).withColumn("word_count", F.size(words(F.col("text")))).withColumn("language", F.lit(cfg.language)).withColumn("extraction_method", F.lit("text"))


def chunked(elements: DataFrame, cfg: ChunkConfig = DEFAULT) -> DataFrame:
    """The whole way: sections, merge, split, merge, filters, numbering."""
    sections = section_chunks(elements, cfg).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("section", "title", "text"))), lambda x: F.struct(x["title"].alias("title"), x["text"].alias("text"))).alias("c"))
    merged = merge_small(F.col("c"), cfg.min_chars, cfg.max_chars)
    parts = F.flatten(F.transform(F.col("c"), lambda c: F.transform(split_long(c["text"], cfg), lambda t: F.struct(c["title"].alias("title"), t.alias("text")))))
    rows = sections.withColumn("c", merged).withColumn("c", parts).withColumn("c", merge_small(F.col("c"), cfg.min_chars, cfg.max_chars)).select(F.col("doc_id").alias("source_id"), F.posexplode("c").alias("pos", "chunk")).select("source_id", "pos", "chunk.title", "chunk.text")
    rows = rows.where(F.length("text") >= cfg.min_chars)
    if cfg.low_signal:
        rows = rows.where(~low_signal(F.col("text"), cfg.min_words, cfg.alpha_share))
    return formatted(rows, cfg)


def size_stats(chunks: DataFrame) -> DataFrame:
    """chunks, and the least, greatest and mean (whole) number of characters of a chunk."""
    n = F.length("text")
    return chunks.agg(F.count("*").alias("chunks"), F.min(n).cast("long").alias("least"), F.max(n).cast("long").alias("greatest"), F.floor(F.sum(n) / F.count("*")).alias("mean"))
