"""Context assembly under a budget of characters, and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import ENTITY_BLOCK, HIDDEN_ATTRIBUTES, LISTED_TYPE, SECTION_BLOCK, RetrievalConfig
from ..functions import text as T
from . import text_index


def within_budget(ranked: DataFrame, budget: int, separator: int = 0, key: str = "query_id", truncate: bool = False) -> DataFrame:
    """Of ranked texts (key, rank, text) those before the first that overflows the budget; with truncate that one too, cut
    to what is left with `...`, if more than 100 characters are."""
    by = Window.partitionBy(key).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    used = F.sum(F.length("text") + separator).over(by)
    rows = ranked.withColumn("used", used).withColumn("over", F.sum(F.when(F.col("used") > budget, 1).otherwise(0)).over(by))
    if not truncate:
        return rows.where("over = 0").drop("over")
    left = budget - (F.col("used") - F.length("text") - separator)
    return rows.withColumn("left", left).where((F.col("over") == 0) | ((F.col("over") == 1) & (F.col("left") > 100))).withColumn("text", F.when(F.col("over") == 1, F.concat(F.expr("substring(text, 1, cast(left as int))"), F.lit("..."))).otherwise(F.col("text"))).drop("over", "left")


def query_terms(query: Column, cfg: RetrievalConfig = RetrievalConfig()) -> Column:
    """The first words of more than 3 letters that are no stop words."""
    w = F.filter(F.split(F.lower(query), r"\s+"), lambda x: (F.length(x) > 3) & ~x.isin(*cfg.stop_words))
    return F.slice(w, 1, cfg.terms)


def is_listing(query: Column, cfg: RetrievalConfig = RetrievalConfig()) -> Column:
    low = F.lower(query)
    out = F.lit(False)
    for word in cfg.listing_words:
        out = out | low.contains(word)
    return out


def query_scope(query: Column) -> Column:
    found = F.regexp_extract(query, r"(?i)semester\s*([IVXLCDM]+|\d+)", 1)
    return F.when(found != "", F.concat(F.lit("Semester "), F.upper(found)))


def prompt(context: Column, question: Column) -> Column:
    asked = F.concat(F.lit("Question: "), question)
    return F.when(F.coalesce(context, F.lit("")) == "", F.concat(F.lit("No context was found.\n\n"), asked)).otherwise(F.concat(F.lit("Context:\n"), context, F.lit("\n\n"), asked))


def entity_line(kind: Column, name: Column, attributes: Column, scope: Column) -> Column:
    """One line about an entity: its type, name, first three attributes that say anything, and scope."""
    told = F.map_entries(F.map_filter(attributes, lambda k, v: ~k.isin(*HIDDEN_ATTRIBUTES) & (F.coalesce(v, F.lit("")) != "")))
    pairs = F.array_join(F.slice(F.transform(told, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), 1, 3), ", ")
    shown = F.when(F.coalesce(pairs, F.lit("")) != "", F.concat(F.lit(" ("), pairs, F.lit(")"))).otherwise("")
    scoped = F.when(F.coalesce(scope, F.lit("")) != "", F.concat(F.lit(" [Scope: "), scope, F.lit("]"))).otherwise("")
    return F.concat(F.lit("\u2022 ["), F.upper(kind), F.lit("] "), name, shown, scoped)


def _firsts(entities: DataFrame, found: DataFrame, key: str, limit: int) -> DataFrame:
    """The first `limit` entities of each value of key in found (key, id): surest first, then by id."""
    best = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("confidence"), "id"))
    return entities.join(found.hint("merge"), "id").withColumn("place", best).where(F.col("place") <= limit)  # entities of a small file aren't small: never broadcast


def entity_hits(queries: DataFrame, entities: DataFrame, cfg: RetrievalConfig = RetrievalConfig(), index: DataFrame | None = None) -> DataFrame:
    """query_id, rank, and the entity's columns, of queries (query_id, query).

    A query that asks for a list gets the listed type's entities of the scope it names. Any other gets those that hold one of its
    first terms in name, alias or attribute, term by term, an entity counting once. Distinct terms and scopes are searched once, whatever the number of queries,
    by trigrams (see text_index; index: the postings of the entities' texts, if there are any).
    """
    asked = queries.select("query_id", F.coalesce("query", F.lit("")).alias("query"))
    asked = asked.select("query_id", is_listing(F.col("query"), cfg).alias("listing"), F.coalesce(query_scope(F.col("query")), F.lit("")).alias("asked_scope"), query_terms(F.col("query"), cfg).alias("terms"))
    lists = asked.where("listing")
    listable = entities.where(F.col("type") == LISTED_TYPE)
    scopes = listable.select(F.coalesce("scope", F.lit("")).alias("id")).distinct()  # a scope is its own id, and is met by name
    met = text_index.containing(scopes.where("id <> ''").select("id", F.array(F.lower("id")).alias("texts")), lists.where("asked_scope <> ''").select(F.col("asked_scope").alias("term")))
    of_scope = met.select(F.col("term").alias("asked_scope"), F.col("id").alias("scope__")).join(listable.select("id", F.coalesce("scope", F.lit("")).alias("scope__")).hint("merge"), "scope__").select("asked_scope", "id")
    any_scope = listable.select("id").withColumn("asked_scope", F.lit(""))  # where no scope is named
    listed = _firsts(listable, of_scope.unionByName(any_scope), "asked_scope", cfg.max_entities)
    listed = lists.select("query_id", "asked_scope").join(listed, "asked_scope").withColumn("term_place", F.lit(0)).drop("asked_scope")
    terms = asked.where("not listing").select("query_id", F.posexplode("terms").alias("term_place", "term"))
    hits = text_index.containing(text_index.entity_texts(entities), terms.select("term"), index)
    found = terms.join(_firsts(entities, hits, "term", cfg.max_entities // cfg.terms), "term").drop("term")
    once = F.row_number().over(Window.partitionBy("query_id", "id").orderBy("term_place", "place"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("term_place", "place"))
    hits = listed.unionByName(found).withColumn("n", once).where("n = 1").withColumn("rank", rank)
    return hits.where(F.col("rank") <= cfg.max_entities).drop("n", "place", "term_place")


def entity_context(queries: DataFrame, entities: DataFrame, cfg: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """query_id, block and found of the queries that find entities."""
    line = entity_line(F.col("type"), F.col("canonical_name"), F.col("attributes"), F.col("scope"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"])
    hits = entity_hits(queries, entities, cfg).select("query_id", "rank", line.alias("line"))
    return hits.groupBy("query_id").agg(F.concat(F.lit(ENTITY_BLOCK + "\n"), F.array_join(lines, "\n")).alias("block"), F.count("*").alias("found"))


def hybrid_context(queries: DataFrame, entities: DataFrame, ranked: DataFrame, cfg: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """query_id, context and sources (source, title, score) of every query.

    The block of entities comes first and counts toward the budget; then the ranked chunks (query_id, rank, source_id, title, text,
    score) up to the first that overflows it, none of them cut.
    """
    named = F.when(F.coalesce("source_id", F.lit("")) != "", T.basename(F.col("source_id"))).otherwise("Unknown")
    titled = F.when(F.coalesce("title", F.lit("")) != "", F.substring("title", 1, 50)).otherwise("Untitled")
    chunks = ranked.select("query_id", "rank", named.alias("source"), "title", "score", F.concat(F.lit("[Source: "), named, F.lit(" | Section: "), titled, F.lit("]\n"), F.coalesce("text", F.lit("")), F.lit("\n")).alias("text"))
    blocks = entity_context(queries, entities, cfg)
    used = F.sum(F.length("text")).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    fits = F.coalesce(F.length("block"), F.lit(0)) + F.col("used") <= cfg.max_context_tokens * cfg.chars_per_token
    rows = chunks.withColumn("used", used).join(blocks.select("query_id", "block"), "query_id", "left").withColumn("fits", fits)
    # at most top_k rows a query, as the search gives them
    kept = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.when(F.col("fits"), F.struct("rank", "text", "source", "title", "score")))).alias("c"))
    source = lambda s, t, n: F.struct(s.alias("source"), t.alias("title"), n.alias("score"))
    out = queries.select("query_id").join(blocks, "query_id", "left").join(kept, "query_id", "left")
    none = F.array().cast("array<string>")
    parts = F.concat(F.when(F.col("block").isNotNull(), F.array("block")).otherwise(none), F.when(F.col("c").isNotNull(), F.concat(F.array(F.lit(SECTION_BLOCK)), F.transform("c", lambda x: x["text"]))).otherwise(none))
    first = F.array(source(F.lit("Entity Store"), F.concat(F.col("found").cast("string"), F.lit(" entities")), F.lit(1.0)))
    nothing = F.array().cast("array<struct<source:string,title:string,score:double>>")
    rest = F.transform("c", lambda x: source(x["source"], x["title"].cast("string"), x["score"].cast("double")))
    return out.select("query_id", F.array_join(parts, cfg.separator).alias("context"), F.concat(F.when(F.col("block").isNotNull(), first).otherwise(nothing), F.coalesce(rest, nothing)).alias("sources"))
