"""Entities and relations as tables: upserts, cascading deletes, search, statistics, merging and inference of relations.

A table is a DataFrame; each operation gives the next state. Keys are content hashes, so writing twice changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def upsert(old: DataFrame, new: DataFrame, key: str = "id", order: str = "ord", ties: tuple[str, ...] = ()) -> DataFrame:
    """new replaces old by key; of several new rows with a key the last counts, of those the first by `ties` (columns that are left out then)."""
    last = new.withColumn("n__", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order), *ties))).where("n__ = 1").drop("n__", order, *ties)
    return old.join(last.select(key), key, "left_anti").select(*last.columns).unionByName(last)


def delete_by_source(entities: DataFrame, relations: DataFrame, source_id) -> tuple[DataFrame, DataFrame]:
    """Without the source's entities, and without relations that begin or end at one of them."""
    gone = entities.where(F.col("source_id") == source_id).select("id")
    left = relations.join(gone.withColumnRenamed("id", "source_entity_id"), "source_entity_id", "left_anti").join(gone.withColumnRenamed("id", "target_entity_id"), "target_entity_id", "left_anti")
    return entities.where(~F.coalesce(F.col("source_id") == source_id, F.lit(False))), left.select(*relations.columns)


def search(entities: DataFrame, query: str | None = None, kind: str | None = None, scope: str | None = None, source_id=None, limit: int = 100) -> DataFrame:
    """Case-insensitive containment in the name, an alias, or an attribute's key or value; surest first, then by id."""
    found = entities
    if kind:
        found = found.where(F.col("type") == kind)
    if scope:
        found = found.where(F.col("scope").ilike(f"%{scope}%"))
    if source_id is not None:
        found = found.where(F.col("source_id") == source_id)
    if query:
        like = lambda c: c.ilike(f"%{query}%")
        hit = like(F.col("canonical_name"))
        if "aliases" in found.columns:
            hit = hit | F.exists("aliases", like)
        if "attributes" in found.columns:
            hit = hit | F.exists(F.map_keys("attributes"), like) | F.exists(F.map_values("attributes"), like)
        found = found.where(hit)
    return found.orderBy(F.desc("confidence"), "id").limit(limit)


def relations_of(relations: DataFrame, entity_id, direction: str = "both", kind: str | None = None) -> DataFrame:
    out, into = F.col("source_entity_id") == entity_id, F.col("target_entity_id") == entity_id
    found = relations.where({"outgoing": out, "incoming": into}.get(direction, out | into))
    return found.where(F.col("type") == kind) if kind else found


def stats(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(kind, type, scope, n): totals, by type, and by scope that is not empty, in one pass over each table."""
    both = entities.select(F.lit("entity").alias("kind"), "type", F.col("scope")).unionByName(relations.select(F.lit("relation").alias("kind"), "type", F.lit(None).cast("string").alias("scope")))
    grouped = both.groupingSets([["kind"], ["kind", "type"], ["kind", "scope"]], "kind", "type", "scope").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    return grouped.where("g in (3, 1) or scope <> ''").select("kind", F.when(F.col("g") == 1, F.col("type")).alias("type"), F.when(F.col("g") == 2, F.col("scope")).alias("scope"), "n")


def merge(entities: DataFrame, by: list[str] | None = None, least: float = 0.5) -> DataFrame:
    """One entity for each source (by), type and lower-cased name: the first id and name, the first scope and page that say
    anything, the greatest confidence, the last value of each attribute (in the order in which they came first), and the aliases but for the name.

    Attributes and aliases are rows of their own that are combined by key before a group comes together, so that a group is as large as what it says, not as its rows.
    """
    keys = [*(by or []), "type", "name_key"]
    item = lambda kind, name, value, place: F.struct(F.lit(kind).alias("kind"), name.cast("string").alias("item"), value.cast("string").alias("value"), place.cast("int").alias("place"))
    none, zero = F.lit(None), F.lit(0)
    told = F.transform(F.map_entries("attributes"), lambda e, i: item(1, e["key"], e["value"], i))
    named = F.transform("aliases", lambda a: item(2, a, none, zero))
    nothing = F.array().cast("array<struct<kind:int,item:string,value:string,place:int>>")
    items = F.concat(F.array(item(0, none, none, zero)), F.coalesce(told, nothing), F.coalesce(named, nothing))
    rows = entities.withColumn("name_key", F.lower("canonical_name")).select(*keys, "ord", "id", "canonical_name", "scope", "page", "confidence", F.explode(items).alias("i")).select("*", "i.*")
    filled = lambda c, ok: F.min(F.when(ok, F.struct("ord", c)))[c]
    once = rows.groupBy(*keys, "kind", "item").agg(
        F.min_by("id", "ord").alias("id"),
        F.min_by("canonical_name", "ord").alias("canonical_name"),
        filled("scope", F.col("scope") != "").alias("scope"),
        filled("page", F.col("page") != 0).alias("page"),
        F.max("confidence").alias("confidence"),
        F.max_by("value", "ord").alias("value"),
        F.min(F.struct("ord", "place")).alias("at"),
    )
    of = lambda kind, c: F.when(F.col("kind") == kind, c)
    whole = once.groupBy(*keys).agg(
        *(F.max(of(0, F.col(c))).alias(c) for c in ("id", "canonical_name", "scope", "page", "confidence")),
        F.array_sort(F.collect_list(of(1, F.struct("at", "item", "value")))).alias("told"),
        F.array_sort(F.collect_list(of(2, F.col("item")))).alias("named"),
    )
    attributes = F.map_from_entries(F.transform("told", lambda x: F.struct(x["item"], x["value"])))
    aliases = F.filter("named", lambda a: a != F.col("canonical_name"))
    return whole.withColumn("attributes", attributes).withColumn("aliases", aliases).where(F.col("confidence") >= least).select(*(by or []), "id", "type", "canonical_name", "aliases", "attributes", F.coalesce("page", F.lit(0)).alias("page"), F.coalesce("scope", F.lit("")).alias("scope"), "confidence")


def scope_relations(entities: DataFrame, confidence: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """An edge belongs_to from every entity with a scope to the scope's entity: the first with that name, or else a new one."""
    scopes = entities.where("scope <> ''").select("scope").distinct()
    named = entities.groupBy(F.col("canonical_name").alias("scope")).agg(F.min_by("id", "ord").alias("found"))
    targets = scopes.join(named, "scope", "left").withColumn("target", F.coalesce("found", F.substring(F.sha2(F.concat(F.lit("scope:"), "scope"), 256), 1, 16)))
    made = targets.where("found is null").select(F.col("target").alias("id"), F.lit("scope").alias("type"), F.col("scope").alias("canonical_name"))
    edges = entities.where("scope <> ''").join(targets, "scope").where("id <> target").select(F.lit("belongs_to").alias("type"), F.col("id").alias("source_entity_id"), F.col("target").alias("target_entity_id"), F.concat("canonical_name", F.lit(" in "), "scope").alias("evidence"), F.lit(confidence).alias("confidence"))
    return edges, made


def defaulted(confidence: Column, page: Column, scope: Column) -> tuple[Column, Column, Column]:
    """What stands for nothing on reading: confidence 0 or null is 1, page null is 0, scope null is empty."""
    return F.coalesce(F.nullif(confidence, F.lit(0.0)), F.lit(1.0)), F.coalesce(page, F.lit(0)), F.coalesce(scope, F.lit(""))


def get(entities: DataFrame, key) -> DataFrame:
    """The entity with this id, if there is one."""
    return entities.where(F.col("id") == F.lit(key))


def cleared(table: DataFrame) -> DataFrame:
    """No rows, the same columns."""
    return table.where(F.lit(False))


def encoded(table: DataFrame) -> DataFrame:
    """Arrays and maps as JSON, times as ISO text: a table as it is stored."""
    json = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "map") else F.date_format(f.name, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(f.name) if f.dataType.typeName().startswith("timestamp") else F.col(f.name) for f in table.schema]
    return table.select(*json)


def decoded(rows: DataFrame) -> DataFrame:
    """Stored rows as entities or relations: JSON parsed, times read, and what stands for nothing by default.

    A JSON that can't be parsed is as an empty one, a time that can't be read is null. Other columns pass.
    """
    made = rows
    if "aliases" in rows.columns:
        made = made.withColumn("aliases", F.coalesce(F.from_json("aliases", "array<string>"), F.array().cast("array<string>")))
    if "attributes" in rows.columns:
        made = made.withColumn("attributes", F.coalesce(F.from_json("attributes", "map<string,string>"), F.create_map().cast("map<string,string>")))
    if "created_at" in rows.columns:
        made = made.withColumn("created_at", F.try_to_timestamp(F.col("created_at").cast("string")))
    for name, nothing in (("source_id", ""), ("scope", ""), ("evidence", ""), ("page", 0)):
        if name in rows.columns:
            made = made.withColumn(name, F.coalesce(F.col(name), F.lit(nothing)))
    if "confidence" in rows.columns:
        made = made.withColumn("confidence", F.coalesce(F.nullif(F.col("confidence"), F.lit(0.0)), F.lit(1.0)))
    return made


def from_facts(facts: DataFrame) -> DataFrame:
    """Facts (entity_type, name, attributes, source_id) as entities without an id."""
    return facts.select(F.col("entity_type").alias("type"), F.col("name").alias("canonical_name"), "attributes", "source_id")


def to_facts(entities: DataFrame) -> DataFrame:
    return entities.select(F.col("type").alias("entity_type"), F.col("canonical_name").alias("name"), "attributes", "source_id")


def search_facts(entities: DataFrame, query: str | None = None, entity_type: str | None = None, value: str | None = None) -> DataFrame:
    """Facts of the entities found by query, or by value where there is no query."""
    return to_facts(search(entities, query or value, entity_type))
