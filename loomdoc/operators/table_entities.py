"""Rows of tables as entities.

A row is the ordered array of its cells (header, value). Rules, cell by cell: a value that looks like a code is the code; under a header
with `code` it is, if there is none yet; under `title` or `name` it is the name; under `subject` or `course` too. Without a code a row is no entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import TableConfig
from ..functions.columns import bound
from .tables import extract, header_key

# What is no name.
NOT_A_CANDIDATE = (r"^[\d\s\-]+$", r"^[A-Z]{2,4}\s+\d", r"^\d+\s+\d+\s+\d+")
NOT_A_NAME = (r"^[A-Z]{2,4}\s+\d", r"^\d[\d\s\-]+$")


def _roles(headers: Column) -> Column:
    """For each header: the keys of its attribute, for a number and for another value (null where it names nothing), and whether codes or names stand under it."""

    def role(h):
        def of(b):
            low, key = b["low"], b["key"]
            has = lambda *parts: F.greatest(*[low.contains(p) for p in parts], F.lit(False))
            other = F.when(key.contains("prereq"), "prerequisites").when(key.contains("cat"), "category").otherwise(key)
            number = F.when(key.contains("credit"), "credits").when(key.contains("hour"), "hours").otherwise(other)
            named = ~key.startswith("column_")
            return F.struct(F.when(named, number).alias("number"), F.when(named, other).alias("other"), has("code").alias("code"), has("title", "name", "subject", "course").alias("name"))

        return bound(F.struct(F.lower(h).alias("low"), header_key(h).alias("key")), of)

    return F.transform(headers, role)


def _code_and_name(cells: Column, cfg: TableConfig) -> Column:
    none = F.lit(None).cast("string")

    def step(state, c):
        code, name, value = state["code"], state["name"], c["value"]
        out = lambda a, b: F.struct(a.alias("code"), b.alias("name"))
        return (
            F.when(value == "", out(code, name))
            .when(value.rlike(cfg.code), out(value, name))
            .when(c["code"] & code.isNull(), out(value, name))
            .when(c["name"], out(code, value))
            .otherwise(out(code, name))
        )

    return F.aggregate(cells, F.struct(none.alias("code"), none.alias("name")), step)


def _any(c: Column, patterns) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(p)
    return out


def _longest(cells: Column, code: Column) -> Column:
    """The longest value that may be a name; those with small letters, or very long ones, come before others."""
    candidates = F.filter(cells, lambda c: (F.length(c["value"]) > 5) & (c["value"] != code) & ~_any(c["value"], NOT_A_CANDIDATE))

    def among(found):
        good = F.filter(found, lambda c: c["value"].rlike("[a-z]") | (F.length(c["value"]) > 15))
        pool = bound(good, lambda g: F.when(F.size(g) > 0, g).otherwise(found))
        return F.aggregate(pool, F.lit(None).cast("string"), lambda best, c: F.when(best.isNull() | (F.length(c["value"]) > F.length(best)), c["value"]).otherwise(best))

    return bound(candidates, among)


def _attributes(cells: Column, code: Column, name: Column) -> Column:
    """The code, and the other values by the key of their header; of several with one key the last counts."""
    used = F.filter(cells, lambda c: (c["value"] != "") & (c["value"] != code) & (c["value"] != name) & c["other"].isNotNull())
    entry = lambda c: F.struct(F.when(c["value"].rlike(r"^\d+$"), c["number"]).otherwise(c["other"]).alias("key"), c["value"].alias("value"))
    entries = F.concat(*(x.cast("array<struct<key:string,value:string>>") for x in (F.array(F.struct(F.lit("code"), code)), F.transform(used, entry))))
    last = lambda e: bound(F.reverse(e["key"]), lambda keys: F.filter(e, lambda x, i: F.size(keys) - F.array_position(keys, x["key"]) == i))
    return F.map_from_entries(bound(entries, last))


def row_entities(rows: DataFrame, cfg: TableConfig = TableConfig(), confidence: float = 0.9) -> DataFrame:
    """rows with cells (array of header, value): the other columns, type, canonical_name, attributes and confidence."""
    return _entities(rows.withColumn("roles__", _roles(F.transform("cells", lambda c: c["header"]))), cfg, confidence)


def _entities(rows: DataFrame, cfg: TableConfig, confidence: float = 0.9) -> DataFrame:
    """row_entities() for rows with the roles of their cells' headers (roles__)."""
    keep = [c for c in rows.columns if c not in ("cells", "roles__")]
    cells = F.zip_with("cells", "roles__", lambda c, r: F.struct(c["value"].alias("value"), *(r[x].alias(x) for x in ("number", "other", "code", "name"))))

    def of(cells):
        def coded(f):
            def called(n):
                name = F.coalesce(n, f["code"])
                made = bound(name, lambda name: F.struct(name.alias("canonical_name"), _attributes(cells, f["code"], name).alias("attributes")))
                return F.when(n.isNull() | ~(_any(n, NOT_A_NAME) | (F.length(n) < 3)), made)

            name = F.trim(F.regexp_replace(F.coalesce(f["name"], _longest(cells, f["code"])), r"\s+", " "))
            return F.when(f["code"].isNotNull(), bound(name, called))

        return bound(_code_and_name(cells, cfg), coded)

    # An array of one entity or none: exploded, so that no filter repeats the expression.
    made = rows.withColumn("cells__", cells).select(*keep, F.array(bound(F.col("cells__"), of)).alias("e__"))
    found = made.withColumn("e__", F.explode_outer("e__")).where("e__ is not null")
    return found.select(*keep, F.lit("course").alias("type"), "e__.canonical_name", "e__.attributes", F.lit(confidence).alias("confidence"))


def _rows(tables: DataFrame, *more: str) -> DataFrame:
    return tables.select("doc_id", "page", "scope", "table_index", *more, F.posexplode_outer("rows").alias("row_index", "cells")).where("cells is not null")


def table_rows(cells: DataFrame, cfg: TableConfig = TableConfig()) -> DataFrame:
    """Positioned cells to the rows of tables: doc_id, page, scope, table_index, row_index (in the table, without its headers) and cells (array of header, value)."""
    return _rows(extract(cells, cfg))


def tables_to_entities(tables: DataFrame, cfg: TableConfig = TableConfig()) -> DataFrame:
    """Tables as `extract` gives them to the entities of their rows, with doc_id, page, scope, table_index and row_index."""
    # what headers say is told once for each table
    return _entities(_rows(tables.withColumn("roles__", _roles(F.array_distinct("headers"))), "roles__"), cfg)
