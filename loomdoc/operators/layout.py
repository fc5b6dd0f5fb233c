"""Layout elements (doc_id, pos, page, text, font_size, bold) to the nodes of a document's tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import LAYOUT_EXCLUDED, LAYOUT_LEVELS, LAYOUT_SCOPES, LAYOUT_SECTIONS
from ..functions.text import any_match, first_match, strip
from . import tree


def excluded(text: Column) -> Column:
    """Page numbers and addresses."""
    return any_match(text, LAYOUT_EXCLUDED, "i")


def is_header(text: Column, font_size: Column, bold: Column) -> Column:
    """By its words; by a large font, a capital and no full stop; or by bold capitals."""
    large = (font_size > 14) & (F.length(text) < 100) & text.rlike(r"^\p{Lu}") & ~text.endswith(".")
    capitals = bold & (F.length(text) < 80) & (F.upper(text) == text) & (F.lower(text) != text)
    return F.coalesce(any_match(text, LAYOUT_SECTIONS, "i") | large | capitals, F.lit(False))


def header_level(text: Column, font_size: Column) -> Column:
    """1 to 3: the first pattern that matches decides, or else the font."""
    level = None
    for pattern, n in LAYOUT_LEVELS:
        level = F.when(text.rlike(pattern), n) if level is None else level.when(text.rlike(pattern), n)
    return level.when(font_size >= 16, 1).when(font_size >= 14, 2).otherwise(3)


def nodes(elements: DataFrame) -> DataFrame:
    """doc_id, pos, page, type (section or paragraph), text, level, scope and parent (a pos; null: the root).

    Elements that are null, empty or excluded make no node. A scope holds from the element that names it to the next one
    that does, within a document. A missing font size counts as 12, missing boldness as none.
    """
    text = strip(F.col("text"))
    size, bold = F.coalesce("font_size", F.lit(12.0)), F.coalesce("bold", F.lit(False))
    rows = elements.select("doc_id", "pos", "page", text.alias("text"), size.alias("font_size"), bold.alias("bold")).where(F.col("text") != "").where(~excluded(F.col("text")))
    rows = rows.withColumn("header", is_header(F.col("text"), F.col("font_size"), F.col("bold"))).withColumn("level", F.when(F.col("header"), header_level(F.col("text"), F.col("font_size"))))
    so_far = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    section_level = F.last(F.when(F.col("header"), F.col("level")), True).over(so_far)
    scope = F.last(F.nullif(strip(first_match(F.col("text"), LAYOUT_SCOPES)), F.lit("")), True).over(so_far)
    out = tree.parents(rows, 3).withColumn("scope", F.coalesce(scope, F.lit(""))).withColumn("level", F.coalesce("level", section_level + 1, F.lit(1)))
    return out.select("doc_id", "pos", "page", F.when(F.col("header"), "section").otherwise("paragraph").alias("type"), "text", "level", "scope", "parent")


def table_scopes(sections: DataFrame, tables: DataFrame) -> DataFrame:
    """tables (doc_id, page, table_index) with the scope of the first section of their page that has one, scopes being carried from section to section."""
    carried = F.last(F.nullif(F.col("scope"), F.lit("")), True).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    first = sections.withColumn("scope", carried).where("scope is not null").groupBy("doc_id", "page").agg(F.min_by("scope", "pos").alias("scope"))
    return tables.join(first, ["doc_id", "page"], "left").withColumn("scope", F.coalesce("scope", F.lit("")))


def flat_nodes(elements: DataFrame) -> DataFrame:
    """The tree of elements (doc_id, pos, text, category, and page if known) that have categories but no layout, as nodes gives it.

    A category that names a title or header makes a section of level 1; the rest are paragraphs under the last section (level 2), or under the root (1).
    """
    page = F.coalesce(F.nullif("page", F.lit(0)), F.lit(1)) if "page" in elements.columns else F.lit(1)
    rows = elements.select("doc_id", "pos", page.alias("page"), strip(F.col("text")).alias("text"), F.coalesce(F.col("category").rlike("Title|Header"), F.lit(False)).alias("header")).where("text <> ''")
    so_far = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    section = F.last(F.when(F.col("header"), F.col("pos")), True).over(so_far)
    scope = F.last(F.nullif(strip(first_match(F.col("text"), LAYOUT_SCOPES)), F.lit("")), True).over(so_far)
    rows = rows.withColumn("section", section).withColumn("scope", F.coalesce(scope, F.lit("")))
    level = F.when(F.col("header") | F.col("section").isNull(), 1).otherwise(2)
    return rows.select("doc_id", "pos", "page", F.when(F.col("header"), "section").otherwise("paragraph").alias("type"), "text", level.alias("level"), "scope", F.when(~F.col("header"), F.col("section")).alias("parent"))
