"""Tables from positioned cells: rows, columns, regions, headers. Cells (doc_id, page, text, x0, y0, x1, y1) have a top origin.

`extract` does it all with one shuffle, by page; what it holds at once is one page. Cells without text, or without all of their
coordinates, are dropped; further columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..config import TableConfig
from ..functions.columns import bound


def grouped_rows(cells: DataFrame, cfg: TableConfig = TableConfig()) -> DataFrame:
    """cells with row_index: in the order of y0 a cell joins the row while its centre is within the tolerance of the row's first cell's."""
    ordered = F.sort_array(F.collect_list(F.struct("y0", "x0", "x1", "y1", "text"))).alias("cells")

    def step(state, c):
        centre = (c["y0"] + c["y1"]) / 2
        new = state["anchor"].isNull() | (F.abs(centre - state["anchor"]) > cfg.row_tolerance)
        row = F.when(new, state["row"] + 1).otherwise(state["row"])
        return F.struct(F.when(new, centre).otherwise(state["anchor"]).alias("anchor"), row.alias("row"), F.concat(state["rows"], F.array(row)).alias("rows"))

    zero = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(-1).alias("row"), F.array().cast("array<int>").alias("rows"))
    pages = cells.groupBy("doc_id", "page").agg(ordered).withColumn("rows", F.aggregate("cells", zero, step, lambda s: s["rows"]))
    return pages.select("doc_id", "page", F.explode(F.arrays_zip("rows", "cells")).alias("z")).select("doc_id", "page", F.col("z.rows").alias("row_index"), "z.cells.*")


def boundaries(xs: Column, gap: float) -> Column:
    """Sorted x0 to column boundaries: a new one where it lies more than gap beyond the last boundary."""
    return F.aggregate(F.sort_array(F.array_compact(xs)), F.array().cast("array<double>"), lambda b, x: F.when((F.size(b) == 0) | (x - F.element_at(F.when(F.size(b) > 0, b), -1) > gap), F.concat(b, F.array(x))).otherwise(b))


def column_of(x: Column, bounds: Column, slack: float) -> Column:
    """Index of the last boundary that is at most slack beyond x; 0 if none is."""
    return F.greatest(F.size(F.filter(bounds, lambda b: x >= b - slack)) - 1, F.lit(0))


def is_table_row(texts: Column, cfg: TableConfig = TableConfig()) -> Column:
    def of(texts):
        indicated = bound(F.array_join(texts, " "), lambda joined: reduce(lambda a, b: a | b, (joined.rlike(f"(?i){p}") for p in cfg.indicators)))
        numbers = F.size(F.filter(texts, lambda t: t.rlike(r"^\d+$"))) >= 2
        return (F.size(texts) >= cfg.min_columns) & (indicated | F.exists(texts, lambda t: t.rlike(cfg.code)) | numbers)

    return bound(texts, of)


def regions(rows: DataFrame, keys: list[str], flag: str, pos: str, least: int = 2) -> DataFrame:
    """first and after (half-open) of each maximal run of rows with the flag, of `least` rows or more."""
    n = F.row_number().over(Window.partitionBy(*keys, flag).orderBy(pos))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(pos))
    runs = rows.withColumn("isle", place - n).where(F.col(flag)).groupBy(*keys, "isle").agg(F.min(pos).alias("first"), (F.max(pos) + 1).alias("after"), F.count("*").alias("n"))
    return runs.where(F.col("n") >= least).select(*keys, "first", "after")


def headers(first_row: Column, n: Column, cfg: TableConfig = TableConfig(), joined: Column | None = None) -> Column:
    """Texts of the first row (map of column to text) if it looks like a header, else and for missing ones Column_i. joined: its whole text, if that isn't the map's values."""
    joined = F.array_join(F.map_values(first_row), " ") if joined is None else joined
    known = bound(joined, lambda joined: reduce(lambda a, b: a | b, (joined.rlike(f"(?i){p}") for p in cfg.headers)))
    named = lambda known: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(F.when(known, F.trim(F.regexp_replace(first_row[i], r"\s+", " "))), F.concat(F.lit("Column_"), i.cast("string"))))
    return bound(known, named)


def header_key(h: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(h), r"\s+", "_"), r"^_+|_+$", "")


def measures(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Width, height and centre of a box."""
    return F.struct((x1 - x0).alias("width"), (y1 - y0).alias("height"), ((x0 + x1) / 2).alias("center_x"), ((y0 + y1) / 2).alias("center_y"))


def outlines(cells: DataFrame, keys: list[str]) -> DataFrame:
    """The least box around the cells of each group, and their raw text: cells of a row by ` | `, rows by line ends. cells: keys, row_index, text, x0, y0, x1, y1."""
    rows = cells.groupBy(*keys, "row_index").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "y0", "text"))), lambda c: c["text"]), " | ").alias("row"))
    return rows.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row_index", "row"))), lambda r: r["row"]), "\n").alias("raw_text"))


def _texts(row: Column) -> Column:
    return F.transform(row, lambda c: c["text"])


def _page_rows(cells: pa.Table, keys: list[str], tolerance: float) -> pa.RecordBatch:
    """Cells in order of page, y0, x0, x1, y1 and text to pages (keys, scope, lines): rows, each in the order of x0."""
    coded = [c.combine_chunks().dictionary_encode("encode").indices.to_numpy() for c in map(cells.column, keys)]
    new = np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in coded])])
    firsts, anchor = [], 0.0
    for i, (first, centre) in enumerate(zip(new.tolist(), ((cells["y0"].to_numpy() + cells["y1"].to_numpy()) / 2).tolist())):
        if first or not abs(centre - anchor) <= tolerance:
            firsts.append(i)
            anchor = centre
    ends = np.array([*firsts, len(new)], np.int32)
    order = ["x0", "y0", "text", "x1", "y1"]
    ranked = cells.select(order).append_column("row", pa.array(np.repeat(np.arange(len(firsts)), np.diff(ends))))
    ranked = ranked.take(pc.sort_indices(ranked, [(c, "ascending") for c in ("row", *order)]))
    rows = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([ranked[c].combine_chunks() for c in order], order))
    begins = np.flatnonzero(new)
    lines = pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(firsts, begins), len(firsts)).astype(np.int32)), rows)
    told = cells.select([*keys, "scope"]).take(pa.array(begins))
    return pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in told.columns), lines], names=[*keys, "scope", "lines"])


def _paged(keys: list[str], tolerance: float):
    """mapInArrow function: cells in the order of _page_rows to pages. What is held is a batch and the page that it ends in."""

    def run(batches):
        held, key = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            at = lambda i: [batch.column(k)[i].as_py() for k in keys]  # noqa: B023, E731
            if held and at(0) == at(-1) == key:
                held.append(batch)
                continue
            cells, key = pa.Table.from_batches([*held, batch]), at(-1)
            last = len(cells) - 1
            while last and [cells[k][last - 1].as_py() for k in keys] == key:
                last -= 1
            if last:
                yield _page_rows(cells.slice(0, last), keys, tolerance)
            held = cells.slice(last).to_batches()
        if held:
            yield _page_rows(pa.Table.from_batches(held), keys, tolerance)

    return run


def _pages(cells: DataFrame, keys: list[str], cfg: TableConfig, scope: str | None) -> DataFrame:
    """keys, scope and lines of each page, by one shuffle."""
    flat = ["y0", "x0", "x1", "y1", "text"]
    put = [*(F.col(c).cast("double").alias(c) for c in flat[:-1]), F.trim("text", F.lit(" \t\n\x0b\f\r")).alias("text")]
    whole = cells.where("text is not null and x0 is not null and y0 is not null and x1 is not null and y1 is not null").select(*keys, *put, (F.col(scope) if scope else F.lit("")).alias("scope")).where("text <> ''")
    dealt = whole.withColumn("scope", F.min("scope").over(Window.partitionBy(*keys))) if scope else whole.repartition(*keys)
    cell = T.StructType([T.StructField(c, T.StringType() if c == "text" else T.DoubleType()) for c in ("x0", "y0", "text", "x1", "y1")])
    schema = T.StructType([*(whole.schema[c] for c in (*keys, "scope")), T.StructField("lines", T.ArrayType(T.ArrayType(cell)))])
    return dealt.sortWithinPartitions(*keys, *flat).mapInArrow(_paged(keys, cfg.row_tolerance), schema)


def _runs(flags: Column, least: int) -> Column:
    """first and after (half-open) of each maximal run of true flags, of `least` or more. flags: a bound value."""
    n = F.size(flags)
    at = lambda i: F.coalesce(F.get(flags, i), F.lit(False))
    firsts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: at(i) & ~at(i - 1))
    afters = F.filter(F.sequence(F.lit(1), n), lambda i: at(i - 1) & ~at(i))
    return F.filter(F.zip_with(firsts, afters, lambda a, b: F.struct(a.alias("first"), b.alias("after"))), lambda r: r["after"] - r["first"] >= least)


def _valued(heads: Column, values: Column) -> Column:
    """Array of header and value; of columns with one header the last counts, at the place of the first."""
    return F.transform(F.array_distinct(heads), lambda h: F.struct(h.alias("header"), F.element_at(F.filter(values, lambda v, i: F.get(heads, i) == h), -1).alias("value")))


def _laid_out(lines: Column, bounds: Column, cfg: TableConfig) -> Column:
    """headers and rows of a table's lines."""
    placed = lambda row: F.transform(row, lambda c: F.struct(column_of(c["x0"], bounds, cfg.column_slack).alias("column"), c["text"].alias("text")))
    value = lambda cells, i: F.array_join(_texts(F.filter(cells, lambda c: c["column"] == i)), " ")
    values = lambda row: bound(placed(row), lambda cells: F.transform(F.sequence(F.lit(0), F.size(bounds) - 1), lambda i: value(cells, i)))

    def laid(grid):
        # no cell's text is empty
        of_first = F.map_from_entries(F.filter(F.transform(grid[0], lambda t, i: F.struct(i.alias("i"), t.alias("t"))), lambda e: e["t"] != ""))
        heads = bound(of_first, lambda m: headers(m, F.size(bounds), cfg, F.array_join(_texts(lines[0]), " ")))

        def rows(heads):
            body = F.when(heads[0] == "Column_0", grid).otherwise(F.slice(grid, F.lit(2), F.size(grid)))
            return F.struct(heads.alias("headers"), F.transform(body, lambda v: _valued(heads, v)).alias("rows"))

        return bound(heads, rows)

    return bound(F.transform(lines, values), laid)


def extract(cells: DataFrame, cfg: TableConfig = TableConfig(), scope: str | None = None) -> DataFrame:
    """One row for each table: doc_id, page, table_index, headers, rows (each an array of header and value), bbox, scope, raw_text, first (its first row's
    index on the page). scope: a column of the cells (the least one of a page counts); without it an empty text. Runs of table rows are tables, numbered on
    their page; those with fewer than `min_columns` columns keep their number and are left out; a first row that looks like headers names the columns and is no row."""
    keys = ["doc_id", "page"]
    pages = _pages(cells, keys, cfg, scope)
    runs = bound(F.transform("lines", lambda row: is_table_row(_texts(row), cfg)), lambda flags: _runs(flags, cfg.min_rows))
    # The outer form, as the inner one would repeat the whole expression in a filter.
    found = pages.select(*keys, "scope", "lines", F.posexplode_outer(runs).alias("table_index", "run")).where("run is not null")
    found = found.select(*keys, "scope", "table_index", "run.first", F.slice("lines", F.col("run.first") + 1, F.col("run.after") - F.col("run.first")).alias("lines"))
    bounds = boundaries(F.transform(F.flatten("lines"), lambda c: c["x0"]), cfg.column_gap)
    laid = bound(bounds, lambda b: F.when(F.size(b) >= cfg.min_columns, _laid_out(F.col("lines"), b, cfg)))
    flat = F.flatten("lines")
    edge = lambda f, c: f(F.transform(flat, lambda x: x[c])).alias(c)
    box = F.struct(edge(F.array_min, "x0"), edge(F.array_min, "y0"), edge(F.array_max, "x1"), edge(F.array_max, "y1"))
    raw = F.array_join(F.transform("lines", lambda row: F.array_join(_texts(row), " | ")), "\n")
    # An array of one table or none: exploded, so that no later filter repeats the expression.
    tables = found.select(*keys, "scope", "table_index", "first", "lines", F.explode_outer(F.array(laid)).alias("laid")).where("laid is not null")
    return tables.select(*keys, "table_index", "laid.headers", "laid.rows", box.alias("bbox"), "scope", raw.alias("raw_text"), "first")
