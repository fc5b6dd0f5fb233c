"""Document trees as rows with parent pointers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.scratch import dropped, written


def parents(nodes: DataFrame, levels: int | None = None) -> DataFrame:
    """nodes (doc_id, pos, level, header) with parent: of a header the nearest one before it with a lesser level, of a paragraph the nearest one; null at the root.

    levels is the greatest level; where it isn't given the table is asked for it.
    """
    if levels is None:
        levels = nodes.where("header").agg(F.max("level")).first()[0] or 1
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    lesser = [F.last(F.when(F.col("header") & (F.col("level") < k), F.col("pos")), True).over(before) for k in range(1, levels + 1)]
    of_header = F.coalesce(*(F.when(F.col("level") == k, lesser[k - 1]) for k in range(1, levels + 1)))
    return nodes.withColumn("parent", F.when(F.col("header"), of_header).otherwise(F.last(F.when(F.col("header"), F.col("pos")), True).over(before)))


def depths(nodes: DataFrame, root: str = "parent is null") -> DataFrame:
    """id, depth and path of the nodes (id, parent) that a root leads to, whatever their depth.

    Each round doubles the stretch of every unfinished path: what a node knows up to an ancestor is joined with what that
    one knows. Rounds grow with the logarithm of the depth. Nodes under a missing parent or on a cycle give no row.
    """
    node = F.col("id").cast("string")
    is_root = F.coalesce(F.expr(root), F.lit(False))
    state = written(nodes.select("id", F.when(~is_root, F.col("parent")).alias("up"), F.when(is_root, 0).otherwise(1).alias("depth"), node.alias("path"), is_root.alias("done")), "depths")
    left = state.where("not done").count()
    while left:
        above = state.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("path").alias("begin"), F.col("done").alias("ends"))
        longer = state.where("not done").join(above, "up").select("id", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), F.concat("begin", F.lit("/"), "path").alias("path"), F.col("ends").alias("done"))
        last, state = state, written(state.where("done").unionByName(longer), "depths")
        dropped(last)
        now = state.where("not done").count()
        if now == left:  # only cycles are left: else the next rank of nodes would have reached its root
            break
        left = now
    return state.where("done").select("id", "depth", "path")


def _sizes(nodes: DataFrame, n: int) -> DataFrame:
    """id and size (of its subtree, itself included), written. In each round a node gives what is less than 2 ** k below it to its ancestor 2 ** k above."""
    state, reach = written(nodes.select("id", F.col("parent").alias("up"), F.lit(1).cast("long").alias("size")), "sizes"), 1
    while reach < n and not state.where("up is not null").isEmpty():
        given = state.where("up is not null").groupBy(F.col("up").alias("id")).agg(F.sum("size").alias("more"))
        above = state.select(F.col("id").alias("up"), F.col("up").alias("next"))
        last, state = state, written(state.join(given, "id", "left").join(above, "up", "left").select("id", F.col("next").alias("up"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")), "sizes")
        dropped(last)
        reach *= 2
    return state


def preorder(nodes: DataFrame, order: str = "pos") -> DataFrame:
    """id, root, place (from 0, within the tree of its root), depth and size of the nodes (id, parent, and `order` among siblings, then id): a walk that visits a node before
    its children, in order.

    A node's place is its parent's, one more, and the sizes of the siblings before it; sizes and places are summed along ancestors by doubling, so that rounds grow with the
    logarithm of the depth. Siblings are dealt by ranges, so that a node with very many children is summed by many tasks. Nodes under a missing parent or on a cycle give no row.
    """
    nodes = written(nodes.select("id", "parent", F.col(order).alias("ord")), "nodes")
    n = nodes.count()
    sizes = _sizes(nodes, n)
    kids = nodes.where("parent is not null").join(sizes.select("id", "size"), "id").repartitionByRange("parent", "ord", "id").sortWithinPartitions("parent", "ord", "id")
    kids = written(kids.select("id", "parent", "size", F.monotonically_increasing_id().alias("idx")).withColumn("part", F.shiftright("idx", 33)), "kids")
    before = lambda by: F.coalesce(F.sum("size").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    earlier = kids.groupBy("parent", "part").agg(F.sum("size").alias("size")).select("parent", "part", before(Window.partitionBy("parent").orderBy("part")).alias("carried"))
    placed = kids.withColumn("local", before(Window.partitionBy("parent", "part").orderBy("idx"))).join(earlier, ["parent", "part"])
    zero, none = F.lit(0).cast("long"), F.lit(None)
    roots = nodes.where("parent is null").select("id", F.col("parent").alias("up"), F.col("id").alias("root"), zero.alias("place"), zero.alias("depth"))
    rest = placed.select("id", F.col("parent").alias("up"), none.cast(nodes.schema["id"].dataType).alias("root"), (1 + F.col("local") + F.col("carried")).alias("place"), F.lit(1).cast("long").alias("depth"))
    state, reach = written(roots.unionByName(rest), "places"), 1
    while reach <= n and not state.where("root is null").isEmpty():
        above = state.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("root").alias("top"), F.col("place").alias("more"), F.col("depth").alias("deeper"))
        longer = state.where("root is null").join(above, "up").select("id", F.col("next").alias("up"), F.col("top").alias("root"), (F.col("place") + F.col("more")).alias("place"), (F.col("depth") + F.col("deeper")).alias("depth"))
        last, state = state, written(state.where("root is not null").unionByName(longer), "places")
        dropped(last)
        reach *= 2
    out = written(state.where("root is not null").join(sizes.select("id", "size"), "id").select("id", "root", "place", "depth", "size"), "preorder")
    dropped(nodes, sizes, kids, state)
    return out


def deepest_first(nodes: DataFrame, levels: int | None = None) -> DataFrame:
    """nodes (doc_id, pos, level) with parent as insertion by level gives it: the last node before it with just one level less; null: the root."""
    if levels is None:
        levels = nodes.agg(F.max("level")).first()[0] or 1
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    found = [F.when(F.col("level") == k, F.last(F.when(F.col("level") == k - 1, F.col("pos")), True).over(before)) for k in range(2, levels + 1)]
    return nodes.withColumn("parent", F.coalesce(*found) if found else F.lit(None).cast("long"))


def text(nodes: DataFrame) -> DataFrame:
    """doc_id and text of nodes (doc_id, pos, text): the texts that aren't empty in order, by line ends."""
    parts = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return nodes.where("text <> ''").groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("text"))


def extent(elements: DataFrame) -> DataFrame:
    """doc_id, pages (the greatest page) and elements (their number) of elements (doc_id, page)."""
    return elements.groupBy("doc_id").agg(F.coalesce(F.max("page"), F.lit(0)).alias("pages"), F.count("*").alias("elements"))


def of_type(nodes: DataFrame, kind: str) -> DataFrame:
    return nodes.where(F.col("type") == kind)


def stats(nodes: DataFrame) -> DataFrame:
    """Of nodes (doc_id, type, text): nodes, sections, paragraphs, and the characters of all texts joined by line ends."""
    some = F.col("text") != ""
    return nodes.groupBy("doc_id").agg(F.count("*").alias("nodes"), F.count_if(F.col("type") == "section").alias("sections"), F.count_if(F.col("type") == "paragraph").alias("paragraphs"), (F.sum(F.length("text")) + F.greatest(F.count_if(some) - 1, F.lit(0))).alias("chars"))
