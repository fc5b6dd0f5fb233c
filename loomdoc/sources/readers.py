"""Documents to ordered elements (doc_id, pos, text, category)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EXCLUDED_CATEGORIES
from ..functions.text import hash16, strip
from .docx import docx_elements

SUFFIXES = (".txt", ".md", ".html")
DOCUMENTS = (".docx", ".pdf")


def text_elements(docs: DataFrame) -> DataFrame:
    """Paragraphs between blank lines of (doc_id, text)."""
    parts = docs.select("doc_id", F.posexplode(F.split("text", "\n\n")).alias("pos", "text"))
    return parts.select("doc_id", "pos", strip(F.col("text")).alias("text"), F.lit("NarrativeText").alias("category")).where("text <> ''")


def unescaped(c: Column) -> Column:
    for name, mark in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("nbsp", " "), ("amp", "&")):
        c = F.regexp_replace(c, f"&{name};", mark)
    return c


def html_elements(pages: DataFrame) -> DataFrame:
    """Titles, headings, paragraphs and list items of (doc_id, html), in page order."""
    plain = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</\1>", ""), r"(?s)<!--.*?-->", "")
    opened = F.regexp_replace(plain, r"(?i)<(title|h[1-6]|p|li)(?:\s[^>]*)?>", "\u0001$1\u0002")
    cut = F.split(opened, "\u0001")
    parts = F.slice(cut, F.lit(2), F.size(cut) - 1)
    rows = pages.select("doc_id", F.posexplode(parts).alias("pos", "part"))
    tag = F.lower(F.substring_index("part", "\u0002", 1))
    body = F.regexp_replace(F.substring_index("part", "\u0002", -1), r"(?is)</(?:title|h[1-6]|p|li)>.*", "")
    kind = F.when(tag.rlike("^(title|h[1-6])$"), "Title").when(tag == "li", "ListItem").otherwise("NarrativeText")
    return rows.select("doc_id", "pos", strip(unescaped(F.regexp_replace(body, r"<[^>]*>", ""))).alias("text"), kind.alias("category")).where("text <> ''")


def without_categories(elements: DataFrame, excluded=EXCLUDED_CATEGORIES) -> DataFrame:
    return elements.where(~F.col("category").isin(*excluded))


def _files(spark: SparkSession, path: str, suffixes) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*{" + ",".join(suffixes) + "}").load(path)
    return files.select(F.col("path").alias("source_id"), "content", F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).alias("suffix"))


def _decoded(content: Column) -> Column:
    """Bytes as text; those that are no UTF-8 become U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def directory(spark: SparkSession, path: str, suffixes=SUFFIXES) -> DataFrame:
    """source_id, source_hash, suffix, text of the text files under path. Bytes that are no UTF-8 become U+FFFD."""
    return _files(spark, path, suffixes).select("source_id", hash16(F.col("content")).alias("source_hash"), "suffix", _decoded(F.col("content")).alias("text"))


def file_elements(spark: SparkSession, path: str, suffixes=(*SUFFIXES, *DOCUMENTS)) -> DataFrame:
    """doc_id (the path), pos, text, category, level and error of all files under path, each by the reader of its suffix.

    A file that can't be read gives one row with its error, and so does one of a suffix without a reader (.pdf); the others aren't touched by it.
    """
    files = _files(spark, path, suffixes)
    texts = files.select(F.col("source_id").alias("doc_id"), "suffix", _decoded(F.col("content")).alias("text"))
    plain = text_elements(texts.where(F.col("suffix").isin(".txt", ".md")))
    html = html_elements(texts.where("suffix = '.html'").withColumnRenamed("text", "html"))
    word = docx_elements(files.where("suffix = '.docx'").withColumnRenamed("source_id", "doc_id"))
    none = files.where(~F.col("suffix").isin(".txt", ".md", ".html", ".docx")).select(F.col("source_id").alias("doc_id"), F.lit(0).alias("pos"), F.concat(F.lit("no reader of "), "suffix").alias("error"))
    return plain.unionByName(html).unionByName(word, allowMissingColumns=True).unionByName(none, allowMissingColumns=True)


def document(spark: SparkSession, path: str) -> DataFrame:
    """file_elements of one file. ValueError where its suffix has no reader."""
    suffix = "." + path.rsplit("/", 1)[-1].rpartition(".")[2].lower()
    if suffix not in (*SUFFIXES, ".docx"):
        raise ValueError(f"no reader of {suffix}: {path}")
    return file_elements(spark, path)


def report(elements: DataFrame) -> DataFrame:
    """source_id, elements, success and error of each file that gave elements or an error."""
    out = elements.groupBy(F.col("doc_id").alias("source_id")).agg(F.count("text").alias("elements"), F.min("error").alias("error"))
    return out.withColumn("success", F.col("error").isNull())


def outcome(reported: DataFrame) -> DataFrame:
    """total, succeeded and failed."""
    return reported.agg(F.count("*").alias("total"), F.count_if("success").alias("succeeded"), F.count_if(~F.col("success")).alias("failed"))
