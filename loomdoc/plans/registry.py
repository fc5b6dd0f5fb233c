"""Registered queries of the library and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULT, LAYOUT_EXCLUDED, LAYOUT_LEVELS, LAYOUT_SCOPES, LAYOUT_SECTIONS, RetrievalConfig, TableConfig
from ..functions import text as T
from ..operators import chunking, embedding, layout, ner, retrieval, store, tables, text_index, tree, vector
from ..operators import table_entities as rows_of_tables
from ..sources import readers
from ..sources.collections import Collections
from ..streaming import ingest
from . import scratch

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark, d):
    return _t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("source_id"), F.col("lang").alias("language"), F.col("n_chars").alias("char_count"))


def _points(spark, d):
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _vector(spark, d, i=0):
    return [float(x) for x in _points(spark, d).where(F.col("id") == i).select("embedding").first()[0]]


# --- vectors

DOT = "round(list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i: e.embedding[i]::DOUBLE * q.embedding[i]::DOUBLE)), 6)"


@query(f"SELECT e.vec_id AS id, {DOT} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, id LIMIT 5")
def vector_topk(spark, d):
    return vector.top_k(_points(spark, d), _vector(spark, d), 5).select("id", "score")


@query(f"""SELECT e.vec_id AS id, {DOT} AS score, d.source AS source_id FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id, (SELECT embedding FROM embeddings WHERE vec_id = 0) q
WHERE d.lang = 'en' AND d.n_chars BETWEEN 300 AND 4000 AND {DOT} >= 0.1 ORDER BY score DESC, id LIMIT 5""")
def vector_topk_filtered(spark, d):
    both = _points(spark, d).join(_docs(spark, d), "id")
    return vector.top_k(both, _vector(spark, d), 5, vector.payload_filter(language="en", min_chars=300, max_chars=4000), 0.1).select("id", "score", "source_id")


@query(f"""SELECT query_id, rank, id, score FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, {DOT} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {DOT} DESC, e.vec_id) AS rank
FROM embeddings e, (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 20 = 0) q) WHERE rank <= 5""")
def vector_topk_per_query(spark, d):
    p = _points(spark, d)
    return vector.top_k_per_query(p, p.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query")), 5).select("query_id", "rank", "id", "score")


@query("SELECT vec_id AS id, round(sqrt(list_sum(list_transform(embedding, lambda x: (3 * x::DOUBLE) ** 2))) / 3, 4) AS norm, 1.0::DOUBLE AS after FROM embeddings")
def vector_normalize(spark, d):
    p = _points(spark, d).withColumn("big", F.transform("embedding", lambda x: 3 * x.cast("double")))
    n = vector.normalized(F.col("big"))
    return p.select("id", F.round(F.sqrt(vector.dot(F.col("big"), F.col("big"))) / 3, 4).alias("norm"), F.round(F.sqrt(vector.dot(n, n)), 6).alias("after"))


@query("SELECT DISTINCT source AS source_id FROM documents")
def point_sources(spark, d):
    return _docs(spark, d).select("source_id").distinct().orderBy("source_id")


@query("SELECT label AS collection, count(*) AS points, max(len(embedding)) AS vector_size FROM embeddings GROUP BY label")
def collection_stats(spark, d):
    return _points(spark, d).groupBy(F.col("label").alias("collection")).agg(F.count("*").alias("points"), F.max(F.size("embedding")).cast("long").alias("vector_size"))


@query("SELECT doc_id AS id FROM documents WHERE source = 'src3' AND lang = 'en' AND n_chars >= 500 AND n_chars <= 3000 AND contains(text, 'The')")
def payload_filter(spark, d):
    return _docs(spark, d).where(vector.payload_filter(source_id="src3", language="en", min_chars=500, max_chars=3000, custom=[F.col("text").contains("The")])).select("id")


@query("SELECT doc_id AS id FROM documents WHERE source = 'src7' AND n_chars = (SELECT max(n_chars) FROM documents WHERE source = 'src7')")
def kv_filter(spark, d):
    docs = _docs(spark, d)
    most = docs.where("source_id = 'src7'").agg(F.max("char_count")).first()[0]
    return docs.where(vector.key_value_filter("source_id = src7", docs.columns)).where(vector.key_value_filter(f"char_count={most}", docs.columns)).select("id")


# --- text

SQUEEZE = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
CLEAN = SQUEEZE.format("regexp_replace(regexp_replace(" + SQUEEZE.format("text") + ", '\\.{3,}', ' ', 'g'), '(\\.\\s){3,}', ' ', 'g')")
WORDS = "list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')"


@query(f"SELECT doc_id AS id, sha256({CLEAN}) AS digest FROM documents")
def clean_text(spark, d):
    return _docs(spark, d).select("id", F.sha2(T.clean(F.col("text")), 256).alias("digest"))


@query("SELECT doc_id AS id, sha256(text)[1:16] AS document_hash, sha256(concat(source, ':', text))[1:16] AS chunk_hash FROM documents")
def document_hashes(spark, d):
    return _docs(spark, d).select("id", T.hash16(F.col("text")).alias("document_hash"), T.chunk_key(F.col("source_id"), F.col("text")).alias("chunk_hash"))


@query(f"""SELECT doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS chunk_index, count(*) OVER (PARTITION BY source) AS total_chunks, length(text) AS char_count, len({WORDS}) AS word_count FROM documents""")
def doc_format(spark, d):
    rows = chunking.formatted(_docs(spark, d).withColumn("pos", F.col("id")))
    return rows.select("id", F.col("chunk_index").cast("long").alias("chunk_index"), "total_chunks", F.col("char_count").cast("long").alias("char_count"), F.col("word_count").cast("long").alias("word_count"))


@query("SELECT doc_id AS id FROM documents WHERE length(text) >= 300")
def filter_short(spark, d):
    return _docs(spark, d).where(F.length("text") >= DEFAULT.min_chars).select("id")


@query(f"SELECT doc_id AS id FROM documents WHERE len({WORDS}) >= 20 AND len(list_filter({WORDS}, lambda w: regexp_full_match(w, '\\pL+'))) / greatest(len({WORDS}), 1) >= 0.3")
def filter_low_signal(spark, d):
    return _docs(spark, d).where(~T.low_signal(F.col("text"))).select("id")


SENTENCES = "string_split(regexp_replace(text, '([.!?。！？।])\\s+', '\\1' || chr(1), 'g'), chr(1))"


@query(f"SELECT doc_id AS id, len({SENTENCES}) AS n, sha256(array_to_string({SENTENCES}, '|')) AS digest FROM documents")
def sentence_split(spark, d):
    s = chunking.sentences(F.col("text"))
    return _docs(spark, d).select("id", F.size(s).cast("long").alias("n"), F.sha2(F.array_join(s, "|"), 256).alias("digest"))


def _pack_sql(items: str, size: int, overlap: int) -> str:
    lead = f"concat(CASE WHEN length(st.now) > {overlap} THEN right(st.now, {overlap}) ELSE st.now END, ' ', s)" if overlap else "s"
    return f"""WITH RECURSIVE parts AS (SELECT doc_id, {items} AS ss FROM documents),
fold(doc_id, i, now, done) AS (SELECT doc_id, 0::BIGINT, '', []::VARCHAR[] FROM parts UNION ALL
 SELECT st.doc_id, st.i + 1, CASE WHEN st.now = '' THEN s WHEN length(st.now) + length(s) + 1 <= {size} THEN concat(st.now, ' ', s) ELSE {lead} END,
        CASE WHEN st.now = '' OR length(st.now) + length(s) + 1 <= {size} THEN st.done ELSE list_append(st.done, st.now) END
 FROM (SELECT f.*, p.ss[f.i + 1] AS s, len(p.ss) AS n FROM fold f JOIN parts p USING (doc_id)) st WHERE st.i < st.n)
SELECT f.doc_id AS id, len(x) AS n, sha256(array_to_string(x, '|')) AS digest FROM (SELECT f.doc_id, CASE WHEN f.now = '' THEN f.done ELSE list_append(f.done, f.now) END AS x FROM fold f JOIN parts p USING (doc_id) WHERE f.i = len(p.ss)) f"""


@query(_pack_sql(SENTENCES, 400, 50))
def sentence_pack(spark, d):
    p = chunking.packed(chunking.sentences(F.col("text")), 400, 50)
    return _docs(spark, d).select("id", p.alias("p")).select("id", F.size("p").cast("long").alias("n"), F.sha2(F.array_join("p", "|"), 256).alias("digest"))


@query()
def hard_split_words(spark, d):
    """The whole text of every document; a recursive query takes too long on these, so that tests compare it with brute force."""
    p = chunking.hard_split(F.col("text"), 120)
    return _docs(spark, d).select("id", p.alias("p")).select("id", F.size("p").cast("long").alias("n"), F.sha2(F.array_join("p", "|"), 256).alias("digest"))


@query("""WITH e AS (SELECT conv_id AS doc_id, turn AS pos, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t, role = 'user' AND length(text) >= 5 AS header FROM conversations),
s AS (SELECT *, sum(header::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM e)
SELECT doc_id, section, count(*) AS parts, string_agg(t, ' ' ORDER BY pos) AS text, bool_or(header) AS opened FROM s GROUP BY doc_id, section""")
def running_sections(spark, d):
    rows = _t(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), T.squeeze(F.col("text")).alias("t"), ((F.col("role") == "user") & (F.length("text") >= 5)).alias("header"))
    rows = rows.withColumn("section", F.sum(F.col("header").cast("int")).over(Window.partitionBy("doc_id").orderBy("pos")))
    return rows.groupBy("doc_id", "section").agg(F.count("*").alias("parts"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda x: x["t"]), " ").alias("text"), F.bool_or("header").alias("opened"))


@query()
def section_chunks(spark, d):
    rows = _t(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), "text", F.when(F.col("role") == "user", "Title").otherwise("NarrativeText").alias("category"))
    return chunking.section_chunks(rows)


@query()
def chunk_documents(spark, d):
    """The whole way from elements to numbered chunks."""
    rows = _docs(spark, d).select(F.col("id").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("pos", "text")).withColumn("category", F.lit("NarrativeText"))
    return chunking.chunked(rows)


@query()
def merge_small(spark, d):
    rows = _docs(spark, d).select("id", F.transform(F.split("text", "\n"), lambda t: F.struct(F.lit("t").alias("title"), t.alias("text"))).alias("c"))
    return rows.select("id", F.posexplode(chunking.merge_small(F.col("c"), 200, 600)).alias("pos", "chunk")).select("id", "pos", "chunk.text")


# --- entities

def _ner_sql(name: str, where: str = "true") -> str:
    p = ner.pattern(name).replace("'", "''")
    return f"SELECT doc_id AS id, len(x) AS n, array_to_string(x, '|') AS found FROM (SELECT doc_id, regexp_extract_all(text, '(?im){p}') AS x FROM documents WHERE {where}) WHERE len(x) > 0"


def _ner(spark, d, name):
    m = ner.matches(F.col("text"), ner.pattern(name), ner.NEEDED.get(name))
    return _docs(spark, d).select("id", m.alias("m")).where(F.size("m") > 0).select("id", F.size("m").cast("long").alias("n"), F.array_join("m", "|").alias("found"))


@query(_ner_sql("email"))
def ner_email(spark, d):
    return _ner(spark, d, "email")


@query(_ner_sql("phone"))
def ner_phone(spark, d):
    return _ner(spark, d, "phone")


@query(_ner_sql("org_with_suffix"))
def ner_org(spark, d):
    return _ner(spark, d, "org_with_suffix")


@query(_ner_sql("percentage"))
def ner_percentage(spark, d):
    return _ner(spark, d, "percentage")


#: Without those that the SQL's expressions can't say: one looks ahead, one has word borders at letters beyond ASCII. Tests compare all with Python's.
EVERY_PATTERN = [p[0] for p in ner.PATTERNS if p[0] not in ("acronym_org", "alphanumeric_code")]


@query(" UNION ALL ".join(f"SELECT '{name}' AS pattern, id, n, found FROM ({_ner_sql(name)})" for name in EVERY_PATTERN))
def ner_by_pattern(spark, d):
    """What each pattern matches in each document, in one pass over the texts."""
    found = [F.struct(F.lit(name).alias("pattern"), ner.matches(F.col("text"), ner.pattern(name), ner.NEEDED.get(name)).alias("m")) for name in EVERY_PATTERN]
    rows = _docs(spark, d).select("id", F.inline(F.array(*found)))
    return rows.where(F.size("m") > 0).select("pattern", "id", F.size("m").cast("long").alias("n"), F.array_join("m", "|").alias("found"))


@query("""WITH m AS (SELECT doc_id, regexp_extract_all(text, '(?im)\\d{3}[-.\\s]?\\d{3}[-.\\s]?\\d{4}') AS x, regexp_split_to_array(text, '(?im)\\d{3}[-.\\s]?\\d{3}[-.\\s]?\\d{4}') AS g FROM documents)
SELECT doc_id AS id, i - 1 AS k, x[i] AS found, (coalesce(list_sum(list_transform(g[1:i], lambda t: length(t))), 0) + coalesce(list_sum(list_transform(x[1:i-1], lambda t: length(t))), 0))::BIGINT AS begin FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM m)""")
def ner_spans(spark, d):
    s = ner.spans(F.col("text"), r"\d{3}[-.\s]?\d{3}[-.\s]?\d{4}")
    return _docs(spark, d).select("id", F.posexplode(s).alias("k", "s")).select("id", F.col("k").cast("long").alias("k"), F.col("s.text").alias("found"), F.col("s.begin").cast("long").alias("begin"))


@query()
def ner_extract(spark, d):
    return ner.extract(_t(spark, d, "documents").select("doc_id", "text"))


#: The types whose patterns the SQL's expressions can say, and whose spans overlap: phones, dates and amounts.
OVERLAPPING = ner.NerConfig(types=("person", "date", "amount", "email", "phone", "url"))


def _spans_sql(order: int, p: tuple) -> str:
    regex = "(?im)" + p[4].replace("'", "''")
    before = "coalesce(list_sum(list_transform(g[1:i], lambda t: length(t))), 0) + coalesce(list_sum(list_transform(x[1:i-1], lambda t: length(t))), 0)"
    found = "trim(regexp_replace(x[i], '\\s+', ' ', 'g'))" if p[0] in ner.SQUEEZED + ner.TITLED else "x[i]"
    return f"""SELECT doc_id, {order} AS ord, '{p[1]}' AS type, '{p[0]}' AS pattern, {found} AS found, ({before})::BIGINT AS b, ({before} + length(x[i]))::BIGINT AS e FROM (
SELECT *, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{regex}') AS x, regexp_split_to_array(text, '{regex}') AS g FROM documents WHERE regexp_matches(text, '{regex}')))"""


@query(f"""WITH s AS ({" UNION ALL ".join(_spans_sql(i, p) for i, p in enumerate(OVERLAPPING.patterns()))}),
piled AS (SELECT doc_id, list({{'ord': ord, 'b': b, 'e': e, 'type': type, 'pattern': pattern, 'found': found}} ORDER BY ord, b) AS ss FROM s WHERE length(found) >= 2 GROUP BY doc_id),
kept AS (SELECT doc_id, unnest(list_reduce(list_transform(ss, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda a: x[1].b >= a.b AND x[1].b < a.e OR x[1].e > a.b AND x[1].e <= a.e)) > 0 THEN acc ELSE list_concat(acc, x) END)) AS c FROM piled)
SELECT doc_id, c.type AS type, lower(c.found) AS text, arg_min(c.pattern, (c.ord, c.b)) AS pattern, arg_min(c.b, (c.ord, c.b)) AS "begin", arg_min(c.e, (c.ord, c.b)) AS "end" FROM kept GROUP BY 1, 2, 3""")
def ner_overlap(spark, d):
    """Entities of six types with the rule of overlaps, without Python workers."""
    found = ner.extract_by_rows(_t(spark, d, "documents"), OVERLAPPING)
    return found.select("doc_id", "type", F.lower("text").alias("text"), "pattern", F.col("begin").cast("long").alias("begin"), F.col("end").cast("long").alias("end"))


def _customers(spark, d):
    return _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("ord"), F.lit("customer").alias("type"), F.col("c_name").alias("canonical_name"), F.col("c_mktsegment").alias("scope"), F.col("c_nationkey").alias("source_id"), F.round(F.abs("c_acctbal") / 10000, 4).alias("confidence"))


def _orders(spark, d):
    return _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit("ordered").alias("type"), F.col("o_custkey").alias("source_entity_id"), (F.col("o_orderkey") % 97).alias("target_entity_id"))


@query("""SELECT lower(c_mktsegment) AS name, min(c_custkey) AS id, arg_min(c_name, c_custkey) AS first_name, max(round(abs(c_acctbal) / 10000, 4)) AS confidence, min(nullif(c_nationkey, 0)) IS NOT NULL AS paged, count(*) AS n FROM customer GROUP BY 1""")
def entity_groups(spark, d):
    e = _t(spark, d, "customer")
    return e.groupBy(F.lower("c_mktsegment").alias("name")).agg(F.min("c_custkey").alias("id"), F.min_by("c_name", "c_custkey").alias("first_name"), F.max(F.round(F.abs("c_acctbal") / 10000, 4)).alias("confidence"), F.min(F.nullif(F.col("c_nationkey"), F.lit(0))).isNotNull().alias("paged"), F.count("*").alias("n"))


@query("""WITH e AS (SELECT p_partkey AS ord, p_brand AS name, p_type, p_size FROM part),
a AS (SELECT name, min(ord) AS id, arg_min(nullif(p_size, 1), ord) FILTER (p_size <> 1) AS page, arg_max(p_type, ord) AS attr FROM e GROUP BY name)
SELECT id, name AS canonical_name, coalesce(page, 0) AS page, attr FROM a""")
def entity_merge(spark, d):
    e = _t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("ord"), F.lit("part").alias("type"), F.col("p_brand").alias("canonical_name"), F.array(F.col("p_brand")).alias("aliases"), F.create_map(F.lit("type"), F.col("p_type")).alias("attributes"), F.when(F.col("p_size") == 1, 0).otherwise(F.col("p_size")).alias("page"), F.lit("").alias("scope"), F.lit(0.9).alias("confidence"))
    return store.merge(e).select("id", "canonical_name", "page", F.col("attributes")["type"].alias("attr"))


@query("""WITH e AS (SELECT (l_linenumber + 10 * l_orderkey) * 100000 + l_partkey AS ord, l_linestatus AS mode, concat('part ', l_partkey % 50) AS alias, concat('k', l_suppkey % 7) AS k, l_returnflag AS v, l_quantity FROM lineitem),
a AS (SELECT mode, string_agg(concat(k, '=', v), ',' ORDER BY first_ord) AS attributes FROM (SELECT mode, k, arg_max(v, ord) AS v, min(ord) AS first_ord FROM e GROUP BY mode, k) GROUP BY mode)
SELECT min(ord) AS id, lower(e.mode) AS name, array_to_string(list_sort(list_distinct(list(alias))), ',') AS aliases, any_value(a.attributes) AS attributes, max(l_quantity / 100) AS confidence FROM e JOIN a USING (mode) GROUP BY e.mode""")
def entity_merge_all(spark, d):
    """The lines of all orders as mentions of their few states: groups of many rows, with aliases and attributes that come again and again."""
    ord_ = (F.col("l_linenumber") + 10 * F.col("l_orderkey")) * 100000 + F.col("l_partkey")
    e = _t(spark, d, "lineitem").select(ord_.alias("id"), ord_.alias("ord"), F.lit("mode").alias("type"), F.col("l_linestatus").alias("canonical_name"), F.array(F.concat(F.lit("part "), (F.col("l_partkey") % 50).cast("string"))).alias("aliases"), F.create_map(F.concat(F.lit("k"), (F.col("l_suppkey") % 7).cast("string")), F.col("l_returnflag")).alias("attributes"), F.lit(0).alias("page"), F.lit("").alias("scope"), (F.col("l_quantity") / 100).alias("confidence"))
    told = F.array_join(F.transform(F.map_entries("attributes"), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",")
    return store.merge(e, least=0.0).select("id", F.lower("canonical_name").alias("name"), F.array_join("aliases", ",").alias("aliases"), told.alias("attributes"), "confidence")


@query("SELECT p_partkey AS id, p_name AS canonical_name FROM part WHERE p_name ILIKE '%a%' AND p_brand ILIKE '%Brand#1%' ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
def entity_search(spark, d):
    e = _t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lit("part").alias("type"), F.col("p_name").alias("canonical_name"), F.col("p_brand").alias("scope"), F.col("p_retailprice").alias("confidence"))
    return store.search(e, "A", "part", "brand#1", limit=20).select("id", "canonical_name")


@query("SELECT p_partkey AS id, p_name AS canonical_name FROM part WHERE p_name ILIKE '%widget%' OR p_brand ILIKE '%widget%' OR p_type ILIKE '%widget%' ORDER BY p_retailprice DESC, p_partkey LIMIT 100")
def entity_search_indexed(spark, d):
    """Parts that hold a word in name or attribute, by an index of trigrams that is written first."""
    e = _t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("canonical_name"), F.create_map(F.lit("x"), F.col("p_brand"), F.lit("y"), F.col("p_type")).alias("attributes"), F.col("p_retailprice").alias("confidence"))
    path = scratch.new_path(spark, "grams")
    text_index.save(text_index.postings(text_index.entity_texts(e)), path)
    return text_index.search(spark, e, path, "WIDGET").select("id", "canonical_name")


@query(r"""WITH w AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: length(w) > 3)) AS term FROM conversations WHERE role = 'user' AND turn = 0)
SELECT term, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM w JOIN documents ON contains(lower(text), term) GROUP BY term""")
def terms_in_documents(spark, d):
    """Every word that a conversation opens with, and the documents that contain it."""
    q = _t(spark, d, "conversations").where("role = 'user' and turn = 0").select(F.explode(F.filter(F.split(F.lower("text"), r"(?U)\s+"), lambda w: F.length(w) > 3)).alias("term"))
    texts = _docs(spark, d).select("id", F.array(F.lower("text")).alias("texts"))
    return text_index.containing(texts, q).groupBy("term").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("""SELECT id, c_name AS canonical_name, fresh FROM (SELECT c_custkey AS id, c_name, false AS fresh FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)
UNION ALL SELECT s_suppkey AS id, s_name, true FROM supplier)""")
def entity_upsert(spark, d):
    old = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("canonical_name"), F.lit(False).alias("fresh"))
    new = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("canonical_name"), F.lit(True).alias("fresh"), F.col("s_suppkey").alias("ord"))
    twice = new.withColumn("ord", F.col("ord") - 1).withColumn("canonical_name", F.lit("older")).unionByName(new)
    return store.upsert(old, twice)


@query("""WITH gone AS (SELECT c_custkey AS id FROM customer WHERE c_nationkey = 3)
SELECT 'entity' AS kind, c_custkey AS id FROM customer WHERE c_nationkey <> 3
UNION ALL SELECT 'relation', o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT id FROM gone) AND o_orderkey % 97 NOT IN (SELECT id FROM gone)""")
def entity_delete_cascade(spark, d):
    e, r = store.delete_by_source(_customers(spark, d), _orders(spark, d), 3)
    return e.select(F.lit("entity").alias("kind"), "id").unionByName(r.select(F.lit("relation").alias("kind"), "id"))


for _direction, _cond in (("outgoing", "o_custkey = 7"), ("incoming", "o_orderkey % 97 = 7"), ("both", "o_custkey = 7 OR o_orderkey % 97 = 7")):

    def _relations(spark, d, _direction=_direction):
        return store.relations_of(_orders(spark, d), 7, _direction).select("id", "source_entity_id", "target_entity_id")

    QUERIES[f"relations_{_direction}"] = _relations
    ORACLES[f"relations_{_direction}"] = f"SELECT o_orderkey AS id, o_custkey AS source_entity_id, o_orderkey % 97 AS target_entity_id FROM orders WHERE {_cond}"


@query("""WITH s AS (SELECT DISTINCT c_mktsegment AS scope FROM customer)
SELECT c_custkey AS source_entity_id, sha256(concat('scope:', c_mktsegment))[1:16] AS target_entity_id, concat(c_name, ' in ', c_mktsegment) AS evidence FROM customer JOIN s ON s.scope = c_mktsegment WHERE c_mktsegment <> ''""")
def relations_belongs_to(spark, d):
    edges, _ = store.scope_relations(_customers(spark, d).withColumn("id", F.col("id").cast("string")))
    return edges.select(F.col("source_entity_id").cast("long").alias("source_entity_id"), "target_entity_id", "evidence")


@query("""SELECT 'entity' AS kind, NULL AS type, NULL AS scope, count(*) AS n FROM customer UNION ALL SELECT 'entity', 'customer', NULL, count(*) FROM customer
UNION ALL SELECT 'entity', NULL, c_mktsegment, count(*) FROM customer WHERE c_mktsegment <> '' GROUP BY c_mktsegment
UNION ALL SELECT 'relation', NULL, NULL, count(*) FROM orders UNION ALL SELECT 'relation', 'ordered', NULL, count(*) FROM orders""")
def store_stats(spark, d):
    return store.stats(_customers(spark, d), _orders(spark, d))


@query("SELECT type, canonical_name, source FROM (SELECT 'nation' AS type, n_name AS canonical_name, 'table' AS source FROM nation UNION ALL SELECT 'region', r_name, 'text' FROM region)")
def union_entities(spark, d):
    a = _t(spark, d, "nation").select(F.lit("nation").alias("type"), F.col("n_name").alias("canonical_name"), F.lit("table").alias("source"))
    return a.unionByName(_t(spark, d, "region").select(F.lit("region").alias("type"), F.col("r_name").alias("canonical_name"), F.lit("text").alias("source")))


@query("SELECT c_nationkey AS id, array_to_string(list_sort(list_distinct(list(c_mktsegment))), ',') AS aliases FROM customer GROUP BY c_nationkey")
def distinct_aliases(spark, d):
    return _t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ",").alias("aliases"))


# --- windows, tables, trees

@query("""SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN concat('S', event_id) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS scope FROM events""")
def scope_ffill(spark, d):
    by = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return _t(spark, d, "events").select("event_id", F.last(F.when(F.col("event_type") == "signup", F.concat(F.lit("S"), F.col("event_id").cast("string"))), True).over(by).alias("scope"))


@query("""WITH p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, value > 50 AS flag FROM events),
i AS (SELECT *, pos - row_number() OVER (PARTITION BY user_id, flag ORDER BY pos) AS isle FROM p)
SELECT user_id, min(pos) AS first, max(pos) + 1 AS after FROM i WHERE flag GROUP BY user_id, isle HAVING count(*) >= 2""")
def table_regions(spark, d):
    e = _t(spark, d, "events").withColumn("pos", (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long")).withColumn("flag", F.col("value") > 50)
    return tables.regions(e, ["user_id"], "flag", "pos", 2)


# Orders as printed pages: a title, headers on two orders of three, a row for each line. Cells of a line lie up to ten points lower than its begin, some are missing, some lines have a
# code that is none or a name that is refused, and notes between the lines end a table.
CELLS = r"""line AS (SELECT l_orderkey AS doc_id, CASE WHEN l_linenumber > 4 THEN 1 ELSE 0 END AS page, 40.0 + 20 * l_linenumber AS y, * FROM lineitem JOIN part ON p_partkey = l_partkey),
cells AS (SELECT doc_id, page, text, CAST(x AS DOUBLE) AS x0, CAST(y AS DOUBLE) AS y0, CAST(x + 30 AS DOUBLE) AS x1, CAST(y + 10 AS DOUBLE) AS y1 FROM (
SELECT o_orderkey AS doc_id, 0 AS page, CONCAT(' Order ', o_orderkey, ' ') AS text, 10 AS x, 0 AS y FROM orders
UNION ALL SELECT o_orderkey, 0, CASE WHEN o_orderkey % 3 = 1 THEN 'Course  Code' ELSE 'Subject No' END, 10, 40 FROM orders WHERE o_orderkey % 3 <> 0
UNION ALL SELECT o_orderkey, 0, CASE WHEN o_orderkey % 3 = 1 THEN 'Course Title' ELSE 'Remark' END, 100, 41 FROM orders WHERE o_orderkey % 3 <> 0
UNION ALL SELECT o_orderkey, 0, 'Credits', 300, 43 FROM orders WHERE o_orderkey % 3 <> 0
UNION ALL SELECT o_orderkey, 0, CASE WHEN o_orderkey % 2 = 1 THEN 'Hours' ELSE 'Credits' END, 360, 46 FROM orders WHERE o_orderkey % 3 <> 0
UNION ALL SELECT o_orderkey, 0, CASE WHEN o_orderkey % 5 = 1 THEN 'Pre-req, prereq of it' ELSE 'Category' END, 420, 40 FROM orders WHERE o_orderkey % 3 <> 0
UNION ALL SELECT doc_id, page, CASE WHEN l_returnflag = 'R' THEN CONCAT('No. ', l_partkey) ELSE CONCAT('P', LPAD(CAST(l_partkey AS VARCHAR(20)), 6, '0')) END, 10, y FROM line WHERE l_partkey % 17 <> 0
UNION ALL SELECT doc_id, page, CASE WHEN l_partkey % 11 = 0 THEN 'HS 3 0 2 0' WHEN l_partkey % 11 = 1 THEN '3 0 2 0' WHEN l_partkey % 11 = 2 THEN '' ELSE p_name END, 100 + l_suppkey % 9, y + l_partkey % 4 FROM line WHERE l_partkey % 13 <> 0
UNION ALL SELECT doc_id, page, CAST(CAST(l_quantity AS INT) AS VARCHAR(20)), 300 + l_suppkey % 15, y + l_suppkey % 11 FROM line WHERE l_partkey % 4 <> 0 OR l_linestatus = 'O'
UNION ALL SELECT doc_id, page, CAST(l_linenumber AS VARCHAR(20)), 360, y + 2 FROM line WHERE l_partkey % 7 <> 0
UNION ALL SELECT doc_id, page, p_type, 420, y + 1 FROM line WHERE l_partkey % 3 <> 0
UNION ALL SELECT doc_id, page, CONCAT('a note on line ', l_linenumber), 10, y + 11 FROM line WHERE l_linenumber = 3 AND l_partkey % 2 = 0))"""


def _cells(spark, d):
    """CELLS: the cells of a line, and those of an order's head, are made together, so that each table is read and joined once."""

    def cell(when, text, x, y):
        put = F.struct(text.cast("string").alias("text"), *(v.cast("double").alias(n) for n, v in (("x0", x), ("y0", y), ("x1", x + 30), ("y1", y + 10))))
        return F.when(when, put)

    def of(rows, *cells):
        return rows.select("doc_id", "page", F.explode_outer(F.array(*cells)).alias("c")).where("c is not null").select("doc_id", "page", "c.*")

    c, n = F.col, F.lit
    part = _t(spark, d, "part").select(c("p_partkey").alias("l_partkey"), "p_name", "p_type")
    line = _t(spark, d, "lineitem").join(part, "l_partkey").withColumns({"doc_id": c("l_orderkey"), "page": F.when(c("l_linenumber") > 4, 1).otherwise(0), "y": n(40) + n(20) * c("l_linenumber")})
    k, s, y, number = c("l_partkey"), c("l_suppkey"), c("y"), c("l_linenumber")
    digits = k.cast("string")
    code = F.when(c("l_returnflag") == "R", F.concat(n("No. "), digits)).otherwise(F.concat(n("P"), F.lpad(digits, 6, "0")))
    name = F.when(k % 11 == 0, "HS 3 0 2 0").when(k % 11 == 1, "3 0 2 0").when(k % 11 == 2, "").otherwise(c("p_name"))
    lines = of(
        line,
        cell(k % 17 != 0, code, n(10), y),
        cell(k % 13 != 0, name, 100 + s % 9, y + k % 4),
        cell((k % 4 != 0) | (c("l_linestatus") == "O"), c("l_quantity").cast("int"), 300 + s % 15, y + s % 11),
        cell(k % 7 != 0, number, n(360), y + 2),
        cell(k % 3 != 0, c("p_type"), n(420), y + 1),
        cell((number == 3) & (k % 2 == 0), F.concat(n("a note on line "), number.cast("string")), n(10), y + 11),
    )
    o = c("o_orderkey")
    head, either = o % 3 != 0, lambda m, a, b: F.when(o % m == 1, a).otherwise(b)
    heads = of(
        _t(spark, d, "orders").select("o_orderkey", o.alias("doc_id"), n(0).alias("page")),
        cell(n(True), F.concat(n(" Order "), o.cast("string"), n(" ")), n(10), n(0)),
        cell(head, either(3, "Course  Code", "Subject No"), n(10), n(40)),
        cell(head, either(3, "Course Title", "Remark"), n(100), n(41)),
        cell(head, n("Credits"), n(300), n(43)),
        cell(head, either(2, "Hours", "Credits"), n(360), n(46)),
        cell(head, either(5, "Pre-req, prereq of it", "Category"), n(420), n(40)),
    )
    return heads.unionByName(lines)


def _regex(c: str, patterns, options: str = "i") -> str:
    return "(" + " OR ".join(f"regexp_matches({c}, '{p}', '{options}')" for p in patterns) + ")"


TC = TableConfig()
LINED = f"""WITH {CELLS},
clean AS (SELECT * REPLACE (regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text) FROM cells),
piled AS (SELECT doc_id, page, list({{'y0': y0, 'x0': x0, 'x1': x1, 'y1': y1, 'text': text, 'anchor': (y0 + y1) / 2, 'row_index': 0}} ORDER BY y0, x0, x1, y1, text) AS cs FROM clean WHERE text <> '' GROUP BY doc_id, page),
folded AS (SELECT doc_id, page, unnest(list_reduce(list_transform(cs, lambda c: [c]), lambda s, c: list_append(s, CASE WHEN abs(c[1].anchor - s[-1].anchor) > {TC.row_tolerance}
  THEN struct_update(c[1], row_index := s[-1].row_index + 1) ELSE struct_update(c[1], anchor := s[-1].anchor, row_index := s[-1].row_index) END))) AS c FROM piled),
rows_ AS (SELECT doc_id, page, c.* FROM folded),
lined AS (SELECT doc_id, page, row_index, list(text ORDER BY x0, y0, text) AS texts FROM rows_ GROUP BY ALL),
flagged AS (SELECT *, len(texts) >= {TC.min_columns} AND ({_regex("array_to_string(texts, ' ')", TC.indicators)} OR len(list_filter(texts, lambda t: regexp_matches(t, '{TC.code}'))) > 0 OR len(list_filter(texts, lambda t: regexp_matches(t, '^\\d+$'))) >= 2) AS flag FROM lined),
isles AS (SELECT *, row_index - row_number() OVER (PARTITION BY doc_id, page, flag ORDER BY row_index) AS isle FROM flagged),
areas AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, page ORDER BY first) - 1)::INT AS table_index FROM (SELECT doc_id, page, min(row_index) AS first, max(row_index) AS last FROM isles WHERE flag GROUP BY doc_id, page, isle HAVING count(*) >= {TC.min_rows})),
inside AS (SELECT r.*, table_index, first FROM rows_ r JOIN areas a ON r.doc_id = a.doc_id AND r.page = a.page AND row_index BETWEEN first AND last),
bounded AS (SELECT * FROM (SELECT doc_id, page, table_index, list_reduce(list_transform(list(x0 ORDER BY x0), lambda x: [x]), lambda b, x: CASE WHEN x[1] - b[-1] > {TC.column_gap} THEN list_concat(b, x) ELSE b END) AS bounds FROM inside GROUP BY ALL) WHERE len(bounds) >= {TC.min_columns}),
placed AS (SELECT i.*, bounds, greatest(len(list_filter(bounds, lambda b: x0 >= b - {TC.column_slack})) - 1, 0)::INT AS col FROM inside i JOIN bounded USING (doc_id, page, table_index)),
vals AS (SELECT doc_id, page, table_index, first, row_index, bounds, col, string_agg(text, ' ' ORDER BY x0, y0, text) AS value FROM placed GROUP BY ALL),
maps AS (SELECT doc_id, page, table_index, first, row_index, bounds, map_from_entries(list((col, value))) AS m FROM vals GROUP BY ALL),
heads AS (SELECT doc_id, page, table_index, list_transform(range(len(bounds)), lambda i: CASE WHEN {_regex("array_to_string(texts, ' ')", TC.headers)} AND m[i::INT] IS NOT NULL THEN trim(regexp_replace(m[i::INT], '\\s+', ' ', 'g')) ELSE 'Column_' || i END) AS headers
  FROM maps JOIN lined USING (doc_id, page, row_index) WHERE row_index = first),
body AS (SELECT doc_id, page, table_index, row_index, list_transform(list_filter(headers, lambda h, i: list_position(headers, h) = i), lambda h: {{'header': h, 'value':
  coalesce(m[(list_filter(range(len(headers)), lambda j: headers[j + 1] = h)[-1])::INT], '')}}) AS cells FROM maps JOIN heads USING (doc_id, page, table_index) WHERE row_index > first OR headers[1] = 'Column_0')
"""

HAS = lambda *parts: "(" + " OR ".join(f"contains(lower(c.header), '{p}')" for p in parts) + ")"
IS_CODE = f"regexp_matches(c.value, '{TC.code}')"
KEYED = "regexp_replace(regexp_replace(lower(c.header), '\\s+', '_', 'g'), '^_+|_+$', '', 'g')"
ENTITIES = f""",
told AS (SELECT *, row_number() OVER () AS rid, list_reduce(list_prepend({{'header': '', 'value': '', 'code': NULL::VARCHAR, 'name': NULL::VARCHAR}}, list_transform(cells, lambda c: {{'header': c.header, 'value': c.value, 'code': NULL::VARCHAR, 'name': NULL::VARCHAR}})),
  lambda s, c: {{'header': '', 'value': '', 'code': CASE WHEN c.value = '' THEN s.code WHEN {IS_CODE} THEN c.value WHEN {HAS('code')} AND s.code IS NULL THEN c.value ELSE s.code END,
    'name': CASE WHEN c.value = '' OR {IS_CODE} OR ({HAS('code')} AND s.code IS NULL) THEN s.name WHEN {HAS('title', 'name', 'subject', 'course')} THEN c.value ELSE s.name END}}) AS f FROM body),
pools AS (SELECT *, list_filter(cells, lambda c: length(c.value) > 5 AND c.value <> f.code AND NOT {_regex('c.value', rows_of_tables.NOT_A_CANDIDATE, 'c')}) AS pool FROM told WHERE f.code IS NOT NULL),
longest AS (SELECT *, list_filter(pool, lambda c: regexp_matches(c.value, '[a-z]') OR length(c.value) > 15) AS good FROM pools),
called AS (SELECT *, trim(regexp_replace(coalesce(f.name, list_reduce(list_transform(CASE WHEN len(good) > 0 THEN good ELSE pool END, lambda c: c.value), lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END, '')), '\\s+', ' ', 'g')) AS raw_name FROM longest),
entities AS (SELECT *, coalesce(nullif(raw_name, ''), f.code) AS canonical_name FROM called WHERE raw_name = '' OR NOT ({_regex('raw_name', rows_of_tables.NOT_A_NAME, 'c')} OR length(raw_name) < 3)),
entries AS (SELECT rid, unnest(list_transform(range(len(cells)), lambda i: {{'i': i, 'c': cells[i + 1]}}), recursive := false) AS e, canonical_name, f.code AS code FROM entities),
used AS (SELECT rid, e.i AS i, {KEYED.replace('c.header', 'e.c.header')} AS key, e.c.value AS value FROM entries WHERE e.c.value <> '' AND e.c.value <> code AND e.c.value <> canonical_name),
renamed AS (SELECT rid, i, value, CASE WHEN contains(key, 'credit') AND regexp_matches(value, '^\\d+$') THEN 'credits' WHEN contains(key, 'hour') AND regexp_matches(value, '^\\d+$') THEN 'hours' WHEN contains(key, 'prereq') THEN 'prerequisites' WHEN contains(key, 'cat') THEN 'category' ELSE key END AS key FROM used WHERE NOT starts_with(key, 'column_')),
attributes AS (SELECT rid, string_agg(key || '=' || value, ';' ORDER BY key) AS attributes FROM (SELECT rid, key, arg_max(value, i) AS value FROM (SELECT * FROM renamed UNION ALL SELECT rid, -1, f.code, 'code' FROM entities) GROUP BY rid, key) GROUP BY rid)
SELECT doc_id, page, table_index, canonical_name, f.code AS code, attributes FROM entities JOIN attributes USING (rid)"""


@query(LINED + "SELECT doc_id, page, text, x0, y0, row_index FROM rows_")
def row_groups(spark, d):
    return tables.grouped_rows(_cells(spark, d).withColumn("text", F.trim("text")).where("text <> ''")).select("doc_id", "page", "text", "x0", "y0", "row_index")


@query(f"""WITH {CELLS}, b AS (SELECT doc_id, page, list_reduce(list_transform(list(x0 ORDER BY x0), lambda x: [x]), lambda b, x: CASE WHEN x[1] - b[-1] > 20 THEN list_concat(b, x) ELSE b END) AS bounds FROM cells GROUP BY ALL)
SELECT doc_id, page, text, x0, y0, greatest(len(list_filter(bounds, lambda b: x0 >= b - 10)) - 1, 0)::INT AS col FROM cells JOIN b USING (doc_id, page)""")
def column_assign(spark, d):
    pages = _cells(spark, d).groupBy("doc_id", "page").agg(F.collect_list(F.struct("text", "x0", "y0")).alias("cells"))
    bounded = pages.withColumn("bounds", tables.boundaries(F.col("cells.x0"), 20.0))
    return bounded.select("doc_id", "page", "bounds", F.inline("cells")).select("doc_id", "page", "text", "x0", "y0", tables.column_of(F.col("x0"), F.col("bounds"), 10.0).alias("col"))


@query(r"""SELECT doc_id, count(*) AS n, sum(length(t)) AS chars, sha256(string_agg(t, '|')) AS digest FROM (SELECT page_id AS doc_id, regexp_replace(
replace(replace(replace(replace(replace(replace(regexp_replace(t, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&'), '^\s+|\s+$', '', 'g') AS t
FROM (SELECT page_id, unnest(regexp_extract_all(html, '<title>(.*?)</title>', 1)) AS t FROM pages)) WHERE t <> '' GROUP BY doc_id""")
def html_titles(spark, d):
    e = readers.html_elements(_t(spark, d, "pages").select(F.col("page_id").alias("doc_id"), "html")).where("pos = 0 AND category = 'Title'")
    return e.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.sha2(F.array_join(F.collect_list("text"), "|"), 256).alias("digest"))


@query()
def html_elements(spark, d):
    return readers.without_categories(readers.html_elements(_t(spark, d, "pages").select(F.col("page_id").alias("doc_id"), "html")))


TREE = """SELECT concat('r', r_regionkey) AS id, NULL AS parent FROM region UNION ALL SELECT concat('n', n_nationkey), concat('r', n_regionkey) FROM nation UNION ALL SELECT concat('c', c_custkey), concat('n', c_nationkey) FROM customer"""


def _tree(spark, d):
    for name in ("region", "nation", "customer"):
        _t(spark, d, name).createOrReplaceTempView(f"tree_{name}__")
    sql = TREE
    for name in ("region", "nation", "customer"):
        sql = sql.replace(f"FROM {name}", f"FROM tree_{name}__")
    return spark.sql(sql.replace("NULL AS parent", "cast(NULL AS string) AS parent"))


@query(f"WITH RECURSIVE t AS ({TREE}), walk AS (SELECT id, 0 AS depth, id AS path FROM t WHERE parent IS NULL UNION ALL SELECT t.id, depth + 1, concat(path, '/', t.id) FROM t JOIN walk ON t.parent = walk.id) SELECT id, depth, path FROM walk")
def tree_depth(spark, d):
    return tree.depths(_tree(spark, d))


@query(f"""WITH RECURSIVE t AS (SELECT id, parent, substring(id, 2)::BIGINT AS pos FROM ({TREE})),
walk AS (SELECT id, id AS root, 0 AS depth, []::BIGINT[] AS path FROM t WHERE parent IS NULL UNION ALL SELECT t.id, root, depth + 1, list_append(path, t.pos) FROM t JOIN walk ON t.parent = walk.id),
sizes AS (SELECT a.id, count(*) AS size FROM walk a JOIN walk b ON a.root = b.root AND len(b.path) >= len(a.path) AND b.path[1:len(a.path)] = a.path GROUP BY a.id)
SELECT id, root, row_number() OVER (PARTITION BY root ORDER BY path) - 1 AS place, depth::BIGINT AS depth, size FROM walk JOIN sizes USING (id)""")
def tree_preorder(spark, d):
    return tree.preorder(_tree(spark, d).withColumn("pos", F.expr("cast(substring(id, 2) as long)")))


LEVELS = "SELECT conv_id AS doc_id, turn AS pos, role = 'user' AS header, turn % 3 + 1 AS level FROM conversations"


@query(f"""WITH n AS ({LEVELS}) SELECT doc_id, pos, (SELECT max(p.pos) FROM n p WHERE p.doc_id = n.doc_id AND p.pos < n.pos AND p.header AND (NOT n.header OR p.level < n.level)) AS parent FROM n""")
def tree_parent(spark, d):
    n = _t(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), (F.col("role") == "user").alias("header"), (F.col("turn") % 3 + 1).alias("level"))
    return tree.parents(n).select("doc_id", "pos", "parent")


@query("""SELECT conv_id AS doc_id, count(*) AS nodes, count(*) FILTER (role = 'user') AS sections, count(*) FILTER (role <> 'user') AS paragraphs,
(sum(length(text)) + greatest(count(*) FILTER (text <> '') - 1, 0))::BIGINT AS chars FROM conversations GROUP BY conv_id""")
def tree_stats(spark, d):
    return tree.stats(_t(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.when(F.col("role") == "user", "section").otherwise("paragraph").alias("type"), "text"))


@query("SELECT conv_id AS doc_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations WHERE text <> '' GROUP BY conv_id")
def tree_text(spark, d):
    return tree.text(_t(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), "text"))


@query("SELECT conv_id AS doc_id, max(turn // 4) AS pages, count(*) AS elements FROM conversations GROUP BY conv_id")
def tree_extent(spark, d):
    return tree.extent(_layout(spark, d))


@query(f"""WITH n AS ({LEVELS}) SELECT doc_id, pos, (SELECT max(p.pos) FROM n p WHERE p.doc_id = n.doc_id AND p.pos < n.pos AND p.level = n.level - 1) AS parent FROM n""")
def tree_insert(spark, d):
    n = _t(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), (F.col("turn") % 3 + 1).alias("level"))
    return tree.deepest_first(n).select("doc_id", "pos", "parent")


# --- retrieval

def _ranked(spark, d):
    return _t(spark, d, "documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("rank"), "text")


@query("SELECT query_id, rank FROM (SELECT source AS query_id, doc_id AS rank, sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id) AS used FROM documents) WHERE used <= 8000")
def context_budget(spark, d):
    return retrieval.within_budget(_ranked(spark, d), 8000).select("query_id", "rank")


@query("""WITH u AS (SELECT source AS query_id, doc_id AS rank, text, sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id) AS used FROM documents),
o AS (SELECT *, sum((used > 8000)::INT) OVER (PARTITION BY query_id ORDER BY rank) AS over FROM u)
SELECT query_id, rank, CASE WHEN over = 1 THEN concat(substring(text, 1, (8000 - (used - length(text)))::BIGINT), '...') ELSE text END AS text FROM o WHERE over = 0 OR over = 1 AND 8000 - (used - length(text)) > 100""")
def context_truncate(spark, d):
    return retrieval.within_budget(_ranked(spark, d), 8000, truncate=True).select("query_id", "rank", "text")


STOPS = ", ".join(f"'{w}'" for w in RetrievalConfig().stop_words)
TERMS = f"list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: length(w) > 3 AND w NOT IN ({STOPS}))[1:3]"


@query(f"SELECT conv_id, turn, array_to_string({TERMS}, ' ') AS terms, " + " OR ".join(f"contains(lower(text), '{w}')" for w in RetrievalConfig().listing_words) + " AS listing FROM conversations WHERE role = 'user'")
def query_terms(spark, d):
    q = _t(spark, d, "conversations").where("role = 'user'")
    return q.select("conv_id", "turn", F.array_join(retrieval.query_terms(F.col("text")), " ").alias("terms"), retrieval.is_listing(F.col("text")).alias("listing"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN concat('No context was found.', chr(10), chr(10), 'Question: ', text) ELSE concat('Context:', chr(10), role, chr(10), chr(10), 'Question: ', text) END AS prompt FROM conversations")
def rag_prompt(spark, d):
    q = _t(spark, d, "conversations")
    return q.select("conv_id", "turn", retrieval.prompt(F.when(F.col("turn") % 2 == 1, F.col("role")), F.col("text")).alias("prompt"))


@query("SELECT source AS source_id, count(*) AS n FROM documents GROUP BY source")
def stream_ingest(spark, d):
    """Streams the documents into a table partitioned by source, then counts what stands there."""
    base = scratch.new_path(spark, "stream")
    schema = _t(spark, d, "documents").schema
    # as a pattern, so that a table of one file will do as well as a folder of many
    made = ingest.ingest(spark, f"{d}/documents.parque[t]", schema, f"{base}/table", f"{base}/log", lambda s: s.select("doc_id", "text", F.col("source").alias("source_id")))
    return made.groupBy("source_id").agg(F.count("*").alias("n"))


# --- tables to entities, embeddings

@query(LINED + ENTITIES)
def table_entities(spark, d):
    found = rows_of_tables.tables_to_entities(tables.extract(_cells(spark, d)))
    listed = F.array_join(F.sort_array(F.transform(F.map_entries("attributes"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return found.select("doc_id", "page", "table_index", "canonical_name", F.col("attributes")["code"].alias("code"), listed.alias("attributes"))


@query(LINED + """, listed AS (SELECT doc_id, page, table_index, string_agg(line, '/' ORDER BY row_index) AS rows, count(*) AS n_rows FROM (SELECT doc_id, page, table_index, row_index, array_to_string(list_transform(cells, lambda c: c.value), '|') AS line FROM body) GROUP BY ALL),
boxes AS (SELECT doc_id, page, table_index, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM inside GROUP BY ALL),
raws AS (SELECT doc_id, page, table_index, string_agg(array_to_string(texts, ' | '), chr(10) ORDER BY row_index) AS raw_text FROM lined JOIN (SELECT DISTINCT doc_id, page, table_index, row_index FROM inside) USING (doc_id, page, row_index) GROUP BY ALL)
SELECT doc_id, page, table_index, array_to_string(headers, '|') AS headers, coalesce(n_rows, 0) AS n_rows, coalesce(rows, '') AS rows, x0, y0, x1, y1, raw_text FROM heads LEFT JOIN listed USING (doc_id, page, table_index) JOIN boxes USING (doc_id, page, table_index) JOIN raws USING (doc_id, page, table_index)""")
def table_extract(spark, d):
    found = tables.extract(_cells(spark, d))
    lines = F.array_join(F.transform("rows", lambda row: F.array_join(F.transform(row, lambda c: c["value"]), "|")), "/")
    return found.select("doc_id", "page", "table_index", F.array_join("headers", "|").alias("headers"), F.size("rows").cast("long").alias("n_rows"), lines.alias("rows"), "bbox.*", "raw_text")


@query("SELECT doc_id AS id, 1.0::DOUBLE AS norm, 384::BIGINT AS dimension FROM documents")
def embed_documents(spark, d):
    e = embedding.embedded(_docs(spark, d).select("id", "text"))
    return e.select("id", F.round(F.sqrt(vector.dot(F.col("embedding"), F.col("embedding"))), 4).alias("norm"), F.size("embedding").cast("long").alias("dimension"))


# --- layout, collections

def _either(patterns, flags="(?i)"):
    return "(" + " OR ".join(f"regexp_matches(text, '{flags}{p}')" for p in patterns) + ")"


LAYOUT = """SELECT conv_id AS doc_id, turn AS pos, turn // 4 AS page, CASE turn % 6 WHEN 0 THEN concat('Semester ', turn + 1) WHEN 1 THEN concat(' ', turn + 1, '. Aims ') WHEN 2 THEN concat(turn, '.1 Topics')
WHEN 3 THEN concat('Page ', turn) ELSE text END AS text, 10.0::DOUBLE + turn % 8 AS font_size, turn % 5 = 0 AS bold FROM conversations"""
NODES_SQL = f"""WITH raw AS ({LAYOUT}), e AS (SELECT * REPLACE (regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text) FROM raw),
h AS (SELECT *, {_either(LAYOUT_SECTIONS)} OR (font_size > 14 AND length(text) < 100 AND regexp_matches(text, '^\\p{{Lu}}') AND NOT ends_with(text, '.'))
  OR (bold AND length(text) < 80 AND upper(text) = text AND lower(text) <> text) AS header,
  coalesce({", ".join(f"nullif(trim(regexp_extract(text, '(?i){p}', 0)), '')" for p in LAYOUT_SCOPES)}) AS own FROM e WHERE text <> '' AND NOT {_either(LAYOUT_EXCLUDED)}),
l AS (SELECT *, CASE WHEN NOT header THEN NULL {" ".join(f"WHEN regexp_matches(text, '{p}') THEN {n}" for p, n in LAYOUT_LEVELS)} WHEN font_size >= 16 THEN 1 WHEN font_size >= 14 THEN 2 ELSE 3 END AS lv FROM h)
SELECT doc_id, pos, page, CASE WHEN header THEN 'section' ELSE 'paragraph' END AS type, text,
  coalesce(lv, (SELECT arg_max(p.lv, p.pos) FROM l p WHERE p.doc_id = l.doc_id AND p.pos < l.pos AND p.header) + 1, 1)::INT AS level,
  coalesce((SELECT arg_max(p.own, p.pos) FROM l p WHERE p.doc_id = l.doc_id AND p.pos <= l.pos AND p.own IS NOT NULL), '') AS scope,
  (SELECT max(p.pos) FROM l p WHERE p.doc_id = l.doc_id AND p.pos < l.pos AND p.header AND (NOT l.header OR p.lv < l.lv)) AS parent FROM l"""


def _layout(spark, d):
    t = F.col("turn")
    text = F.when(t % 6 == 0, F.concat(F.lit("Semester "), t + 1)).when(t % 6 == 1, F.concat(F.lit(" "), t + 1, F.lit(". Aims "))).when(t % 6 == 2, F.concat(t, F.lit(".1 Topics"))).when(t % 6 == 3, F.concat(F.lit("Page "), t)).otherwise(F.col("text"))
    return _t(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), t.alias("pos"), F.floor(t / 4).alias("page"), text.alias("text"), (F.lit(10.0) + t % 8).alias("font_size"), (t % 5 == 0).alias("bold"))


@query(NODES_SQL)
def layout_nodes(spark, d):
    return layout.nodes(_layout(spark, d))


@query(f"""SELECT doc_id, page, min(scope) FILTER (rn = 1) AS scope FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY scope = '' OR type <> 'section', pos) AS rn
FROM (SELECT doc_id, pos, page, type, CASE WHEN type = 'section' THEN scope ELSE '' END AS scope FROM ({NODES_SQL}))) GROUP BY doc_id, page""")
def table_scopes(spark, d):
    found = layout.nodes(_layout(spark, d))
    return layout.table_scopes(found.where("type = 'section'"), found.select("doc_id", "page").distinct())


@query("""SELECT lang AS source_id, count(*) AS n, sum(doc_id)::BIGINT AS ids, count(*) FILTER (text = 'new') AS changed FROM
(SELECT lang, doc_id, CASE WHEN doc_id % 10 = 0 THEN 'new' ELSE 'old' END AS text FROM documents JOIN embeddings ON vec_id = doc_id WHERE lang <> 'de') GROUP BY lang""")
def collection_upsert(spark, d):
    """Writes all points twice, the second time a tenth of them changed, and deletes a source."""
    base = scratch.new_path(spark, "collections")
    points = _docs(spark, d).join(_points(spark, d).select("id", "embedding"), "id").select("id", F.col("language").alias("source_id"), F.lit("old").alias("text"), "embedding")
    store_ = Collections(spark, base)
    store_.create("documents", points.schema, len(_vector(spark, d)))
    store_.replace_sources("documents", points)
    store_.upsert("documents", points.where("id % 10 = 0").withColumn("text", F.lit("new")))
    store_.delete_source("documents", "de")
    return store_.read("documents").groupBy("source_id").agg(F.count("*").alias("n"), F.sum("id").alias("ids"), F.count_if(F.col("text") == "new").alias("changed"))


# --- stored rows, facts, entities and chunks for a question

@query("SELECT c_custkey AS id, c_name AS canonical_name FROM customer WHERE c_custkey = 7")
def entity_get(spark, d):
    return store.get(_customers(spark, d), 7).select("id", "canonical_name")


@query("""SELECT id, type, source_entity_id, target_entity_id FROM (SELECT o_orderkey AS id, 'ordered' AS type, o_custkey AS source_entity_id, o_orderkey % 97 AS target_entity_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT l_orderkey, 'holds', l_orderkey, arg_max(l_partkey, l_linenumber) FROM lineitem GROUP BY l_orderkey)""")
def relation_upsert(spark, d):
    """Of an order's lines the last one counts, of several last ones the first in the table. Lines without a number or a part don't count; an order with no others has no part."""
    part, number = F.col("l_partkey"), F.col("l_linenumber")
    new = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.lit("holds").alias("type"), F.col("l_orderkey").alias("source_entity_id"), F.when(number.isNotNull(), part).alias("target_entity_id"), F.when(part.isNotNull(), number).alias("ord"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("line"))
    return store.upsert(_orders(spark, d), new, ties=("file", "line"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 2 END AS aliases, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_brand END AS brand, p_size % 5 AS page, CASE WHEN p_partkey % 2 = 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS confidence, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 2024 END AS year FROM part""")
def store_decode(spark, d):
    """Parts as stored rows, read back: lists, maps and times as text, nulls and zeros for nothing."""
    k = F.col("p_partkey")
    rows = _t(spark, d, "part").select(k.alias("id"), F.when(k % 3 != 0, F.array("p_name", "p_type")).alias("aliases"), F.when(k % 4 != 0, F.create_map(F.lit("brand"), F.col("p_brand"))).alias("attributes"), F.nullif(F.col("p_size") % 5, F.lit(0)).alias("page"), F.when(k % 2 == 0, 0.0).otherwise(0.5).alias("confidence"), F.when(k % 5 != 0, F.lit("2024-05-06T07:08:09.123456").cast("timestamp")).alias("created_at"))
    out = store.decoded(store.encoded(rows))
    return out.select("id", F.size("aliases").alias("aliases"), F.col("attributes")["brand"].alias("brand"), "page", "confidence", F.year("created_at").alias("year"))


@query("SELECT 'part' AS entity_type, p_name AS name, p_brand AS brand, CAST(p_size AS VARCHAR) AS source_id FROM part WHERE p_name ILIKE '%ring%' ORDER BY p_retailprice DESC, p_partkey LIMIT 100")
def fact_search(spark, d):
    e = _t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lit("part").alias("type"), F.col("p_name").alias("canonical_name"), F.create_map(F.lit("brand"), F.col("p_brand")).alias("attributes"), F.col("p_size").cast("string").alias("source_id"), F.col("p_retailprice").alias("confidence"))
    return store.search_facts(e, entity_type="part", value="Ring").select("entity_type", "name", F.col("attributes")["brand"].alias("brand"), "source_id")


@query("SELECT count(*) AS chunks, min(length(text)) AS least, max(length(text)) AS greatest, sum(length(text))::BIGINT // count(*) AS mean FROM documents")
def chunk_sizes(spark, d):
    return chunking.size_stats(_docs(spark, d))


@query("SELECT page_id AS id, regexp_extract(rtrim(url, '/'), '([^/]*)$', 1) AS name, CASE WHEN length(html) > 50 THEN concat(substring(html, 1, 50), '...') ELSE html END AS preview FROM pages")
def page_previews(spark, d):
    return _t(spark, d, "pages").select(F.col("page_id").alias("id"), T.basename(F.col("url")).alias("name"), T.preview(F.col("html")).alias("preview"))


@query(LINED + """SELECT doc_id, page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, any_value(raw_text) AS raw_text FROM rows_
JOIN (SELECT doc_id, page, string_agg(array_to_string(texts, ' | '), chr(10) ORDER BY row_index) AS raw_text FROM lined GROUP BY ALL) USING (doc_id, page) GROUP BY ALL""")
def table_outlines(spark, d):
    return tables.outlines(tables.grouped_rows(_cells(spark, d).withColumn("text", F.trim("text")).where("text <> ''")), ["doc_id", "page"])


QUESTIONS = "SELECT vec_id AS query_id, embedding, CASE WHEN vec_id % 40 = 0 THEN concat('List semester ', vec_id % 50 + 1) ELSE concat('What is ', p_name) END AS query FROM embeddings LEFT JOIN part ON p_partkey = vec_id WHERE vec_id % 20 = 0"
PARTS = "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'course' ELSE 'part' END AS type, p_name AS canonical_name, concat('Semester ', p_size) AS scope, p_retailprice AS confidence, p_brand, p_type FROM part"
HITS_SQL = f"""q AS ({QUESTIONS}), e AS ({PARTS}),
asked AS (SELECT query_id, query, vec_id_list, {TERMS.replace("lower(text)", "lower(query)")} AS terms FROM (SELECT *, query LIKE 'List%' OR {" OR ".join(f"contains(lower(query), '{w}')" for w in RetrievalConfig().listing_words)} AS vec_id_list FROM q)),
listed AS (SELECT query_id, 0 AS term_place, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, id) AS place, e.* FROM asked JOIN e ON type = 'course' AND contains(lower(scope), coalesce(nullif(regexp_extract(lower(query), 'semester\\s*([ivxlcdm]+|\\d+)', 0), ''), '')) WHERE vec_id_list),
words AS (SELECT query_id, unnest(range(len(terms))) AS term_place, unnest(terms) AS term FROM asked WHERE NOT vec_id_list),
found AS (SELECT query_id, term_place, row_number() OVER (PARTITION BY query_id, term_place ORDER BY confidence DESC, id) AS place, e.* FROM words JOIN e ON contains(lower(canonical_name), term) OR contains('brand', term) OR contains('kind', term) OR contains('pattern', term) OR contains('x', term) OR contains(lower(p_brand), term) OR contains(lower(p_type), term)),
once AS (SELECT * FROM (SELECT * FROM listed WHERE place <= 20 UNION ALL SELECT * FROM found WHERE place <= 6) QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY term_place, place) = 1),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY term_place, place) AS rank FROM once QUALIFY rank <= 20),
blocks AS (SELECT query_id, concat('=== Extracted Entities ===', chr(10), string_agg(concat('\u2022 [', upper(type), '] ', canonical_name, ' (brand: ', p_brand, ', kind: ', p_type, ') [Scope: ', scope, ']'), chr(10) ORDER BY rank)) AS block, count(*) AS found FROM hits GROUP BY query_id)"""


def _questions(spark, d):
    both = _points(spark, d).where("id % 20 = 0").join(_t(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_name").hint("merge"), "id", "left")
    return both.select(F.col("id").alias("query_id"), "embedding", F.when(F.col("id") % 40 == 0, F.concat(F.lit("List semester "), (F.col("id") % 50 + 1).cast("string"))).otherwise(F.concat(F.lit("What is "), "p_name")).alias("query"))


def _parts(spark, d):
    attributes = F.create_map(F.lit("pattern"), F.lit("x"), F.lit("brand"), F.col("p_brand"), F.lit("kind"), F.col("p_type"))
    return _t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 2 == 0, "course").otherwise("part").alias("type"), F.col("p_name").alias("canonical_name"), F.concat(F.lit("Semester "), F.col("p_size").cast("string")).alias("scope"), F.col("p_retailprice").alias("confidence"), attributes.alias("attributes"))


@query(f"WITH {HITS_SQL} SELECT query_id, block, found FROM blocks")
def entity_context(spark, d):
    return retrieval.entity_context(_questions(spark, d).select("query_id", "query"), _parts(spark, d))


@query(f"""WITH {HITS_SQL},
scored AS (SELECT query_id, e.vec_id AS id, {DOT} AS score FROM q, embeddings e),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id, score FROM scored QUALIFY rank <= 3),
chunks AS (SELECT query_id, rank, r.score, source, lang, concat('[Source: ', source, ' | Section: ', lang, ']', chr(10), text, chr(10)) AS chunk FROM ranked r JOIN documents ON doc_id = id),
used AS (SELECT *, coalesce(length(block), 0) + sum(length(chunk)) OVER (PARTITION BY query_id ORDER BY rank) <= 8000 AS fits FROM chunks LEFT JOIN blocks USING (query_id)),
kept AS (SELECT query_id, string_agg(concat(chr(10), '---', chr(10), chunk), '' ORDER BY rank) FILTER (fits) AS t, count(*) FILTER (fits) AS n, string_agg(concat('|', source, ':', lang, ':', round(score * 10000)::BIGINT), '' ORDER BY rank) FILTER (fits) AS s FROM used GROUP BY query_id)
SELECT q.query_id, concat(coalesce(block, ''), CASE WHEN block IS NOT NULL AND n IS NOT NULL THEN concat(chr(10), '---', chr(10)) ELSE '' END, CASE WHEN n IS NOT NULL THEN concat(chr(10), '=== Retrieved Document Sections ===') ELSE '' END, coalesce(t, '')) AS context,
(CASE WHEN block IS NULL THEN 0 ELSE 1 END + coalesce(n, 0))::BIGINT AS sources, concat(CASE WHEN block IS NOT NULL THEN concat('|Entity Store:', found, ' entities:10000') ELSE '' END, coalesce(s, '')) AS told FROM q LEFT JOIN blocks USING (query_id) LEFT JOIN kept USING (query_id)""")
def hybrid_context(spark, d):
    """Entities and the nearest documents for a twentieth of the vectors as questions, under one budget."""
    q = _questions(spark, d)
    near = vector.top_k_per_query(_points(spark, d), q.select("query_id", F.col("embedding").alias("query")), 3)
    docs = _docs(spark, d).select("id", F.concat(F.lit("/data/"), "source_id").alias("source_id"), F.col("language").alias("title"), "text")
    out = retrieval.hybrid_context(q.select("query_id", "query"), _parts(spark, d), near.join(docs, "id"))
    told = F.transform("sources", lambda x: F.concat(F.lit("|"), x["source"], F.lit(":"), x["title"], F.lit(":"), F.round(x["score"] * 10000).cast("long").cast("string")))
    return out.select("query_id", "context", F.size("sources").cast("long").alias("sources"), F.array_join(told, "").alias("told"))


@query("""WITH n AS (SELECT conv_id AS doc_id, turn AS pos, role = 'user' AS header, trim(text) AS text FROM conversations WHERE trim(text) <> ''),
s AS (SELECT *, max(CASE WHEN header THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM n)
SELECT doc_id, pos, CASE WHEN header THEN 'section' ELSE 'paragraph' END AS type, CASE WHEN header OR section IS NULL THEN 1 ELSE 2 END AS level, CASE WHEN NOT header THEN section END AS parent FROM s""")
def flat_nodes(spark, d):
    e = _t(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), "text", F.when(F.col("role") == "user", "Title").otherwise("NarrativeText").alias("category"))
    return layout.flat_nodes(e).select("doc_id", "pos", "type", "level", "parent")
