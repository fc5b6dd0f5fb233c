"""The jobs as queries: each runs twice into one new folder, and what stands there then is the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobs import chunk_store, entity_stream

from ..operators import ner
from .registry import CLEAN, WORDS, _pack_sql
from .scratch import new_path


def job1_chunk_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    output = new_path(spark, "chunk_store")
    for _ in range(2):
        chunk_store.run(spark, f"{sf_dir}/documents.parquet", output)
    return spark.read.schema(chunk_store.CHUNKS).parquet(f"{output}/chunks")


def job2_entity_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    output = new_path(spark, "entity_stream")
    for _ in range(2):
        entity_stream.run(spark, f"{sf_dir}/documents.parquet", output)
    return spark.read.schema(entity_stream.ENTITIES).parquet(f"{output}/entities")


def _chunks_sql(cfg: chunk_store.Config = chunk_store.Config()) -> str:
    sentences = "string_split(regexp_replace(text, '([.!?。！？।])\\s+', '\\1' || chr(1), 'g'), chr(1))"
    packed = _pack_sql(sentences, cfg.max_chars, cfg.overlap_chars).replace("FROM documents)", "FROM kept)").replace("SELECT f.doc_id AS id, len(x) AS n, sha256(array_to_string(x, '|')) AS digest FROM", "SELECT f.doc_id, x FROM").removeprefix("WITH RECURSIVE ")
    return f"""WITH RECURSIVE cleaned AS (SELECT doc_id, coalesce(source, '') AS source_id, coalesce(lang, 'und') AS lang, {CLEAN.replace("text", "coalesce(text, '')")} AS text FROM documents WHERE doc_id IS NOT NULL),
said AS (SELECT * FROM cleaned WHERE text <> '' AND len({WORDS}) >= {cfg.min_words} AND len(list_filter({WORDS}, lambda w: regexp_full_match(w, '\\pL+'))) / greatest(len({WORDS}), 1) >= {cfg.alpha_share}),
kept AS MATERIALIZED (SELECT * FROM said QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id, source_id, lang) = 1),
{packed.rsplit("SELECT f.doc_id, x FROM", 1)[0].rstrip()},
made AS (SELECT f.doc_id, CASE WHEN f.now = '' THEN f.done ELSE list_append(f.done, f.now) END AS x FROM fold f JOIN parts p USING (doc_id) WHERE f.i = len(p.ss)),
rows AS (SELECT doc_id, source_id, lang, len(x) AS total_chunks, unnest(range(len(x))) AS chunk_index, unnest(x) AS text FROM made JOIN kept USING (doc_id)),
first AS (SELECT *, sha256(concat(source_id, ':', text))[1:16] AS chunk_hash FROM rows QUALIFY row_number() OVER (PARTITION BY chunk_hash ORDER BY doc_id, chunk_index) = 1)
SELECT chunk_hash, source_id, doc_id, chunk_index, total_chunks, length(text) AS char_count, len({WORDS}) AS word_count, text, lang FROM first"""


def _entities_sql(cfg: entity_stream.Config = entity_stream.Config()) -> str:
    kind = {p[0]: p[1] for p in ner.PATTERNS}
    found = " UNION ALL ".join(f"SELECT doc_id, '{kind[n]}' AS type, unnest(regexp_extract_all(text, '(?im){ner.pattern(n)}')) AS name FROM documents" for n in cfg.patterns)
    return f"""SELECT name, count(*) AS n_docs, sum(n)::BIGINT AS n_mentions, min(doc_id) AS first_doc, type FROM (SELECT doc_id, type, lower(name) AS name, count(*) AS n FROM ({found}) GROUP BY ALL) GROUP BY name, type"""


QUERIES = {f.__name__: f for f in (job1_chunk_store, job2_entity_stream)}
ORACLES = {"job1_chunk_store": _chunks_sql(), "job2_entity_stream": _entities_sql()}
