"""The jobs: results against SQL, reruns, growing input, odd rows, command line."""

import collections
import json
import re
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from jobs import chunk_store, entity_stream
from loomdoc.plans import job_queries

ROOT = Path(__file__).resolve().parents[1]
DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, batch long, n long"


@pytest.mark.parametrize("name", sorted(job_queries.QUERIES))
def test_job_against_sql(spark, name):
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.sources.partitionOverwriteMode", "spark.sql.shuffle.partitions")}
    df = job_queries.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    found = con.execute(job_queries.ORACLES[name])
    at = {c[0]: i for i, c in enumerate(found.description)}
    assert sorted(at) == cols
    rows = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    assert rows and rows == sorted(repr(tuple(r[at[c]] for c in cols)) for r in found.fetchall())
    assert before == {k: spark.conf.get(k, None) for k in before}


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, 0, "x", 7, 1) for i, t, lang, source in rows], SCHEMA)


def table(spark, path, schema):
    return sorted(map(tuple, spark.read.schema(schema).parquet(path).collect()), key=repr)


def test_chunk_store(spark, tmp_path):
    body = "All of these words say one plain thing or another to the reader. " * 40
    rows = [(1, body, "en", "a"), (2, body, "en", "b"), (3, None, "en", "a"), (4, "", "de", None), (5, "1 2 3", "en", "a"), (None, body, "en", "a"), (6, body[:400], None, None), (6, body[:400], None, None), (7, body + "é", "de", "a")]
    docs(spark, rows).write.parquet(f"{tmp_path}/in")
    counts = chunk_store.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", chunk_store.Config(max_chars=300, overlap_chars=30))
    first = table(spark, f"{tmp_path}/out/chunks", chunk_store.CHUNKS)
    assert {k: counts[k] for k in ("read", "no_id", "empty", "low_signal", "repeated", "unique")} == {"read": 9, "no_id": 1, "empty": 2, "low_signal": 1, "repeated": 2, "unique": 3}
    assert counts["chunks"] == len(first) and {r[2] for r in first} == {1, 6, 7} and {r[8] for r in first} == {"en", "de", "und"}
    assert all(len(r[7]) == r[5] <= 300 and len(r[7].split()) == r[6] for r in first)
    assert len({r[0] for r in first}) == len(first)
    assert chunk_store.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", chunk_store.Config(max_chars=300, overlap_chars=30)) == counts
    assert table(spark, f"{tmp_path}/out/chunks", chunk_store.CHUNKS) == first
    assert json.loads(next(Path(f"{tmp_path}/out/report").glob("*.json")).read_text()) == counts
    docs(spark, []).write.parquet(f"{tmp_path}/none")
    assert chunk_store.run(spark, f"{tmp_path}/none", f"{tmp_path}/out")["chunks"] == 0
    assert table(spark, f"{tmp_path}/out/chunks", chunk_store.CHUNKS) == []


EMAIL = re.compile(r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", re.I)


def emails(texts):
    out = collections.defaultdict(list)
    for i, t in texts.items():
        for name, n in collections.Counter(x.lower() for x in EMAIL.findall(t or "")).items():
            out[name].append((i, n))
    return sorted(((name, len(d), sum(n for _, n in d), min(i for i, _ in d), "email") for name, d in out.items()), key=repr)


def test_entity_stream_over_growing_input(spark, tmp_path):
    cfg, out = entity_stream.Config(("email",), 1), f"{tmp_path}/out"
    texts = {i: f"write to u{i % 4}@mail.org or U{i % 4}@MAIL.org, {i}" for i in range(12)}
    put = lambda rows: docs(spark, [(i, t, "en", "s") for i, t in rows]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    put([*texts.items(), (None, "nobody@x.org"), (50, None), (51, ""), (0, texts[0])])
    counts = entity_stream.run(spark, f"{tmp_path}/in", out, cfg)
    texts |= {50: None, 51: ""}
    assert (counts["read"], counts["no_id"], counts["new"], counts["changed"], counts["unchanged"]) == (16, 1, 14, 0, 0)
    first = table(spark, f"{out}/entities", entity_stream.ENTITIES)
    assert first == emails(texts)

    counts = entity_stream.run(spark, f"{tmp_path}/in", out, cfg)  # nothing new
    assert counts["read"] == 0 and table(spark, f"{out}/entities", entity_stream.ENTITIES) == first

    put([(2, texts[2]), (3, "now other@place.net"), (4, "gone"), (90, "u1@mail.org u1@mail.org")])
    texts |= {3: "now other@place.net", 4: "gone", 90: "u1@mail.org u1@mail.org"}
    put([(3, "at last third@place.net")])  # a batch of its own, after the one above or before
    counts = entity_stream.run(spark, f"{tmp_path}/in", out, cfg)
    assert (counts["read"], counts["unchanged"], counts["new"], counts["changed"]) == (5, 1, 1, 3)
    newest = {r.doc_id: r.batch for r in spark.read.schema(entity_stream.LEDGER).parquet(f"{out}/ledger").groupBy("doc_id").agg({"batch": "max"}).toDF("doc_id", "batch").collect()}
    held = {r.name for r in spark.read.schema(entity_stream.MENTIONS).parquet(f"{out}/mentions").where("doc_id = 3").collect() if r.batch == newest[3]}
    texts[3] = " ".join(held)
    assert len(held) == 1 and table(spark, f"{out}/entities", entity_stream.ENTITIES) == emails(texts)


def test_a_batch_that_comes_again_leaves_the_same(spark, tmp_path):
    cfg, out = entity_stream.Config(("email",)), f"{tmp_path}/out"
    entity_stream._stands(spark, f"{out}/ledger", entity_stream.LEDGER, "batch")
    entity_stream._stands(spark, f"{out}/mentions", entity_stream.MENTIONS, "batch", "type")
    write = entity_stream._batch(out, cfg, {})
    for n, rows in ((0, [(1, "a@b.org", None, None)]), (1, [(1, "c@d.org", None, None), (2, "a@b.org", None, None)]), (1, [(1, "c@d.org", None, None), (2, "a@b.org", None, None)])):
        write(docs(spark, rows).select("doc_id", "text", "source"), n)
        made = sorted(map(tuple, entity_stream.totals_of(spark, out).collect()))
    assert made == [("a@b.org", 1, 1, 2, "email"), ("c@d.org", 1, 1, 1, "email")]


def test_settings(tmp_path):
    for job in (chunk_store, entity_stream):
        assert job.Config.read(str(Path(job.__file__).with_suffix(".json"))) == job.Config()
        (tmp_path / "bad.json").write_text('{"colour": 1}')
        with pytest.raises(ValueError, match="colour"):
            job.Config.read(str(tmp_path / "bad.json"))


def test_command_line(tmp_path):
    ran = subprocess.run([sys.executable, "-m", "jobs.entity_stream", "--documents", f"{DATA}/documents.parquet", "--output", str(tmp_path / "out")], cwd=ROOT, capture_output=True, text=True, timeout=200)
    assert ran.returncode == 0, ran.stderr[-2000:]
    assert "read 200 documents" in ran.stderr and list((tmp_path / "out/entities").glob("type=*"))
