"""The registered queries against their SQL on the smallest tables, and the pipeline on odd rows."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tillwork.session import TABLES

ROOT = os.environ.get("TILLWORK_SF_DIR", "/root/testdata/sf0.001")
SQL = {n: s for n, s in entry.oracle_sql().items() if n.startswith("op")}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in TABLES:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{ROOT}/{name}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, con, name):
    df = entry.queries()[name](spark, ROOT)
    cols = sorted(df.columns)
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    rel = con.execute(SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    assert sorted(map(str, got)) == sorted(str(tuple(r[i] for i in order)) for r in rel.fetchall())


def test_every_operator_has_one_query():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()


def test_the_pipeline_keeps_what_it_should(spark, odd, prose, root):
    bad = [(300 + i, " ".join(w.upper() + "!!" for w in p.split()[:40])) for i, p in enumerate(prose)]
    leak = " ".join(prose[10].split()[20:50])
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    more = bad + [(400, f"{prose[11][::-1]} {leak} end"), (401, f'{prose[12][::-1]} token = "{key}" end')]
    docs = odd.unionByName(spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in more], odd.schema))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(10)] + [(i, 0, 0) for i, _ in bad[:12]], "doc_id long, quality int, toxic int")
    # Every item is the passage; prose[10] holds it too and goes.
    path = root(documents=docs, labels=labels, benchmark=spark.createDataFrame([(0, leak), (1, None)], "item_id long, text string"))
    stage = spark.read.parquet(f"{path}/documents.parquet")
    kept = {}
    for name, step in corpus_pipeline.STAGES:
        out = f"{path}/{name}"
        step(spark, stage, path).write.parquet(out)
        stage = spark.read.parquet(out)
        if name != "mix":
            assert stage.schema.names == docs.schema.names
        kept[name] = [r["doc_id"] for r in stage.collect()]
    assert not set(kept["quality"]) & {i for i, _ in bad} and {0, 3, 14, 400, 401} <= set(kept["quality"])
    assert len(kept["near_duplicates"]) == len(set(kept["near_duplicates"])) and {25, 26, 28}.isdisjoint(kept["near_duplicates"])
    assert set(kept["near_duplicates"]) - set(kept["decontamination"]) == {10, 27, 400} & set(kept["near_duplicates"])
    assert kept["secrets"] == kept["decontamination"] or sorted(kept["secrets"], key=str) == sorted(kept["decontamination"], key=str)
    assert stage.where("doc_id = 401").where(F.col("text").contains("[SECRET]") & ~F.col("text").contains(key)).count() == stage.where("doc_id = 401").count()
    assert stage.where("taken <= 0").count() == 0
    nothing = root(documents=docs.limit(0), labels=labels.limit(0), benchmark=spark.createDataFrame([], "item_id long, text string"))
    assert corpus_pipeline.run(spark, nothing).count() == 0
