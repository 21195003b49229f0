"""Benchmark items without an id hit documents as the query's SQL says."""

import duckdb

import corpus_pipeline
from matchloom.llm import decontaminate
from matchloom.llm.queries import QUERIES, SQL


def test_unnamed_items(spark, docs, tmp_path):
    words = [f"w{k}" for k in range(14)]
    items = [(None, " ".join(words)), (None, "w1 w2"), ("i1", " ".join(words[:11])), ("i2", "only four words here"), (None, "only four words here"), (None, None)]
    rows = [(1, "x " + " ".join(words[3:]) + " y"), (2, "w1 w2 w1"), (3, " ".join(words)), (4, "Only four words here"), (5, "clean"), (6, None)]
    df = docs(rows).select("doc_id", "text", "lang", "source")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    bench = spark.createDataFrame(items, "item_id string, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted(tuple(r) for r in QUERIES["op7_decontaminate"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    assert got == sorted(con.execute(SQL["op7_decontaminate"]).fetchall())
    assert [r[:5] for r in got] == [(i, *decontaminate.brute_force([(i, t)], items)[i]) for i, t in rows]
    in_parts = decontaminate.digest(decontaminate.decontaminate(df, bench, part_bytes=40, unnamed=True))
    assert sorted(tuple(r) for r in in_parts.collect()) == got
    assert sorted(r.doc_id for r in corpus_pipeline.benchmarks(spark, df, str(tmp_path)).collect()) == [5, 6]
