"""Benchmark items without id count as hits and are named in no list."""

from __future__ import annotations

from tideline.llm import decontam


def test_pipeline_drops_passages_of_items_without_id(spark, tmp_path):
    import corpus_pipeline

    passage = "one two three four five six seven eight nine ten"
    spark.createDataFrame([(None, passage), (7, "alpha beta gamma")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, f"x {passage} y"), (2, "alpha beta gamma delta"), (3, "clean words"), (4, None)], "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.drop_leaks(spark, docs, str(tmp_path)).collect()} == {3, 4}
    found = decontam.find_hits(docs, spark.read.parquet(f"{tmp_path}/benchmark.parquet")).collect()
    assert {r["doc_id"]: (len(r["hits"]), list(r["items"])) for r in found} == {1: (1, []), 2: (1, ["7"]), 3: (0, []), 4: (0, [])}
    r = {r["doc_id"]: r for r in decontam.report(docs, spark.read.parquet(f"{tmp_path}/benchmark.parquet")).collect()}
    assert (r[1]["n_hit"], r[1]["n_items"], r[1]["contaminated"], r[2]["n_items"], r[3]["contaminated"]) == (10, 0, True, 1, False)


def test_query_equals_its_sql(spark, tmp_path):
    import duckdb

    from tideline.llm.queries import ORACLES, QUERIES

    passage = "One, two; three four FIVE six seven eight nine ten eleven"
    items = [(None, passage), (7, "alpha beta gamma"), (8, passage + " twelve"), (None, None), (9, ""), (None, "solo")]
    docs = [(1, f"x {passage} y"), (2, "alpha beta gamma delta"), (3, None), (4, ""), (1, f"x {passage} y"), (None, "solo solo"), (5, "clean words only")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for t in ("benchmark", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    out = QUERIES["op3_decontaminate"](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(out.columns)} FROM ({ORACLES['op3_decontaminate']})").fetchall()
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str) and len(want) == 7
