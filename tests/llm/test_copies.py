"""A page and its copies count once for line dedup."""

from __future__ import annotations

import random

from tests.llm.helpers import sentence
from tideline.llm import line_dedup


def test_copies_are_one_page_in_the_pipeline(spark):
    import corpus_pipeline

    rng = random.Random(1)
    copy = "\n".join(sentence(rng, 8) for _ in range(4))
    data = [(i, "s", copy + "\n \n" * (i % 2)) for i in range(20)] + [(i, "s", f"{sentence(rng, 20)}\nfoot") for i in range(20, 50)]
    docs = spark.createDataFrame(data, "doc_id long, source string, text string").selectExpr("*", "'xx' AS lang", "CAST(length(text) AS long) AS n_chars")
    out = {r["doc_id"]: r for r in corpus_pipeline.drop_boilerplate(spark, docs, "").collect()}
    assert len(out) == 50
    assert all(out[i]["text"] == data[i][2] and out[i]["n_chars"] == len(data[i][2]) for i in range(20))
    assert all(out[i]["text"] == data[i][2].split("\n")[0] for i in range(20, 50))
    kept = corpus_pipeline.one_of_each_group(spark, corpus_pipeline.drop_boilerplate(spark, docs, ""), "").collect()
    assert sum(copy in r["text"] for r in kept) == 1
    apart = line_dedup.dedup_lines(docs.where("doc_id < 20 AND doc_id % 2 = 0"), copies_once=False)
    assert {r["n_dropped"] for r in apart.collect()} == {4}


def test_query_equals_its_sql(spark, tmp_path):
    import duckdb

    from tideline.llm.queries import ORACLES, QUERIES

    rng = random.Random(2)
    copy = "\n".join(["foot", *(sentence(rng, 6) for _ in range(3))])
    data = [(i, "s" if i % 3 else "t", copy + "\n \n" * (i % 2)) for i in range(30)] + [(i, "s", f"{sentence(rng, 9)}\n foot ") for i in range(30, 50)]
    data += [(50, None, "foot"), (51, "s", None), (52, "s", ""), (53, "s", "\n\n"), (54, "t", "foot"), (None, "t", "foot"), (54, "t", "foot")]
    spark.createDataFrame(data, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    out = QUERIES["op7_line_dedup"](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(out.columns)} FROM ({ORACLES['op7_line_dedup']})").fetchall()
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str) and len(want) == len(data)
    assert any(r[3] for r in want) and all(copy.split("\n", 1)[1] in r[1] for r in want if r[0] in range(30))
