"""All llm queries over the test tables."""

from orrery.llm.queries import QUERIES
from orrery.llm.sql import SQL


def test_every_query_runs_and_is_whole(spark, data):
    n = {name: f(spark, data).count() for name, f in QUERIES.items()}
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert n["p6_ids"] == docs.count()
    assert n["p1_diagnostics"] == n["p1_outcomes"] > n["p1_found"] > 0
    assert n["p8_statistics"] > n["p8_found"] > 0
    assert not SQL


def test_found_queries_are_part_of_their_reports(spark, data):
    a = {r["doc_id"] for r in QUERIES["p1_found"](spark, data).collect()}
    b = {r["doc_id"] for r in QUERIES["p1_diagnostics"](spark, data).where("not well_formed").collect()}
    assert a == b
    p = QUERIES["p7_containers"](spark, data)
    assert p.columns == ["container_no", "doc_id", "piece_no", "n_tokens"]
    assert p.groupBy("container_no").sum("n_tokens").agg({"sum(n_tokens)": "max"}).first()[0] <= 2048
