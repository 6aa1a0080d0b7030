"""Texts without a line meet the queries that ask for the last one."""

import duckdb
import pytest

from docketry.plans import catalog_review, check

TEXTS = ["", "\n", "a\n\nb", "x\r\n", None, "\r\n\r\n", "only", "again\nagain"]


@pytest.mark.parametrize("name", ["evidence_line", "rule_evidence"])
def test_last_line_of_texts_without_one(spark, tmp_path, name):
    docs = [(i, t, "en", "src1", len(t or "")) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    marks = [(i, 1, 0) for i, t in enumerate(TEXTS) if t is not None]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for table in ("documents", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    matches, message = check.compare(spark, con, name, catalog_review.QUERIES[name], catalog_review.ORACLES[name], str(tmp_path))
    assert matches, message
