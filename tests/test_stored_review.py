"""Stages of the stand-in review read stored rows, so that texts are split and checked once."""

import os

import pytest

from docketry.plans import catalog_review

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def test_texts_are_checked_once(spark):
    case = catalog_review.Evaluation(spark, DATA)
    results, effective, _ = case.resolved()
    for rows in (results, effective, case.decisions, case.verdicts, case.failures, case.targets, case.pool(20), case.slots()):
        assert not [f for f in rows.inputFiles() if "documents.parquet" in f]
        assert "content" not in rows.columns
    assert results.count() == catalog_review.labelled(spark, DATA).count()
