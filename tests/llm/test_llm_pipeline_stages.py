"""Pipeline stages on odd rows: nulls, empty and long texts, repeated rows, empty tables, clashing names."""

import os

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
CLASHING = ["row", "score", "predicted", "_text", "_h", "fp", "component_id", "spans"]
PROSE = "the river and the old house of a man was for that in the evening with lamps by it . "


def odd(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return docs.select("*", *[F.lit(f"x{c}").alias(c) for c in CLASHING])


ODD = [(1, None, "a"), (2, "", "a"), (3, PROSE * 4, "a"), (3, PROSE * 4, "a"), (4, PROSE * 4, "b"), (5, "long " * 30_000, "b"), (None, PROSE * 3, None)]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stage_keeps_columns_on_odd_rows(spark, name, stage):
    docs = odd(spark, ODD)
    out = stage(spark, docs, SF_DIR)
    assert out.columns == docs.columns
    rows = out.collect()
    assert all(r[c] == f"x{c}" for r in rows for c in CLASHING)
    assert stage(spark, docs.limit(0), SF_DIR).count() == 0
    if name == "quality":
        assert not {1, 2} & {r["doc_id"] for r in rows}
    if name == "near_duplicates":
        assert sorted(r["doc_id"] for r in rows if r["text"] == PROSE * 4) == [3]
    if name == "personal_data":
        assert len(rows) == len(ODD)
