"""Screens of ids and the small helpers."""

from pyspark.sql import functions as F

from stratalog.llm.common import Screen, free, others, pick, written
from tests.llm.data import clashing, frame


def test_screen_never_loses_an_id(spark):
    docs = clashing(frame(spark, [(i, f"t{i}") for i in range(500)] + [(None, "none"), (7, "again")]))
    ids = spark.createDataFrame([(i,) for i in range(0, 500, 7)] + [(None,)], "doc_id long")
    for bits in (26, 6):  # a bitmap that is nearly full lets others pass as well
        screen = Screen(ids, bits=bits)
        inside = screen.split(docs, F.col("doc_id"))
        outside = screen.split(docs, F.col("doc_id"), False)
        assert inside.columns == outside.columns == docs.columns
        got = {r.doc_id for r in inside.collect()}
        assert got >= {*range(0, 500, 7), None}
        assert got.isdisjoint(r.doc_id for r in outside.collect())
        assert inside.count() + outside.count() == 502
    assert {r.doc_id for r in pick(docs, ids).collect()} == {*range(0, 500, 7), None}
    assert pick(docs, ids).count() == 74
    assert pick(docs, ids.limit(0)).count() == 0


def test_names():
    class Table:
        columns = ["Text", "n", "_n"]
    assert others(Table, ("text",)) == ["n", "_n"]
    assert free("_n", Table.columns) == "__n" and free("m", Table.columns) == "m"


def test_written_tables_stand_alone(spark):
    df = spark.range(10).withColumn("x", F.rand())
    kept = written(df, "numbers")
    assert sorted(r.x for r in kept.collect()) == sorted(r.x for r in kept.collect())
    assert kept.dtypes == df.dtypes
