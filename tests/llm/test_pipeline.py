"""The pipeline's stages on a table with planted cases, and the queries of the subpackage."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.compare import compare, connect
from tests.llm.data import frame
from tests.llm.test_neardup import brute

SF = "/root/testdata/sf0.001"
NAMES = [f"op{n}_" for n in range(1, 11)]


def test_ten_queries_and_the_pipeline_are_registered():
    names = list(entry.queries())
    for start in NAMES:
        assert len([n for n in names if n.startswith(start)]) == 1
    assert "pipeline" in names


@pytest.mark.parametrize("name", ["op5_", "op6_", "op8_", "op9_"])
def test_queries_equal_their_sql(spark, name):
    name = next(n for n in entry.queries() if n.startswith(name))
    text, _ = compare(spark, connect(SF), entry.queries()[name], entry.oracle_sql()[name], SF)
    assert text.startswith("ok"), text


def test_near_duplicates_of_the_smallest_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    found = entry.queries()["op2_minhash_near_dedup"](spark, SF)
    assert {tuple(r) for r in found.collect()} == brute(rows, 2)


def test_stages_in_turn(spark, tmp_path):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    clean = docs.filter("doc_id < 2500 AND length(trim(text)) > 0")
    passage = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").limit(1).collect()][0]
    long = " ".join(f"planted{i}" for i in range(80))
    extra = [(90_000, long), (90_001, long.replace(" ", "\n")), (90_002, long + " end"),
             (90_003, f"Seen before: {passage}"), (90_004, None), (90_005, " "),
             (90_006, "idiot moron scum trash pathetic loser worthless clown")]
    planted = frame(spark, extra).selectExpr(
        "doc_id", "text", "'en' AS lang", "'x' AS source", "CAST(length(text) AS long) AS n_chars")
    rows = clean.unionByName(planted)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, rows, sf).write.parquet(path)
        after = spark.read.parquet(path)
        kept[name] = {r.doc_id for r in after.select("doc_id").collect()}
        if name != "packing":
            assert after.columns == docs.columns
        rows = after
    assert 90_006 not in kept["toxicity"] and 90_000 in kept["toxicity"]
    assert {90_000, 90_001} & kept["exact_dedup"] == {90_000}
    assert len({90_004, 90_005} & kept["exact_dedup"]) == 1
    assert {90_000, 90_002} & kept["near_dedup"] == {90_000}
    assert 90_003 in kept["near_dedup"] and 90_003 not in kept["decontamination"]
    assert kept["packing"] == kept["decontamination"]
