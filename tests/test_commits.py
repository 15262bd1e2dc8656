"""Atomic commits, and the index in segments."""

import random

import pytest
from pyspark.sql import functions as F

from stratalog.operators import search
from stratalog.sources import commits, writers
from stratalog.streaming import ingest as streaming

SCHEMA = "part STRING, id STRING, v INT"


def table(spark, path):
    return sorted((r.part, r.id, r.v) for r in writers.read_table(spark, path).select("part", "id", "v").collect())


def upsert(spark, path, *rows):
    writers.upsert_table(spark.createDataFrame(rows, SCHEMA), path, ["part", "id"], "part")


def test_a_writer_that_dies_leaves_the_old_state(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        writers.read_table(spark, path)
    upsert(spark, path, ("a", "1", 1), ("b", "1", 1))
    upsert(spark, path, ("a", "2", 2))
    old = [("a", "1", 1), ("a", "2", 2), ("b", "1", 1)]
    assert table(spark, path) == old

    def dies(*_):
        raise KeyboardInterrupt

    write = commits.write_parts
    monkeypatch.setattr(commits, "commit", dies)  # after the data, before the commit
    with pytest.raises(KeyboardInterrupt):
        upsert(spark, path, ("a", "1", 9), ("b", "1", 9))
    monkeypatch.undo()

    def half(df, where, part):
        write(df.filter("part = 'a'"), where, part)
        raise KeyboardInterrupt

    monkeypatch.setattr(commits, "write_parts", half)  # between two partitions
    with pytest.raises(KeyboardInterrupt):
        upsert(spark, path, ("a", "1", 9), ("b", "1", 9))
    monkeypatch.undo()
    assert table(spark, path) == old
    upsert(spark, path, ("a", "1", 9), ("b", "1", 9))
    assert table(spark, path) == [("a", "1", 9), ("a", "2", 2), ("b", "1", 9)]


def test_a_reader_keeps_its_state_and_a_slow_writer_tries_again(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    upsert(spark, path, ("a", "1", 1))
    reader = writers.read_table(spark, path)
    write, calls = commits.write_parts, []

    def overtaken(df, where, part):
        """While the first writer writes, another one commits to the same part."""
        calls.append(1)
        if len(calls) == 1:
            upsert(spark, path, ("a", "2", 2))
        return write(df, where, part)

    monkeypatch.setattr(commits, "write_parts", overtaken)
    upsert(spark, path, ("a", "3", 3))
    assert len(calls) == 3  # the other writer's, and twice the first one's
    assert table(spark, path) == [("a", "1", 1), ("a", "2", 2), ("a", "3", 3)]
    assert reader.count() == 1 and commits.snapshot(spark, path).n == 3


def test_parts_that_go(spark, tmp_path):
    path = str(tmp_path / "t")
    upsert(spark, path, ("a", "1", 1), ("b", "1", 1))
    commits.commit(spark, path, commits.snapshot(spark, path), lambda now: {"a": None})
    assert table(spark, path) == [("b", "1", 1)]
    commits.commit(spark, path, commits.snapshot(spark, path), lambda now: {"b": None})
    with pytest.raises(FileNotFoundError):
        writers.read_table(spark, path)


# --- the index -----------------------------------------------------------------------------

WORDS = [f"{a}{b}" for a in ("alp", "bet", "Gám", "del") for b in ("ha", "ma", "ta", "x1")]


def corpus(spark, rng, ids):
    rows = [("raw", f"d{i}", "2024-01-01", " ".join(rng.choices(WORDS, k=rng.randrange(0, 40)))) for i in ids]
    return spark.createDataFrame(rows, "source_type STRING, source_id STRING, date STRING, content STRING"), rows


def ranks(spark, postings, totals, text="alp gam"):
    return {(r.source_type, r.source_id): round(r.rank, 9) for r in search.search(text, postings, totals).collect()}


def test_segments_equal_a_full_rebuild(spark, tmp_path):
    """Batches that add and replace rows, with merges between, rank like one index of the last state."""
    rng, path, held = random.Random(3), str(tmp_path / "index"), {}
    for step in range(6):
        ids = [i for i in range(60) if rng.random() < 0.3] + [100 + step]
        batch, rows = corpus(spark, rng, ids)
        held.update({r[1]: r for r in rows})
        writers.append_index(batch, path)
        if step % 2:
            merged = writers.merge_index(spark, path, factor=2)
            assert merged >= 2 or len(commits.snapshot(spark, path).folders) < 3
        whole = spark.createDataFrame(list(held.values()), batch.schema)
        counted = search.count_tokens(whole)
        assert ranks(spark, *writers.read_index(spark, path)) == ranks(spark, search.postings(counted), counted)
        totals = writers.read_index(spark, path)[1].first()
        assert totals.docs == len(held)
    assert len(commits.snapshot(spark, path).folders) < 6


def test_appending_reads_no_older_postings(spark, tmp_path):
    rng, path = random.Random(4), str(tmp_path / "index")
    writers.write_index(corpus(spark, rng, range(20))[0], path)
    for folder in commits.snapshot(spark, path).folders.values():
        assert spark.read.parquet(f"{folder}/postings").count() > 0
    before = commits.snapshot(spark, path).folders
    writers.append_index(corpus(spark, rng, range(10, 30))[0], path)
    after = commits.snapshot(spark, path).folders
    assert {p: after[p] for p in before} == before and len(after) == 2
    assert writers.merge_index(spark, path, factor=9) == 0


def test_counts_equal_the_columns_they_replace(spark):
    rows = [("raw", str(i), "d", t) for i, t in enumerate(
        [None, "", " .,- ", "a a A á Á b", "x1 x1-x2", "漢字 漢字 ½ Ⅷ é", "İstanbul ẞ ǅ"])]
    df = spark.createDataFrame(rows, "source_type STRING, source_id STRING, date STRING, content STRING")
    want = {}
    for r in df.select("source_id", search.tokens().alias("t")).collect():
        for t in r.t or []:
            want[r.source_id, t] = want.get((r.source_id, t), 0) + 1
    got = {(r.source_id, r.token): r.tf for r in search.build_index(df).collect()}
    assert got == want
    assert {r.source_id: r.doc_len for r in search.count_tokens(df).collect()}["3"] == 6


def test_what_is_no_date_has_one_partition(spark, tmp_path):
    rows = [(f"{i}", f"no date {i}" if i else "2024-02-03", "t", "s", "f", "user", "x") for i in range(500)]
    batch = spark.createDataFrame(rows, "id STRING, date STRING, time STRING, source STRING, source_file STRING, "
                                        "role STRING, text STRING")
    assert streaming.touched_months(batch) == ["2024-01", "2024-02", "other"]
    writers.write_raw(batch, str(tmp_path / "s"))
    assert writers.read_store(spark, str(tmp_path / "s"), months=["other"]).count() == 499
    assert writers.read_store(spark, str(tmp_path / "s")).filter(F.col("date") == "2024-02-03").count() == 1


# --- labels and names that contain one another ----------------------------------------------


def test_containment_equals_all_pairs(spark):
    from stratalog.operators import entities
    rng = random.Random(5)
    some = sorted({"".join(rng.choices("abc #", k=rng.randrange(0, 9))) for _ in range(120)})
    others = sorted({"".join(rng.choices("abc #", k=rng.randrange(0, 6))) for _ in range(120)} | {"abc" * 20})
    a, b = (spark.createDataFrame([(x,) for x in v], "x STRING") for v in (others, some))
    got = sorted((r.inner, r.outer) for r in entities.contained(a, b).collect())
    assert got == sorted((x, y) for x in others for y in some if x and x in y)
    assert "NestedLoop" not in entities.contained(a, b)._jdf.queryExecution().toString()


def test_grams_of_small_files_are_not_broadcast(spark, tmp_path):
    from stratalog.operators import entities
    spark.range(3000).selectExpr("printf('customer#%09d', id) AS x").write.parquet(str(tmp_path / "names"))
    names = spark.read.parquet(str(tmp_path / "names"))
    found = entities.contained(names.selectExpr("substr(x, 5) AS x"), names)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 3000


def test_label_notes_equal_dossiers(spark):
    from stratalog.operators import entities
    rng = random.Random(6)
    names = ["Ann", "Anna Berg", "Bo", "x", "Cy-Lee", "ann b", "Dora", "Dorabella"]
    rows = [("day", f"2024-01-{i + 1:02d}", f"2024-01-{i + 1:02d}",
             {k: rng.choice(["here", "Not mentioned today", None]) for k in rng.sample(names, rng.randrange(0, 6))})
            for i in range(28)]
    units = spark.createDataFrame(rows, "level STRING, period_start STRING, period_end STRING, entities "
                                        "MAP<STRING, STRING>")
    labels = {"Ann": ["anna"], "Bo": [], "Dora": ["dorabella of the hill"], "nobody": ["zzz"], "Lee": ["cy-lee"]}
    terms = spark.createDataFrame([(k, t) for k, v in labels.items() for t in (k, *v)], "label STRING, term STRING")
    want = entities.dossiers(units, labels, "day")
    got = entities.label_notes(units, terms, "day").select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 5


def test_an_index_has_a_row_per_document_and_letter(spark, tmp_path):
    df = spark.createDataFrame([("raw", "1", "2024-01-01", "beta alpha apple alpha élan 7"),
                                ("raw", "2", "2024-01-02", ""), ("raw", "3", "2024-01-03", "gamma beta")],
                               "source_type STRING, source_id STRING, date STRING, content STRING")
    path = str(tmp_path / "index")
    writers.append_index(df, path)
    folder = next(iter(commits.snapshot(spark, path).folders.values()))
    assert spark.read.parquet(f"{folder}/postings").count() == 6  # a, b, e, 7; g, b
    got = {(r.source_id, r.letter, r.token, r.tf) for r in writers.read_index(spark, path)[0].collect()}
    want = {("1", "a", "alpha", 2), ("1", "a", "apple", 1), ("1", "b", "beta", 1), ("1", "e", "elan", 1),
            ("1", "7", "7", 1), ("3", "b", "beta", 1), ("3", "g", "gamma", 1)}
    assert got == want
    # A segment with one token a row, as they were written before.
    (search.postings(search.count_tokens(df)).withColumn("letter", F.substring("token", 1, 1))
     .write.mode("overwrite").partitionBy("letter").parquet(f"{folder}/postings"))
    spark.catalog.refreshByPath(folder)
    assert {(r.source_id, r.letter, r.token, r.tf) for r in writers.read_index(spark, path)[0].collect()} == want
    writers.append_index(df.filter("source_id = '3'").withColumn("content", F.lit("delta")), path)
    assert ranks(spark, *writers.read_index(spark, path), "alp del bet").keys() == {("raw", "1"), ("raw", "3")}
