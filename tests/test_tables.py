"""Queries on tables that are folders of files, as Spark writes them, and on longer ones."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import TABLES, compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """The smallest tables, each as a folder of three files."""
    root = tmp_path_factory.mktemp("folders")
    for name in TABLES:
        spark.read.parquet(f"{SF}/{name}.parquet").repartition(3).write.parquet(f"{root}/{name}.parquet")
    return str(root)


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def same(spark, con, name, sf):
    text, _ = compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], sf)
    assert text.startswith("ok") and text != "ok 0", text


@pytest.mark.parametrize("name", ["merge_stream", "usage_stream"])
def test_streams_over_folders(spark, con, folders, name):
    assert os.path.isdir(f"{folders}/conversations.parquet")
    same(spark, con, name, folders)
    same(spark, con, name, SF)


@pytest.fixture(scope="module")
def long_days(spark, tmp_path_factory):
    """All conversations on two days, whose texts do not fit the window."""
    root = tmp_path_factory.mktemp("long")
    rows = spark.read.parquet(f"{SF}/conversations.parquet")
    rows.selectExpr("conv_id % 2 + 730 * conv_id AS conv_id", "turn", "role", "repeat(text, 40) AS text"
                    ).write.parquet(f"{root}/conversations.parquet")
    for name in TABLES:
        if name != "conversations":
            os.symlink(f"{SF}/{name}.parquet", f"{root}/{name}.parquet")
    return str(root)


@pytest.mark.parametrize("name", ["day_prompts", "apply_model"])
def test_long_days_are_one_prompt(spark, long_days, name):
    con = connect(SF)
    con.execute(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{long_days}/conversations.parquet/*.parquet'")
    longest = con.execute("SELECT max(n) FROM (SELECT sum(length(text)) AS n FROM conversations "
                          "GROUP BY conv_id % 730)").fetchone()[0]
    assert longest > 40_000 * 3.2
    same(spark, con, name, long_days)


def test_long_batches_are_counted_in_slices():
    import pyarrow as pa
    from stratalog.operators import search
    texts = ["a b a", "", None, "x " * 400_000] + [f"w{i} w{i} z" for i in range(2000)]
    parts = list(search._counted(iter([pa.array(texts)])))
    assert max(len(p) for p in parts) <= search.SLICE_ROWS
    got = [r for p in parts for r in p.to_pylist()]
    assert [r["doc_len"] for r in got] == [3, 0, 0, 400_000] + [3] * 2000
    assert got[0]["tokens"] == [{"token": "a", "tf": 2}, {"token": "b", "tf": 1}]
    assert list(search._counted(iter([pa.array([], pa.string())]))) == []


@pytest.fixture
def no_broadcast(spark):
    """Joins as they are between tables too large for a broadcast."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    held = spark.conf.get(name)
    spark.conf.set(name, "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set(name, held)
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_prompts_that_share_a_context_are_not_shuffled(spark, no_broadcast):
    import random
    from stratalog.operators import context
    from stratalog.plans import synthesis
    text = f"{random.Random(3).getrandbits(400_000):x}"
    ctx = spark.createDataFrame([("2024-01-01", 0, 1, 0, len(text), text)],
                                "center_date STRING, page LONG, n LONG, start LONG, chars LONG, text STRING")
    lead = len(synthesis.type_b_head(1, 1))
    evidence = spark.range(400).selectExpr(
        "'e' AS id", "'2024-01-01' AS period_start", "id AS seq", "concat('TYPE A ', id, '!') AS head",
        "'2024-01-01' AS context_date", f"{len(text)}L AS context_chars",
        f"CAST(length(concat('TYPE A ', id, '!')) + {lead + len(text)} AS BIGINT) AS block_chars", "1000L AS tokens")
    chunks = context.pack_chunks(evidence, ["id"], synthesis.evidence_order(), 1000, 3).localCheckpoint()
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def used():
        return sum(os.path.getsize(p) for p in blocks.getAllFiles().mkString("\n").split("\n") if os.path.exists(p))
    before = used()
    got = {r.chunk: r.prompt for r in synthesis.chunk_prompts(evidence, ctx, chunks, "{entity}:{entity_timeline}").collect()}
    assert used() - before < 20 * len(text)
    assert len(got) == 400
    for chunk, prompt in got.items():
        want = synthesis.BLOCK_RULE.join(f"TYPE A {i}!{synthesis.type_b_head(1, 1)}{text}" 
                                           for i in range(max(chunk - 3, 0), chunk + 1))
        assert prompt.endswith("\n\n" + want)


def mentions_of(spark, dates_of, texts, page_chars=None, keys=""):
    """Contexts, and one evidence block per entity and date; ``texts`` has a date's text in parts."""
    from stratalog.plans import synthesis
    ctx, size = [], {}
    for date, parts in texts.items():
        starts = [sum(map(len, parts[:i])) for i in range(len(parts))]
        ctx += [("t", date, i, 1, at, len(part), part) for i, (at, part) in enumerate(zip(starts, parts))]
        size[date] = sum(map(len, parts))
    lead, rows = len(synthesis.type_b_head(1, 1)), []
    for who, dates in dates_of.items():
        for seq, date in enumerate(dates):
            head, more = f"TYPE A {who} {date}!", size.get(date, 0)
            rows.append(("t", who, date, seq, head, date, more, len(head) + (lead + more if more else 0), 10))
    return (spark.createDataFrame(rows, "tenant STRING, id STRING, period_start STRING, seq LONG, head STRING, "
                                  "context_date STRING, context_chars LONG, block_chars LONG, tokens LONG"),
            spark.createDataFrame(ctx, "tenant STRING, center_date STRING, page LONG, n LONG, start LONG, "
                                  "chars LONG, text STRING"))


def timeline(who, dates, texts):
    from stratalog.plans import synthesis
    return synthesis.BLOCK_RULE.join(f"TYPE A {who} {date}!" + (
        synthesis.type_b_head(1, 1) + "".join(texts[date]) if date in texts else "") for date in dates)


def test_prompts_that_need_other_dates_share_texts(spark, no_broadcast):
    """60 entities with 60 combinations of eight dates: a text moves a few times, not once per combination."""
    import hashlib
    import itertools
    import random
    from stratalog.plans import synthesis
    dice = random.Random(5)
    texts = {f"2024-01-0{i}": [f"{dice.getrandbits(200_000):x}"] for i in range(1, 9)}
    dates_of = {f"e{i}": list(c) for i, c in enumerate(dice.sample(list(itertools.combinations(texts, 4)), 60))}
    evidence, ctx = (x.drop("tenant") for x in mentions_of(spark, dates_of, texts))
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def used():
        return sum(os.path.getsize(p) for p in blocks.getAllFiles().mkString("\n").split("\n") if os.path.exists(p))
    before = used()
    arcs = synthesis.synthesize_entities(evidence, ctx, lambda system, user: hashlib.sha256(user.encode()).hexdigest(),
                                         "{entity}:{entity_timeline}", "{entity}{n_chunks}{partial_arcs}")
    got = {r.id: (r.arc_chunks_used, r.arc_summary) for r in arcs.collect()}
    assert used() - before < 40 * 50_000  # 60 combinations of four texts of 50,000 characters are 240 of them
    assert got == {who: (1, hashlib.sha256(f"{who}:\n\n{timeline(who, dates, texts)}".encode()).hexdigest())
                   for who, dates in dates_of.items()}


def test_long_prompts_are_joined_at_the_call(spark):
    """Contexts of several pages, dates far apart and dates without text, under keys: whole and at the call."""
    from stratalog.operators import context
    from stratalog.plans import models, synthesis
    days = [f"2024-0{m}-1{d}" for m in range(1, 7) for d in range(3)]
    texts = {day: [f"{day}/{p}" * (5 + p) + "\n" for p in range(i % 4 + 1)] for i, day in enumerate(days) if i % 5}
    dates_of = {"near": days[:3], "far": days[::8], "all": days, "bare": [days[0]]}
    evidence, ctx = mentions_of(spark, dates_of, texts)
    chunks = context.pack_chunks(evidence, ["tenant", "id"], synthesis.evidence_order(), 1000, 3)

    def asked(**how):
        return synthesis.chunk_prompts(evidence, ctx, chunks, "{entity}>{entity_timeline}", keys=["tenant"],
                                       page_chars=150, **how)
    said = models.apply_model(asked(whole=False), lambda s, u: f"{s}{u}", "sys ").collect()
    assert {(r.id, r.page): r.reply for r in said} == {(r.id, r.page): f"sys {r.prompt}" for r in said}
    pages = {}
    for r in asked().orderBy("page").collect():
        assert r.prompt.startswith(f"{r.id}>\n\n") and r.date_range == f"{dates_of[r.id][0]} → {dates_of[r.id][-1]}"
        assert len(r.prompt) < 150 + 150 + len(f"{r.id}>\n\n")
        pages.setdefault(r.id, []).append(r.prompt[len(f"{r.id}>\n\n"):])
    assert {k: "".join(v) for k, v in pages.items()} == {who: timeline(who, d, texts) for who, d in dates_of.items()}
    assert len(pages["all"]) > 3
    calls = models.apply_model(asked(whole=False), lambda s, u: f"{s}{u}", "sys ", concurrency=3, keep=False)
    assert "prompt" not in calls.columns and {(r.id, r.page, r.reply) for r in calls.collect()} == {
        (r.id, r.page, r.reply) for r in said}


def test_a_file_per_row_is_written_by_many_tasks(spark, tmp_path):
    from stratalog.registry import source_q
    source_q._one_per_file(spark.range(64).coalesce(1), str(tmp_path / "out"))
    names = [n for n in os.listdir(tmp_path / "out") if n.endswith(".json")]
    assert len(names) == 64 and len({n.split("-")[1] for n in names}) > 8
    assert spark.read.json(str(tmp_path / "out")).distinct().count() == 64


def test_line_dated_texts_are_written_by_many_tasks(spark, con, tmp_path, monkeypatch):
    from stratalog.registry import source_q
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    paths = []
    monkeypatch.setattr(source_q, "_folder", lambda s: paths.append(str(tmp_path / f"t{len(paths)}")) or paths[-1])
    from stratalog.session import RUNTIME
    monkeypatch.setitem(RUNTIME, name, "false")
    monkeypatch.setitem(RUNTIME, "spark.sql.shuffle.partitions", "20")
    try:
        same(spark, con, "line_dated_entries", SF)
    finally:
        spark.conf.set(name, "true")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    files = [n for d, _, names in os.walk(paths[0]) for n in names if n.endswith(".txt")]
    assert len(os.listdir(paths[0])) >= 8 and len({n.split("-")[1] for n in files}) > 12
