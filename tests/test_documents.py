"""Large JSON documents, cut at braces and read by many tasks."""

import json
import random

import pytest

from stratalog.sources import documents, readers


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def odd(rng):
    """Strings with everything that could be taken for structure."""
    return "".join(rng.choices(['"', "\\", "{", "}", "[", "]", ",", ":", "\n", "é", "漢", "a", " ", '\\"', "\\\\"],
                               k=rng.randrange(0, 25)))


def nested(rng, depth=0):
    kind = rng.randrange(6 if depth < 3 else 3)
    if kind < 3:
        return rng.choice([odd(rng), rng.randrange(100), None, True, 1.5])
    if kind == 3:
        return [nested(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {odd(rng): nested(rng, depth + 1) for _ in range(rng.randrange(4))}


@pytest.mark.parametrize("seed", range(3))
def test_records_equal_a_parser(spark, tmp_path, small_splits, monkeypatch, seed):
    rng = random.Random(seed)
    monkeypatch.setattr(documents, "PIECES_PER_BLOCK", 7)
    docs = {}
    for k in range(4):
        records = [{"x": odd(rng), "y": nested(rng), "k": i} for i in range(rng.randrange(0, 60))]
        text = json.dumps(records, ensure_ascii=bool(rng.randrange(2)), indent=rng.choice([None, 2]))
        docs[f"{k}.json"] = records
        (tmp_path / f"{k}.json").write_text(rng.choice(["", "\n ", "﻿"]) + text + rng.choice(["", "\n"]),
                                            encoding="utf-8")
    found = documents.json_records(spark, str(tmp_path))
    assert documents.json_tokens(spark, str(tmp_path)).rdd.getNumPartitions() >= 4
    got = {}
    for r in found.orderBy("file", "place").collect():
        got.setdefault(r.file.rsplit("/", 1)[1], []).append(json.loads(r.json, strict=False))
    assert got == {name: records for name, records in docs.items() if records}


def test_objects_at_a_depth(spark, tmp_path):
    one = {"about": {"a": "{[\"}"}, "entries": [{"date": "d1", "entries": [{"text": "}"}]}, {"date": "d2"}]}
    (tmp_path / "one.json").write_text(json.dumps(one))
    (tmp_path / "two.json").write_text(json.dumps([one, one]))
    (tmp_path / "cut.json").write_text(json.dumps(one)[:-16])
    (tmp_path / "none.json").write_text("")
    (tmp_path / "text.json").write_text("no json at all")
    got = documents.json_records(spark, str(tmp_path), 2).collect()
    days = sorted((r.file.rsplit("/", 1)[1], json.loads(r.json)["date"]) for r in got if r.json.endswith("}"))
    assert days == [("cut.json", "d1"), ("one.json", "d1"), ("one.json", "d2")] + [
        ("two.json", d) for d in ("d1", "d1", "d2", "d2")]
    whole = documents.json_records(spark, str(tmp_path / "one.json")).first().json
    assert json.loads(whole) == one


def test_one_export_in_many_parts(spark, tmp_path, small_splits):
    """Chats, days and turns of one file each, read as they would be from whole documents."""
    rng = random.Random(9)
    chats = [{"title": f"t{i} {odd(rng)}", "chat": {"messages": [
        {"role": "user", "content": f"m{k} {odd(rng)}", "timestamp": 1700000000 + i * 100 + k} for k in range(3)]}}
        for i in range(80)]
    (tmp_path / "chats.json").write_text(json.dumps(chats))
    got = readers.read_chat_export(spark, str(tmp_path / "chats.json"))
    want = sorted((c["title"], m["content"].strip(" \t\n\r\x0b\x0c")) for c in chats for m in c["chat"]["messages"])
    assert sorted((r.title, r.text) for r in got.collect()) == want
    days = {"entries": [{"date": f"2024-01-{i:02d}", "entries": [{"text": f"e{i}{k}"} for k in range(5)]}
                        for i in range(1, 29)], "note": "]}"}
    (tmp_path / "days.json").write_text(json.dumps(days))
    assert documents.json_tokens(spark, str(tmp_path / "days.json")).rdd.getNumPartitions() >= 4
    got = readers.read_merged_json(spark, str(tmp_path / "days.json"))
    assert sorted((r.date, r.text) for r in got.collect()) == sorted(
        (d["date"], e["text"]) for d in days["entries"] for e in d["entries"])
    turns = [{"datetime_parsed": f"2024-01-01T00:00:{i:02d}", "user": f"u {{ {i}"} for i in range(60)]
    (tmp_path / "turns.json").write_text(json.dumps(turns))
    got = readers.read_preparsed_json(spark, str(tmp_path / "turns.json"))
    assert sorted((r.datetime_parsed, r.user, r.source_file) for r in got.collect()) == [
        (t["datetime_parsed"], t["user"], "turns.json") for t in turns]
