"""File formats, sinks and streams."""

import json
import os

import pytest
from pyspark.sql import functions as F, types as T

from stratalog.functions import replies as R, text as X
from stratalog.operators import entities, ingest, search
from stratalog.plans import models
from stratalog.sources import readers, writers
from stratalog import streaming
from stratalog.schema import SUMMARY_BODY


def put(folder, name, body):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(body if isinstance(body, str) else json.dumps(body), encoding="utf-8")
    return str(path)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_merged_json(spark, tmp_path):
    path = put(tmp_path, "m.json", {"metadata": {}, "entries": [
        {"date": "2024-01-02", "entries": [{"text": " b "}, {"text": "  "},
                                           {"time": "01:00:00", "role": "assistant", "text": "c"}]},
        {"date": "2024-01-01", "entries": [{"text": ""}]}]})
    got = readers.read_merged_json(spark, path)
    assert rows(got, "date", "time", "source", "source_file", "role", "text") == [
        ("2024-01-02", "00:00:00", "unknown", "", "user", "b"),
        ("2024-01-02", "01:00:00", "unknown", "", "assistant", "c")]
    assert readers.read_merged_json(spark, path, ["user"]).count() == 1


def test_split_json_skips_broken_files(spark, tmp_path):
    put(tmp_path, "2024-01-01.json", {"entries": [{"text": "a"}]})
    put(tmp_path, "x.json", {"date": "2024-01-03", "entries": [{"text": "b", "source_file": "f"}]})
    put(tmp_path, "broken.json", "{ not json")
    assert rows(readers.read_split_json(spark, str(tmp_path)), "date", "source_file", "text") == [
        ("2024-01-01", "2024-01-01.json", "a"), ("2024-01-03", "f", "b")]


def test_dated_text(spark, tmp_path):
    for name, body in (("2025-03-17.txt", " hi \n"), ("notes.txt", "no"), ("2025-03-18.txt", " "),
                       ("2025-03-19.TXT", "caps"), ("2025-03-20.md", "# md")):
        put(tmp_path, name, body)
    assert rows(readers.read_dated_text(spark, str(tmp_path)), "date", "source", "source_file", "text") == [
        ("2025-03-17", "txt", "2025-03-17.txt", "hi"), ("2025-03-19", "txt", "2025-03-19.TXT", "caps")]
    assert rows(readers.read_dated_text(spark, str(tmp_path), "md"), "date", "source", "text") == [
        ("2025-03-20", "md", "# md")]


def test_dated_csv(spark, tmp_path):
    path = put(tmp_path, "d.csv", 'date,text\n2024-01-01,"a, ""q""\nb"\n2024-01-01,c\nbad,d\n2024-01-02,\n')
    assert rows(readers.read_dated_csv(spark, path), "date", "source_file", "text") == [
        ("2024-01-01", "d.csv", 'a, "q"\nb'), ("2024-01-01", "d.csv", "c")]


def test_chat_export(spark, tmp_path):
    path = put(tmp_path, "c.json", [
        {"title": "T", "chat": {"messages": [
            {"role": "user", "content": "hello", "timestamp": 1700000000},
            {"role": "assistant", "content": '<details type="reasoning" x>hm\n</details>\n yes ',
             "timestamp": 1700000060.9},
            {"role": "assistant", "content": '<details type="reasoning">only</details>', "timestamp": 1},
            {"role": "system", "content": "s", "timestamp": 1},
            {"role": "user", "content": "", "timestamp": 1}, {"role": "user", "content": "no time"},
            {"role": "user", "content": "bad", "timestamp": "soon"}]}},
        {"title": "Empty", "chat": {}}, {"chat": {"messages": [
            {"role": "user", "content": "untitled", "timestamp": "1700000001"}]}}])
    got = readers.read_chat_export(spark, path)
    assert rows(got, "date", "time", "source", "role", "text", "title") == [
        ("2023-11-14", "22:13:20", "owui", "user", "hello", "T"),
        ("2023-11-14", "22:13:21", "owui", "user", "untitled", "(no title)"),
        ("2023-11-14", "22:14:20", "owui", "assistant", "yes", "T")]
    assert readers.read_chat_export(spark, path, ["T"]).count() == 2
    stats = ingest.conversation_stats(readers.read_chat_messages(spark, path).filter(
        "timestamp > 1 OR timestamp IS NULL"))
    assert ("T", 3, "2023-11-14") in rows(stats, "title", "message_count", "date_start")


def test_activity_html(spark, tmp_path):
    cell = '<div class="outer-cell"><div class="content-cell">{}</div></div>'
    foot = "<br>This activity was saved to your Google Account, see Prompted settings"
    path = put(tmp_path, "a.html", "<html><title>x</title>" + "".join(map(cell.format, (
        "Prompted&nbsp;how &amp; why?<br>Jan 1, 2022, 10:00:00 PM EET<p>Because <b>so</b>.</p>" + foot,
        "Prompted first thing. A named gem was used in this chat. Manage your Gems. "
        "Feb 3, 2022, 1:05:09 AM UTC Fine." + foot,
        "Prompted nothing dated")))
               + "</html>")
    got = rows(readers.read_activity_html(spark, path), "datetime_parsed", "user", "response")
    assert ("2022-01-01T22:00:00", "how & why?", "Because so .") in got
    assert ("2022-02-03T01:05:09", "first thing.", "Fine.") in got
    entries = ingest.turns_to_entries(readers.read_activity_html(spark, path), "gemini")
    assert rows(entries.filter("date = '2022-02-03'"), "time", "role", "source_file") == [
        ("01:05:09", "assistant", "a.html"), ("01:05:09", "user", "a.html")]


def test_preparsed_and_turn_cache(spark, tmp_path):
    path = put(tmp_path, "p.json", [
        {"datetime_parsed": "2024-01-02T00:00:00", "user": " u ", "response": "r"},
        {"datetime_raw_parsed": "2024-01-01T00:00:00", "text": "t"}, {"user": "no date"},
        {"datetime_parsed": "2024-01-01"}])
    got = readers.read_preparsed_json(spark, path)
    assert rows(got, "datetime_parsed", "datetime_raw", "user", "response") == [
        ("2024-01-01T00:00:00", "2024-01-01T00:00:00", "t", ""),
        ("2024-01-02T00:00:00", "2024-01-02T00:00:00", "u", "r")]
    with pytest.raises(ValueError, match="no valid entries"):
        readers.read_preparsed_json(spark, put(tmp_path, "none.json", [{"user": "x"}]))
    writers.write_turn_cache(got, str(tmp_path / "cache"))
    again = readers.read_preparsed_json(spark, str(tmp_path / "cache"), lines=True)
    assert rows(again, "datetime_parsed", "user") == rows(got, "datetime_parsed", "user")


def test_line_dated_text(spark, tmp_path):
    path = put(tmp_path, "old.txt", "intro\n\n2020-05-02 Saturday\nfirst\n\nMay 4, 2020\nsecond\nJune 2020\nthird\n")
    assert rows(readers.read_line_dated_text(spark, path), "date", "source", "text") == [
        ("2020-05-01", "old_diary", "intro\n\n[without a date; filed before 2020-05-02]"),
        ("2020-05-02", "old_diary", "2020-05-02 Saturday\nfirst"),
        ("2020-05-04", "old_diary", "May 4, 2020\nsecond"), ("2020-06-01", "old_diary", "June 2020\nthird")]
    bare = put(tmp_path, "bare.txt", "no dates\nat all")
    assert rows(readers.read_line_dated_text(spark, bare), "date", "text") == [
        ("1970-01-01", "no dates\nat all")]
    asked = readers.read_line_dated_text(
        spark, bare, lambda s, u: "1999-09-09" if u.startswith("at") else "maybe 2001")
    assert rows(asked, "date", "text") == [
        ("1999-09-08", "no dates\n\n[without a date; filed before 1999-09-09]"),
        ("1999-09-09", "at all")]


def test_long_dated_text_in_many_parts(spark, tmp_path):
    """A file in many splits, and blocks of a few lines, give what one pass over the lines gives."""
    lines = ["above all dates"]
    for i in range(400):
        lines.append(f"2021-{i % 12 + 1:02d}-{i % 28 + 1:02d} head {i}" if i % 37 == 5 else f"line {i} " * (i % 5))
    path = put(tmp_path, "long.txt", "\n".join(lines))
    want, body, day = [], [], None
    for ln in [*lines, "2099-01-01"]:
        if ln.startswith("20"):
            if day:
                want.append((day, "\n".join(body).strip()))
            day, body = ln[:10], []
        body.append(ln)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        got = readers.read_line_dated_text(spark, path).cache()
        dated = rows(got.filter(~F.contains("text", F.lit("above all"))), "date", "text")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert dated == sorted(want)
    numbered = spark.createDataFrame([("f", i, ln) for i, ln in enumerate(lines)],
                                     "file STRING, line_no INT, line STRING")
    marked = models.detect_dates(numbered)
    whole = rows(ingest.forward_fill_dates(marked), "first_line", "datetime_parsed", "user")
    cut = ingest.forward_fill_dates(marked, block=F.floor(F.col("line_no") / 3))
    assert rows(cut, "first_line", "datetime_parsed", "user") == whole and len(whole) == len(want) + 1


def test_route_sources_and_manifest(spark, tmp_path):
    for name in ("a.JSON", "b.html", "c.txt", "d.md", "e.png", "sub/f.json"):
        put(tmp_path, name, "{}")
    found = readers.route_sources(spark, str(tmp_path))
    assert sorted((os.path.basename(r.path), r.kind) for r in found.collect()) == [
        ("a.JSON", "chat"), ("b.html", "activity"), ("c.txt", "line_dated"), ("d.md", "line_dated")]
    manifest = found.filter("kind <> 'chat'").select("path", "mtime")
    assert [os.path.basename(r.path) for r in ingest.changed_files(found, manifest).collect()] == ["a.JSON"]


def test_legacy_tree(spark, tmp_path):
    put(tmp_path, "raw_entries/2024-01-01.json", {"date": "2024-01-01", "entries": [
        {"time": "08:00:00", "source": "s", "role": "user", "text": "a"}, {"text": "b"}]})
    put(tmp_path, "raw_entries/nodate.json", {"entries": [{"text": "lost"}]})
    for level, start in (("day", "2024-01-01"), ("week", "2024-01-01"), ("month", "2024-01"), ("year", "2024")):
        put(tmp_path, f"summaries/{level}/{start}.json", {
            "unit": "wrong", "period_start": start, "period_end": start, "summary": f"{level} text",
            "energy_level": 3, "central_themes": ["dropped"]})
    put(tmp_path, "entity_profiles/john.json", {"id": "john", "display_name": "John", "aliases": ["J"],
                                                "stable_facts": {"mention_count": 2},
                                                "timestamped_knowledge": [{"valid_from": "2024-01-01"}]})
    put(tmp_path, "entity_profiles/_index.json", {"alias_map": {"johnny": "john"}})
    tree = readers.read_legacy_tree(spark, str(tmp_path))
    assert dict(rows(readers.legacy_counts(tree), "table", "rows")) == {
        "raw_entry": 2, "summary": 4, "entity_profile": 1}
    assert rows(tree["raw_entry"], "source_file", "text") == [("2024-01-01.json", "a"), ("2024-01-01.json", "b")]
    assert ("week", "week text", 3) in rows(tree["summary"], "level", "summary", "energy_level")
    got = tree["entity_profile"].first()
    assert got.stable_facts == {"mention_count": "2"} and got.timestamped_knowledge[0].valid_from == "2024-01-01"


def test_load_summaries_drops_unknown_and_fills_lists(spark):
    stored = spark.createDataFrame([("day", "2024-01-01", "2024-01-01", '{"summary": "s", "themes": 1}'),
                                    ("day", "2024-01-02", "2024-01-02", "{broken")],
                                   "level STRING, period_start STRING, period_end STRING, data_json STRING")
    got = readers.load_summaries(stored, "day")
    assert "themes" not in got.columns
    assert rows(got.select("period_start", "summary", F.size("key_events").alias("n")), "*")[0] == (
        "2024-01-01", "s", 0)
    corpus = search.index_corpus(spark.createDataFrame([], "id STRING, date STRING, text STRING"), got)
    assert rows(corpus, "source_id") == [("day:2024-01-01",)]


ENTRY = "date STRING, time STRING, source STRING, source_file STRING, role STRING, text STRING"


def test_sinks_round_trip(spark, tmp_path):
    entries = ingest.with_entry_id(spark.createDataFrame([
        ("2024-01-31", "08:00:00", "s", "f", "user", "a"), ("2024-02-01", "08:00:00", "s", "f", "user", "b")], ENTRY))
    store = str(tmp_path / "store")
    assert writers.read_store(spark, store).count() == 0
    writers.write_raw(entries, store)
    assert sorted(os.listdir(store))[-2:] == ["month=2024-01", "month=2024-02"]
    assert rows(writers.read_store(spark, store), "id") == rows(entries, "id")
    writers.export_merged(entries, str(tmp_path / "merged"))
    meta = spark.read.json(str(tmp_path / "merged/metadata")).first()
    assert (meta.total_days, meta.total_entries, meta.first_date) == (2, 2, "2024-01-31")
    back = spark.read.json(str(tmp_path / "merged/entries"))
    assert rows(back.select("date", F.explode("entries.text").alias("t")), "date", "t") == [
        ("2024-01-31", "a"), ("2024-02-01", "b")]
    writers.export_split(ingest.load_days(entries), str(tmp_path / "split"), "date")
    assert (tmp_path / "split/by_date=2024-01-31").is_dir()


def test_profile_upsert_and_index_files(spark, tmp_path):
    path = str(tmp_path / "profiles")
    schema = "id STRING, display_name STRING, aliases ARRAY<STRING>"
    writers.write_profiles(spark.createDataFrame([("a", "A", ["x"]), ("b", "B", [])], schema), path)
    writers.write_profiles(spark.createDataFrame([("b", "Bee", ["y"]), ("c", "C", [])], schema), path)
    assert rows(writers.read_table(spark, path), "id", "display_name", "aliases_json") == [
        ("a", "A", '["x"]'), ("b", "Bee", '["y"]'), ("c", "C", "[]")]
    for label in ("Ann Ö./x", "Ann B", "Ann/B"):  # the last two are alike when made safe
        notes = spark.createDataFrame([(label, "2024-01-01", f"of {label}")],
                                      "label STRING, period_start STRING, note STRING")
        writers.write_dossiers(notes, str(tmp_path / "d"))
    assert rows(writers.list_dossiers(spark, str(tmp_path / "d")), "label") == [
        ("Ann B",), ("Ann Ö./x",), ("Ann/B",)]
    for label in ("Ann Ö./x", "Ann B", "Ann/B"):
        assert rows(writers.read_dossier(spark, str(tmp_path / "d"), label), "note") == [(f"of {label}",)]
    m = spark.createDataFrame([("Vera", "zoe_k", None, None, "2024-01-01", "2024-01-01", 1),
                               ("vera", None, None, None, "2024-01-02", "2024-01-02", 2)],
                              "name_as_written STRING, normalized_name STRING, valence STRING, interaction_summary "
                              "STRING, source_date STRING, period_start STRING, seq LONG")
    writers.write_entity_index(m, str(tmp_path / "i"))
    # "vera" belongs to zoe_k and to vera: equally frequent, so the one seen later has it.
    assert rows(writers.read_alias_map(spark, str(tmp_path / "i")), "alias", "id") == [
        ("", "vera"), ("vera", "vera"), ("zoe_k", "zoe_k")]
    assert rows(entities.discover_entities(m), "id", "display_name", "appearances") == [
        ("vera", "vera", 1), ("zoe_k", "Vera", 1)]


def test_usage_and_documents(spark, tmp_path):
    calls = spark.createDataFrame([("t", "m", 1, 3, 2, 10), ("t", "m", 1, 0, 2, 10)],
                                  "timestamp STRING, model STRING, estimated_input_tokens INT, actual_input_tokens "
                                  "INT, actual_output_tokens INT, char_count INT")
    for _ in range(2):
        writers.append_usage(calls, str(tmp_path / "u"))
    got = spark.read.csv(str(tmp_path / "u"), header=True)
    assert rows(got.select(F.coalesce("empirical_ratio", F.lit("")).alias("r")), "r") == [
        ("",), ("",), ("3.3333",), ("3.3333",)]
    unit = spark.createDataFrame([("day", "day", "2024-01-01", "2024-01-01", "text", ["e1", "e2"], "peak")],
                                 "level STRING, unit STRING, period_start STRING, period_end STRING, summary STRING, "
                                 "key_events ARRAY<STRING>, peak_moment STRING")
    assert unit.select(X.summary_document(unit.columns, "md")).first()[0] == (
        "# DAY: 2024-01-01 – 2024-01-01\n\n## Summary\ntext\n\n## Key Events\n- e1\n- e2\n\n"
        "## Peak Moment\npeak\n\n")
    assert unit.select(X.summary_document(unit.columns, "txt")).first()[0].startswith("DAY: ")
    writers.write_documents(unit, str(tmp_path / "docs"))
    assert (tmp_path / "docs/level=day/period_start=2024-01-01").is_dir()
    corpus = search.index_corpus(
        spark.createDataFrame([("1", "2024-01-01", "alpha beta")], "id STRING, date STRING, text STRING"), unit)
    writers.write_index(corpus, str(tmp_path / "index"))
    postings, totals = writers.read_index(spark, str(tmp_path / "index"))
    assert postings.filter("letter = 'a'").count() == 1 and totals.first().docs == 2
    found = search.search("alph", postings, totals)
    assert [r.source_id for r in found.collect()] == ["1"]
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(letter" in plan or "PartitionFilters: [(letter" in plan


def test_mention_blocks(spark):
    blocks = ["", "none", "just some words",
              "- name_as_written: \"Vera\"\n  normalized_name: vera_holm\n  valence: positive\n"
              "  interaction_summary: Mended a net.\n  source_date: 2031-05-02\n",
              "- name_as_written: Vera\n  valence: warm\n- name_as_written: Ola\n  valence: tense",
              "name_as_written: Vera; normalized_name: vera; valence: warm; interaction_summary: hi; "
              "source_date: 2031-05-02)", "Name_As_Written: X"]
    got = [r[0] for r in spark.createDataFrame([(i, b) for i, b in enumerate(blocks)], "i INT, b STRING")
           .orderBy("i").select(R.parse_mentions("b")).collect()]
    assert [len(g or []) for g in got] == [0, 0, 0, 1, 2, 1, 1]
    assert tuple(got[3][0]) == ("Vera", "vera_holm", "positive", "Mended a net.", "2031-05-02")
    assert [(m.name_as_written, m.valence) for m in got[4]] == [("Vera", "warm"), ("Ola", "tense")]
    assert tuple(got[5][0]) == ("Vera", "vera", "warm", "hi", "2031-05-02")
    assert got[6][0].normalized_name is None


def test_reply_sections(spark):
    text = ("preface SUMMARY: not a header here\nsummary: one\nSUMMARY - two\n === X ===\n\nkey events: a, b ,c\n"
            "ENERGY LEVEL: high (4 of 5)\nScalar Metrics:\n  energy_level: 2\n  FORWARD MOMENTUM - 3\n"
            "ENTITIES:\n- [Ann]: kind\n  still kind\n* Ola - away\n- Ann: again\nOVERALL_VIBE: mixed (x)\n")
    s = R.parse_replies(spark.createDataFrame([(text,)], "reply STRING")).first().fields
    assert (s.summary, s.key_events, s.energy_level, s.forward_momentum, s.social_connectedness) == (
        "two", ["a", "b", "c"], 4, 3, None)
    assert s.entities == {"Ann": "again", "Ola": "away"} and s.overall_vibe == "MIXED"
    assert s.questions_raised == [] and s.peak_moment is None
    body = T.StructType([f for f in SUMMARY_BODY.fields if f.name in ("summary", "energy_level")])
    for reply, want in (('{"summary": "s", "energy_level": 2}', ("s", 2)),
                        ('Sure {"summary": "s"} ok', ("s", None)), ("{nope}", None), ("", None)):
        got = spark.createDataFrame([(reply,)], "r STRING").select(R.parse_json_reply("r", body)).first()[0]
        assert (tuple(got) if got else None) == (tuple(reversed(want)) if want and got.__fields__[0] != "summary" else want)


def test_threads(spark):
    block = ("- thread_job_hunt: status: escalating\n  description: looking\n  first_seen: 2024-01-01\n"
             "  last_active: 2024-02-01\n- thread_move: status: new\n  description: boxes")
    got = spark.createDataFrame([(block,)], "b STRING").select(R.parse_threads("b")).first()[0]
    assert [tuple(t) for t in got] == [
        ("thread_job_hunt", "escalating", "looking", "2024-01-01", "2024-02-01"),
        ("thread_move", "new", "boxes", None, None)]


def test_text_functions(spark):
    one = spark.range(1)
    def value(c):
        return one.select(c).first()[0]
    assert value(X.parse_datetime(F.lit("January 5, 2022, 1:02:03 PM GMT"))).hour == 13
    assert value(X.parse_datetime(F.lit("nonsense"))) is None
    assert value(X.strip_thinking(F.lit("<think>a\nb</think> x <THINK>c</THINK>"))) == "x"
    assert value(X.thinking_trace(F.lit("<think> a </think>"))) == "a"
    assert value(X.thinking_trace(F.lit("plain"))) is None
    assert value(X.normalize_id(F.lit("  Anna-Maria  K. "))) == "anna_maria_k"
    assert value(X.kwic(F.lit("The\n quick brown Fox jumps"), "fox", 6)) == "...brown >>Fox<< jumps..."
    assert value(X.kwic(F.lit("none"), "fox")) is None
    assert [value(X.match_category(F.lit(c), ["a_b", "c_b", "other_x", "misc"]))
            for c in ("A b!", "c", "b", "zzz")] == ["a_b", "c_b", "misc", "misc"]
    assert value(X.fold(F.lit("ÅÉñç"))) == "aenc" and X.fold_word("ÅÉñç") == "aenc"
    est = value(X.token_estimate(F.lit("x" * 3200), 1000, 1000))
    assert (est.estimated_tokens, est.usage_fraction, est.status) == (1000, 1.0, "danger")
    assert [value(models.date_in_line(F.lit(s))) for s in ("2024-02-30 x", "Mar 3, 2024 y", "May 2022", "hm")
            ] == [None, "2024-03-03", "2022-05-01", None]


def test_streams(spark, tmp_path):
    line = json.dumps({"date": "2024-01-03", "time": "08:00:00", "source": "s", "source_file": "f", "role": "user",
                       "text": "hi"})
    put(tmp_path, "in/1.json", line + "\n")
    put(tmp_path, "in/2.json", line + "\n")
    once = streaming.ingest_stream(spark, str(tmp_path / "in"))
    (once.writeStream.format("parquet").option("path", str(tmp_path / "out"))
     .option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1

    def run():
        streaming.merge_stream(streaming.read_stream(spark, str(tmp_path / "in")), str(tmp_path / "store"),
                               str(tmp_path / "c2"), affected=str(tmp_path / "hit")).awaitTermination()
        return writers.read_store(spark, str(tmp_path / "store"))
    assert run().count() == 1 and run().count() == 1
    put(tmp_path, "in/3.json", line.replace("2024-01-03", "2024-01-01") + "\n" + line)
    assert run().count() == 2
    hit = spark.read.parquet(str(tmp_path / "hit"))
    assert rows(hit.filter("batch = 1"), "level", "period_start") == [
        ("day", "2024-01-01"), ("month", "2024-01"), ("week", "2024-01-03"), ("year", "2024")]
    batch = streaming.read_stream(spark, str(tmp_path / "in"))
    assert batch.isStreaming
    calls = put(tmp_path, "calls/1.json", json.dumps({"timestamp": "t", "model": "m", "char_count": 10,
                                                      "actual_input_tokens": 4}) + "\n")
    schema = ("timestamp STRING, model STRING, estimated_input_tokens INT, actual_input_tokens INT, "
              "actual_output_tokens INT, char_count INT")
    streaming.usage_stream(spark.readStream.schema(schema).json(os.path.dirname(calls)), str(tmp_path / "log"),
                           str(tmp_path / "c3")).awaitTermination()
    assert spark.read.csv(str(tmp_path / "log"), header=True).first().empirical_ratio == "2.5"


def test_whole_run(spark, tmp_path):
    from stratalog.plans import hierarchy, pipeline
    raw, store = tmp_path / "raw", str(tmp_path / "store")
    put(raw, "chat.json", [{"title": "T", "chat": {"messages": [
        {"role": "user", "content": "hello", "timestamp": 1700000000}]}}])
    put(raw, "act.html", "<div>Prompted code<br>Nov 14, 2023, 1:00:00 PM UTC<p>ok</p></div>"
                         "<div>Prompted feelings<br>Nov 15, 2023, 1:00:00 PM UTC<p>hm</p></div>")
    put(raw, "old.md", "2023-11-20\nfirst")

    calls = spark.sparkContext.accumulator(0)

    def label(system, user):
        calls.add(1)
        return "coding related" if "code" in user else "therapy"
    parsing = {"label": label, "keep": ["self_reflection_psychology_therapy_dating"],
               "journal": str(tmp_path / "journal")}
    dry = pipeline.run_ingest(spark, str(raw), store, dry_run=True, **parsing)
    assert tuple(dry.stats.first()) == (3, 4, 0) and not (tmp_path / "store").exists()
    asked = calls.value
    assert asked > 0 and dry.manifest.count() == 0
    run = pipeline.run_ingest(spark, str(raw), store, **parsing)
    assert tuple(run.stats.first()) == (3, 4, 0) and calls.value == asked
    units = pipeline.update_units(spark, store, None, run.dates)
    assert units.filter("level = 'day'").count() == 3
    again = pipeline.run_ingest(spark, str(raw), store, run.manifest, **parsing)
    assert tuple(again.stats.first()) == (0, 0, 0) and again.dates.count() == 0
    put(raw, "late.txt", "2023-11-14\nlate\n2023-12-01\nlater")
    more = pipeline.run_ingest(spark, str(raw), store, run.manifest, **parsing)
    assert tuple(more.stats.first()) == (1, 2, 0)  # the files that stayed are not read again
    assert rows(more.dates, "date") == [("2023-11-14",), ("2023-12-01",)]
    units = pipeline.update_units(spark, store, units, more.dates)
    path = str(tmp_path / "units")
    writers.write_units(units, path)
    writers.write_units(units.filter("level = 'week'").withColumn("period_end", F.lit("x")), path)
    saved = writers.read_units(spark, path)
    assert saved.count() == units.count() and saved.filter("period_end = 'x'").count() == units.filter(
        "level = 'week'").count()
    full = hierarchy.structural_units(writers.read_store(spark, store))
    assert rows(units, *hierarchy.UNIT) == rows(full, *hierarchy.UNIT)
