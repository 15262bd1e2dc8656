"""Waves of units, journals of calls, prompts that keep to the window."""

import os
import random

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from stratalog.functions import replies as R, text as X
from stratalog.operators import ingest, periods
from stratalog.plans import hierarchy, models, prompts, waves
from stratalog.registry.wave_q import quote
from stratalog.sources import readers

UNITS = ("level STRING, period_start STRING, period_end STRING, source_units ARRAY<STRING>, "
         "source_entry_count LONG, summary STRING, stream STRING")


def weeks(spark, stored, streams=("a",), n=12):
    """Days and weeks of 2024; the weeks named in ``stored`` (stream, number) have a summary."""
    days, out = [], []
    for s in streams:
        for w in range(n):
            day = f"2024-{1 + w // 4:02d}-{1 + 7 * (w % 4):02d}"
            days.append(("day", day, day, [day], 1, f"day {s}{w}", s))
            if (s, w) in stored:
                out.append(("week", day, day, [day], 1, f"week {s}{w}", s))
    return spark.createDataFrame(days + out, UNITS)


def pending_of(units, keys):
    below = periods.filter_level(units, "day")
    return ingest.pending_units(periods.rollup_level(below, "week", keys), units, keys)


def test_runs_and_waves(spark):
    stored = {("a", 0), ("a", 1), ("a", 4), ("a", 7), ("a", 8), ("b", 11)}
    units = weeks(spark, stored, ("a", "b"))
    got = {(r.stream, r.period_start): r for r in waves.frontier(
        pending_of(units, ["stream"]), units, "week", 2, ["stream"]).collect()}
    a = [r for k, r in sorted(got.items()) if k[0] == "a"]
    # Weeks 2 3 | 5 6 | 9 10 11: one stored week between does not part a run of two looking back, two do.
    assert [(r.run, r.wave) for r in a] == [(1, 1), (1, 2), (1, 3), (1, 4), (2, 1), (2, 2), (2, 3)]
    assert [len(r.between) for r in a] == [2, 0, 1, 0, 2, 0, 0]
    assert [r.wave for k, r in sorted(got.items()) if k[0] == "b"] == list(range(1, 12))
    alone = waves.frontier(pending_of(units, ["stream"]), units, "week", 0, ["stream"])
    assert {r.wave for r in alone.collect()} == {1}


@pytest.mark.parametrize("seed", [1, 2])
def test_waves_equal_asking_one_unit_after_the_other(spark, seed):
    rng = random.Random(seed)
    stored = {(s, w) for s in "ab" for w in range(12) if rng.random() < 0.4}
    units = weeks(spark, stored, "ab")
    template = "{date}|{history}|{entries}"
    describe = hierarchy.describe_with(quote, units.limit(0), {"week_historical": template}, "sys", 2,
                                       keys=["stream"])
    got = {(r.stream, r.period_start): r.summary for r in describe(
        "week", pending_of(units, ["stream"]), units).collect()}
    want = {}
    for s in "ab":
        told = []
        for w in range(12):
            day = f"2024-{1 + w // 4:02d}-{1 + 7 * (w % 4):02d}"
            entries = f"[{day} — {day}]\nSummary: day {s}{w}"
            if (s, w) in stored:
                text = f"week {s}{w}"
            else:
                before = [f"[{d} — {d}]\nSummary: day {s}{k}" for k, d in enumerate(days_before(w))][-14:]
                history = prompts.RULE.join(told[-2:]) if told else (
                    prompts.BELOW_NOTE.format(level="week", child="day") + prompts.RULE.join(before)
                    if before else prompts.NO_HISTORY)
                text = quote("sys", f"{day}|{history}|{entries}").removeprefix("SUMMARY: ")
                want[s, day] = text
            told.append(f"[{day} — {day}]\nSummary: {text}")
    assert got == want


def days_before(w):
    return [f"2024-{1 + k // 4:02d}-{1 + 7 * (k % 4):02d}" for k in range(w)]


def test_prompts_keep_to_the_window(spark):
    """Grandchildren go first, then history, and children that do not fit come in pages."""
    days = [("day", f"2024-01-{d:02d}", f"2024-01-{d:02d}", [f"2024-01-{d:02d}"], 1, "x" * 900, "a")
            for d in range(1, 15)]
    weeks_ = [("week", "2023-12-25", "2023-12-31", ["2023-12-25"], 1, "p" * 3000, "a"),
              ("week", "2023-12-18", "2023-12-24", ["2023-12-18"], 1, "q" * 3000, "a")]
    units = spark.createDataFrame(days + weeks_, UNITS)
    parents = periods.rollup_level(periods.filter_level(units.filter("period_start > '2024'"), "day"), "week")
    items = units.filter("level = 'day'").select(F.col("period_start").alias("item"), F.repeat(F.lit("g"), F.lit(500))
                                                 .alias("text"))
    template = "{date}\n{history}\n{entries}\n{grandchild_items}"

    def asked(tokens):
        rows = prompts.level_prompts(units, "week", template, "sys", 2, tokens + 1024 + 5000, 1024, items, parents)
        return [r for r in rows.orderBy("period_start", "page").collect() if r.period_start == "2024-01-01"]

    whole = asked(6000)[0]
    assert (whole.n_children, whole.n_grandchildren, whole.n_history, whole.n_dropped) == (7, 7, 2, 0)
    for tokens in (5000, 4400, 4200, 3400, 3000, 2400, 2100):
        rows = asked(tokens)
        assert all(r.prompt_chars + 4 <= (tokens + 1) * X.CHARS_PER_TOKEN for r in rows)
        first = rows[0]
        assert first.n_history + first.n_grandchildren + first.n_dropped == 9
        if first.n_history < 2:
            assert first.n_grandchildren == 0
    pages = asked(1000)
    assert len(pages) > 2 and [r.page for r in pages] == list(range(len(pages)))
    assert all(r.prompt_chars + 4 <= 1001 * X.CHARS_PER_TOKEN and r.n_history == 0 for r in pages)
    assert sum(r.prompt.count("Summary: ") for r in pages) == 7
    assert pages[1].prompt.startswith(f"2024-01-01\n{prompts.NO_HISTORY}\n(part 2 of {len(pages)})")


def test_pages_of_a_unit_are_merged(spark):
    units = spark.createDataFrame(
        [("day", f"2024-01-{d:02d}", f"2024-01-{d:02d}", [f"2024-01-{d:02d}"], 1, f"{d}" + "x" * 900, "a")
         for d in range(1, 8)], UNITS)

    def model(system, user):
        heads = [ln[1:11] for ln in user.split("\n") if ln.startswith("[2024")]
        return "KEY_EVENTS:\n" + "\n".join(f"- {h}" for h in heads)

    describe = hierarchy.describe_with(model, units.limit(0), {"week_historical": "{history}>>\n{entries}"}, "sys", 1,
                                       1000 + 1024 + 5000)
    row = describe("week", pending_of(units, []), units).first()
    assert row.key_events == [f"2024-01-{d:02d}" for d in range(1, 8)]


# --- journals ------------------------------------------------------------------------------


def counting(folder, answer="done", dies_on=None):
    """A model that leaves a file per call and may take its worker down."""
    def model(system, user):
        if dies_on is not None and user.startswith(dies_on) and os.path.exists(f"{folder}/deadly"):
            os._exit(1)
        with open(f"{folder}/calls", "a") as f:
            f.write(f"{user}\n")
        if user.startswith("fails"):
            raise ValueError("no answer")
        return f"{answer} {user}"
    return model


def calls(folder):
    path = f"{folder}/calls"
    return open(path).read().split("\n")[:-1] if os.path.exists(path) else []


def test_a_run_that_dies_is_resumed(spark, tmp_path):
    folder, journal = str(tmp_path), str(tmp_path / "journal")
    rows = spark.createDataFrame([(i, f"p{i:03d}") for i in range(200)], "i LONG, prompt STRING")
    open(f"{folder}/deadly", "w").close()
    # The last batch by hash has the deadly prompt, so some batches are committed before it.
    keyed = rows.withColumn("b", F.pmod(F.xxhash64(models.call_key("sys", "prompt")), F.lit(10)))
    deadly = keyed.filter("b >= 6").orderBy("b", "i").first().prompt
    with pytest.raises(Py4JJavaError):
        models.apply_model(rows, counting(folder, dies_on=deadly), "sys", journal=journal, commit_calls=20).collect()
    kept = models.read_journal(spark, journal).count()
    assert 0 < kept < 200
    os.rename(f"{folder}/deadly", f"{folder}/mended")
    before = len(calls(folder))
    done = models.apply_model(rows, counting(folder), "sys", journal=journal, commit_calls=20).collect()
    assert len(done) == 200 and all(r.reply == f"done {r.prompt}" for r in done)
    assert len(calls(folder)) - before == 200 - kept
    again = models.apply_model(rows.union(rows), counting(folder), "sys", journal=journal).collect()
    assert len(again) == 400 and len(calls(folder)) - before == 200 - kept
    # Another system text is another call.
    assert models.apply_model(rows.limit(1), counting(folder, "other"), "sys2", journal=journal
                              ).first().reply.startswith("other")


def test_errors_and_repeats(spark, tmp_path):
    folder, journal = str(tmp_path), str(tmp_path / "journal")
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "fails"), (4, None)], "i LONG, prompt STRING")
    got = {r.i: r for r in models.apply_model(rows, counting(folder), journal=journal).collect()}
    assert got[1].reply == got[2].reply == "done a" and got[4].reply is None and got[4].error is None
    assert got[3].error == "ValueError: no answer" and got[3].reply is None
    assert sorted(calls(folder)) == ["a", "fails"]
    models.apply_model(rows, counting(folder), journal=journal).collect()
    assert sorted(calls(folder)) == ["a", "fails", "fails"]  # an error is tried anew
    empty = models.apply_model(rows.limit(0), counting(folder), journal=str(tmp_path / "none"))
    assert empty.count() == 0 and empty.columns == ["i", "prompt", "reply", "error", "tokens_in", "tokens_out",
                                                    "seconds"]


def test_jobs_of_a_journal_follow_the_logarithm_of_its_calls(spark, tmp_path):
    rows = spark.range(100).selectExpr("id", "if(id % 10 = 3, 'fails', concat('p', id)) AS prompt")
    sc, folder = spark.sparkContext, str(tmp_path)
    sc.setJobGroup("journal", "journal")
    try:
        done = models.apply_model(rows, counting(folder), journal=f"{folder}/journal", commit_calls=1).collect()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(sc.statusTracker().getJobIdsForGroup("journal")) < 60
    assert sorted(calls(folder)) == sorted({r.prompt for r in done})
    assert all(r.error == "ValueError: no answer" if r.prompt == "fails" else r.reply == f"done {r.prompt}" for r in done)
    assert models.read_journal(spark, f"{folder}/journal").count() == 90
    slow = models.apply_model(rows, counting(folder), "s", concurrency=2, journal=f"{folder}/slow", commit_calls=30)
    assert len(slow.collect()) == 100 and models._doubling(10) == [1, 1, 2, 4, 2] and models._doubling(0) == []


def test_labels_follow_the_text_not_its_place(spark, tmp_path):
    """A new export with a turn on top shifts all places; old turns keep their labels unasked."""
    folder, journal = str(tmp_path), str(tmp_path / "labels")

    def label(system, user):
        with open(f"{folder}/calls", "a") as f:
            f.write("call\n")
        return "coding related" if "code" in user else "other"

    old = [("f.html", 0, "code"), ("f.html", 1, "walk")]
    new = [("f.html", 0, "swim"), ("f.html", 1, "code"), ("f.html", 2, "walk")]
    schema = "file STRING, msg_index INT, user STRING"
    for rows, n in ((old, 2), (new, 3)):
        turns = spark.createDataFrame(rows, schema).withColumn("response", F.lit("r"))
        got = {r.user: r.category for r in models.classify(turns, label, journal=journal).collect()}
        assert got["code"] == "coding_related" and got["walk"] == "other" and len(calls(folder)) == n


# --- texts ---------------------------------------------------------------------------------


def test_paragraphs_headings_and_items():
    told = readers.paragraph_text
    assert told("no<p>a <b>b</b>&amp;c</p>out<h3>d</h3><h2>e</h2><ul><li>f<p>g</p></li></ul>") == "a b &c d f g g"
    assert told("<p>a<br>b<img src='>'/>c") == "a b '/>c"
    assert told("<div><p>open<li>in</div>after<p>next") == "open in in next"
    assert told(f"<p>a</p><p>b {readers.ACTIVITY_FOOTER}</p><p>c</p>") == "a"
    assert told("text only </p> <!-- <p>x</p> -->") == "" and told("") == ""
    assert told("<P>up</P>") == "up" and told("<p>" * 2000 + "x") == " ".join(["x"] * 2000)


def test_cells_are_cut_before_anything_else(spark):
    foot = f"<div>{readers.ACTIVITY_FOOTER}</div><p>settings</p></div>"
    page = ("<div title='Prompted x'>Prompted first. Then. Gem was used in this chat. Manage your Gems. "
            "Feb 3, 2022, 1:05:09 AM UTC<br>loose<p>one</p><h3>two</h3>" + foot
            + "Prompted second. Or. Gem was used in this chat. Manage your Gems. Feb 4, 2022, 1:05:09 AM UTC flat" + foot
            + "Prompted third<br>Feb 5, 2022, 1:05:09 AM UTC out <p>in</p>" + foot)
    got = readers.activity_turns(spark.createDataFrame([(page,)], "html STRING")).collect()
    assert [(r.user, r.response) for r in got] == [
        ("first. Then.", "one two"), ("second. Or.", "flat"), ("third", "out in")]


def test_huge_entries_come_in_pages(spark):
    """Text without a date for many blocks is pages of bounded size, and the rest is as before."""
    lines = [("f", i, f"line {i}", None) for i in range(100)]
    lines[3] = ("f", 3, "2020-01-01", "2020-01-01")
    lines[90] = ("f", 90, "2020-02-02", "2020-02-02")
    df = spark.createDataFrame(lines, "file STRING, line_no INT, line STRING, anchor STRING")
    block = F.floor(F.col("line_no") / 10)
    got = ingest.forward_fill_dates(df, block=block, page_chars=200).orderBy("first_line", "page").collect()
    big = [r for r in got if r.first_line == 3]
    assert len(big) > 2 and [r.page for r in big] == sorted({r.page for r in big})
    assert "\n".join(r.user for r in big) == "\n".join(r[2] for r in lines[3:90])
    assert max(len(r.user) for r in big) < 200 + 90
    assert {r.datetime_parsed for r in big} == {"2020-01-01T00:00:00"}
    assert {r.datetime_raw for r in big} == {"2020-01-01"}
    whole = ingest.forward_fill_dates(df, block=block).orderBy("first_line").collect()
    assert [(r.first_line, r.page) for r in whole] == [(0, 0), (3, 0), (90, 0)]
    bare = ingest.resolve_undated(ingest.forward_fill_dates(
        df.filter("line_no < 60").withColumn("anchor", F.lit(None).cast("string")).unionByName(
            df.filter("line_no = 90")), block=block, page_chars=200))
    notes = [r.user for r in bare.orderBy("first_line", "page").collect() if "without a date" in r.user]
    assert len(notes) == 1 and notes[0].startswith("line") and "line 59" in notes[0]


def test_files_of_one_name_in_two_folders(spark, tmp_path):
    for folder, day in (("a", "2020-01-01"), ("b", "2021-01-01")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "same +x.txt").write_text(f"early\n{day}\nlate")
    got = readers.read_line_dated_text(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
    assert sorted((r.date, r.source_file) for r in got.collect()) == [
        ("2019-12-31", "same +x.txt"), ("2020-01-01", "same +x.txt"),
        ("2020-12-31", "same +x.txt"), ("2021-01-01", "same +x.txt")]


def test_entity_notes_and_fields_between_punctuation(spark):
    df = spark.createDataFrame([("- [Ann]: calls - twice\n* Bob - waits\n  and waits\nno note\n• [Cy] : x\n-: y",
                                 "name_as_written: Ann; valence: warm - interaction_summary: (met); "
                                 "NAME_AS_WRITTEN: Bob, source_date: 2024-01-01)")], "notes STRING, block STRING")
    r = df.select(R.last_per_key(R.entity_notes("notes")).alias("n"), R.parse_mentions("block").alias("m")).first()
    assert r.n["Ann"] == "calls - twice" and r.n["Bob"] == "waits and waits no note" and r.n["Cy"].startswith("x")
    assert [(m.name_as_written, m.valence, m.interaction_summary, m.source_date) for m in r.m] == [
        ("Ann", "warm", "(met", None), ("Bob", None, None, "2024-01-01")]
