"""Paging, context windows, budgets, chunks, hierarchy, prompts: against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from stratalog.functions import replies as R, text as X
from stratalog.operators import context, entities, ingest, paging, periods
from stratalog.plans import hierarchy, models, prompts, synthesis

ENTRY = "date STRING, time STRING, source STRING, source_file STRING, role STRING, text STRING"


def make_entries(spark, n=400, hot=0.4, seed=3):
    """Entries on a few dates; one date holds ``hot`` of them, many at one time."""
    rnd = random.Random(seed)
    days = [f"2024-0{m}-{d:02d}" for m in (1, 2, 3) for d in (1, 2, 3, 5, 8, 29)]
    rows = []
    for i in range(n):
        day = "2024-02-02" if rnd.random() < hot else rnd.choice(days)
        time = "12:00:00" if rnd.random() < 0.5 else f"{rnd.randrange(24):02d}:{rnd.randrange(60):02d}:07"
        rows.append((day, time, "s", f"f{i}", rnd.choice(["user", "assistant", "system"]),
                     "w" * rnd.randrange(1, 40) + f" {i}"))
    return ingest.with_entry_id(spark.createDataFrame(rows, ENTRY)).cache()


@pytest.fixture(scope="module")
def entries(spark):
    return make_entries(spark)


@pytest.fixture(scope="module")
def by_day(entries):
    days = {}
    for r in sorted(entries.collect(), key=lambda r: (r.date, r.time, r.id)):
        days.setdefault(r.date, []).append(r)
    return days


def line(r):
    return f"[{r.time} - {r.role if r.role != 'system' else 'user'}]: {r.text}"


def test_pages_of_a_day_join_to_its_whole_text(entries, by_day):
    pages = {}
    for r in ingest.day_text(entries, page_chars=200).collect():
        assert r.chars == len(r.text) and r.chars <= 200 + 80
        pages.setdefault(r.date, {})[r.page] = r
    for day, rows in by_day.items():
        whole, at = "\n\n".join(map(line, rows)), 0
        for p in sorted(pages[day]):
            assert pages[day][p].start == at and whole[at:].startswith(pages[day][p].text)
            at += pages[day][p].chars + 2
        assert at == len(whole) + 2
    assert max(len(p) for p in pages.values()) > 10
    single = {r.date: r.text for r in ingest.day_text(entries).collect()}
    assert single == {d: "\n\n".join(map(line, rows)) for d, rows in by_day.items()}


def test_positions_and_nested_days(entries, by_day):
    got = {(r.date, r.position): r.id for r in paging.position(
        entries, ["date"], paging.by_time_and_id()).collect()}
    assert got == {(d, i): r.id for d, rows in by_day.items() for i, r in enumerate(rows)}
    nested = ingest.load_days(entries, ["user"], page_chars=150).orderBy("date", "page").collect()
    flat = [(r.date, e.id) for r in nested for e in r.entries]
    assert flat == [(d, r.id) for d, rows in sorted(by_day.items()) for r in rows if r.role == "user"]


def test_rows_without_time_are_kept(spark):
    rows = ingest.with_entry_id(spark.createDataFrame(
        [("2024-01-01", None, "s", "f", "user", "a"), ("2024-01-01", "08:00:00", "s", "f", "user", "b")],
        ENTRY))
    got = ingest.load_days(rows).first()
    assert [e.text for e in got.entries] == ["a", "b"]


def context_of(by_day, center, before, after):
    from datetime import date, timedelta
    out = []
    for delta in range(-before, after + 1):
        d = str(date.fromisoformat(center) + timedelta(days=delta))
        if d in by_day:
            label = "day of mention" if delta == 0 else (
                f"{-delta} day(s) before" if delta < 0 else f"{delta} day(s) after")
            body = "\n".join(f"  [{r.time}] {r.text.strip()}" for r in by_day[d])
            out.append(f"=== Raw entries: {d} ({label}) ===\n{body}")
    return "\n\n".join(out)


@pytest.mark.parametrize("page", [300, 4_000_000])
def test_context_window(spark, entries, by_day, page):
    centers = ["2024-02-02", "2024-02-04", "2024-03-01", "2024-02-28", "bad-date", "2030-01-01"]
    asked = spark.createDataFrame([(c,) for c in centers * 2], "center_date STRING")
    got = {}
    for r in context.context_window(entries, asked, 1, 2, page_chars=page).orderBy("page").collect():
        assert r.start == len(got.get(r.center_date, "")) and r.chars == len(r.text)
        got[r.center_date] = got.get(r.center_date, "") + r.text
    want = {c: context_of(by_day, c, 1, 2) for c in centers[:4]}
    assert got == {c: t for c, t in want.items() if t}


def greedy(tokens, budget, overlap):
    """Packing as its definition says, block by block."""
    chunks, current, total = [], [], 0
    for i, t in enumerate(tokens):
        if current and total + t > budget:
            chunks.append(current)
            current = current[-overlap:] if overlap else []
            total = sum(tokens[j] for j in current)
        current = current + [i]
        total += t
    return chunks + [current] if current else chunks


@pytest.mark.parametrize("overlap,segment", [(0, 65_536), (3, 65_536), (3, 16), (2, 7), (0, 5)])
def test_pack_chunks_is_greedy(spark, overlap, segment):
    rnd = random.Random(overlap * 100 + segment)
    sizes = {"big": [rnd.choice([1, 5, 20, 40, 90, 300]) for _ in range(150)],
             "one": [700], "even": [50] * 30, "zero": [0, 0, 3, 0, 99, 0, 0, 101, 0],
             "spiky": [101, 1, 101, 1, 1, 250, 250, 1]}
    rows = [(k, "2024-01-01", i, t) for k, ts in sizes.items() for i, t in enumerate(ts)]
    blocks = spark.createDataFrame(rows, "id STRING, period_start STRING, seq LONG, tokens LONG")
    got = {}
    for r in context.pack_chunks(blocks, ["id"], synthesis.evidence_order(), 100, overlap,
                                 segment=segment).collect():
        got.setdefault(r.id, {}).setdefault(r.chunk, []).append(r.block)
    for k, ts in sizes.items():
        want = greedy(ts, 100, overlap)
        assert [sorted(got[k][c]) for c in sorted(got[k])] == want, k


def test_chunk_budget():
    assert context.chunk_budget(32_768, 3000, 900) == 32_768 - 3000 - 900 - 1638
    with pytest.raises(ValueError):
        context.chunk_budget(1000, 3000, 900)


def test_budget_keeps_the_longest_fitting_suffix(entries, by_day):
    limit, fixed, n = 260, 37, 5
    kept = {}
    for r in context.day_history(entries, n, limit, fixed).collect():
        kept.setdefault(r.date, []).append(r.past)
    from datetime import date, timedelta
    text = {d: "\n\n".join(map(line, rows)) for d, rows in by_day.items()}
    for d in by_day:
        first = str(date.fromisoformat(d) - timedelta(days=n))
        items = [p for p in sorted(by_day) if first <= p < d]
        while items and int((fixed + len(text[d]) + len(
                "\n\n".join(f"[{p}]\n{text[p]}" for p in items))) / 3.2) > limit:
            items.pop(0)
        assert sorted(kept.get(d, [])) == items


def test_day_prompts_fill_the_template(entries, by_day):
    template = "D {date} N {n}\n{history}\n>>{entries}<<{date}"
    got, most = {}, 0
    for r in prompts.day_prompts(entries, template, "sys", 3, 3600, 1024).orderBy("page").collect():
        got.setdefault(r.date, []).append(r)
        most = max(most, r.page)
    assert most > 0
    for d, rows in by_day.items():
        own = "\n\n".join(map(line, rows))
        parts = got[d]
        told = [r.prompt.split(">>", 1)[1].removesuffix(f"<<{d}") for r in parts]
        if len(parts) > 1:
            told = [t.removeprefix(f"(part {i + 1} of {len(parts)})\n") for i, t in enumerate(told)]
            assert all(r.n_history == 0 for r in parts)
        assert "\n\n".join(told) == own and [r.page for r in parts] == list(range(len(parts)))
        for r in parts:
            assert r.prompt.startswith(f"D {d} N 3\n") and r.prompt.endswith(f"<<{d}")
            assert (len(r.prompt) + 4) / 3.2 < 3600 - 1024 - 2000 + 1
    isolated = prompts.day_prompts(entries, "{date}: {entries}", "sys", 3)
    assert {r.n_history for r in isolated.collect()} == {0}
    with pytest.raises(ValueError):
        prompts.day_prompts(entries, "no place", "sys")


def test_level_prompts_history_fallback(spark):
    days = [("day", f"2024-01-{d:02d}", f"2024-01-{d:02d}", f"s{d}", 1) for d in (2, 3, 9, 10)]
    units = spark.createDataFrame(days, "level STRING, period_start STRING, period_end STRING, "
                                        "summary STRING, source_entry_count LONG").withColumn(
        "source_units", F.array("period_start"))
    late = periods.rollup_level(units.filter("period_start > '2024-01-05'"), "week")
    got = prompts.level_prompts(units, "week", "{date}|{history}|{entries}", "sys", 1,
                                parents=late).first()
    assert got.prompt == (
        "2024-01-09|(No earlier week is known; these are the 'day' summaries before it.)"
        "\n\n[2024-01-02 — 2024-01-02]\nSummary: s2\n\n---\n\n[2024-01-03 — 2024-01-03]\nSummary: s3"
        "|[2024-01-09 — 2024-01-09]\nSummary: s9\n\n---\n\n[2024-01-10 — 2024-01-10]\nSummary: s10")
    both = prompts.level_prompts(units, "week", "{history}{entries}", "sys", 1)
    assert both.filter("period_start = '2024-01-02'").first().prompt.startswith(prompts.NO_HISTORY)


def test_rollup_conserves_entries_and_straddles(spark, entries):
    units = hierarchy.structural_units(entries).cache()
    total = entries.count()
    sums = {r.level: r.n for r in units.groupBy("level").agg(
        F.sum("source_entry_count").alias("n")).collect()}
    assert sums == dict.fromkeys(("day", "week", "month", "year"), total)
    # 2024-01-29 opens a week that runs into February; the week counts for January.
    jan = units.filter("level = 'month' AND period_start = '2024-01'").first()
    assert "2024-01-29" in jan.source_units and jan.period_end == "2024-02-03"
    week = units.filter("level = 'week' AND period_start = '2024-01-29'").first()
    assert week.source_units == ["2024-01-29", "2024-02-01", "2024-02-02", "2024-02-03"]


def test_keys_keep_streams_apart(spark, entries):
    two = entries.withColumn("tenant", F.lit("a")).union(
        entries.filter("date < '2024-02-01'").withColumn("tenant", F.lit("b")))
    units = hierarchy.structural_units(two, keys=["tenant"])
    assert units.filter("tenant = 'a' AND level = 'year'").first().source_entry_count == entries.count()
    assert units.filter("tenant = 'b' AND level = 'month'").count() == 1
    assert ingest.day_text(two, keys=["tenant"]).filter("tenant = 'b'").count() == 6


def test_incremental_run_equals_full_run(spark, entries):
    full = {tuple(r)[:3] + (tuple(r.source_units), r.source_entry_count)
            for r in hierarchy.structural_units(entries).select(*hierarchy.UNIT).collect()}
    early = hierarchy.structural_units(entries.filter("date <> '2024-01-29' AND date <> '2024-02-01'"))
    done = hierarchy.run_hierarchy(entries, early)
    assert {tuple(r)[:3] + (tuple(r.source_units), r.source_entry_count)
            for r in done.select(*hierarchy.UNIT).collect()} == full
    days = hierarchy.run_hierarchy(entries, levels=("day",), target_range=("2024-02-02", "2024-02-05"),
                                   history_n=2)
    assert [r.period_start for r in days.orderBy("period_start").collect()] == [
        "2024-01-29", "2024-02-01", "2024-02-02", "2024-02-03", "2024-02-05"]


def test_run_with_a_model(entries):
    small = entries.filter("date < '2024-02-01'")
    templates = {"day_isolated": "{date}\n{entries}", **{
        f"{u}_isolated": "{date}\n{entries}" for u in ("week", "month", "year")}}
    describe = hierarchy.describe_with(models.stub_model, small, templates, "sys", concurrency=2)
    got = hierarchy.run_hierarchy(small, describe=describe)
    assert {r.level: r.n for r in got.groupBy("level").agg(F.count("summary").alias("n")).collect()
            }["day"] == 6
    assert got.filter("summary IS NULL OR energy_level IS NULL OR emotional_tone <> 'calm'").count() == 0


def test_pages_of_a_day_keep_all_notes(spark):
    replies = ["ENTITIES:\n- [Ann]: calls\n- [Bob]: waits\nKEY_EVENTS:\n- a\n- b\nSUMMARY: one",
               "SUMMARY: nothing else", None,
               "ENTITIES:\n- [Bob]: waits\n- [Ann]: leaves\n- [Cy]:\nKEY_EVENTS:\n- b\n- c\nSUMMARY: two",
               "ENTITIES:\n- [Ann]: calls\n- [Cy]: comes"]
    pages = R.parse_replies(spark.createDataFrame(list(enumerate(replies)), "page INT, reply STRING"), "reply", "_s")
    held = pages.coalesce(1).sortWithinPartitions("page").agg(F.collect_list(F.struct("page", "_s")).alias("p"))
    merged = hierarchy.merge_pages("p", pages.schema["_s"].dataType)
    got = held.select(*merged).first()
    assert got.entities == {"Ann": "calls\nleaves", "Bob": "waits", "Cy": "comes"}
    assert got.key_events == ["a", "b", "c"] and got.summary == "one\nnothing else\ntwo"
    assert held.select(F.filter("p", lambda p: p["page"] == 2).alias("p")).select(*merged).first().entities == {}


def test_target_days(entries):
    def days(start, end, n):
        return [r.date for r in prompts.target_days(entries, start, end, n).orderBy("date").collect()]
    assert days("2024-02-03", "2024-02-06", 1) == ["2024-02-02", "2024-02-03", "2024-02-05"]
    assert len(days(None, None, 0)) == 18
    assert len(days("2030-01-01", "2030-02-01", 2)) == 18


def test_staleness_climbs(spark, entries):
    then = hierarchy.fingerprints(entries.filter("date <> '2024-02-05' OR role <> 'user'"))
    stale = {(r.level, r.period_start, r.change)
             for r in hierarchy.stale_units(hierarchy.fingerprints(entries), then).collect()}
    assert stale == {("day", "2024-02-05", "changed"), ("week", "2024-02-05", "changed"),
                     ("month", "2024-02", "changed"), ("year", "2024", "changed")}


def test_model_failures_become_rows(spark):
    def picky(system, user):
        if user == "bad":
            raise RuntimeError("no")
        return user.upper()
    rows = models.apply_model(spark.createDataFrame([("ok",), ("bad",)], "prompt STRING"), picky
                              ).orderBy("prompt").collect()
    assert rows[0].reply is None and rows[0].error == "RuntimeError: no" and rows[1].reply == "OK"
    turns = spark.createDataFrame([("bad", "r"), ("x", "y")], "user STRING, response STRING")
    labelled = models.classify(turns, lambda s, u: "Coding related" if "bad" not in u else 1 / 0)
    assert {r.user: r.category for r in labelled.collect()} == {"bad": "other", "x": "coding_related"}


def test_chunked_synthesis_merges(spark, entries):
    rows = [("U1", "user_1", "warm", f"did {i}", "2024-02-02", "2024-02-02", i) for i in range(30)]
    rows.append(("Solo", None, None, None, None, "2024-01-01", 99))
    mentions = spark.createDataFrame(rows, "name_as_written STRING, normalized_name STRING, "
                                     "valence STRING, interaction_summary STRING, source_date STRING, "
                                     "period_start STRING, seq LONG")
    facts = entities.knowledge(mentions, entities.alias_map(mentions))
    days = spark.createDataFrame([("2024-02-02", "calm", ["a", "b", "c", "d", "e", "f"])],
                                 "period_start STRING, emotional_tone STRING, key_events ARRAY<STRING>")
    ctx = context.context_window(entries, facts.select(F.col("valid_from").alias("center_date")), 0, 0)
    evidence = synthesis.entity_evidence(facts, days, ctx, 0, 0).cache()
    one = evidence.filter("seq = 0").first()
    assert one.head.count("•") == 6 and "Day emotional tone: calm" in one.head
    full = one.head + synthesis.type_b_head(0, 0) + ctx.filter("center_date = '2024-02-02'").first().text
    assert one.block_chars == len(full) and one.tokens == int(len(full) / 3.2)

    def count(system, prompt):
        return f"<{prompt.count('TYPE A')}>"
    arcs = synthesis.synthesize_entities(
        evidence, ctx, count, "{entity}: {entity_timeline}", "{entity} x{n_chunks}\n{partial_arcs}",
        budget=one.tokens * 10 + 20, overlap=3, n_before=0, n_after=0)
    got = {r.id: r for r in arcs.collect()}
    assert got["user_1"].arc_chunks_used == len(greedy([one.tokens] * 30, one.tokens * 10 + 20, 3))
    assert got["user_1"].arc_summary == "<0>" and got["solo"].arc_summary == "<1>"

    def fail_merge(system, prompt):
        if "## part" in prompt:
            raise RuntimeError("down")
        return count(system, prompt)
    arcs = synthesis.synthesize_entities(
        evidence, ctx, fail_merge, "{entity}: {entity_timeline}", "{entity}{n_chunks}{partial_arcs}",
        budget=one.tokens * 10 + 20, overlap=3, n_before=0, n_after=0)
    text = {r.id: r.arc_summary for r in arcs.collect()}["user_1"]
    assert text.startswith("## part 1 of ") and "<10>" in text
    solo = facts.filter("id = 'solo'").first()
    assert (solo.valid_from, solo.content, solo.emotional_valence) == (
        "2024-01-01", "(no summary)", "neutral")
    assert X.CHARS_PER_TOKEN == 3.2
