import random
import re

import numpy as np
import pytest

from stratalog.llm import components, neardup
from tests.llm.data import clashing, corpus, frame


def shingles(text, size):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return frozenset(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def brute(rows, size, percent=80):
    sets = [(d, shingles(t, size)) for d, t in rows]
    top = {d: d for d, _ in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            common = len(s & t)
            if s and t and 100 * common >= percent * (len(s) + len(t) - common):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {(d, len(s), find(d), find(d) == d) for d, s in sets}


def near_corpus(seed, n=150, length=40):
    """Families whose members differ by one to six words from a common text."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if i % 30 == 0:
            base = [f"b{i}x{k}" for k in range(length)]
        text = list(base)
        for _ in range(rng.randrange(0, 6)):
            text[rng.randrange(length)] = f"r{rng.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    rng.shuffle(rows)
    return rows


def got(df):
    return {tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()}


@pytest.mark.parametrize("size", [2, 5])
def test_components_equal_brute_force(spark, size):
    rows = corpus(3, 80)
    found = neardup.find_groups(clashing(frame(spark, rows)), neardup.Plan(words=size))
    assert got(found) == brute(rows, size)


def test_large_families_in_small_blocks(spark):
    rows = near_corpus(4) + [(1000 + i, " ".join(f"b0x{k}" for k in range(4 + i))) for i in range(40)]
    plan = neardup.Plan(words=2, block_members=7, block_shingles=300)
    assert got(neardup.find_groups(frame(spark, rows), plan)) == brute(rows, 2)


def test_stage_keeps_one_of_each_group(spark):
    rows = near_corpus(5) + [(0, None), (7, None), (7, None)]
    docs = clashing(frame(spark, rows))
    kept = neardup.drop_near_copies(docs)
    assert kept.columns == docs.columns
    got_ids = sorted(r.doc_id for r in kept.collect())
    assert len(got_ids) == len(set(got_ids))
    single = [(d, t) for d, t in rows if t is not None]
    want = {d for d, _, _, stays in brute(single, 5) if stays}
    assert set(got_ids) - {0, 7} == want - {0, 7}


def test_awkward_ids_and_empty_table(spark):
    text = " ".join(f"v{i}" for i in range(30))
    rows = [(None, text), (5, text), (5, "something else entirely"), (9, "something else entirely"),
            (None, None)]
    found = {(r.doc_id, r.component_id) for r in neardup.find_groups(frame(spark, rows)).collect()}
    assert found == {(None, 5), (5, 5), (9, 5), (None, None)}
    assert neardup.find_groups(frame(spark, [])).count() == 0
    assert neardup.drop_near_copies(frame(spark, [])).count() == 0


def test_star_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [
        (i, i + 1) for i in range(400, 440)] + [(500, x) for x in range(501, 560)]
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        top[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "u long, v long")
    want = {(x, find(x)) for x in top if find(x) != x}
    assert {tuple(r) for r in components.connected(df).collect()} == want
    assert components.connected(df.limit(0)).count() == 0


def test_band_recall():
    """Bands meet at the promised rate for sets at the least similarity."""
    from stratalog.llm.shingles import Minima
    plan, rng = neardup.Plan(), np.random.default_rng(7)
    minima, missed = Minima(plan.bands * plan.rows, plan.seed), 0
    for _ in range(300):
        x = rng.integers(0, 2**63, 1000).astype(np.uint64)
        a, b = np.sort(x[:900]), np.sort(x[100:])  # 800 of 1000 in common
        missed += not set(neardup._keys(minima(a), plan)) & set(neardup._keys(minima(b), plan))
    assert missed == 0


def test_signatures_go_before_sets():
    """A family of weakly alike texts costs signatures, a family of near copies next to nothing."""
    from collections import Counter

    from stratalog.llm.shingles import Minima
    rng, plan = np.random.default_rng(8), neardup.Plan()
    minima = Minima(plan.bands * plan.rows, plan.seed)

    def run(sets):
        tally = Counter()
        signatures = np.stack([minima(s) for s in sets])
        links = neardup.links_of(np.arange(len(sets)), np.full(len(sets), 2), sets, signatures, plan, tally)
        return links, tally

    core = rng.integers(0, 2**63, 300).astype(np.uint64)
    weak = [np.sort(np.append(core[:160], rng.integers(0, 2**63, 140).astype(np.uint64))) for _ in range(200)]
    links, tally = run(weak)  # similarity 0.36
    assert not links and tally["signatures"] == 200 * 199 // 2 and tally["sets"] < 20
    close = [np.sort(np.append(core[:295], rng.integers(0, 2**63, 5).astype(np.uint64))) for _ in range(200)]
    links, tally = run(close)
    assert {b for _, b in links} == {0} and len(links) == 199 and tally["sets"] == 199


def test_weakly_alike_families_equal_brute_force(spark):
    """Many texts that share half their words, a few of them near copies of others."""
    rng = random.Random(9)
    base = [f"b{k}" for k in range(60)]
    rows = []
    for i in range(500):
        if i % 50 == 7:
            text = rows[-1][1].split()
            text[rng.randrange(60)] = f"n{i}"
        else:
            text = [w if rng.random() < 0.72 else f"r{rng.randrange(10**6)}" for w in base]
        rows.append((i, " ".join(text)))
    found = neardup.find_groups(frame(spark, rows), neardup.Plan(words=2, block_members=64))
    want = brute(rows, 2)
    assert got(found) == want and sum(not kept for *_, kept in want) >= 10
