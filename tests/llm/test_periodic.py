"""Periodic runs against a direct scan of every lag."""

import hashlib
import random
import zlib
from fractions import Fraction

import pytest

from stratalog.llm import periodic, queries
from tests.llm.data import clashing, corpus, frame


def brute(w):
    """Maximal stretches by every lag, with the smallest period, of 24 words and three periods."""
    out = []
    for p in range(1, len(w) // 3 + 1):
        i = 0
        while i + p < len(w):
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            n = i - s + p
            if n >= max(24, 3 * p) and not any(
                    p % d == 0 and all(w[j] == w[j + d] for j in range(s, s + n - d)) for d in range(1, p)):
                out.append((s, n, p))
            i += i == s
    return sorted(out)


def repetitive(rng):
    """Words with roots that repeat, roots of roots among them, and noise between."""
    w = []
    for _ in range(rng.randrange(0, 5)):
        few = rng.choice([1, 2, 3, 50])
        root = [f"v{rng.randrange(few)}" for _ in range(rng.randrange(1, 30))]
        if rng.random() < .4:
            root = root * rng.randrange(1, 4) + [f"z{rng.randrange(3)}"]
        w += (root * rng.randrange(1, 7))[:rng.randrange(1, 200)]
        w += [f"u{rng.randrange(5)}" for _ in range(rng.randrange(0, 9))]
    return w


def test_scan_equals_brute_force():
    rng = random.Random(1)
    for _ in range(400):
        docs = [repetitive(rng) for _ in range(rng.randrange(1, 6))]
        for w, (n, runs, kept) in zip(docs, periodic.scan([" ".join(w) for w in docs])):
            assert (n, runs) == (len(w), brute(w))
            gone = {i for s, m, q in runs for i in range(s + q, s + m)}
            assert kept.split() == [x for i, x in enumerate(w) if i not in gone]


@pytest.mark.parametrize("period", [1, 7, 8, 11, 12, 17, 18, 100, 1000])
def test_three_periods_are_enough(period):
    """A run of just three periods at every scale, and none with a word less."""
    rng = random.Random(period)
    root = [f"r{rng.randrange(10 ** 9)}" for _ in range(period)]
    n = max(24, 3 * period)
    for words, want in ((n, [(2, n, period)]), (n - 1, [])):
        w = ["a", "b", *(root[i % period] for i in range(words)), "c"]
        assert periodic.scan([" ".join(w)])[0][1] == want


def test_long_texts_of_few_words():
    rng = random.Random(2)
    same, two, noise = "a " * 300_000, "a b " * 150_000, " ".join(rng.choices("ab", k=300_000))
    got = periodic.scan([same, None, two, noise])
    assert got[0][1] == [(0, 300_000, 1)] and got[2][1] == [(0, 300_000, 2)]
    assert got[0][2] == "a" and got[2][2] == "a b" and got[1] == (0, [], "")
    assert all(q < 20 for _, _, q in got[3][1])


def test_find_runs_with_awkward_rows(spark):
    rows = corpus(5) + [(90, "x y z " * 20), (90, "x y z " * 20), (None, "x " * 40), (91, "\x1c \x1c " * 20)]
    got = periodic.find_runs(clashing(frame(spark, rows), ("runs", "N_WORDS", "_found", "x"))).collect()
    want = []
    for _, text in rows:
        w = (text or "").encode().split()
        want.append((len(w), tuple(brute(w))))
    assert sorted((r.n_words, tuple(map(tuple, r.runs))) for r in got) == sorted(want)
    assert set(got[0].asDict()) == {"doc_id", "text", "_found", "x", "n_words", "runs", "collapsed"}
    assert periodic.find_runs(frame(spark, [])).count() == 0


def test_query_equals_brute_force(spark, tmp_path):
    rows = [r for r in corpus(6, 200) if r[0] != 8] + [(k, " ".join(repetitive(random.Random(k))))
                                                       for k in range(300, 420)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    planted = 0
    for doc, text in rows:
        w = [x.decode() for x in (text or "").encode().split()]
        h, n = zlib.crc32(str(doc).encode()), len(w)
        if h % 10 == 0 and n:
            planted += 1
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs, r = brute(w), got[doc]
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        assert r.n_runs == len(runs)
        assert r.runs_sha256 == sha("".join(f"{s},{m},{q}\n" for s, m, q in runs))
        assert r.collapsed_sha256 == sha(" ".join(x for i, x in enumerate(w) if i not in gone))
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        assert (r.start, r.length, r.period) == (best or (None,) * 3)
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
    assert planted > 20
