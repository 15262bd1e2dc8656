"""Spelling variants against all pairs of a small vocabulary."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from stratalog.llm import queries, spelling
from stratalog.llm.spelling import Plan
from tests.llm.data import clashing, corpus, frame


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(n, plan=Plan()):
    """(word, n, n_near, form, form_n, root) of a vocabulary of counts."""
    n = {w: c for w, c in n.items() if len(w) >= plan.letters and c >= plan.occurrences}
    forms, out = {}, set()
    for w in n:
        others = [x for x in n if near(w, x)]
        best = min(others, key=lambda x: (-n[x], x), default=None)
        forms[w] = best if best and n[best] >= plan.factor * n[w] else None
        out.add((w, len(others)))
    rows = set()
    for w, k in out:
        root = w
        while forms[root]:
            root = forms[root]
        rows.add((w, n[w], k, forms[w], n.get(forms[w]), root))
    return rows


def counted(rows, change=None):
    n = Counter()
    for doc, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c <= "Z" else c for c in w)
            n[change(doc, w) if change else w] += 1
    return n


def noisy(seed, docs=60):
    """Texts over a few frequent words, each spelled many ways, chains of variants among them."""
    rng = random.Random(seed)
    letters = "abcdeéÀÿz"
    base = ["".join(rng.choices(letters, k=rng.randrange(6, 11))) for _ in range(25)]
    rows = []
    for i in range(docs):
        w = []
        for _ in range(rng.randrange(0, 150)):
            x = rng.choice(base[:1 + rng.randrange(25)])
            for _ in range(rng.choice([0, 0, 0, 0, 1, 1, 2])):
                k = rng.randrange(len(x) + 1)
                x = rng.choice([x[:k] + rng.choice("ab") + x[k:], x[:k] + x[k + 1:],
                                x[:k] + rng.choice("ab") + x[k + 1:]])
            w.append(x.upper() if rng.random() < .1 and x.isascii() else x)
        rows.append((i, rng.choice([" ", ", ", "1"]).join(w)))
    return rows


def as_rows(df):
    return {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


def test_edits_reach_every_pair_once():
    rng = random.Random(3)
    words = sorted({"".join(rng.choices("abcéÿ", k=rng.randrange(1, 8))) for _ in range(900)}
                   | {"x" * n for n in range(60, 70)} | {"x" * 65 + "y" + "x" * n for n in range(4)})
    want = {(a, b) for a in words for b in words if a < b and near(a, b)}
    shards = spelling.Shards.sized(Counter(map(len, words)), 16)
    bits = np.zeros(shards.blocks * spelling.BLOCK_WORDS, np.uint64)
    for members in spelling._by_length(words):
        codes = spelling.letters_of([words[i] for i in members])
        block, drawn = shards.place(codes.shape[1], spelling.hashes(codes))
        for k in range(spelling.PROBES):
            word, bit = spelling._probe(drawn, k)
            np.bitwise_or.at(bits, block * spelling.BLOCK_WORDS + word, bit)
    for step in (shards.blocks, 7):  # one page, and many
        got, passed = [], 0
        for low in range(0, shards.blocks, step):
            high = min(low + step, shards.blocks)
            page = spelling.Page(shards, low, high, bits[low * 8:high * 8])
            for members in spelling._by_length(words):
                codes = spelling.letters_of([words[i] for i in members])
                for row, at, letter in spelling.edits(codes, page):
                    w = words[members[row]]
                    other = w[:at] + ("" if letter is None else chr(letter)) + w[at + 1:]
                    passed += 1
                    if other in set(words):
                        got.append(tuple(sorted((w, other))))
        assert len(got) == len(want) and set(got) == want
        assert passed < 2 * len(want) + 500


@pytest.mark.parametrize("plan", [Plan(), Plan(page_bytes=256), Plan(letters=3, occurrences=1, factor=2)])
def test_variants_equal_brute_force(spark, plan):
    rows = noisy(11)
    got = as_rows(spelling.find_variants(frame(spark, rows), plan))
    want = brute(counted(rows), plan)
    assert got == want and len({r[5] for r in want if r[3]}) > 3


def test_chains_of_forms_and_ties(spark):
    n = {"abcdef": 1, "abcdeg": 5, "abcdgg": 25, "abcggg": 125, "abgggg": 625, "bbgggg": 125,
         "zzzzzz": 5, "zzzzzy": 25, "zzzzzx": 25, "zzzzz": 99, "lonely": 7}
    rows = [(i, " ".join([w] * c)) for i, (w, c) in enumerate(n.items())]
    got = as_rows(spelling.find_variants(frame(spark, rows)))
    assert got == brute(n)
    assert {r[0]: r[5] for r in got}["abcdeg"] == "abgggg"
    assert {r[0]: r[3] for r in got}["zzzzzz"] == "zzzzzx"


def test_awkward_rows(spark):
    rows = corpus(7) + [(90, "Éxemple éxemple " * 6), (90, "Éxemple éxemple " * 6), (None, "éxempla " * 40),
                        (91, "×÷×÷×÷ " * 5), (92, ("y" * 30_000 + " ") * 5), (93, ("y" * 29_999 + " ") * 25)]
    got = as_rows(spelling.find_variants(clashing(frame(spark, rows), ("word", "n", "form", "root", "doc"))))
    assert got == brute(counted(rows))
    assert spelling.find_variants(frame(spark, [])).count() == 0
    assert spelling.find_variants(frame(spark, [(1, None), (2, "")])).count() == 0


def test_query_misspells_by_document(spark, tmp_path):
    rows = noisy(12, 200)
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")

    def change(doc, w):
        h = zlib.crc32(f"{doc}:{w}".encode())
        return w if h % 199 else "".join(c for i, c in enumerate(w) if i != h % len(w))

    n = counted(rows, change)
    assert n != counted(rows)
    assert as_rows(queries.op12_spelling_variants(spark, str(tmp_path))) == brute(n)
