"""Token counts, decontamination, substring dedup and personal data against brute force."""

import hashlib
import random
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stratalog.llm import bpe, decontaminate, pii, substrings
from tests.llm.data import clashing, corpus, frame

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = "ab '<sd\n\t\r\x0b\x0c\x1c\x1f\x85\xa0\u3000\u200b0123\u0663\u00b2\u2160\u00e9\u6f22\U0001f600\u0301\x00\u0378\u088f"


def odd_texts(seed, n=400):
    rng = random.Random(seed)
    parts = [*ODD, "<|endoftext|>", "  ", "hello", "'ll", "\U0003fc3b"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(15))) for _ in range(n)]


def test_token_counts_equal_the_library(spark):
    rows = corpus(10) + list(enumerate(odd_texts(1), 1000)) + [(None, "a" * 50_000)]
    library = Tokenizer.from_file(PATH)
    got = bpe.count_tokens(clashing(frame(spark, rows)), PATH).select(
        "doc_id", "n_bytes", "n_tokens", "over_limit").collect()
    want = sorted((str(d), len((t or "").encode()),
                   n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512)
                  for d, t in rows)
    assert sorted((str(r[0]), *r[1:]) for r in got) == want


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        bpe.Merges(open(public_tokenizers.path("word_bpe_49k.json"), "rb").read())


ITEMS = "item_id long, text string"


def overlap(rows, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(
        c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = [(i, w[k:k + 10]) for i, t in items if (w := cut(t))
               for k in range(max(1, len(w) - 9))]
    out = []
    for d, t in rows:
        w, hit, names = cut(t), set(), set()
        for i, g in windows:
            for k in range(len(w) - len(g) + 1):
                if w[k:k + len(g)] == g:
                    hit |= set(range(k, k + len(g)))
                    names.add(str(i))
        out.append((d, len(w), len(hit), sorted(names)))
    return sorted(out)


@pytest.mark.parametrize("windows", [1_000_000, 7])
def test_overlap_equals_brute_force(spark, windows):
    rng = random.Random(11)
    passage = [f"q{rng.randrange(99)}" for _ in range(40)]
    items = [(1, " ".join(passage[:14])), (2, "Short item é"), (10, " ".join(passage[4:30])),
             (3, ""), (4, None), (5, "!?"), (1, "twice the same id")]
    rows = [(d, t) for d, t in corpus(12, 40) if d not in (7, 8)] + [
        (100, "Intro, " + "; ".join(passage).upper() + "!"), (101, "a SHORT-ITEM é b short item é"),
        (102, " ".join(passage[3:13])), (103, " ".join(passage[3:12])), (104, "twice the same id"),
        (100, "repeated id")]
    bench = spark.createDataFrame(items, ITEMS)
    found = decontaminate.find_overlap(clashing(frame(spark, rows)), bench,
                                       symbols_per_automaton=windows, group_bytes=200)
    got = found.select("doc_id", "n_words", "n_hit", "items").collect()
    assert sorted((r[0], r[1], r[2], list(r[3])) for r in got) == overlap(rows, items)
    for r in found.filter("doc_id = 101").collect():
        text = dict(rows)[101]
        assert [text[s.start:s.end] for s in r.spans] == ["SHORT-ITEM é", "short item é"]
    kept = decontaminate.drop_overlapping(clashing(frame(spark, rows)), bench)
    assert kept.columns == clashing(frame(spark, rows)).columns
    assert sorted(r.doc_id for r in kept.collect()) == [x[0] for x in overlap(rows, items) if not x[2]]


def test_empty_benchmark_and_table(spark):
    none = spark.createDataFrame([], ITEMS)
    assert decontaminate.find_overlap(frame(spark, corpus(13)), none).filter("n_hit > 0").count() == 0
    assert decontaminate.find_overlap(frame(spark, []), none).count() == 0
    assert bpe.count_tokens(frame(spark, []), PATH).count() == 0


def repeats(rows):
    cut = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    order = lambda d: 2**63 if d is None else d
    first = {}
    for d, t in rows:
        w = cut(t)
        for k in range(len(w) - 12):
            g = tuple(w[k:k + 13])
            first[g] = min(first.get(g, 2**63), order(d))
    out = []
    for d, t in rows:
        w = cut(t)
        gone = {j for k in range(len(w) - 12) if first[tuple(w[k:k + 13])] < order(d)
                for j in range(k, k + 13)}
        rest = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((str(d), len(w), len(gone), hashlib.sha256(rest.encode()).hexdigest(), rest))
    return sorted(out)


@pytest.mark.parametrize("flush", [1 << 20, 50])
def test_repeats_equal_brute_force(spark, flush, monkeypatch):
    rng = random.Random(14)
    long = [f"p{rng.randrange(10**6)}" for _ in range(60)]
    rows = corpus(15, 90) + [
        (200, " ".join(long)), (150, "before " + " ".join(long[:30])), (300, " ".join(long[20:50])),
        (None, " ".join(long)), (None, "x " + " ".join(long)), (200, " ".join(long)),
        (400, "a b " * 40), (401, "b a " * 40), (200, " ".join(reversed(long)))]
    monkeypatch.setattr(substrings, "FLUSH_ENTRIES", flush)
    found = substrings.find_repeats(clashing(frame(spark, rows, parts=5)), keep_text=True)
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.hex) for r in found.withColumn(
        "hex", F.lower(F.hex("kept_digest"))).collect())
    assert got == [x[:4] for x in repeats(rows)]
    texts = {r.kept for r in found.filter("n_removed > 0").collect()}
    assert texts == {x[4] for x in repeats(rows) if x[2]}
    assert substrings.find_repeats(frame(spark, [])).count() == 0


def test_a_flush_of_entries_takes_bounded_memory():
    import tracemalloc
    import numpy as np
    keys = np.random.default_rng(1).integers(0, 1 << 40, 1 << 14).astype(np.uint64)
    for smallest in (False, True):
        tracemalloc.start()
        entries, at, n = substrings.Entries(smallest, 64), 0, 0
        while entries.size < substrings.FLUSH_ENTRIES:
            docs, at = np.repeat(np.arange(at, at + 128), 128), at + 128
            entries.add(docs, keys + np.uint64(at), (keys % 64).astype(np.int64))
            n += len(docs)
        kind = np.uint64 if smallest else np.uint32
        rows = [r for b in entries.flush() for r in b.to_pylist() if r["place"] >= 0]
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 80 << 20 and entries.size == 0
        assert n * 0.9 < sum(len(r["keys"]) // kind().itemsize for r in rows) <= n


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    bare = lambda m: re.sub("[^0-9]", "", m[0])
    return [*((0, *m.span()) for m in EMAIL.finditer(text)),
            *((1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))),
            *((2, *m.span()) for m in CARD.finditer(text)
              if 13 <= len(bare(m)) <= 19 and pii.luhn(bare(m))),
            *((3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(bare(m)) <= 15)]


def test_base_spans_equal_the_patterns():
    rng = random.Random(16)
    parts = ["a", "b@", "@", "x.y", ".", "..", "1", "25", "256.", "1.2.3.4", "4111 1111-1111 1111",
             "+1 (", " ", "-", ")", "555", "é", "%", "0"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert pii.base_spans(text) == plain_spans(text), text
    assert pii.base_spans("1" * 200_000 + "a" * 200_000 + "@") == []


def test_spans_are_added_and_base_ones_stay(spark):
    rng = random.Random(17)
    rows = [(0, None), (1, ""), (2, "plain words")]
    for i in range(3, 300):
        digits = "".join(str(rng.randrange(10)) for _ in range(7))
        rows.append((i, f"call phone +1 (212) {digits[:3]}-{digits[3:]} or mail a{i}@host.example.com "
                        f"at 10.{i % 256}.3.4 now {'card ' if i % 2 else 'then '}5500005555555559 too"))
    cut = "phone +1 (415) 555-2671 4111111111111111"
    rows += [(400, cut), (401, "version 1.2.3.4.5.6.7 order 123-456-7890x")]
    found = {r.doc_id: r for r in pii.find_personal(clashing(frame(spark, rows))).select(
        "doc_id", "base", "spans").collect()}
    for d, t in rows:
        base = [tuple(s) for s in found[d].base]
        assert base == plain_spans(t or "")
        assert set(base) <= {tuple(s) for s in found[d].spans}
    added = {(s.kind, cut[s.start:s.end]) for s in found[400].spans}
    assert added == {(3, "+1 (415) 555-2671"), (2, "4111111111111111")}
    assert pii.find_personal(frame(spark, [])).count() == 0


def test_reliabilities_find_the_noisy_labeler():
    rng = random.Random(18)
    counts = {}
    for _ in range(4000):
        real = rng.random() < 0.6
        vote = "".join("+" if (rng.random() < right) == real else "-" for right in (0.95, 0.9, 0.85, 0.5))
        counts[vote] = counts.get(vote, 0) + 1
    rate, given, _ = pii.reliabilities(sorted((k, float(v)) for k, v in counts.items()))
    assert abs(rate - 0.6) < 0.05
    right = given[1, :, 2]
    assert right[0] > right[1] > right[2] > right[3] and abs(right[3] - 0.5) < 0.1


def test_many_spans_in_one_text():
    import time
    text = " ".join(f"user{i}@example.com +1 202 555 {i % 10000:04d}" for i in range(50_000))
    begun = time.process_time()
    base = pii.base_spans(text)
    assert len(base) == 100_000
    assert time.process_time() - begun < 5
    begun = time.process_time()
    loose = pii.loose_spans(text, base)
    assert time.process_time() - begun < 5
    assert not any(a < e and s < b for _, s, e in loose[:200] for _, a, b in base)


def test_patterns_are_word_numbers():
    """Ten nodes a window, whatever its words; windows that are part of others count too."""
    windows = [(" ".join(f"w{(i * 7 + k) % 5000}xxxxxxxxxx" for k in range(10)), [str(i)]) for i in range(2000)]
    automaton = decontaminate.Automaton(windows)
    assert automaton.walk.get_stats()["nodes_count"] <= 10 * 2000 + 1
    short = decontaminate.Automaton([("a b c", ["long"]), ("b", ["short"]), ("c d", ["end"])])
    assert short.hits([b"x", b"a", b"b", b"c", b"d", b"b"]) == ({1, 2, 3, 4, 5}, {"long", "short", "end"})
    assert short.hits([b"x"]) == (set(), set()) and short.hits([]) == (set(), set())
