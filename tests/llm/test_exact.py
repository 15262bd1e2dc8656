import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F, types as T

from stratalog.llm import exact, fuse
from tests.llm.data import clashing, corpus, frame


@pytest.mark.parametrize("n", [0, 1, 2, 7, 500, 40_000])
def test_filter_keeps_all_members(n):
    keys = np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64)
    built = fuse.build(np.concatenate([keys, keys[: n // 2]]))
    assert fuse.contains(keys, *built).all()
    others = np.random.default_rng(n + 1).integers(0, 2**63, 50_000).astype(np.uint64)
    assert fuse.contains(others, *built).mean() < 0.01


def expected(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[exact.normal(text)].append((doc_id, len(text or "")))
    out = Counter()
    for data, members in groups.items():
        most = max(p for _, p in members)
        ids = [d for d, p in members if p == most and d is not None]
        keep = min(ids, default=None)
        seen = False
        for doc_id, points in members:
            kept = doc_id == keep and points == most and not seen
            seen |= kept
            out[doc_id, keep, len(members), kept, hashlib.sha256(data).hexdigest()] += 1
    return out


def found(df):
    return Counter(tuple(r) for r in df.select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest"))).collect())


@pytest.mark.parametrize("batches", [1, 2, 4])
def test_groups_equal_brute_force(spark, batches):
    rows = corpus(1) + [(8, "again"), (8, "again"), (9, "a g a in")]
    assert found(exact.find_copies(clashing(frame(spark, rows)), batches=batches)) == expected(rows)


def test_colliding_digests_are_told_apart(spark):
    @F.arrow_udf(T.BinaryType())
    def weak(texts: pa.Array) -> pa.Array:
        return pa.array([hashlib.sha256(exact.normal(t)).digest()[:1] for t in texts.to_pylist()],
                        pa.binary())
    rows = [(i, f"text {i % 700}") for i in range(1000)]
    got = exact.find_copies(frame(spark, rows), digest=weak)
    want = Counter((d, k, n, s) for d, k, n, s, _ in expected(rows).elements())
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got.collect()) == want


def test_stage_keeps_one_row_of_each_group_and_all_columns(spark):
    rows = corpus(2) + [(8, "again"), (8, "again"), (None, "nothing like it")]
    docs = clashing(frame(spark, rows))
    kept = exact.drop_copies(docs)
    assert kept.columns == docs.columns
    want = Counter(k[0] for k in expected(rows).elements() if k[3])
    ids = Counter(r.doc_id for r in kept.collect())
    ids.pop(None), want.pop(None, None)
    assert ids == want


def test_empty_table(spark):
    empty = frame(spark, [])
    assert exact.find_copies(empty).count() == 0
    assert exact.drop_copies(empty).count() == 0
