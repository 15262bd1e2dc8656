"""Substring dedup: difference-cover anchors find shared passages, then windows are extended.

A passage is a window of 13 words.  Positions modulo 7 in the cover {0, 1, 3} are anchors, and
an anchor is the hash of the 7 words there.  For any two positions some shift below 7 puts
both on the cover, so equal windows of 13 words have an anchor in common at the same place in
both; 3/7 of the positions are hashed and no match is missed.

1. Equal word sequences: of documents alike word for word the smallest id represents the rest,
   which lose all their words without further work.
2. Anchors of the representatives are dealt to buckets by hash, packed: one row per task,
   flush and bucket.  A bucket says which of its anchors several documents have.
3. Documents with such anchors extend them: the windows around a shared anchor, and only
   they, are hashed and dealt to buckets, which find the smallest document of each window.
4. Words of windows that a smaller document has are removed.

Before anything is dealt, a task settles what it can see: an anchor in several of its own
documents is shared, a window is removed from all but the smallest of them, and only one entry
goes out.  So a passage that a third of all documents have is one entry per flush, not one
per document.  The number of buckets follows the words, which bounds a bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stratalog.llm.common import Screen, bounded_batches, spread, written
from stratalog.llm.fuse import mix
from stratalog.llm.shingles import rolled, word_hashes

NO_ID = 2**63 - 1  # stands for a null id inside, after all others
WINDOW = 13
PERIOD, COVER = 7, (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
# An entry takes some 100 bytes of a worker while it is settled, at both ends of the shuffle.
ENTRIES_PER_BUCKET = 1 << 19
FLUSH_ENTRIES = 1 << 19
_PACKED = "place long, docs binary, counts binary, keys binary"
_PACKED_ARROW = pa.schema([("place", pa.int64()), ("docs", pa.binary()), ("counts", pa.binary()),
                           ("keys", pa.binary())])
_FOUND = "doc long, keys array<long>"
_ON_COVER = np.isin(np.arange(PERIOD), COVER)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


class Words:
    """The words of a batch of texts end to end, with each word's place in its text."""

    def __init__(self, texts: list[str | None]):
        self.texts = [words_of(t) for t in texts]
        self.sizes = np.array([len(w) for w in self.texts], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.text = np.repeat(np.arange(len(texts)), self.sizes)
        self.hashes = word_hashes([w for words in self.texts for w in words])
        at = np.arange(len(self.hashes))
        self.behind = at - (self.ends - self.sizes)[self.text]  # words before it in its text
        self.ahead = self.ends[self.text] - at                  # words from it on

    def runs(self, size: int, seed: int = 1) -> np.ndarray:
        """A hash at every word, of it and the next ones; only good where enough are ahead."""
        found = rolled(self.hashes, size, seed)
        return np.concatenate([found, np.zeros(len(self.hashes) - len(found), np.uint64)])

    def anchors(self) -> np.ndarray:
        """Words on the cover where an anchor starts, in texts that have a window."""
        return np.flatnonzero(_ON_COVER[self.behind % PERIOD] & (self.ahead >= ANCHOR)
                              & (self.sizes[self.text] >= WINDOW))

    def around(self, anchors: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold one of the anchors within their first words."""
        near = np.zeros(len(self.hashes), bool)
        for k in range(PERIOD):
            near[anchors[self.behind[anchors] >= k] - k] = True
        return np.flatnonzero(near & (self.ahead >= WINDOW))


def anchor_keys(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """An anchor's bucket and 32 bits more, enough to find candidates."""
    return (hashes % np.uint64(buckets)) << np.uint64(32) | hashes >> np.uint64(32)


class Entries:
    """Keys of documents gathered by one task, settled among themselves and packed.

    ``smallest`` False: keys that several documents have are found in all of them.  True: keys
    are found in all documents but the smallest that has them.  A packed row's place is a
    bucket of keys still to be settled, or below zero a part of documents with found keys.
    """

    def __init__(self, smallest: bool, parts: int):
        self.smallest, self.parts, self.size = smallest, parts, 0
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, docs: np.ndarray, keys: np.ndarray, buckets: np.ndarray) -> None:
        self.held.append((docs, keys, buckets))
        self.size += len(keys)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            docs, keys, buckets = map(np.concatenate, zip(*self.held))
            self.held, self.size = [], 0
            first, found = settle(docs, keys, buckets, self.smallest)
            kind = np.uint64 if self.smallest else np.uint32
            rows = [*packed(buckets[first], docs[first], keys[first], kind),
                    *packed(part_of(docs[found], self.parts), docs[found], keys[found], np.uint64)]
            for at in range(0, len(rows), 512):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows[at:at + 512]), _PACKED_ARROW)],
                    schema=_PACKED_ARROW)


def part_of(docs: np.ndarray, parts: int) -> np.ndarray:
    return -1 - (mix(docs.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)


def packed(places: np.ndarray, docs: np.ndarray, keys: np.ndarray, kind: type
           ) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """Per place: documents, their numbers of keys, the keys."""
    order = np.lexsort((docs, places))
    places, docs, keys = places[order], docs[order], keys[order].astype(kind)
    cuts = np.flatnonzero(np.r_[True, places[1:] != places[:-1]]) if len(places) else []
    for a, b in zip(cuts, [*cuts[1:], len(places)]):
        names, counts = np.unique(docs[a:b], return_counts=True)
        yield (int(places[a]), names.astype(np.int64).tobytes(), counts.astype(np.uint32).tobytes(),
               keys[a:b].tobytes())


def settle(docs: np.ndarray, keys: np.ndarray, buckets: np.ndarray, smallest: bool
           ) -> tuple[np.ndarray, np.ndarray]:
    """Masks: one entry per key (the smallest document's), and the entries already found."""
    order = np.lexsort((docs, keys, buckets))
    d, k, b = docs[order], keys[order], buckets[order]
    start = np.r_[True, (k[1:] != k[:-1]) | (b[1:] != b[:-1])] if len(k) else np.zeros(0, bool)
    group = np.cumsum(start) - 1
    if smallest:
        hit = d > d[start][group] if len(k) else start
    else:
        end = np.r_[start[1:], True] if len(k) else start
        hit = (d[end] > d[start])[group] if len(k) else start
    first, found = np.zeros(len(k), bool), np.zeros(len(k), bool)
    first[order], found[order] = start, hit
    return first, found


def _unpacked(rows: pa.Table, kind: type) -> tuple[np.ndarray, np.ndarray]:
    def all_of(name: str, as_: type) -> np.ndarray:
        return np.frombuffer(b"".join(rows[name].to_pylist()), as_)
    docs = np.repeat(all_of("docs", np.int64), all_of("counts", np.uint32).astype(np.int64))
    return docs, all_of("keys", kind).astype(np.uint64)


def meet(entries: DataFrame, smallest: bool, parts: int) -> DataFrame:
    """doc, keys: what is found of each document's keys, over all tasks' entries.

    One shuffle brings the entries of a bucket together, one the found keys of a part of the
    documents; both carry packed rows, so their number follows the tasks and buckets.
    """
    kind = np.uint64 if smallest else np.uint32

    def bucket(key: tuple, rows: pa.Table) -> pa.Table:
        place = key[0].as_py()
        if place < 0:
            return rows.select(_PACKED_ARROW.names)
        docs, keys = _unpacked(rows, kind)
        if not smallest:
            keys = keys | np.uint64(place) << np.uint64(32)
        _, found = settle(docs, keys, np.zeros(len(docs), np.int64), smallest)
        out = list(packed(part_of(docs[found], parts), docs[found], keys[found], np.uint64))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(
            zip(*out) if out else [[]] * 4, _PACKED_ARROW)], schema=_PACKED_ARROW)

    def part(key: tuple, rows: pa.Table) -> pa.Table:
        docs, keys = _unpacked(rows, np.uint64)
        order = np.lexsort((keys, docs))
        docs, keys = docs[order], keys[order]
        new = np.r_[True, (docs[1:] != docs[:-1]) | (keys[1:] != keys[:-1])]
        names, counts = np.unique(docs[new], return_counts=True)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)),
                                         pa.array(keys[new].view(np.int64)))
        return pa.table({"doc": pa.array(names), "keys": lists})

    return (entries.groupBy("place").applyInArrow(bucket, _PACKED)
            .groupBy("place").applyInArrow(part, _FOUND))


def _read(docs: DataFrame) -> DataFrame:
    """doc, n_words, digest of each row: what is known without comparing."""
    @F.arrow_udf("n_words long, digest binary")
    def known(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [words_of(t) for t in batch.to_pylist()]
            yield pa.StructArray.from_arrays(
                [pa.array([len(w) for w in found], pa.int64()),
                 pa.array([hashlib.sha256(b" ".join(w)).digest() for w in found], pa.binary())],
                names=["n_words", "digest"])
    return docs.select("doc", "text", known("text").alias("_k")).select(
        "doc", "text", "_k.n_words", "_k.digest")


def _buckets(words: int, share: float, least: int) -> int:
    return 1 << max(int(words * share / ENTRIES_PER_BUCKET), least - 1).bit_length()


def _anchor_entries(reps: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = Entries(False, buckets)
        for batch in batches:
            words = Words(batch.column(1).to_pylist())
            at = words.anchors()
            keys = anchor_keys(words.runs(ANCHOR)[at], buckets)
            docs = batch.column(0).to_numpy(zero_copy_only=False)[words.text[at]]
            entries.add(docs, keys, (keys >> np.uint64(32)).astype(np.int64))
            del words, at, keys, docs  # not held beside what a flush takes
            if entries.size >= FLUSH_ENTRIES:
                yield from entries.flush()
        yield from entries.flush()
    return reps.select("doc", "text").mapInArrow(run, _PACKED)


def _window_entries(flagged: DataFrame, anchor_buckets: int, buckets: int) -> DataFrame:
    """Windows around shared anchors: 64 bits each, and a bucket by a second hash on top."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = Entries(True, buckets)
        for batch in batches:
            words = Words(batch.column(1).to_pylist())
            at = words.anchors()
            # Who has a shared anchor shares it, so one set serves the whole batch.
            shared = np.unique(batch.column(2).flatten().to_numpy()).view(np.uint64)
            keys = anchor_keys(words.runs(ANCHOR)[at], anchor_buckets)
            starts = words.around(at[np.isin(keys, shared)])
            place = words.runs(WINDOW, seed=1000)[starts] % np.uint64(buckets)
            docs = batch.column(0).to_numpy(zero_copy_only=False)[words.text[starts]]
            entries.add(docs, words.runs(WINDOW)[starts], place.astype(np.int64))
            del words, at, shared, keys, starts, place, docs
            if entries.size >= FLUSH_ENTRIES:
                yield from entries.flush()
        yield from entries.flush()
    return flagged.select("doc", "text", "keys").mapInArrow(run, _PACKED)


KEPT = "n_words long, n_removed long, digest binary, kept_digest binary, kept string"


def _remove(keep_text: bool):
    @F.arrow_udf(KEPT)
    def removed(text: pa.Array, keys: pa.Array) -> pa.Array:
        words = Words(text.to_pylist())
        # A window is removed from some of its documents: pairs of text and key are compared.
        gone = keys.flatten().to_numpy().view(np.uint64)
        known, number = np.unique(gone, return_inverse=True)
        of_text = np.repeat(np.arange(len(keys)), keys.value_lengths().to_numpy())
        found = words.runs(WINDOW)
        at = np.flatnonzero(np.isin(found, known) & (words.ahead >= WINDOW))
        pairs = words.text[at] * len(known) + np.searchsorted(known, found[at])
        at = at[np.isin(pairs, of_text * len(known) + number)]
        cover = np.zeros(len(found) + 1, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + WINDOW, -1)
        stays = np.cumsum(cover)[:-1] == 0
        out = [[], [], [], [], []]
        for w, end in zip(words.texts, words.ends):
            stay = stays[end - len(w):end]
            rest = b" ".join(compress(w, stay.tolist()))
            for column, value in zip(out, (len(w), len(w) - int(stay.sum()),
                                           hashlib.sha256(b" ".join(w)).digest(),
                                           hashlib.sha256(rest).digest(),
                                           rest.decode() if keep_text else None)):
                column.append(value)
        return pa.StructArray.from_arrays(
            [pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.binary(),
                                                  pa.string()))],
            names=["n_words", "n_removed", "digest", "kept_digest", "kept"])
    return removed


def find_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                 keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_digest (SHA-256) and, if asked for, the kept words.

    Words end at space and the controls from tab to carriage return and are kept as they are;
    kept words are joined by one space.  Null and empty texts have no words; texts under 13
    words lose none.  Only a strictly smaller id removes, so rows repeated with their id do
    not remove each other; a null id comes after all others.  An empty table gives an empty one.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc"),
                       F.col(text).alias("text"))
    prints = written(_read(rows).drop("text"), "prints")
    firsts = written(prints.filter(F.col("n_words") >= WINDOW).groupBy("digest")
                     .agg(F.min("doc").alias("first"), F.max("doc").alias("last")), "firsts", True)
    several = firsts.filter("first <> last").select("digest", "first")
    copies = written(prints.join(several, "digest").filter("doc > first")
                     .select("doc", "digest"), "copies", True)

    # Representatives: rows that cannot be copies, and of the rest those that are not.
    maybe, doc = Screen(copies, "doc"), F.col("doc")
    checked = _read(maybe.split(rows, doc)).join(
        copies.distinct(), ["doc", "digest"], "left_anti")
    reps = maybe.split(rows, doc, False).unionAll(checked.select("doc", "text"))

    words, least = prints.agg(F.sum("n_words")).first()[0] or 0, spread(docs)
    anchor_buckets = _buckets(words, len(COVER) / PERIOD, least)
    shared = written(meet(_anchor_entries(reps, anchor_buckets), False, anchor_buckets), "anchors")
    flagged = Screen(shared, "doc").split(reps, doc).join(shared, "doc")
    buckets = _buckets(words, 0.5, least)
    removed = written(meet(_window_entries(flagged, anchor_buckets, buckets), True, buckets), "windows")

    hit = Screen(removed, "doc").split(reps, doc).join(removed, "doc")
    cut = (hit.select("doc", _remove(keep_text)("text", "keys").alias("_r"))
           .select("doc", "_r.digest", "_r.n_removed", "_r.kept_digest", "_r.kept")
           .dropDuplicates(["doc", "digest"]))
    nothing = F.lit(hashlib.sha256(b"").digest())
    gone = copies.distinct().select("doc", "digest", F.lit(None).cast("long").alias("n_removed"),
                                    nothing.alias("kept_digest"), F.lit("").alias("kept"))
    known = written(cut.unionAll(gone), "cut", True).withColumn("_cut", F.lit(True))
    out = prints.join(known, ["doc", "digest"], "left")
    is_cut = F.coalesce("_cut", F.lit(False))
    return out.select(
        F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "n_words",
        F.when(is_cut, F.coalesce("n_removed", "n_words")).otherwise(0).alias("n_removed"),
        F.when(is_cut, F.col("kept_digest")).otherwise(F.col("digest")).alias("kept_digest"),
        *([F.col("kept")] if keep_text else []))
