"""Best-fit packing of tokenised documents into sequences of fixed length.

Tasks tokenise whole texts, cut what is longer than a sequence and write the pieces with
their ids once; every piece knows its block (the task that wrote it) and its number among the
pieces of its length there.  The histogram of lengths has at most ``capacity`` rows, so the
packing itself is solved on it (``bins``), as patterns of lengths.  A piece's rank among all
pieces of its length is the rows of earlier blocks plus its number; ranks map to bins and
offsets through the runs in which the patterns use up each length.  No piece is sorted or
moved with its ids for that, and a length that a third of all pieces share is as good as any.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import pairwise
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T
from tokenizers import Tokenizer

from stratalog.llm import bins
from stratalog.llm.bpe import BYTE_LEVEL, byte_letters
from stratalog.llm.common import bounded_batches, written

PIECES = ("doc_id long, piece int, start long, length long, ids binary, ids_crc32 long, "
          "block int, nth long")


@lru_cache(maxsize=1)
def encoder(content: bytes) -> Callable[[str], np.ndarray]:
    """Text -> ids as the tokenizers library gives them for this file, special strings included.

    Where ids follow the order of merges, a byte-level vocabulary is a table of ranks for
    tiktoken, which is several times faster; other files go to the tokenizers library, and so
    does a text that tiktoken's split refuses (a run of about a million white-space characters).
    """
    spec = json.loads(content)
    model, split = spec["model"], spec["pre_tokenizer"] or {}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    ids = [model["vocab"].get(a + b, -1) for a, b in merges]

    @lru_cache(maxsize=1)
    def library() -> Tokenizer:
        return Tokenizer.from_buffer(content)

    def by_library(text: str) -> np.ndarray:
        return np.array(library().encode(text, add_special_tokens=False).ids, np.uint32)

    plain = (model["type"] == "BPE" and split.get("type") == "ByteLevel"
             and not split.get("add_prefix_space") and split.get("use_regex", True)
             and not spec["normalizer"] and not model.get("ignore_merges")
             and all(a < b for a, b in pairwise(ids)) and len(model["vocab"]) == len(ids) + 256
             and not any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"]
                         for a in spec["added_tokens"]))
    if plain:
        import tiktoken
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items()}
        special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        table = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL, mergeable_ranks=ranks,
                                  special_tokens=special)

        def by_ranks(text: str) -> np.ndarray:
            try:
                return table.encode_to_numpy(text, allowed_special="all")
            except ValueError:  # the split's stack is full
                return by_library(text)

        return by_ranks
    return by_library


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """start, length of the pieces of n ids; only the first may be shorter than the capacity."""
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def tokenised(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """The pieces of doc_id, text with their ids (little-endian, 32 bits) and places."""
    content = docs.sparkSession.sparkContext.broadcast(Path(path).read_bytes())
    schema = T._parse_datatype_string(PIECES)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(content.value)
        block, met = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows = []
            for doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(2))):
                ids = np.append(encode(text or "").astype("<u4"), np.array([end_id], "<u4"))
                for k, (start, length) in enumerate(cuts(len(ids), capacity)):
                    data = ids[start:start + length].tobytes()
                    rows.append((doc_id, k, start, length, data, zlib.crc32(data), block,
                                 int(met[length])))
                    met[length] += 1
            columns = zip(*rows) if rows else [[] for _ in range(8)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (
                    pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(),
                    pa.int32(), pa.int64()))],
                names=[f.name for f in schema])

    return docs.mapInArrow(pieces, schema)


def runs(patterns: Sequence[bins.Pattern]) -> np.ndarray:
    """Rows length, first rank, number per bin, first bin, offset in the bin; by length and rank."""
    out, used, first = [], {}, 0
    for p in patterns:
        at = 0
        for length, each in p.items:
            rank = used.get(length, 0)
            out.append((length, rank, each, first, at))
            used[length] = rank + each * p.times
            at += length * each
        first += p.times
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, text: str = "text",
         doc_id: str = "doc_id", nodes: int = 5_000) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset.

    A document is its ids and ``end_id``; null and empty texts are ``end_id`` alone.  Rows
    repeated with their id are packed each for itself, a null id stays null.  An empty table
    gives an empty one.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = written(tokenised(rows, path, capacity, end_id), "pieces")
    counts = pieces.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1)
    bases = written(counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))),
                    "bases", True)
    histogram = {r["length"]: r["n"] for r in
                 bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = docs.sparkSession.sparkContext.broadcast(
        runs(bins.complete(histogram, capacity, nodes)))

    @F.arrow_udf("sequence_id long, offset long")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        held = table.value
        n, r = (x.to_numpy(zero_copy_only=False) for x in (length, rank))
        at = np.searchsorted(held[:, 0] << 44 | held[:, 1], n << 44 | r, side="right") - 1
        found = held[at]
        k = r - found[:, 1]
        return pa.StructArray.from_arrays(
            [pa.array(found[:, 3] + k // found[:, 2]),
             pa.array(found[:, 4] + k % found[:, 2] * n)], names=["sequence_id", "offset"])

    ranked = pieces.join(bases.select("length", "block", "base"), ["length", "block"])
    return (ranked.withColumn("_at", place("length", F.col("base") + F.col("nth")))
            .select("doc_id", "piece", "start", "length", "ids", "ids_crc32",
                    F.col("_at.sequence_id").alias("sequence_id"),
                    F.col("_at.offset").alias("offset")))


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length, ids: the pieces of each sequence put together, at most one sequence a row."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "length")))
    return packed.groupBy("sequence_id").agg(parts.alias("_p")).select(
        "sequence_id",
        F.aggregate("_p", F.lit(0).cast("long"), lambda n, p: n + p["length"]).alias("length"),
        F.aggregate("_p", F.lit(b""), lambda d, p: F.concat(d, p["ids"])).alias("ids"))
