"""Token counts by byte-pair merging with a heap and a linked list.

A tokenizer file gives the vocabulary, the order of merges, the special strings and the
byte-level split into pieces.  For each piece the symbols are a linked list of its bytes and
the heap holds every adjacent pair that has a merge; the lowest rank, then the leftmost pair,
is popped again and again, pairs that changed meanwhile are skipped, and each merge pushes
the two pairs it made.  A text's count is its initial symbols minus its merges, plus one for
every special string; no identifier is emitted.  A piece of n bytes takes O(n log n) steps,
so one endless word is no trouble.

Pieces repeat, so each Python worker keeps the counts of short pieces it has met, up to a
fixed number; the rest are counted again.  The table of merges is as large as the vocabulary
and reaches the executors as one broadcast.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stratalog.llm.common import bounded_batches, others

# The split of a byte-level pre-tokenizer, as the format defines it.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# No character below this one is unassigned.
FIRST_UNASSIGNED = "\u0378"
CACHE_PIECES = 1 << 19
CACHE_LENGTH = 64


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary, as letter -> byte.

    Printable bytes stand for themselves; the others take the letters from 256 on, in order.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(printable)]
    return {**{chr(b): b for b in printable}, **{chr(256 + i): b for i, b in enumerate(hidden)}}


class Merges:
    """Counts tokens of texts; made from the content of a tokenizer file."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        model, split = spec["model"], spec["pre_tokenizer"]
        if (model["type"] != "BPE" or split["type"] != "ByteLevel" or split["add_prefix_space"]
                or not split.get("use_regex", True) or spec["normalizer"] or model["ignore_merges"]
                or any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in spec["added_tokens"])):
            raise ValueError("a byte-level BPE tokenizer without normalizer is needed")
        vocab, letters = model["vocab"], byte_letters()
        self.first = [0] * 256
        for letter, byte in letters.items():
            self.first[byte] = vocab[letter]
        # (left, right) -> (rank, merged symbol)
        self.table = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.table[vocab[left], vocab[right]] = rank, vocab[left + right]
        special = sorted((a["content"] for a in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.plain = regex.compile(BYTE_LEVEL).findall
        self.high = re.compile(f"[{FIRST_UNASSIGNED}-\U0010ffff]").search
        self.known = _Known(self)

    def piece(self, data: bytes) -> int:
        """Tokens of one piece: its bytes minus the merges done."""
        table, n = self.table, len(data)
        symbol = [self.first[b] for b in data]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [found[0] << 32 | i for i in range(n - 1)
                if (found := table.get((symbol[i], symbol[i + 1]))) is not None]
        heapq.heapify(heap)
        left = n
        while heap:
            top = heapq.heappop(heap)
            i, rank = top & 0xFFFFFFFF, top >> 32
            j = after[i]
            if symbol[i] < 0 or j >= n:
                continue
            found = table.get((symbol[i], symbol[j]))
            if found is None or found[0] != rank:
                continue
            symbol[i], symbol[j] = found[1], -1
            left -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (found := table.get((symbol[i], symbol[k]))) is not None:
                    heapq.heappush(heap, found[0] << 32 | i)
            if (h := before[i]) >= 0 and (found := table.get((symbol[h], symbol[i]))) is not None:
                heapq.heappush(heap, found[0] << 32 | h)
        return left

    def pieces(self, text: str) -> list[str]:
        if self.high(text) and any(unicodedata.category(c) == "Cn" for c in set(text)):
            return careful_split()(text)
        return self.plain(text)

    def count(self, text: str) -> int:
        known, total, parts = self.known, 0, [text]
        if self.special is not None and (parts := self.special.split(text))[1:]:
            total = len(parts) - 1
        for part in parts:
            total += sum(map(known.__getitem__, self.pieces(part)))
        return total


@lru_cache(maxsize=1)
def careful_split() -> Callable[[str], list[str]]:
    """The split for texts with unassigned characters, which are neither letters nor digits.

    The regex module takes some of them for letters, so its classes are cut down here.
    """
    spans: list[list[int]] = []
    for c in range(ord(FIRST_UNASSIGNED), sys.maxunicode + 1):
        if unicodedata.category(chr(c)) == "Cn":
            if spans and spans[-1][1] == c - 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
    free = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)
    shape = BYTE_LEVEL.replace(r"[^\s\p{L}\p{N}]", f"(?:[^\\s\\p{{L}}\\p{{N}}]|[{free}])")
    for kind in ("L", "N"):
        shape = shape.replace(rf" ?\p{{{kind}}}+", rf" ?[\p{{{kind}}}--[{free}]]+")
    return regex.compile(shape, regex.V1).findall


class _Known(dict):
    """Counts by piece; emptied when full, and long pieces are not kept."""

    def __init__(self, merges: Merges):
        super().__init__()
        self.merges = merges

    def __missing__(self, piece: str) -> int:
        n = self.merges.piece(piece.encode())
        if len(piece) <= CACHE_LENGTH:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = n
        return n


@lru_cache(maxsize=1)
def merges_of(content: bytes) -> Merges:
    """One table per worker and file, however many tasks the worker runs."""
    return Merges(content)


def token_count(spark: SparkSession, path: str, text: Column) -> Column:
    """Tokens of a text column by the tokenizer file at ``path`` on the driver; null counts as empty."""
    content = spark.sparkContext.broadcast(Path(path).read_bytes())

    @F.arrow_udf("long")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        merges = merges_of(content.value)
        for batch in batches:
            yield pa.array([merges.count(t or "") for t in batch.to_pylist()], pa.int64())

    return counted(text)


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = 512) -> DataFrame:
    """The rows with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    Null and empty texts have no bytes and no tokens; every row, repeated or not, is counted;
    columns of the input with one of the new names are replaced; an empty table stays empty.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    kept = others(docs, ("n_bytes", "n_tokens", "over_limit"))
    return docs.select(
        *kept, F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes"),
        token_count(spark, path, F.col(text)).alias("n_tokens")).select(
        *kept, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
