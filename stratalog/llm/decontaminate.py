"""Benchmark decontamination: one Aho-Corasick automaton over the benchmark's windows.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased.  Each window of
ten consecutive words of a question or answer is one pattern.  Its symbols are word numbers, so
a pattern has ten nodes whatever the words' lengths, and a document is walked once as the
numbers of its words; a word of no window is a symbol of its own that no pattern has.  The
normalisation keeps the place of every byte, so the words of a hit map back to offsets of the
original text.

An automaton is bounded by ``symbols_per_automaton`` (about 50 bytes each in a worker).  Beyond
that the windows are dealt to several, and a task walks one after the other over a bounded
group of its texts: it holds one automaton and one group, and every window counts.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator, Sequence
from itertools import repeat

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stratalog.llm.common import LOWER_BYTES, bounded_batches, free, others, whole_row

WINDOW = 10
# Every byte that is no part of a word becomes a blank; A-Z become a-z; the rest stays.
_WORD = set(b"abcdefghijklmnopqrstuvwxyz0123456789") | set(range(0x80, 0x100))
PLAIN = bytes(LOWER_BYTES[b] if LOWER_BYTES[b] in _WORD else 0x20 for b in range(256))
RESULT = ("n_words long, n_hit long, items array<string>, "
          "spans array<struct<start: long, end: long>>")
_TYPE = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
                   ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def words(text: str) -> list[bytes]:
    return text.encode().translate(PLAIN).split()


def windows_of(items: DataFrame, item_id: str, text: str, size: int = WINDOW) -> DataFrame:
    """window, items: each distinct window with the ids, as strings, that hold it.

    An item of fewer than ``size`` words is one window; one without words has none.
    """
    @F.arrow_udf("array<string>")
    def cut(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            w = [x.decode() for x in words(t.as_py() or "")]
            out.append(sorted({" ".join(w[i:i + size]) for i in range(max(1, len(w) - size + 1))})
                       if w else [])
        return pa.array(out, pa.list_(pa.string()))

    named = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"),
                         F.explode(cut(F.col(text))).alias("window"))
    return named.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))


class Automaton:
    """Walks over the words of texts and reports the items and words that were hit."""

    def __init__(self, windows: Iterable[tuple[str, Sequence[str]]]):
        self.walk = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        self.number: dict[bytes, int] = {}
        self.sizes, self.items = array("l"), []
        names: dict[str, str] = {}
        for k, (window, items) in enumerate(windows):
            symbols = tuple([self.number.setdefault(w, len(self.number) + 1)
                             for w in window.encode().split()])
            self.walk.add_word(symbols, k)
            self.sizes.append(len(symbols))
            self.items.append(tuple([names.setdefault(i, i) for i in items]))
        if len(self.walk):
            self.walk.make_automaton()

    def hits(self, found: list[bytes]) -> tuple[set[int], set[str]]:
        """Indexes of the words inside any occurrence, and the items of those windows."""
        hit: set[int] = set()
        items: set[str] = set()
        if not found or not len(self.walk):
            return hit, items
        for last, k in self.walk.iter(tuple(map(self.number.get, found, repeat(0)))):
            hit.update(range(last - self.sizes[k] + 1, last + 1))
            items.update(self.items[k])
        return hit, items


def _row(text: str, n: int, hit: set[int], items: set[str]) -> dict:
    return {"n_words": n, "n_hit": len(hit), "items": sorted(items),
            "spans": _spans(text, hit) if hit else []}


def _spans(text: str, hit: set[int]) -> list[dict]:
    """Runs of hit words as character offsets of the original text, end exclusive."""
    data = text.encode()
    places = [m.span() for m in re.finditer(rb"[^ ]+", data.translate(PLAIN))]
    runs: list[list[int]] = []
    for i in sorted(hit):
        if runs and runs[-1][1] == i - 1:
            runs[-1][1] = i
        else:
            runs.append([i, i])
    out, at, chars = [], 0, 0
    for first, last in runs:
        start, end = places[first][0], places[last][1]
        chars += len(data[at:start].decode())
        length = len(data[start:end].decode())
        out.append({"start": chars, "end": chars + length})
        chars, at = chars + length, end
    return out


def find_overlap(docs: DataFrame, benchmark: DataFrame, item_id: str = "item_id",
                 item_text: str = "text", text: str = "text", size: int = WINDOW,
                 symbols_per_automaton: int = 5_000_000, group_bytes: int = 32 << 20) -> DataFrame:
    """The rows with n_words, n_hit, items (ids as sorted strings) and spans.

    Null texts and texts without words have no words and no hits.  Repeated rows are all
    reported; a window that several items share counts for each of them; columns of the
    input with one of the new names are replaced.  An empty benchmark hits nothing.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shards, part, symbols = [], [], 0
    for row in windows_of(benchmark, item_id, item_text, size).toLocalIterator():
        part.append((row["window"], tuple(row["items"])))
        symbols += row["window"].count(" ") + 1
        if symbols >= symbols_per_automaton:
            shards.append(spark.sparkContext.broadcast(tuple(part)))
            part, symbols = [], 0
    if part or not shards:
        shards.append(spark.sparkContext.broadcast(tuple(part)))

    @F.arrow_udf(RESULT)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if len(shards) == 1:
            automaton = Automaton(shards[0].value)
            for batch in batches:
                out = []
                for t in batch.to_pylist():
                    found = words(t or "")
                    out.append(_row(t, len(found), *automaton.hits(found)))
                yield pa.array(out, _TYPE)
            return
        order, built = list(range(len(shards))), (None, None)
        for group in grouped(batches, group_bytes):
            hit = [[(set(), set()) for _ in texts] for texts in group]
            for k in order:
                if built[0] != k:
                    built = (None, None)  # one automaton at a time
                    built = (k, Automaton(shards[k].value))
                for texts, sofar in zip(group, hit):
                    for t, (places, items) in zip(texts, sofar):
                        more, names = built[1].hits(words(t or ""))
                        places |= more
                        items |= names
            order.reverse()  # the next group begins with the automaton that is there
            for texts, sofar in zip(group, hit):
                yield pa.array([_row(t, len(words(t or "")), *h) for t, h in zip(texts, sofar)], _TYPE)

    new = ("n_words", "n_hit", "items", "spans")
    kept = others(docs, new)
    found = free("_found", kept)
    return (docs.select(*kept, scan(F.col(text)).alias(found))
            .select(*kept, *[F.col(f"{found}.{c}").alias(c) for c in new]))


def grouped(batches: Iterable[pa.Array], size: int) -> Iterator[list[list[str | None]]]:
    """The texts of the batches, as many batches together as reach ``size`` bytes."""
    group, held = [], 0
    for batch in batches:
        group.append(batch.to_pylist())
        held += batch.nbytes
        if held >= size:
            yield group
            group, held = [], 0
    if group:
        yield group


def drop_overlapping(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that no benchmark window hits, with their columns.

    Null, empty and blank texts have no words and stay; repeated rows stay or go together, an
    empty table gives an empty one.
    """
    held = docs.select(whole_row(docs).alias("_row"), F.col(text).alias("_text"))
    found = find_overlap(held, benchmark, text="_text", **options)
    return found.filter("n_hit = 0").select("_row.*")
