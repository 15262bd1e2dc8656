"""Spelling variants: words one edit apart, found by probing Bloom filters with generated edits.

1. Words are counted per task and added up; words of enough letters and occurrences are the
   vocabulary, written once.
2. Every length has its shard of blocked Bloom filters: 512-bit blocks, as many as the words
   of that length need.  All shards lie one after the other in one space of blocks, which is
   cut into pages of bounded bytes.  A page is the only thing that is broadcast; a
   vocabulary that needs more pages is probed page by page, so the bound holds at any size.
3. Each word generates its edits as hashes alone: a hash is a sum over letters and places, so
   an edit's hash is a difference of prefix sums, for all words of a length at once.
   Deletions, and replacements by letters that come later in code-point order, reach every
   pair of near words exactly once from one of its two sides; insertions are the deletions
   of the other word.
4. Only edits that pass are written out as strings and shuffled to an exact join with the
   vocabulary, which removes false positives.

A word has at most (2 letters + 1) times the alphabet near words, so no group grows with the
corpus.  Roots are found by pointer doubling; a form has a multiple of its word's
occurrences, so chains are logarithmic in the largest count.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from stratalog.llm.common import LOWER, UPPER, bounded_batches, spread, written
from stratalog.llm.fuse import mix

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
# Every code point a lower-cased word can hold, in order.
ALPHABET = np.array([*range(0x61, 0x7B), *range(0xC0, 0x100)], np.uint32)
_TO_LOWER = str.maketrans(UPPER, LOWER)
COUNTED_WORDS = 1 << 17  # distinct words a task holds before it hands them on,
COUNTED_LETTERS = 1 << 26  # and letters it reads before that at most
CELLS = 1 << 18          # letters worked on at once
LONGEST_SHARD = 64       # words of more letters share one shard
BLOCK_WORDS = 8          # 64-bit words of a block
PROBES = 5
BASE = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(int(BASE), -1, 1 << 64))


@dataclass(frozen=True)
class Plan:
    """Least letters and occurrences of a word, the factor of a form, the bounds of the filters."""

    letters: int = 6
    occurrences: int = 5
    factor: int = 5
    bits_per_word: int = 16
    page_bytes: int = 32 << 20


def count_words(docs: DataFrame, plan: Plan = Plan(), text: str = "text", doc_id: str = "doc_id",
                change: Callable[[int | None, str], str] | None = None) -> DataFrame:
    """word, n of the whole texts: runs of letters, A-Z lower-cased, by length and occurrences.

    ``change`` is what a word of a document becomes before it is counted.
    """
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        read = 0

        def flush() -> pa.RecordBatch:
            out = [(w, n) for w, n in held.items() if len(w) >= plan.letters]
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in out], pa.string()), pa.array([n for _, n in out], pa.int64())],
                names=["word", "n"])

        for batch in batches:
            for doc, t in zip(*(batch.column(i).to_pylist() for i in range(2))):
                own = Counter(LETTERS.findall((t or "").translate(_TO_LOWER)))
                if change is None:
                    held.update(own)
                else:
                    for w, n in own.items():
                        held[change(doc, w)] += n
                read += len(t or "")
                if len(held) >= COUNTED_WORDS or read >= COUNTED_LETTERS:
                    yield flush()
                    read = 0
        yield flush()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    return (rows.mapInArrow(counted, "word string, n long").groupBy("word")
            .agg(F.sum("n").alias("n")).filter(F.col("n") >= plan.occurrences))


def letters_of(words: Sequence[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)


def _values(codes: np.ndarray) -> np.ndarray:
    return mix(codes.astype(np.uint64) + np.uint64(1)) | np.uint64(1)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, BASE)
    out[0:1] = 1
    return np.multiply.accumulate(out)


def hashes(codes: np.ndarray) -> np.ndarray:
    """One hash per row of code points: the sum of its letters, each times a power of its place."""
    return (_values(codes) * _powers(codes.shape[1])).sum(axis=1, dtype=np.uint64)


@dataclass(frozen=True)
class Shards:
    """Where the blocks of each length begin in the space of blocks; a length may have none."""

    begins: tuple[int, ...]

    @staticmethod
    def sized(words_by_length: dict[int, int], bits_per_word: int) -> "Shards":
        begins = [0] * (LONGEST_SHARD + 2)
        sizes = Counter()
        for length, n in words_by_length.items():
            sizes[min(length, LONGEST_SHARD)] += n
        for length in range(LONGEST_SHARD + 1):
            blocks = -(-sizes[length] * bits_per_word // (64 * BLOCK_WORDS))
            begins[length + 1] = begins[length] + blocks
        return Shards(tuple(begins))

    @property
    def blocks(self) -> int:
        return self.begins[-1]

    def range(self, length: int) -> tuple[int, int]:
        at = min(length, LONGEST_SHARD)
        return self.begins[at], self.begins[at + 1]

    def place(self, length: int, summed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Block of each hash of words of one length, and the bits to draw its probes from."""
        low, high = self.range(length)
        mixed = mix(summed + np.uint64(length))
        block = ((mixed >> np.uint64(32)) * np.uint64(high - low) >> np.uint64(32)) + np.uint64(low)
        return block.astype(np.int64), mix(mixed + BASE)


def _probe(drawn: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k-th probe: its 64-bit word in the block and its bit."""
    nine = drawn >> np.uint64(9 * k)
    return (nine >> np.uint64(6) & np.uint64(7)).astype(np.int64), np.uint64(1) << (nine & np.uint64(63))


class Page:
    """The blocks low .. high - 1 of the filters, as one array."""

    def __init__(self, shards: Shards, low: int, high: int, bits: np.ndarray):
        self.shards, self.low, self.high, self.bits = shards, low, high, bits

    def touches(self, length: int) -> bool:
        low, high = self.shards.range(length)
        return low < high and low < self.high and high > self.low

    def holds(self, length: int, summed: np.ndarray) -> np.ndarray:
        """Indexes of the hashes that may be words of this length in this page."""
        block, drawn = self.shards.place(length, summed)
        left = np.flatnonzero((block >= self.low) & (block < self.high))
        block, drawn = (block[left] - self.low) * BLOCK_WORDS, drawn[left]
        for k in range(PROBES):
            word, bit = _probe(drawn, k)
            ok = self.bits[block + word] & bit != 0
            left, block, drawn = left[ok], block[ok], drawn[ok]
        return left


def edits(codes: np.ndarray, page: Page) -> Iterator[tuple[int, int, int | None]]:
    """row, place, letter (none: deleted) of the edits of words of one length that pass the page."""
    m, length = codes.shape
    values = _values(codes)
    power = _powers(length)
    terms = values * power
    summed = terms.sum(axis=1, dtype=np.uint64)
    if length > 1 and page.touches(length - 1):
        before = np.cumsum(terms, axis=1, dtype=np.uint64)
        shorter = before - terms + (summed[:, None] - before) * BACK
        # Of a run of equal letters the first stands for all: their deletions are one word.
        first = np.ones((m, length), bool)
        first[:, 1:] = codes[:, 1:] != codes[:, :-1]
        cells = np.flatnonzero(first)
        for c in cells[page.holds(length - 1, shorter.reshape(-1)[cells])].tolist():
            yield c // length, c % length, None
    if page.touches(length):
        bare = summed[:, None] - terms
        for letter, value in zip(ALPHABET.tolist(), _values(ALPHABET)):
            cells = np.flatnonzero(codes < letter)
            changed = (bare + power * value).reshape(-1)[cells]
            for c in cells[page.holds(length, changed)].tolist():
                yield c // length, c % length, letter


def _by_length(words: Sequence[str]) -> Iterator[list[int]]:
    """Indexes of words of one length, of a bounded number of letters together."""
    of: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        of.setdefault(len(w), []).append(i)
    for length, members in of.items():
        step = max(1, CELLS // max(1, length))
        for at in range(0, len(members), step):
            yield members[at:at + step]


def build_filters(vocabulary: DataFrame, shards: Shards) -> DataFrame:
    """place (of a 64-bit word in the space of blocks), bits: the filters of the vocabulary."""
    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            at, bits = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
            for members in _by_length(words):
                codes = letters_of([words[i] for i in members])
                block, drawn = shards.place(codes.shape[1], hashes(codes))
                for k in range(PROBES):
                    word, bit = _probe(drawn, k)
                    at.append(block * BLOCK_WORDS + word)
                    bits.append(bit)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(at)),
                                              pa.array(np.concatenate(bits).view(np.int64))],
                                             names=["place", "bits"])

    return (vocabulary.select("word").mapInArrow(marked, "place long, bits long")
            .groupBy("place").agg(F.bit_or("bits").alias("bits")))


def pages(filters: DataFrame, shards: Shards, page_bytes: int) -> Iterator[Page]:
    """The filters page by page, none of more than ``page_bytes``."""
    step = max(1, page_bytes // (8 * BLOCK_WORDS))
    for low in range(0, shards.blocks, step):
        high = min(low + step, shards.blocks)
        bits = np.zeros((high - low) * BLOCK_WORDS, np.uint64)
        part = filters.filter(F.col("place").between(low * BLOCK_WORDS, high * BLOCK_WORDS - 1))
        table = part.toArrow()
        bits[table["place"].to_numpy() - low * BLOCK_WORDS] = table["bits"].to_numpy().view(np.uint64)
        yield Page(shards, low, high, bits)


def positives(vocabulary: DataFrame, page: Page) -> DataFrame:
    """word, n, edit: the edits of the vocabulary that pass a page of the filters."""
    held = vocabulary.sparkSession.sparkContext.broadcast(page)

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[str] = []
        ns: list[int] = []
        letters = 0

        def passed() -> Iterator[pa.RecordBatch]:
            for members in _by_length(words):
                out = []
                codes = letters_of([words[i] for i in members])
                for row, place, letter in edits(codes, held.value):
                    w = words[members[row]]
                    new = "" if letter is None else chr(letter)
                    out.append((w, ns[members[row]], w[:place] + new + w[place + 1:]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[k] for x in out], t)
                     for k, t in enumerate((pa.string(), pa.int64(), pa.string()))],
                    names=["word", "n", "edit"])

        for batch in batches:
            more = batch.column(0).to_pylist()
            words += more
            ns += batch.column(1).to_pylist()
            letters += sum(map(len, more))
            if letters >= CELLS:  # many words of each length at once
                yield from passed()
                words, ns, letters = [], [], 0
        yield from passed()

    dealt = vocabulary.select("word", "n").repartition(spread(vocabulary), "word")
    return dealt.mapInArrow(probed, "word string, n long, edit string")


def near_words(vocabulary: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """word, n, near, near_n of all ordered pairs of words one edit apart; from word, n, written."""
    by_length = {r["length"]: r["n"] for r in vocabulary.groupBy(
        F.least(F.length("word"), F.lit(LONGEST_SHARD)).alias("length"))
        .agg(F.count(F.lit(1)).alias("n")).collect()}
    shards = Shards.sized(by_length, plan.bits_per_word)
    filters = written(build_filters(vocabulary, shards), "filters", True)
    found = None
    for page in pages(filters, shards, plan.page_bytes):
        part = positives(vocabulary, page)
        found = part if found is None else found.unionAll(part)
    if found is None:
        return vocabulary.select("word", "n", F.col("word").alias("near"), F.col("n").alias("near_n"))
    exact = vocabulary.select(F.col("word").alias("edit"), F.col("n").alias("near_n"))
    pairs = written(found.join(exact, "edit").select("word", "n", F.col("edit").alias("near"),
                                                     "near_n"), "near", True)
    return pairs.unionAll(pairs.select("near", "near_n", "word", "n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last of the forms that follow each word; from word, form, never in a ring.

    Every round doubles the steps taken, until no word's end has a form of its own.
    """
    state = written(forms.select("word", F.col("form").alias("root")), "roots", True)
    while True:
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = state.join(ahead, "root", "left")
        new = written(joined.select("word", F.coalesce("next", "root").alias("root"),
                                    F.col("next").isNotNull().alias("moved")), "roots", True)
        state = new.select("word", "root")
        if new.filter("moved").isEmpty():
            return state


def find_variants(docs: DataFrame, plan: Plan = Plan(), text: str = "text", doc_id: str = "doc_id",
                  change: Callable[[int | None, str], str] | None = None) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of the vocabulary.

    A word's form is its near word of most occurrences (ties: smallest in code-point order)
    if that has ``factor`` times the word's; else null, as is form_n, and the word is its own
    root.  Null, empty and blank texts have no words, repeated rows count each time, a null id
    only matters to ``change``; other columns are not read; an empty table gives an empty one.
    """
    bounded_batches(docs.sparkSession)
    vocabulary = written(count_words(docs, plan, text, doc_id, change), "vocabulary", True)
    best = near_words(vocabulary, plan).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"),
        F.min(F.struct((-F.col("near_n")).alias("least"), "near")).alias("best"))
    known = vocabulary.join(best, "word", "left")
    most = -F.col("best.least")
    settled = written(known.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(most >= F.lit(plan.factor) * F.col("n"), F.struct(
            F.col("best.near").alias("form"), most.alias("form_n"))).alias("_f"))
        .select("word", "n", "n_near", "_f.form", "_f.form_n"), "forms", True)
    ends = roots(settled.filter("form IS NOT NULL"))
    return settled.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
