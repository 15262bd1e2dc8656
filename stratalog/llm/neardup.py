"""Near duplicates: MinHash bands, links confirmed on full shingle sets, star components.

1. Each text becomes its set of distinct word shingles; equal sets are one class, so copies
   count once from here on.  A class is named by its smallest id.
2. Minima of many universal hash functions over the set are cut into bands.  Classes that
   share a band have it in a bucket; a bucket is an edge from every member to its smallest.
   Components of those edges (large-star, small-star) are families: all candidates of a class
   are in its family.
3. Families are verified.  A family is split by size class and then into blocks of bounded rows
   and bytes; only pairs of blocks whose sizes can reach the similarity meet.  In a pair of
   blocks, members that are not yet joined compare their signatures (all minima); only a pair
   whose signatures agree often enough is counted on the full sets, as bit rows, which decides.
   The task returns for each member the smallest it reaches: never more rows than members.
4. The links' components, again by stars, are the groups.

Bands of 6 in 45 miss a pair at similarity 0.8 with probability 1e-6, less above; signatures
of 270 minima of such a pair agree in less than the estimate asked for (0.25 below the similarity)
with probability below 1e-20.  Sets and signatures are moved only for classes with a candidate,
once each in families of one block.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from stratalog.llm.common import Screen, bounded_batches, pick, spread, whole_row, written
from stratalog.llm.components import connected
from stratalog.llm.fuse import mix
from stratalog.llm.shingles import Minima, lower_words, shingle_set

NO_ID = 2**63 - 1  # stands for a null id inside, after all others
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Plan:
    """Shingle length, least similarity in per cent, bands, and the bounds of a block."""

    words: int = 5
    percent: int = 80
    bands: int = 45
    rows: int = 6
    seed: int = 7
    block_members: int = 1024
    block_shingles: int = 1 << 20
    slack: int = 25  # per cent that an estimate may lie below the similarity

    @property
    def agreeing(self) -> int:
        """Minima that must agree before a pair's sets are compared."""
        return self.bands * self.rows * (self.percent - self.slack) // 100


def _prints(plan: Plan):
    @F.arrow_udf("n long, class binary, bands array<long>")
    def prints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        minima = Minima(plan.bands * plan.rows, plan.seed)
        for batch in batches:
            n, names, bands = [], [], []
            for text in batch.to_pylist():
                s = shingle_set(lower_words(text), plan.words)
                n.append(len(s))
                names.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                bands.append(_keys(minima(s), plan) if len(s) else None)
            yield pa.StructArray.from_arrays(
                [pa.array(n, pa.int64()), pa.array(names, pa.binary()),
                 pa.array(bands, pa.list_(pa.int64()))], names=["n", "class", "bands"])
    return prints


def _keys(minima: np.ndarray, plan: Plan) -> np.ndarray:
    """One 64-bit key per band, the band's number mixed in."""
    m = minima.reshape(plan.bands, plan.rows).astype(np.uint64)
    key = np.arange(1, plan.bands + 1, dtype=np.uint64)
    for k in range(plan.rows):
        key = mix(key * _STEP + m[:, k])
    return key.view(np.int64)


def _sets(plan: Plan):
    @F.arrow_udf("n long, class binary, shingles binary, signature binary")
    def sets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        minima = Minima(plan.bands * plan.rows, plan.seed)
        for batch in batches:
            out = [shingle_set(lower_words(t), plan.words) for t in batch.to_pylist()]
            yield pa.StructArray.from_arrays(
                [pa.array([len(s) for s in out], pa.int64()),
                 pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in out],
                          pa.binary()),
                 pa.array([s.tobytes() for s in out], pa.binary()),
                 pa.array([minima(s).tobytes() for s in out], pa.binary())],
                names=["n", "class", "shingles", "signature"])
    return sets


def candidates(classes: DataFrame) -> DataFrame:
    """u, v: every member of a bucket with the bucket's smallest member; from node, bands."""
    rows = classes.select("node", F.explode("bands").alias("key"))
    shared = written(rows.groupBy("key").agg(F.min("node").alias("v"), F.count(F.lit(1)).alias("n"))
                     .filter("n > 1").select("key", "v"), "buckets", True)
    return (Screen(shared, "key").split(rows, F.col("key")).join(shared, "key").filter("node <> v")
            .select(F.col("node").alias("u"), "v").distinct())


def _tasks(members: DataFrame, plan: Plan) -> DataFrame:
    """The members (family, node, n) with every pair of blocks they take part in.

    A member's size class is the power of 100 / percent at its size; sets that can reach the
    similarity are in the same class or in neighbouring ones.  Hashes deal the members of a
    class to its blocks.
    """
    grade = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / plan.percent)) + 1e-9)
    rows = members.withColumn("grade", grade.cast("int"))

    def blocks(count, total):
        return F.greatest(F.ceil(count / F.lit(plan.block_members)),
                          F.ceil(total / F.lit(plan.block_shingles))).cast("int")

    grades = rows.groupBy("family", "grade").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    # Grades are few, whatever the family's size; a family that fits one block has but one.
    family = Window.partitionBy("family")
    near = family.orderBy("grade").rangeBetween
    known = grades.withColumns({
        "whole": (F.sum("c").over(family) <= plan.block_members)
        & (F.sum("s").over(family) <= plan.block_shingles),
        "own": blocks(F.col("c"), F.col("s")),
        "below": F.coalesce(F.max(blocks(F.col("c"), F.col("s"))).over(near(-1, -1)), F.lit(0)),
        "above": F.coalesce(F.max(blocks(F.col("c"), F.col("s"))).over(near(1, 1)), F.lit(0))})
    mine = F.pmod(F.xxhash64("node"), F.col("own")).cast("int")

    def each(count, left, right):
        """Structs (grade, block of left, next grade or the same, block of right) per partner."""
        return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(
            *[x.cast("int").alias(n) for n, x in zip(("a", "i", "b", "j"), (*left(i), *right(i)))])
        )).otherwise(F.array())

    g = F.col("grade")
    same = each(F.col("own"), lambda i: (g, F.least(F.col("block"), i)),
                lambda i: (g, F.greatest(F.col("block"), i)))
    up = each(F.col("above"), lambda i: (g, F.col("block")), lambda i: (g + 1, i))
    down = each(F.col("below"), lambda i: (g - 1, i), lambda i: (g, F.col("block")))
    whole = F.array(F.struct(*[F.lit(0).alias(n) for n in ("a", "i", "b", "j")]))
    joined = rows.join(known.select("family", "grade", "whole", "own", "below", "above"),
                       ["family", "grade"]).withColumn("block", mine)
    return (joined.withColumn("task", F.explode(
        F.when(F.col("whole"), whole).otherwise(F.concat(same, up, down))))
        # Whether the member is on the left of the pair, the right, or both in one block.
        .withColumn("side", F.when(F.col("whole") | ((F.col("task.a") == F.col("task.b"))
                                                     & (F.col("task.i") == F.col("task.j"))), 2)
                    .when((F.col("task.a") == g) & (F.col("task.i") == F.col("block")), 0)
                    .otherwise(1))
        .select("node", "n", "side", F.xxhash64("family", "task").alias("task")))


def links_of(nodes: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], signatures: np.ndarray,
             plan: Plan, tally: Counter | None = None) -> list[tuple[int, int]]:
    """The links of a pair of blocks, as edges from each member to the smallest it reaches.

    ``tally`` counts the pairs whose signatures, and whose sets, were compared.
    """
    m = len(nodes)
    sizes = np.array([len(s) for s in sets])
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.full(len(count), -1)
    number[count > 1] = np.arange(int((count > 1).sum()))
    column = number[place]
    row = np.repeat(np.arange(m), sizes)
    words = max(1, -(-int(number.max(initial=-1) + 1) // 64))
    bits = np.zeros((m, words), np.uint64)
    row, column = row[column >= 0], column[column >= 0]
    np.bitwise_or.at(bits, (row, column >> 6), np.uint64(1) << (column & 63).astype(np.uint64))

    top = np.arange(m)  # smallest member each one reaches
    for i in range(m - 1):
        loose = top[i + 1:] != top[i]
        if sides[i] != 2:
            loose &= sides[i + 1:] != sides[i]
        others = np.flatnonzero(loose) + i + 1
        alike = others[(signatures[others] == signatures[i]).sum(axis=1) >= plan.agreeing]
        if tally is not None:
            tally.update(signatures=len(others), sets=len(alike))
        if not len(alike):
            continue
        common = np.bitwise_count(bits[i] & bits[alike]).sum(axis=1, dtype=np.int64)
        near = alike[100 * common >= plan.percent * (sizes[i] + sizes[alike] - common)]
        if len(near):
            joined = np.unique(top[np.append(near, i)])
            top[np.isin(top, joined)] = joined[0]
    return [(int(nodes[i]), int(nodes[top[i]])) for i in range(m) if top[i] != i]


def _verify(rows: DataFrame, plan: Plan) -> DataFrame:
    """u, v: confirmed links of rows task, node, side, shingles, signature, one task after the other."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held = None, []

        def done() -> pa.RecordBatch:
            links = []
            if len(held) > 1:
                nodes, sides, sets, minima = zip(*sorted(held, key=lambda x: x[0]))
                links = links_of(np.array(nodes), np.array(sides),
                                 [np.frombuffer(s, np.uint64) for s in sets],
                                 np.stack([np.frombuffer(x, np.uint32) for x in minima]), plan)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64())
                                               for k in range(2)], names=["u", "v"])

        for batch in batches:
            for t, *member in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if t != task:
                    yield done()
                    task, held = t, []
                held.append(member)
        yield done()

    dealt = (rows.select("task", "node", "side", "shingles", "signature")
             .repartition(spread(rows), "task").sortWithinPartitions("task"))
    return dealt.mapInArrow(run, "u long, v long")


def find_groups(docs: DataFrame, plan: Plan = Plan(), text: str = "text", doc_id: str = "doc_id"
                ) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    A-Z are lower-cased and words end at space, tab to carriage return.  A text with fewer
    words than a shingle is one shingle; null, empty and blank texts have none and are linked
    with nothing.  Rows repeated with their id are one document; so are different texts under
    one id, with the links of all of them.  A null id comes after all others and stands for one
    document.  An empty table gives an empty one.
    """
    bounded_batches(docs.sparkSession)
    node = F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))
    rows = docs.select(node.alias("node"), F.col(text).alias("text"))
    prints = written(rows.select("node", _prints(plan)("text").alias("_p"))
                     .select("node", "_p.*"), "prints")
    classes = written(prints.filter("n > 0").groupBy("class")
                      .agg(F.min("node").alias("node"), F.first("bands").alias("bands")), "classes")
    families = connected(candidates(classes))
    families = written(families.unionAll(
        families.select(F.col("component").alias("node"), "component").distinct()), "families", True)

    # The sets of the classes that have a candidate, read from their texts again.
    named = classes.select("node", "class").join(families, "node")
    texts = pick(rows, families, "node").select("node", _sets(plan)("text").alias("_s")).select(
        "node", "_s.*")
    sets = written(texts.join(named, ["node", "class"]).dropDuplicates(["node", "class"])
                   .select("node", "n", "shingles", "signature", F.col("component").alias("family")),
                   "sets")
    tasks = _tasks(sets.select("family", "node", "n"), plan)
    links = _verify(tasks.join(sets.drop("family"), ["node", "n"]), plan)
    groups = written(connected(links), "groups", True)

    of_class = classes.select("class", F.col("node").alias("first")).join(
        groups.select(F.col("node").alias("first"), "component"), "first", "left").select(
        "class", F.coalesce("component", "first").alias("component"))
    full = prints.filter("n > 0").select("node", "n", "class").join(of_class, "class")
    least = full.groupBy("node").agg(F.min("component").alias("lowest"),
                                     F.count_distinct("class").alias("texts"))
    placed = full.select("node", "n", "component")
    if least.filter("texts > 1").isEmpty():
        settled = placed
    else:  # an id with several texts: all of its groups are one
        joint = full.join(least.filter("texts > 1"), "node").select(
            F.col("component").alias("u"), F.col("lowest").alias("v"))
        merged = connected(joint).select(F.col("node").alias("component"),
                                         F.col("component").alias("_m"))
        settled = placed.join(merged, "component", "left").select(
            "node", "n", F.coalesce("_m", "component").alias("component"))
    bare = prints.filter("n = 0").select("node", "n", F.col("node").alias("component"))
    back = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return settled.unionAll(bare).select(
        back("node").alias("doc_id"), F.col("n").alias("n_shingles"),
        back("component").alias("component_id"), (F.col("node") == F.col("component")).alias("kept"))


def drop_near_copies(docs: DataFrame, plan: Plan = Plan(), text: str = "text",
                     doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, one of each group, with their columns.

    Rows whose id is settled as kept never move; of rows repeated with their id one stays.
    """
    found = written(find_groups(docs, plan, text, doc_id), "near", True)
    ids = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.min("kept").alias("kept"))
    unsure = written(ids.filter("rows > 1 OR NOT kept"), "unsure", True)
    maybe, key = Screen(unsure), F.col(doc_id).cast("long")
    asked = maybe.split(docs, key).select(whole_row(docs).alias("row"), key.alias("_id"),
                                           F.col(text).alias("_text"))
    gone = unsure.filter("NOT kept").select(F.col("doc_id").alias("_g"))
    twice = unsure.filter("kept").select(F.col("doc_id").alias("_r"))
    stay = asked.join(gone, F.col("_id").eqNullSafe(F.col("_g")), "left_anti")
    single = stay.join(twice, F.col("_id").eqNullSafe(F.col("_r")), "left_anti")
    several = (stay.join(twice, F.col("_id").eqNullSafe(F.col("_r")), "left_semi")
               .withColumn("_nth", F.row_number().over(Window.partitionBy("_id").orderBy("_text")))
               .filter("_nth = 1"))
    return (maybe.split(docs, key, False).unionAll(single.select("row.*"))
            .unionAll(several.select("row.*")))
