"""Ordered groups of any size: running totals and paged collection.

A day, an entity or a file may own a third of all rows, so no operator here sorts or
collects a whole group in one task.  A group is cut along order-preserving buckets
(coarse, then fine); bucket totals are small and give every bucket its start, and only
rows of one fine bucket share a window.  ``paged`` then collects text or structs page
by page, each page bounded by ``page_size`` plus one row.  A group that fits one page,
which is the normal case, comes back as a single row with ``page = 0``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

PAGE_CHARS = 4_000_000


class Order:
    """A total order inside a group, with two levels of order-preserving buckets.

    ``coarse`` and ``fine`` must be non-decreasing along ``columns`` and never null.
    """

    def __init__(self, columns: Sequence[str], coarse: Sequence[Column], fine: Sequence[Column]):
        self.columns, self.coarse, self.fine = list(columns), list(coarse), list(fine)


def by_time_and_id(time: str = "time", id_: str = "id") -> Order:
    """Entries of a day: by minute, then by second and three digits of the hashed id.

    Ids are uniform hex, so even a day whose rows all carry one time splits evenly.
    """
    at = F.coalesce(time, F.lit(""))
    return Order([time, id_], [F.substring(at, 1, 5)], [at, F.substring(id_, 1, 3)])


def by_date_and_seq(date: str, seq: str, rows_per_bucket: int = 65_536) -> Order:
    """Dated rows of an entity or label: by date, then by blocks of the sequence number."""
    return Order([date, seq], [F.coalesce(date, F.lit(""))],
                 [F.floor(F.col(seq) / F.lit(rows_per_bucket))])


def by_seq(seq: str, rows_per_bucket: int = 65_536) -> Order:
    return Order([seq], [F.floor(F.col(seq) / F.lit(rows_per_bucket * 65_536))],
                 [F.floor(F.col(seq) / F.lit(rows_per_bucket))])


def running_total(df: DataFrame, keys: Sequence[str], order: Order,
                  amounts: dict[str, Column]) -> DataFrame:
    """Add for each name the sum of its amount over all earlier rows of the same group."""
    keys, names = list(keys), list(amounts)
    c = [f"_c{i}" for i in range(len(order.coarse))]
    f = [f"_f{i}" for i in range(len(order.fine))]
    rows = df.withColumns({**dict(zip(c, order.coarse)), **dict(zip(f, order.fine)),
                           **{f"_amount_{n}": a.cast("long") for n, a in amounts.items()}})

    def before(name: str, group: list[str], along: list[str]) -> Column:
        w = (Window.partitionBy(*group).orderBy(*along)
             .rowsBetween(Window.unboundedPreceding, -1))
        return F.coalesce(F.sum(name).over(w), F.lit(0).cast("long"))

    fine = rows.groupBy(*keys, *c, *f).agg(*[F.sum(f"_amount_{n}").alias(f"_fine_{n}")
                                             for n in names])
    coarse = (fine.groupBy(*keys, *c).agg(*[F.sum(f"_fine_{n}").alias(f"_coarse_{n}")
                                            for n in names])
              .select(*keys, *c, *[before(f"_coarse_{n}", keys, c).alias(f"_base_{n}")
                                   for n in names]))
    starts = fine.join(coarse, [*keys, *c]).select(
        *keys, *c, *f, *[(F.col(f"_base_{n}") + before(f"_fine_{n}", keys + c, f))
                         .alias(f"_start_{n}") for n in names])
    return (rows.join(starts, [*keys, *c, *f])
            .select(*df.columns, *[(F.col(f"_start_{n}")
                                    + before(f"_amount_{n}", keys + c + f, order.columns)).alias(n)
                                   for n in names]))


def position(df: DataFrame, keys: Sequence[str], order: Order, out: str = "position") -> DataFrame:
    """Zero-based position of each row in its group."""
    return running_total(df, keys, order, {out: F.lit(1)})


def paged_text(df: DataFrame, keys: Sequence[str], order: Order, text: Column, separator: str,
               page_size: int = PAGE_CHARS) -> DataFrame:
    """Concatenate ``text`` per group in order: columns keys, page, n, start, chars, text.

    Joining the pages of a group with ``separator`` gives the whole text; ``start`` is a
    page's offset in it.
    """
    keys = list(keys)
    rows = df.select(*keys, *order.columns, text.alias("_text"))
    placed = running_total(rows, keys, order, {"_at": F.length("_text") + F.lit(len(separator))})
    return concat_pages(placed.withColumn("page", F.floor(F.col("_at") / F.lit(page_size))),
                        keys, order.columns, separator)


def concat_pages(placed: DataFrame, keys: Sequence[str], along: Sequence[str], separator: str
                 ) -> DataFrame:
    """Concatenate ``_text`` of rows that know their ``page`` and their offset ``_at``."""
    keys = list(keys)
    return (placed.groupBy(*keys, "page")
            .agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("start"),
                 F.array_sort(F.collect_list(F.struct(*along, "_text"))).alias("_rows"))
            .withColumn("text", F.array_join(F.transform("_rows", lambda r: r["_text"]), separator))
            .withColumn("chars", F.length("text").cast("long"))
            .select(*keys, "page", "n", "start", "chars", "text"))


def paged_rows(df: DataFrame, keys: Sequence[str], order: Order, fields: Sequence[str], out: str,
               size: Column, page_size: int = PAGE_CHARS) -> DataFrame:
    """Nest rows per group in order: columns keys, page, n, and an array of structs."""
    keys, fields = list(keys), list(fields)
    kept = list(dict.fromkeys([*keys, *order.columns, *fields]))
    placed = running_total(df.select(*kept, size.alias("_size")), keys, order,
                           {"_at": F.col("_size")})
    return (placed.withColumn("page", F.floor(F.col("_at") / F.lit(page_size)))
            .groupBy(*keys, "page")
            .agg(F.count(F.lit(1)).alias("n"),
                 F.array_sort(F.collect_list(F.struct(
                     F.struct(*order.columns).alias("_order"),
                     F.struct(*fields).alias("_row")))).alias("_rows"))
            .select(*keys, "page", "n", F.transform("_rows", lambda r: r["_row"]).alias(out)))


def latest(df: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Last write wins: one row per key, combined before the shuffle, no window."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_row"))
            .select(*keys, "_row.*").select(*df.columns))
