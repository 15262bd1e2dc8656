"""A whole run: a folder of raw files into the store, and the units above what changed."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from stratalog.functions import periods as P
from stratalog.operators import ingest
from stratalog.plans import hierarchy, models
from stratalog.schema import DEFAULT_CATEGORIES, ENTRY_COLUMNS
from stratalog.session import cut_lineage, stored
from stratalog.sources import readers, writers
from stratalog.streaming.ingest import touched_months


@dataclass
class IngestRun:
    """Result of one run: counts in one row, dates that received entries, the new manifest, and
    the day hashes of the entries that were new."""

    stats: DataFrame
    dates: DataFrame
    manifest: DataFrame
    hashes: DataFrame


def parse_folder(spark: SparkSession, path: str, label: models.ModelFn | None = None,
                 categories: Sequence[str] = DEFAULT_CATEGORIES,
                 keep: Iterable[str] | None = None, detect: models.ModelFn | None = None,
                 files: dict[str, list[str]] | None = None, journal: str | None = None) -> DataFrame:
    """Staged entries of files directly under a folder, by kind; all of them, or ``files``.

    Activity turns are classified when ``label`` is given and filtered to ``keep``.  Date lines
    of plain text are found by rule, or by ``detect``.  With a ``journal`` a turn or line is
    asked about once, whatever file or place it turns up in later, and the answers a run got
    before it died are there for the next.
    """
    if files is None:
        files = {kind: [f"{path}/{shape}"] for kind, shape in SHAPES.items()}
    staged = []
    if files.get("chat"):
        staged.append(readers.read_chat_export(spark, files["chat"]).drop("title"))
    if files.get("activity"):
        turns = readers.read_activity_html(spark, files["activity"])
        if label:
            turns = models.classify(turns, label, categories, journal=journal)
        staged.append(ingest.turns_to_entries(turns, "gemini", categories=keep if label else None))
    if files.get("line_dated"):
        staged.append(readers.read_line_dated_text(spark, files["line_dated"], detect, journal=journal))
    return ingest.union_sources(*staged)


# File name patterns of the kinds, where a whole folder is read.
SHAPES = {"chat": "*.[jJ][sS][oO][nN]", "activity": "*.[hH][tT][mM]*",
          "line_dated": "*.{[tT][xX][tT],[mM][dD]}"}
# More changed files than this are read by pattern; the merge drops what is known either way.
LISTED_FILES = 10_000


def run_ingest(spark: SparkSession, path: str, store: str, manifest: DataFrame | None = None,
               dry_run: bool = False, **parsing) -> IngestRun:
    """Parse what changed in a folder and append what is new to the store.

    Only new and changed files are parsed, and only the months their entries lie in are read
    from the store.  The staged rows are made durable first, so a model is not asked twice
    and the counts belong to what is written.  A dry run leaves the manifest as it was.
    """
    found = readers.route_sources(spark, path).select("path", "mtime", "kind")
    changed = found if manifest is None else cut_lineage(ingest.changed_files(found, manifest))
    counts = {r.kind: r["count"] for r in changed.groupBy("kind").count().collect()}  # three at most
    files: dict[str, list[str]] = {}
    for kind, n in counts.items():
        if manifest is None or n > LISTED_FILES:
            files[kind] = [f"{path}/{SHAPES[kind]}"]
        else:
            files[kind] = [r.path for r in changed.filter(F.col("kind") == kind).collect()]
    if files:
        staged = cut_lineage(parse_folder(spark, path, files=files, **parsing))
        months = touched_months(ingest.prepare(staged))
    else:
        staged, months = writers.read_store(spark, store).drop("id").limit(0), []
    existing = writers.read_store(spark, store, months=months)
    fresh = cut_lineage(ingest.new_entries(
        ingest.prepare(staged).select(*ENTRY_COLUMNS), existing))
    stats = cut_lineage(ingest.ingest_stats(staged, existing))
    if not dry_run:
        writers.write_raw(fresh, store)
    before = found.limit(0) if manifest is None else manifest
    done = before if dry_run else found
    return IngestRun(stats, fresh.select("date").distinct(), done, hierarchy.day_hashes(fresh))


def update_units(spark: SparkSession, store: str, units: DataFrame | None, dates: DataFrame,
                 describe: Callable[[str, DataFrame, DataFrame], DataFrame] | None = None,
                 history_n: int = 7) -> DataFrame:
    """Bring the units up to date for dates that received entries.

    A day whose text grew is done anew, with everything above it.
    """
    entries = writers.read_store(spark, store)
    if units is not None:
        touched = dates.select(F.lit("day").alias("level"), F.col("date").alias("period_start"))
        units = cut_lineage(ingest.invalidate_units(units, touched))
    return hierarchy.run_hierarchy(entries, units, history_n=history_n, describe=describe)


def update_stale(spark: SparkSession, store: str, units: DataFrame | None, batch: DataFrame,
                 before: DataFrame | None = None,
                 describe: Callable[[str, DataFrame, DataFrame], DataFrame] | None = None
                 ) -> tuple[DataFrame, DataFrame]:
    """Redo just the units whose fingerprints a batch has changed; the units, and the day hashes now.

    ``batch`` has the day hashes of a run's new entries, ``before`` those stored so far.
    Fingerprints of all levels follow from day hashes, one small row a day, so the entries are read
    for the months of stale days alone; other days stand in the units that are there.
    """
    now = stored(hierarchy.merge_day_hashes(before, batch), "day_hashes")
    if units is None or before is None:
        return hierarchy.run_hierarchy(writers.read_store(spark, store), None, describe=describe), now
    stale = stored(hierarchy.stale_units(hierarchy.fingerprints_of(now),
                                         hierarchy.fingerprints_of(before)), "stale")
    days = stale.filter("level = 'day'").select(F.col("period_start").alias("date"))
    months = sorted(r[0] for r in days.select(P.store_month()).distinct().collect())
    if not months:
        return units, now
    entries = writers.read_store(spark, store, months=months).join(days, "date", "left_semi")
    kept = stored(ingest.invalidate_units(units, stale), "kept")
    return hierarchy.run_hierarchy(entries, kept, cascade=False, describe=describe), now
