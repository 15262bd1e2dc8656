"""Writers.  Appends are spread by a rebalance hint, which splits a hot partition."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from stratalog.functions import periods as P, text as X
from stratalog.operators import entities, ingest, paging, search
from stratalog.schema import ENTRY_COLUMNS, USAGE_COLUMNS
from stratalog.session import cut_lineage, stored
from stratalog.sources import commits


def write_raw(entries: DataFrame, path: str, keys: Sequence[str] = ()) -> None:
    """Append entries to the store, partitioned by month."""
    cols = [*keys, *ENTRY_COLUMNS]
    (entries.select(*cols, P.store_month().alias("month")).hint("rebalance", "month")
     .write.mode("append").partitionBy("month").parquet(path))


def read_store(spark: SparkSession, path: str, keys: Sequence[str] = (),
               months: Sequence[str] | None = None) -> DataFrame:
    """The entry store, or only some of its month partitions.

    A path that does not exist yet is an empty store.
    """
    cols = [*keys, *ENTRY_COLUMNS]
    schema = ", ".join(f"{c} STRING" for c in [*cols, "month"])
    try:
        rows = spark.read.schema(schema).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], schema)
    if months is not None:
        rows = rows.filter(F.col("month").isin(*months)) if months else rows.limit(0)
    return rows.select(*cols)


def upsert_table(updates: DataFrame, path: str, key: Sequence[str], partition: str) -> None:
    """Replace rows by key in a table of ``commits``, rewriting only the partitions touched.

    The partition must be part of the key.  The merged partitions are written beside the old ones
    and take their place in one commit, so a reader sees all of an upsert or nothing, and a writer
    that dies leaves the old state.  When another writer has changed a partition in between, the
    updates are merged into its state.
    """
    spark = updates.sparkSession
    updates = cut_lineage(updates)
    touched = sorted(str(r[0]) for r in updates.select(partition).distinct().collect())

    def merged(base: commits.Snapshot) -> dict[str, str]:
        old = commits.read_parts(spark, path, at=base, parts=touched)
        rows = updates if old is None else ingest.upsert(old.select(*updates.columns), updates, key)
        return commits.write_parts(rows, path, partition)

    base, done = commits.snapshot(spark, path), {}

    def change(now: commits.Snapshot) -> dict[str, str]:
        seen = {p: now.folders.get(p) for p in touched}
        if done.get("seen") != seen:
            done.update(seen=seen, folders=merged(now))
        return done["folders"]

    commits.commit(spark, path, base, change)


def read_table(spark: SparkSession, path: str, parts: Sequence[str] | None = None) -> DataFrame:
    """The newest state of a table that ``upsert_table`` writes, or some of its partitions."""
    rows = commits.read_parts(spark, path, parts=parts)
    if rows is None:
        raise FileNotFoundError(f"no table at {path}")
    return rows


def write_units(units: DataFrame, path: str, keys: Sequence[str] = ()) -> None:
    """Upsert units by level and time: a new day rewrites the days of its month only.

    The partition is the level with the month of a day, or the year of a higher unit.
    """
    of = F.when(F.col("level") == "day", F.substring("period_start", 1, 7)).otherwise(
        F.substring("period_start", 1, 4))
    upsert_table(units.withColumn("part", F.concat_ws("-", "level", of)), path,
                 [*keys, "part", "level", "period_start"], "part")


def read_units(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path).drop("part")


def merged_metadata(entries: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Header of a merged export: days, entries, first and last date, format; one per stream."""
    return entries.groupBy(*keys).agg(F.countDistinct("date").alias("total_days"),
                       F.count(F.lit(1)).alias("total_entries"),
                       F.min("date").alias("first_date"), F.max("date").alias("last_date"),
                       F.lit("2.0").alias("format_version"))


def export_merged(entries: DataFrame, path: str, page_chars: int = paging.PAGE_CHARS,
                  keys: Sequence[str] = ()) -> None:
    """Nested days as JSON lines ordered by date, and the header beside them."""
    days = ingest.load_days(entries, keys=keys, page_chars=page_chars)
    body = F.transform("entries", lambda e: F.struct(
        e["time"].alias("time"), e["source"].alias("source"),
        F.coalesce(e["source_file"], F.lit("")).alias("source_file"), e["role"].alias("role"),
        e["text"].alias("text")))
    (days.select(*keys, "date", "page", body.alias("entries")).orderBy(*keys, "date", "page")
     .write.mode("overwrite").json(f"{path}/entries"))
    merged_metadata(entries, keys).write.mode("overwrite").json(f"{path}/metadata")


def export_split(df: DataFrame, path: str, name: str) -> None:
    """One folder of JSON per value of ``name``, for values the calendar bounds (date, period).

    For ids, of which there is no bound, see ``export_bucketed``.
    """
    body = F.to_json(F.struct(*df.columns)).alias("value")
    (df.select(F.col(name).alias(f"by_{name}"), body).hint("rebalance", f"by_{name}")
     .write.mode("overwrite").partitionBy(f"by_{name}").text(path))


def export_bucketed(df: DataFrame, path: str, name: str) -> None:
    """JSON lines in 256 folders by a hash of ``name`` (an entity id), sorted by it."""
    (df.withColumn("bucket", F.substring(F.sha2(F.col(name), 256), 1, 2))
     .hint("rebalance", "bucket").sortWithinPartitions("bucket", name)
     .write.mode("overwrite").partitionBy("bucket").json(path))


def append_usage(calls: DataFrame, path: str) -> None:
    """Append call-log rows to CSV; the ratio is blank unless both counts are positive."""
    from stratalog.operators import audit
    audit.usage_rows(calls).select(*USAGE_COLUMNS).write.mode("append").csv(path, header=True)


def write_documents(units: DataFrame, path: str, fmt: str = "md") -> None:
    """Summaries as Markdown or text, one folder per level and period."""
    (units.select("level", "period_start",
                  X.summary_document(units.columns, fmt).alias("value"))
     .write.mode("overwrite").partitionBy("level", "period_start").text(path))


def write_profiles(profiles: DataFrame, path: str, keys: Sequence[str] = ()) -> None:
    """Upsert profiles as id, display_name, aliases_json, data_json; ``read_table`` reads them."""
    rows = profiles.select(
        *keys, "id", "display_name", F.to_json("aliases").alias("aliases_json"),
        F.to_json(F.struct(*profiles.columns)).alias("data_json"),
        F.substring(F.sha2("id", 256), 1, 2).alias("bucket"))
    upsert_table(rows, path, [*keys, "bucket", "id"], "bucket")


def write_entity_index(mentions: DataFrame, path: str, keys: Sequence[str] = ()) -> None:
    """The alias map and the entity list, for review between the two passes."""
    entities.alias_map(mentions, keys).write.mode("overwrite").json(f"{path}/alias_map")
    (entities.discover_entities(mentions, keys).drop("first_seen")
     .withColumn("role", F.lit(""))
     .withColumn("profile_file", F.concat("id", F.lit(".json")))
     .write.mode("overwrite").json(f"{path}/entities"))


def read_alias_map(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("alias STRING, id STRING").json(f"{path}/alias_map")


def _dossier_folder(label: F.Column) -> F.Column:
    """The label made safe for a folder name, and a hash that keeps alike names apart."""
    return F.concat_ws("-", X.safe_label(label), F.substring(F.sha2(label, 256), 1, 16))


def write_dossiers(notes: DataFrame, path: str) -> None:
    """Dossier notes by label, a folder each; labels that are alike when made safe stay apart.

    Stream columns are kept in the rows; readers name them in their schema.
    """
    (notes.withColumn("safe_label", _dossier_folder(F.col("label"))).hint("rebalance", "safe_label")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("safe_label").json(path))


DOSSIER = "label STRING, period_start STRING, note STRING, safe_label STRING"


def read_dossier(spark: SparkSession, path: str, label: str, schema: str = DOSSIER) -> DataFrame:
    """The notes of one label: its folder alone is read."""
    rows = spark.read.schema(schema).json(path)
    return rows.filter((F.col("safe_label") == _dossier_folder(F.lit(label)))
                       & (F.col("label") == label)).drop("safe_label")


def list_dossiers(spark: SparkSession, path: str) -> DataFrame:
    """The labels that have a dossier."""
    return spark.read.schema("label STRING").json(path).select("label").distinct()


def write_turn_cache(entries: DataFrame, path: str) -> None:
    """Dated text blocks as turns, one per line; ``read_preparsed_json`` reads them back."""
    entries.select(F.coalesce("datetime_raw", F.lit("")).alias("datetime_raw"),
                   F.coalesce("datetime_parsed", F.lit("")).alias("datetime_parsed"),
                   X.strip(F.coalesce("user", F.lit(""))).alias("user"),
                   F.lit("").alias("response")).write.mode("overwrite").json(path)


# Segments written before tokens were kept by document and letter have one token a row.
LETTER = ("source_type STRING, source_id STRING, date STRING, doc_len BIGINT, "
          "tokens ARRAY<STRUCT<token: STRING, tf: BIGINT>>, token STRING, tf BIGINT, letter STRING")
DOCUMENT = "source_type STRING, source_id STRING, date STRING, doc_len BIGINT"


def write_index(corpus: DataFrame, path: str, keys: Sequence[str] = ()) -> None:
    """The index of searchable rows as one segment; more follow with ``append_index``."""
    append_index(corpus, path, keys)


def append_index(corpus: DataFrame, path: str, keys: Sequence[str] = ()) -> None:
    """Add searchable rows to an index; rows that are there already are replaced.

    The batch becomes an immutable segment: the tokens of each document by first letter, its
    documents, and as tombstones the older segments' documents it replaces.  Earlier segments are
    neither read, but for the ids of their documents, nor written, and one commit makes it seen.
    """
    spark, doc = corpus.sparkSession, [*keys, "source_type", "source_id"]
    counted = stored(search.count_tokens(corpus, keys), "counted")

    def change(now: commits.Snapshot) -> dict[str, str]:
        name = f"segment-{now.n + 1:09d}"
        folder = commits.new_folder(path)
        _write_letters(search.by_letter(counted, keys), folder)
        counted.select(*doc, "date", "doc_len").write.parquet(f"{folder}/documents")
        older = [f for p, f in now.folders.items() if p < name]
        dead = spark.createDataFrame([], _columns(keys) + "source_type STRING, source_id STRING, "
                                     "date STRING, doc_len BIGINT, segment STRING")
        if older:
            gone = _documents(spark, older, keys).join(counted.select(*doc).distinct(), doc, "left_semi")
            dead = gone.join(_tombstones(spark, older, keys), [*doc, "segment"], "left_anti").select(*dead.columns)
        dead.write.parquet(f"{folder}/tombstones")
        return {name: folder}

    commits.commit(spark, path, commits.snapshot(spark, path), change)


def merge_index(spark: SparkSession, path: str, keys: Sequence[str] = (), factor: int = 4) -> int:
    """Merge segments of like size into one, without their tombstones; how many were merged.

    Sizes are told apart by powers of ``factor`` in documents; the lowest size with ``factor``
    segments is merged.  Texts are not read again.
    """
    at = commits.snapshot(spark, path)
    if not at.folders:
        return 0
    counts = {r.segment: r["count"] for r in _documents(spark, list(at.folders.values()), keys)
              .groupBy("segment").count().collect()}  # one row per segment
    tiers: dict[int, list[str]] = {}
    for part, folder in sorted(at.folders.items()):
        tier = int(math.log(max(counts.get(_segment(folder), 0), 1), factor) + 1e-9)
        tiers.setdefault(tier, []).append(part)
    chosen = next((parts for _, parts in sorted(tiers.items()) if len(parts) >= factor), [])
    if not chosen:
        return 0
    doc, folders = [*keys, "source_type", "source_id"], [at.folders[p] for p in chosen]
    dead = stored(_tombstones(spark, list(at.folders.values()), keys), "tombstones")
    folder = commits.new_folder(path)
    live = _letters(spark, folders, keys).join(dead, [*doc, "segment"], "left_anti").drop("segment")
    _write_letters(live, folder)
    _documents(spark, folders, keys).join(dead, [*doc, "segment"], "left_anti").drop("segment").write.parquet(
        f"{folder}/documents")
    # What the merged segments say of segments that stay must still be said.
    kept = [_segment(f) for p, f in at.folders.items() if p not in chosen]
    _tombstone_rows(spark, folders, keys).filter(F.col("segment").isin(kept)).write.parquet(f"{folder}/tombstones")

    def change(now: commits.Snapshot) -> dict[str, str | None]:
        if any(now.folders.get(p) != at.folders[p] for p in chosen):
            raise RuntimeError("another writer has merged these segments")
        fresh = _tombstone_rows(spark, [f for p, f in now.folders.items() if p not in at.folders], keys
                                ) if set(now.folders) - set(at.folders) else None
        if fresh is not None and not fresh.filter(F.col("segment").isin([_segment(f) for f in folders])).isEmpty():
            raise RuntimeError("a newer segment replaces rows of these; merge again")
        return {**dict.fromkeys(chosen), chosen[0]: folder}

    commits.commit(spark, path, at, change)
    return len(chosen)


def _columns(keys: Sequence[str]) -> str:
    return "".join(f"{k} STRING, " for k in keys)


def _segment(folder: str) -> str:
    return folder.rstrip("/").rsplit("/", 1)[1]


def _of_segments(spark: SparkSession, folders: Sequence[str], kind: str, schema: str) -> DataFrame:
    """Rows of one kind from some segments, with the ``segment`` they come from."""
    parts = [spark.read.schema(schema).parquet(f"{f}/{kind}").withColumn("segment", F.lit(_segment(f)))
             for f in folders]
    return ingest.union_sources(*parts)


def _documents(spark: SparkSession, folders: Sequence[str], keys: Sequence[str]) -> DataFrame:
    return _of_segments(spark, folders, "documents", _columns(keys) + DOCUMENT)


def _tombstone_rows(spark: SparkSession, folders: Sequence[str], keys: Sequence[str]) -> DataFrame:
    schema = _columns(keys) + DOCUMENT + ", segment STRING"
    return ingest.union_sources(*[spark.read.schema(schema).parquet(f"{f}/tombstones") for f in folders])


def _tombstones(spark: SparkSession, folders: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """keys, source_type, source_id, segment of the documents that a newer segment replaces."""
    return _tombstone_rows(spark, folders, keys).select(*keys, "source_type", "source_id", "segment").distinct()


def _letters(spark: SparkSession, folders: Sequence[str], keys: Sequence[str]) -> DataFrame:
    return _of_segments(spark, folders, "postings", _columns(keys) + LETTER)


def _write_letters(rows: DataFrame, folder: str) -> None:
    """A row per document and letter, in a folder per letter: far fewer rows than there are postings."""
    rows.hint("rebalance", "letter").write.partitionBy("letter").parquet(f"{folder}/postings")


def read_postings(spark: SparkSession, folders: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    rows = _letters(spark, folders, keys).withColumn("_p", F.explode_outer("tokens"))
    return rows.select(*keys, *search.DOC, "doc_len", F.coalesce("_p.token", "token").alias("token"),
                       F.coalesce("_p.tf", "tf").alias("tf"), "letter", "segment")


def read_index(spark: SparkSession, path: str, keys: Sequence[str] = ()
               ) -> tuple[DataFrame, DataFrame]:
    """Postings and totals as ``search.search`` takes them, of the newest state of an index.

    A replaced document counts in no total, and its postings vanish behind the search's own
    filters, so only those that match a query meet the tombstones.
    """
    folders = list(commits.snapshot(spark, path).folders.values())
    if not folders:
        raise FileNotFoundError(f"no index at {path}")
    found = read_postings(spark, folders, keys)
    lengths = _documents(spark, folders, keys).select(*keys, F.lit(1).alias("d"), "doc_len")
    if len(folders) > 1:
        doc = [*keys, "source_type", "source_id", "segment"]
        found = found.join(_tombstones(spark, folders, keys), doc, "left_anti")
        live = {_segment(f) for f in folders}
        gone = _tombstone_rows(spark, folders, keys).filter(F.col("segment").isin(live))
        lengths = lengths.unionByName(gone.select(*keys, F.lit(-1).alias("d"), (-F.col("doc_len")).alias("doc_len")))
    totals = lengths.groupBy(*keys).agg(F.sum("d").alias("docs"), (F.sum("doc_len") / F.sum("d")).alias("avg_len"))
    return found.drop("segment"), totals
