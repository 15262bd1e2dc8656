"""Entities: discovery, aliases, resolution, profiles with as-of history.

A mention has name_as_written, normalized_name, valence, interaction_summary,
source_date, period_start (the day unit it came from) and seq (its order).
Knowledge stays a flat table, one row per fact: an entity may own a third of all facts.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from stratalog.functions import text as X
from stratalog.operators import paging
from stratalog.schema import check_mode


def _named(mentions: DataFrame) -> DataFrame:
    """Mentions with a name, and their canonical id from the normalized or written name."""
    raw = X.strip("name_as_written")
    norm = F.coalesce(X.strip("normalized_name"), F.lit(""))
    return (mentions.withColumns({"_raw": raw, "_norm": norm}).filter(F.col("_raw") != "")
            .withColumn("id", X.normalize_id(F.coalesce(X.present("_norm"), "_raw"))))


def name_table(mentions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct (id, written name, normalized name) with count and first sight.

    The one pass over all mentions: it combines before the shuffle, so a name that makes
    up a third of the rows costs one row per task.  What follows works on names.
    """
    seen = F.struct("period_start", "seq")
    return _named(mentions).groupBy(*keys, "id", "_raw", "_norm").agg(
        F.count(F.lit(1)).alias("_n"), F.min(seen).alias("_seen"),
        F.min(F.coalesce("source_date", "period_start")).alias("_date"))


def discover_entities(mentions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per canonical id: first written name, earliest date, number of appearances."""
    return name_table(mentions, keys).groupBy(*keys, "id").agg(
        F.min_by("_raw", "_seen").alias("display_name"), F.min("_date").alias("first_mentioned"),
        F.sum("_n").alias("appearances"), F.min("_seen").alias("first_seen"))


def entity_aliases(mentions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct (id, alias): the written name and, where it differs, the normalized one."""
    both = F.array_distinct(F.array(F.lower("_raw"), F.lower("_norm")))
    return name_table(mentions, keys).select(*keys, "id", F.explode(both).alias("alias")).distinct()


def alias_map(mentions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Alias to id; an alias of several entities goes to the rarest, then the latest seen."""
    keys = list(keys)
    # One pass over the mentions: the rank of an id is a window over its distinct spellings.
    own = Window.partitionBy(*keys, "id")
    rank = F.struct((-F.sum("_n").over(own)).alias("n"), F.min("_seen").over(own).alias("seen"))
    both = F.array_distinct(F.array(F.lower("_raw"), F.lower("_norm")))
    return (name_table(mentions, keys).withColumn("_rank", rank)
            .select(*keys, "id", "_rank", F.explode(both).alias("alias"))
            .groupBy(*keys, "alias").agg(F.max_by("id", "_rank").alias("id")))


def alias_groups(aliases: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per id the sorted aliases that point to it, and how many."""
    return aliases.groupBy(*keys, "id").agg(
        F.sort_array(F.collect_list("alias")).alias("aliases"),
        F.count(F.lit(1)).alias("n_aliases"))


def top_entities(entities: DataFrame, n: int = 20) -> DataFrame:
    return entities.orderBy(F.desc("appearances"), "id").limit(n)


def target_entities(aliases: DataFrame, ids: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Canonical ids of the alias map that the caller asked for."""
    return (aliases.select(*keys, "id").distinct()
            .join(ids.select(*keys, "id").distinct(), [*keys, "id"], "left_semi"))


def intersect_targets(aliases: DataFrame, ids: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return aliases.select(*keys, "id").intersect(ids.select(*keys, "id"))


def resolve_alias(mentions: DataFrame, aliases: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Add ``entity``: written-name alias, else normalized-name alias, else the own id.

    Names are few next to mentions: distinct name pairs are resolved, then joined back,
    which a size-checked broadcast or a skew-split shuffle can serve.
    """
    keys = list(keys)
    rows = mentions.withColumns({"_w": F.lower(F.coalesce("name_as_written", F.lit(""))),
                                 "_m": F.lower(F.coalesce("normalized_name", F.lit("")))})
    pairs = rows.select(*keys, "_w", "_m").distinct()
    by_w = aliases.select(*keys, F.col("alias").alias("_w"), F.col("id").alias("_by_w"))
    by_m = aliases.select(*keys, F.col("alias").alias("_m"), F.col("id").alias("_by_m"))
    own = X.normalize_id(F.coalesce(X.present("_m"), "_w"))
    known = (pairs.join(by_w, [*keys, "_w"], "left").join(by_m, [*keys, "_m"], "left")
             .select(*keys, "_w", "_m", F.coalesce("_by_w", "_by_m", own).alias("entity")))
    return rows.join(known, [*keys, "_w", "_m"]).drop("_w", "_m")


def knowledge(mentions: DataFrame, aliases: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One dated fact per mention: id, valid_from, source entry, content, valence, seq."""
    return resolve_alias(mentions, aliases, keys).select(
        *keys, F.col("entity").alias("id"),
        F.coalesce(X.present("source_date"), "period_start").alias("valid_from"),
        F.lit(None).cast("string").alias("valid_until"),
        F.col("period_start").alias("source_entry"),
        X.strip(F.coalesce("interaction_summary", F.lit("(no summary)"))).alias("content"),
        F.coalesce("valence", F.lit("neutral")).alias("emotional_valence"), "period_start", "seq")


def build_profiles(facts: DataFrame, aliases: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Profile header per id of the alias map; the facts themselves stay in ``facts``."""
    keys = list(keys)
    heads = facts.groupBy(*keys, "id").agg(F.min("valid_from").alias("first_mentioned"),
                                           F.count(F.lit(1)).alias("mention_count"))
    return (alias_groups(aliases, keys).join(heads, [*keys, "id"], "left")
            .select(*keys, "id", F.col("id").alias("display_name"), "aliases",
                    F.coalesce("first_mentioned", F.lit("")).alias("first_mentioned"),
                    F.coalesce("mention_count", F.lit(0)).alias("mention_count")))


def as_of(facts: DataFrame, date: str | None = None) -> DataFrame:
    """Facts known by ``date``; without a date all of them."""
    return facts if date is None else facts.filter(F.col("valid_from") <= date)


def entity_by_id(profiles: DataFrame, id_: str) -> DataFrame:
    return profiles.filter(F.col("id") == id_)


def project_profile(profiles: DataFrame, facts: DataFrame, mode: str = "full",
                    date: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Columns of a profile by mode: the arc, the evidence log up to ``date``, or both.

    With evidence there is one row per fact (profiles without facts keep one row).
    """
    keys = list(keys)
    arc = F.coalesce("arc_summary", F.lit("(no arc generated)")).alias("arc_summary")
    if check_mode(mode) == "arc":
        return profiles.select(*keys, "id", arc)
    log = ["valid_from", "content", "emotional_valence", "seq"]
    rows = profiles.join(as_of(facts, date).select(*keys, "id", *log), [*keys, "id"], "left")
    return rows.select(*keys, "id", *([arc] if mode == "full" else []), *log)


def entity_directory(profiles: DataFrame, facts: DataFrame | None = None,
                     keys: Sequence[str] = ()) -> DataFrame:
    """Id, role and mentions: the stored count, else the number of facts; most first."""
    keys = list(keys)
    if facts is None:
        counted, fallback = profiles, F.size("knowledge").cast("long")
    else:
        n = facts.groupBy(*keys, "id").agg(F.count(F.lit(1)).alias("_n"))
        counted = profiles.join(n, [*keys, "id"], "left")
        fallback = F.coalesce("_n", F.lit(0).cast("long"))
    stored = F.try_element_at("stable_facts", F.lit("mention_count")).try_cast("long")
    return (counted.select(*keys, "id", "role", F.coalesce(stored, fallback).alias("mentions"))
            .orderBy(F.desc("mentions"), "id"))


def lookup_entity(requests: DataFrame, profiles: DataFrame, keys: Sequence[str] = (),
                  request: str = "request") -> DataFrame:
    """Exact id, else case-insensitive alias (smallest id), else ``not_found``."""
    keys = list(keys)
    ids = profiles.select(*keys, F.col("id").alias(request), F.col("id").alias("_by_id"))
    by_alias = (profiles.select(*keys, "id", F.explode("aliases").alias("_a"))
                .groupBy(*keys, F.lower("_a").alias("_low")).agg(F.min("id").alias("_by_alias")))
    found = (requests.withColumn("_low", F.lower(request))
             .join(ids, [*keys, request], "left").join(by_alias, [*keys, "_low"], "left"))
    id_ = F.coalesce("_by_id", "_by_alias")
    return found.select(*keys, request, id_.alias("id"),
                        F.when(F.col("_by_id").isNotNull(), "id")
                        .when(F.col("_by_alias").isNotNull(), "alias")
                        .otherwise("not_found").alias("matched_by"))


def dossier(units: DataFrame, label: str, aliases: Iterable[str], level: str,
            keys: Sequence[str] = ()) -> DataFrame:
    """Notes about one label from the entity maps of all units at a level."""
    found = dossiers(units, {label: list(aliases)}, level, keys)
    return found.drop("label")


def dossiers(units: DataFrame, labels: dict[str, Sequence[str]], level: str,
             keys: Sequence[str] = ()) -> DataFrame:
    """Notes about many labels, each with its aliases, in one pass over the units.

    Only the first map key that contains a search term of a label, or is contained in one,
    counts; a note saying "not mentioned" is dropped after that choice.
    """
    def first_of(label: str, aliases: Sequence[str]):
        terms = [label.lower(), *[a.lower() for a in aliases]]

        def hit(entry):
            key = F.lower(entry["key"])
            found = F.lit(False)
            for t in terms:
                found = found | F.contains(key, F.lit(t)) | F.contains(F.lit(t), key)
            return found

        entry = F.try_element_at(F.filter(F.map_entries("entities"), hit), F.lit(1))
        return F.struct(F.lit(label).alias("label"), entry["key"].alias("key"),
                        entry["value"].alias("note"))

    hits = F.filter(F.array(*[first_of(k, v) for k, v in labels.items()]),
                    lambda e: e["key"].isNotNull() & ~F.contains(F.lower(F.coalesce(
                        e["note"], F.lit("not mentioned"))), F.lit("not mentioned")))
    return (units.filter(F.col("level") == level)
            .select(*keys, "period_start", "period_end", F.col("level").alias("unit"),
                    F.explode(hits).alias("_e"))
            .select(*keys, "period_start", "period_end", "unit", "_e.label", "_e.key", "_e.note"))


GRAMS = (1, 2, 4, 8, 16, 32)


def contained(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """inner, outer: all pairs of the strings of two one-column tables where one is part of the other.

    A string that is part of another shares all its grams with it.  An inner string's grams are of
    the greatest of the sizes that it has, so that names made to one pattern are told apart, and
    the string is looked up by the one of them that fewest outer strings have; the hits are checked
    in full.  Blank strings are part of nothing.
    """
    def strings(df: DataFrame) -> DataFrame:
        return df.select(F.col(df.columns[0]).alias("s")).filter(F.col("s") != "").distinct()

    def grams(size: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length("s") - size + 1), lambda i: F.substr("s", i, size))

    a, b = strings(inner), strings(outer)
    size = F.element_at(F.filter(F.array(*[F.lit(n) for n in GRAMS]), lambda n: n <= F.length("s")), -1)
    sizes = a.select(F.collect_set(size)).scalar()
    # One gram may be in millions of strings, and a table of grams is many times its strings: no
    # side of these joins is small, whatever the size of the files they come from.
    held = b.withColumn("_sizes", sizes).select(F.col("s").alias("outer"), F.explode(F.array_distinct(F.flatten(
        F.transform(F.filter("_sizes", lambda n: n <= F.length("s")), grams)))).alias("g"))
    often = held.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    asked = a.select(F.col("s").alias("inner"), F.explode(F.array_distinct(grams(size))).alias("g"))
    # A gram that no outer string has rules its string out.
    rare = asked.join(often.hint("merge"), "g", "left").groupBy("inner").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g")).alias("m")).filter("m.n > 0")
    return rare.select("inner", "m.g").join(held.hint("merge"), "g").filter(
        F.contains("outer", F.col("inner"))).select("inner", "outer")


def label_notes(units: DataFrame, terms: DataFrame, level: str, keys: Sequence[str] = ()) -> DataFrame:
    """``dossiers`` for a table of labels and their search terms (label, term), of any size.

    Names and terms that are part of one another are joined by their grams, so no unit is held
    against every label.  Of a unit's map the first key with a hit counts for each label.
    """
    keys = list(keys)
    on = [*keys, "period_start", "period_end", "unit"]
    entries = units.filter(F.col("level") == level).select(
        *keys, "period_start", "period_end", F.col("level").alias("unit"),
        F.posexplode("entities").alias("_at", "key", "note")).withColumn("_name", F.lower("key"))
    asked = terms.select("label", F.lower("term").alias("_term")).distinct()
    names, words = entries.select("_name").distinct(), asked.select("_term").distinct()
    pairs = contained(words, names).select(F.col("inner").alias("_term"), F.col("outer").alias("_name")).unionByName(
        contained(names, words).select(F.col("inner").alias("_name"), F.col("outer").alias("_term"))).distinct()
    hits = pairs.join(asked.hint("merge"), "_term").select("_name", "label").distinct().join(
        entries.hint("merge"), "_name")
    first = hits.groupBy(*on, "label").agg(F.min(F.struct("_at", "key", "note")).alias("_e"))
    told = ~F.contains(F.lower(F.coalesce("_e.note", F.lit("not mentioned"))), F.lit("not mentioned"))
    return first.filter(told).select(*on, "label", "_e.key", "_e.note")


def timeline_text(notes: DataFrame, group: Sequence[str], order: paging.Order,
                  labels: DataFrame | None = None, page_chars: int = paging.PAGE_CHARS
                  ) -> DataFrame:
    """``[period_start] note`` lines per group; groups in ``labels`` without notes say so."""
    line = F.concat(F.lit("["), F.col("period_start"), F.lit("] "), F.col("note"))
    pages = paging.paged_text(notes, group, order, line, "\n", page_chars)
    if labels is None:
        return pages
    return (labels.select(*group).distinct().join(pages, list(group), "left")
            .withColumn("text", F.coalesce("text", F.lit("(No mentions found)"))))
