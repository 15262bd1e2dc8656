"""Ranked and literal text search."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window, functions as F

from stratalog.functions import text as X
from stratalog.operators import ingest, periods
from stratalog.schema import check_scope

# The ranking function's parameters.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
TOKEN = r"[\p{L}\p{N}]+"
DOC = ("source_type", "source_id", "date")


def index_corpus(entries: DataFrame, units: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Searchable rows: all entries, and all summaries that have text."""
    raw = entries.select(*keys, F.lit("raw").alias("source_type"), F.col("id").alias("source_id"),
                         "date", F.col("text").alias("content"))
    told = units.filter(F.coalesce("summary", F.lit("")) != "").select(
        *keys, F.concat(F.lit("summary_"), F.col("level")).alias("source_type"),
        F.concat_ws(":", "level", "period_start").alias("source_id"),
        F.col("period_start").alias("date"), F.col("summary").alias("content"))
    return raw.unionByName(told)


def summaries_from_json(stored: DataFrame, schema) -> DataFrame:
    """Stored JSON bodies as columns; unknown fields vanish, malformed bodies give nulls."""
    body = F.from_json("data_json", schema)
    rest = [c for c in schema.fieldNames() if c not in ("unit", "period_start", "period_end")]
    return stored.withColumn("_b", body).select(
        *[c for c in stored.columns if c != "data_json"], *[f"_b.{c}" for c in rest])


def tokens(content: str | Column = "content") -> Column:
    return F.regexp_extract_all(X.fold(content), F.lit(TOKEN), F.lit(0))


def totals(lengths: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """docs, avg_len: what a ranking needs to know of all rows; one row per stream."""
    return lengths.groupBy(*keys).agg(F.count(F.lit(1)).alias("docs"),
                                      F.avg("doc_len").alias("avg_len"))


def document_lengths(corpus: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Length in tokens of every searchable row, also of rows without any token."""
    return corpus.select(*keys, *DOC, F.size(tokens()).cast("long").alias("doc_len"))


COUNTED = ("doc_len long, tokens array<struct<token: string, tf: long>>, "
           "letters array<struct<letter: string, first: int, n: int>>")
SLICE_ROWS, SLICE_BYTES = 256, 1 << 20


def _slices(batch: pa.Array) -> Iterator[pa.Array]:
    """A batch in parts of few rows and bytes, or of one row: each token of a part is a Python object."""
    size = max(batch.nbytes // max(len(batch), 1), 1)
    rows = min(SLICE_ROWS, max(SLICE_BYTES // size, 1))
    for at in range(0, len(batch), rows):
        yield batch.slice(at, rows)


def _counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    find = regex.compile(TOKEN).findall
    for batch in (part for whole in batches for part in _slices(whole)):
        lengths, ends, names, counts = [], [0], [], []
        letters, firsts, sizes, letter_ends = [], [], [], [0]
        for text in batch.to_pylist():
            found = find(text or "")
            n = Counter(found)
            lengths.append(len(found))
            own = sorted(n)
            at = 1
            for letter, m in Counter([t[0] for t in own]).items():
                letters.append(letter)
                firsts.append(at)
                sizes.append(m)
                at += m
            names += own
            counts += map(n.__getitem__, own)
            ends.append(len(names))
            letter_ends.append(len(letters))
        pairs = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())],
                                           names=["token", "tf"])
        parts = pa.StructArray.from_arrays([pa.array(letters, pa.string()), pa.array(firsts, pa.int32()),
                                            pa.array(sizes, pa.int32())], names=["letter", "first", "n"])
        yield pa.StructArray.from_arrays(
            [pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs),
             pa.ListArray.from_arrays(pa.array(letter_ends, pa.int32()), parts)],
            names=["doc_len", "tokens", "letters"])


def count_tokens(corpus: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, source_type, source_id, date, doc_len, tokens, letters: each text's tokens with their numbers.

    A text sits in one row and is counted there, in Arrow batches, after it was folded.  Tokens are in
    order; ``letters`` says from where on and how many of them begin with a letter.
    """
    bare = F.arrow_udf(_counted, COUNTED)(X.fold("content"))
    return corpus.select(*keys, *DOC, bare.alias("_c")).select(*keys, *DOC, "_c.doc_len", "_c.tokens", "_c.letters")


def by_letter(counted: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows of ``count_tokens`` by first letter: keys, source_type, source_id, date, doc_len, tokens, letter."""
    cut = F.transform("letters", lambda s: F.struct(
        F.slice("tokens", s["first"], s["n"]).alias("tokens"), s["letter"].alias("letter")))
    return counted.select(*keys, *DOC, "doc_len", F.explode(cut).alias("_l")).select(
        *keys, *DOC, "doc_len", "_l.*")


def postings(counted: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows of ``count_tokens`` by token."""
    return counted.select(*keys, *DOC, "doc_len", F.explode("tokens").alias("_p")).select(
        *keys, *DOC, "doc_len", "_p.token", "_p.tf")


def build_index(corpus: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Postings: source_type, source_id, date, doc_len, token, tf.

    Neither texts nor postings are shuffled.
    """
    return postings(count_tokens(corpus, keys), keys)


def query_terms(query: str) -> list[str]:
    """Words of a query, folded like the indexed tokens."""
    return list(dict.fromkeys(X.fold_word(w) for w in query.split()))


def search(query: str, postings: DataFrame, lengths: DataFrame, scope: str = "all",
           date_from: str | None = None, date_to: str | None = None,
           limit: int | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Rows with a token that starts with a query word; with a limit the best ones in order.

    ``lengths`` has a row per document, or the ``totals`` of a stored index.  A stream ranks
    against its own rows only.  Postings with a ``letter`` column are read by letter.

    Each word is one phrase: its frequency in a row sums the matching tokens, and its
    document frequency is taken over the whole index, as is the average length.  The
    word test is a literal filter on the postings, so it reaches the scan.
    """
    types, words = check_scope(scope), query_terms(query)
    keys, doc = list(keys), [*keys, *DOC]
    if not words:
        return postings.select(*doc, F.lit(0.0).alias("rank")).limit(0)
    if "letter" in postings.columns:
        postings = postings.filter(F.col("letter").isin(sorted({w[:1] for w in words})))
    starts = F.lit(False)
    for w in words:
        starts = starts | F.col("token").startswith(w)
    matched = F.filter(F.array(*[F.lit(w) for w in words]),
                       lambda w: F.startswith(F.col("token"), w))
    hits = postings.filter(starts).withColumn("_w", F.explode(matched))
    per_doc = hits.groupBy(*doc, "doc_len", "_w").agg(F.sum("tf").alias("tf"))
    idf = F.log((F.col("_docs") - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    stats = lengths if "avg_len" in lengths.columns else totals(lengths, keys)
    stats = stats.select(*keys, F.col("docs").alias("_docs"), F.col("avg_len").alias("_avg"))
    df = per_doc.groupBy(*keys, "_w").agg(F.count(F.lit(1)).alias("_df"))
    if keys:
        df = df.join(stats, keys)
    else:
        df = df.withColumns({c: stats.select(c).scalar() for c in ("_docs", "_avg")})
    df = df.select(*keys, "_w", "_avg",
                   F.when(idf > 0, idf).otherwise(F.lit(IDF_FLOOR)).alias("_idf"))
    # Without keys this is one row per query word; with keys Spark checks the size.
    df = df if keys else F.broadcast(df)
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("doc_len") / F.col("_avg"))
    score = F.col("_idf") * F.col("tf") * F.lit(K1 + 1) / (F.col("tf") + norm)
    scored = per_doc.join(df, [*keys, "_w"]).filter(F.col("source_type").isin(*types))
    scored = ingest.filter_dates(scored, date_from, date_to)
    ranked = scored.groupBy(*doc).agg((-F.sum(score)).alias("rank"))
    return top_hits(ranked, limit, keys)


def top_hits(ranked: DataFrame, limit: int | None, keys: Sequence[str] = ()) -> DataFrame:
    """The best ``limit`` hits, of each stream if there are several."""
    if limit is None:
        return ranked
    if not keys:
        return ranked.orderBy("rank", "source_id").limit(limit)
    # Spark keeps the first rows of each stream in every task before it shuffles them.
    w = Window.partitionBy(*keys).orderBy("rank", "source_id")
    return (ranked.withColumn("_nth", F.row_number().over(w)).filter(F.col("_nth") <= limit)
            .drop("_nth").orderBy(*keys, "rank", "source_id"))


def snippets(hits: DataFrame, corpus: DataFrame, query: str, n: int = 150,
             keys: Sequence[str] = ()) -> DataFrame:
    """Add ``context``: the text around the first token that starts with a query word."""
    on = [*keys, "source_type", "source_id"]
    rows = hits.join(corpus.select(*on, "content"), on)
    body, folded = F.col("content"), X.fold("content")
    starts = "|".join(_literal(w) for w in query_terms(query))
    pattern = rf"(?s)^(.*?)(?<![\p{{L}}\p{{N}}])((?:{starts})[\p{{L}}\p{{N}}]*)"
    at = F.length(F.regexp_extract(folded, pattern, 1)) + 1
    size = F.length(F.regexp_extract(folded, pattern, 2))
    left = F.greatest(at - F.lit(n), F.lit(1))
    context = F.concat(F.lit("..."), X.clean_text(F.substring(body, left, at - left)),
                       F.lit(" >>"), F.substring(body, at, size), F.lit("<< "),
                       X.clean_text(F.substring(body, at + size, F.lit(n))), F.lit("..."))
    return rows.withColumn("context", context).drop("content")


def _literal(word: str) -> str:
    return "".join(c if c.isalnum() else "\\" + c for c in word)


def search_user(query: str, entries: DataFrame, context_chars: int = 150,
                date_from: str | None = None, date_to: str | None = None,
                limit: int | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """The user's own entries that contain the query, with a snippet; a limit takes the oldest."""
    if not query.split():
        entries = entries.limit(0)
    rows = ingest.filter_dates(entries.filter(F.col("role") == "user"), date_from, date_to)
    hits = rows.filter(F.contains(F.lower("text"), F.lit(query.lower())))
    at = F.locate(query.lower(), F.lower("text"))
    out = hits.select(*keys, "id", "date",
                      F.substring("text", at, F.lit(len(query))).alias("matched_word"),
                      X.kwic("text", query, context_chars).alias("context"))
    return out if limit is None else out.orderBy("date", "id").limit(limit)


def search_totals(hits: DataFrame, limit: int) -> DataFrame:
    """Hits counted before the limit, how many are shown, and whether that cut any."""
    n = F.count(F.lit(1))
    return hits.agg(n.alias("total_hits"), F.least(n, F.lit(limit)).alias("results_shown"),
                    (n > limit).alias("truncated"))


def search_sentences(query: str, entries: DataFrame, radius: int = 1, keys: Sequence[str] = ()
                     ) -> DataFrame:
    """Every sentence of the user's entries that contains the query, with its neighbours.

    A sentence ends at ``.``, ``!`` or ``?`` before white space.  Neighbours sit in the same
    row, so nothing is joined.
    """
    rows = entries.filter((F.col("role") == "user")
                          & F.contains(F.lower("text"), F.lit(query.lower())))
    keys = list(keys)
    cut = rows.select(*keys, "id", "date", F.split("text", r"(?<=[.!?])\s+").alias("_s"))
    lead = F.lit(radius)

    def around(one: Column, i: Column) -> Column:
        first = F.greatest(i - lead, F.lit(0))
        size = F.least(i + lead, F.size("_s") - 1) - first + 1
        return F.when(F.contains(F.lower(one), F.lit(query.lower())), F.struct(
            i.alias("sentence_no"),
            F.array_join(F.slice("_s", first + 1, size), " ").alias("context")))

    hits = F.filter(F.transform("_s", around), lambda h: h.isNotNull())
    return (cut.select(*keys, "id", "date", hits.alias("_hits"))
            .select(*keys, "id", "date", F.explode_outer("_hits").alias("_h"))
            .filter(F.col("_h").isNotNull()).select(*keys, "id", "date", "_h.*"))


def search_events(query: str, units: DataFrame, level: str = "month", keys: Sequence[str] = ()
                  ) -> DataFrame:
    """Periods whose joined key events contain the query, in any case."""
    return (periods.filter_level(units, level)
            .filter(F.contains(F.lower(F.array_join("key_events", " ")), F.lit(query.lower())))
            .select(*keys, "period_start", "key_events"))


def scan_threads(units: DataFrame, level: str = "month", keys: Sequence[str] = ()) -> DataFrame:
    """All narrative threads of a level with the period they were found in."""
    from stratalog.functions import replies
    return (periods.filter_level(units, level)
            .withColumn("_t", F.explode(replies.parse_threads("narrative_threads")))
            .select(*keys, "period_start", "_t.*"))
