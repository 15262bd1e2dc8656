"""String functions over columns."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# The characters a Unicode strip removes.
WHITESPACE = (" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
              + "".join(chr(c) for c in range(0x2000, 0x200B))
              + "\u2028\u2029\u202f\u205f\u3000")
# Lower-case Latin letters with one accent, and the letter the search index folds each to.
_FOLDED = {c: unicodedata.normalize("NFD", c)[0]
           for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)])
           if c.islower() and len(unicodedata.normalize("NFD", c)) == 2}
ACCENTED, UNACCENTED = "".join(_FOLDED), "".join(_FOLDED.values())
# Characters per token, for prompts and for cost reports.
CHARS_PER_TOKEN = 3.2
COST_CHARS_PER_TOKEN = 3.5
# Context window labels.
CONTEXT_SIZES = {
    "32k": 32_768, "64k": 65_536, "96k": 98_304, "128k": 131_072,
    "160k": 163_840, "192k": 196_608, "224k": 229_376, "256k": 262_144,
}
# Entities unescaped when HTML is flattened.
HTML_ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"),
                 ("&#39;", "'"), ("&quot;", '"'))
# Timestamp layouts of activity exports.
TIMESTAMP_LAYOUTS = ("MMM d, yyyy, h:mm:ss a", "MMM d, yyyy, H:mm:ss",
                     "MMMM d, yyyy, h:mm:ss a", "MMMM d, yyyy, H:mm:ss")

NAME = "[^a-z0-9]+"
SPACES = r"(?U)\s+"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    return F.btrim(col(c), F.lit(WHITESPACE))


def nonblank(c: str | Column) -> Column:
    """True where the text has something left after a strip."""
    return F.coalesce(strip(c), F.lit("")) != ""


def present(c: str | Column) -> Column:
    """The text, or null where it is empty."""
    return F.when(col(c) != "", col(c))


def clean_text(c: str | Column) -> Column:
    return strip(F.regexp_replace(col(c), SPACES, " "))


def entry_id(date="date", time="time", source_file="source_file", role="role",
             text="text") -> Column:
    """First 16 hex digits of SHA-256 over the entry's identity (``source`` is not part)."""
    parts = [F.coalesce(col(c), F.lit("")) for c in (date, time, source_file, role, text)]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def normalize_id(c: str | Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(strip(c)), NAME, "_"), F.lit("_"))


def safe_label(c: str | Column) -> Column:
    return F.regexp_replace(col(c), r"[^\p{L}\p{N}_-]", "_")


def fold(c: str | Column) -> Column:
    """Lower case without accents; keeps the length, so offsets stay valid."""
    return F.translate(F.lower(col(c)), ACCENTED, UNACCENTED)


def fold_word(word: str) -> str:
    """The same folding for a word of a query."""
    return word.lower().translate(str.maketrans(ACCENTED, UNACCENTED))


def strip_thinking(c: str | Column) -> Column:
    return strip(F.regexp_replace(col(c), r"(?is)<think>.*?</think>", ""))


def thinking_trace(c: str | Column) -> Column:
    """Content of the first thinking block, null when there is none."""
    block = r"(?is)<think>(.*?)</think>"
    return F.when(col(c).rlike(block), strip(F.regexp_extract(col(c), block, 1)))


def strip_reasoning(c: str | Column) -> Column:
    return strip(F.regexp_replace(col(c), r'(?s)<details type="reasoning".*?</details>', ""))


def html_to_text(c: str | Column) -> Column:
    out = F.regexp_replace(col(c), "<[^>]+>", " ")
    for entity, char in HTML_ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.regexp_replace(out, SPACES, " ")


def parse_datetime(c: str | Column) -> Column:
    """Timestamp of an activity export, zone name dropped.

    The suffix rule also takes the AM/PM mark of a time written without a zone, which
    is then read on the 24-hour clock; entry ids depend on it, so it is kept.
    """
    bare = strip(F.regexp_replace(clean_text(c), r"\s+[A-Z]{2,5}$", ""))
    return F.coalesce(*[F.try_to_timestamp(bare, F.lit(p)) for p in TIMESTAMP_LAYOUTS])


def iso_datetime(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def entry_line(time="time", role="role", text="text") -> Column:
    """``[time - role]: text``; any role but user and assistant is shown as user."""
    label = F.when(col(role).isin("user", "assistant"), col(role)).otherwise(F.lit("user"))
    return F.concat(F.lit("["), col(time), F.lit(" - "), label, F.lit("]: "), col(text))


def tokens(chars: Column, per_token: float = CHARS_PER_TOKEN) -> Column:
    return (chars / F.lit(per_token)).cast("long")


def token_estimate(text: str | Column, context_window: int = 32_768,
                   output_budget: int = 1024) -> Column:
    """Struct of chars, tokens, fraction of the usable window, status and its label."""
    chars = F.length(col(text)).cast("long")
    return token_estimate_chars(chars, context_window, output_budget)


def token_estimate_chars(chars: Column, context_window: int = 32_768,
                         output_budget: int = 1024) -> Column:
    usable = context_window - output_budget
    fraction = tokens(chars) / F.lit(float(usable)) if usable > 0 else F.lit(1.0)
    status = F.when(fraction < 0.5, "ok").when(fraction < 0.8, "warn").otherwise("danger")
    # The wording of each status.
    label = (F.when(fraction < 0.5, "✓ Within budget")
             .when(fraction < 0.8, "⚠ Approaching limit")
             .otherwise("✗ May exceed context window"))
    return F.struct(chars.alias("char_count"), tokens(chars).alias("estimated_tokens"),
                    fraction.alias("usage_fraction"), status.alias("status"),
                    label.alias("status_label"))


def context_size(label: str | Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in CONTEXT_SIZES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, col(label)), F.lit(CONTEXT_SIZES["32k"])).cast("long")


def match_category(raw: str | Column, categories: Sequence[str]) -> Column:
    """Map a free-form model label to one of the categories."""
    norm = F.btrim(F.regexp_replace(F.lower(col(raw)), "[^a-z0-9_]", "_"), F.lit("_"))
    names = F.array(*[F.lit(c) for c in categories])
    exact = F.filter(names, lambda c: F.lower(c) == norm)
    by_token = F.filter(names, lambda c: F.array_contains(F.split(F.lower(c), "_"), norm))
    fallback = next((c for c in categories if c.lower() == "other"), categories[-1])
    return (F.when(F.size(exact) > 0, exact[0])
            .when((norm != "") & (F.size(by_token) == 1), by_token[0])
            .otherwise(F.lit(fallback)))


def kwic(text: str | Column, query: str, n: int = 150) -> Column:
    """First case-insensitive hit with ``n`` characters on each side; null without a hit."""
    body, size = col(text), len(query)
    at = F.locate(query.lower(), F.lower(body))
    left = F.greatest(at - F.lit(n), F.lit(1))
    before = clean_text(F.substring(body, left, at - left))
    after = clean_text(F.substring(body, at + size, F.lit(n)))
    return F.when(at > 0, F.concat(F.lit("..."), before, F.lit(" >>"),
                                   F.substring(body, at, F.lit(size)),
                                   F.lit("<< "), after, F.lit("...")))


def day_label(delta: str | Column) -> Column:
    d = col(delta)
    n = F.abs(d).cast("string")
    return (F.when(d == 0, F.lit("day of mention"))
            .when(d < 0, F.concat(n, F.lit(" day(s) before")))
            .otherwise(F.concat(n, F.lit(" day(s) after"))))


def left_chars(c: str | Column, n: int) -> Column:
    return F.substring(col(c), 1, n)


def empirical_ratio(chars: str | Column, tokens_in: str | Column) -> Column:
    """Characters per actual token, null unless both are positive."""
    return F.when((col(chars) > 0) & (col(tokens_in) > 0),
                  F.round(col(chars) / col(tokens_in), 4))


# Summary fields shown as context, with their labels.
CONTEXT_FIELDS = (
    ("summary", "Summary"), ("emotional_tone", "Tone"), ("key_events", "Events"),
    ("overall_vibe", "Vibe"), ("peak_moment", "Peak"), ("narrative_threads", "Threads"),
    ("scalar_metrics", "Metrics"), ("significant_delta", "Delta"),
    ("physiological_flags", "Physio"), ("relational_map", "Relations"),
    ("avoidance_signals", "Avoidance"), ("growth_markers", "Growth"),
    ("coping_mechanisms", "Coping"), ("self_perception_snapshot", "Self-perception"),
    ("values_in_tension", "Values-tension"), ("context_bridge", "Bridge"),
)
_KEEP_NEWLINES = {"summary", "emotional_tone", "key_events", "overall_vibe", "peak_moment"}


def summary_context(columns: Sequence[str]) -> Column:
    """Labelled lines of the fields present, newlines flattened in the index fields."""
    lines = [F.concat(F.lit("["), F.col("period_start"), F.lit(" — "), F.col("period_end"),
                      F.lit("]"))]
    for name, label in CONTEXT_FIELDS:
        if name not in columns:
            continue
        value = F.array_join(name, "; ") if name == "key_events" else F.col(name)
        if name not in _KEEP_NEWLINES:
            value = F.replace(value, F.lit("\n"), F.lit(" "))
        lines.append(F.concat(F.lit(label + ": "), present(value)))
    return F.concat_ws("\n", *lines)


# Section titles of an exported summary.
EXPORT_FIELDS = (
    ("peak_moment", "Peak Moment"), ("narrative_threads", "Narrative Threads"),
    ("scalar_metrics", "Scalar Metrics"), ("significant_delta", "Significant Delta"),
    ("physiological_flags", "Physiological Flags"), ("relational_map", "Relational Map"),
    ("avoidance_signals", "Avoidance Signals"), ("growth_markers", "Growth Markers"),
    ("coping_mechanisms", "Coping Mechanisms"),
    ("self_perception_snapshot", "Self-Perception Snapshot"),
    ("values_in_tension", "Values in Tension"), ("context_bridge", "Context Bridge"),
)


def summary_document(columns: Sequence[str], fmt: str = "md") -> Column:
    """A summary as Markdown or plain text; absent sections are left out."""
    if fmt not in ("md", "txt"):
        raise ValueError(f"fmt must be md or txt, not {fmt!r}")
    top, head, gap = ("# ", "## ", "\n\n") if fmt == "md" else ("", "── ", "\n")

    def bullets(items: Column, line) -> Column:
        return F.when(F.size(items) > 0, F.array_join(F.transform(items, line), "\n"))

    def section(title: str, body: Column) -> Column:
        return F.concat(F.lit(f"{head}{title}\n"), present(body), F.lit(gap))

    parts = [F.concat(F.lit(top), F.upper("unit"), F.lit(": "), F.col("period_start"),
                      F.lit(" – "), F.col("period_end"), F.lit(gap))]
    if "summary" in columns:
        parts.append(section("Summary", F.col("summary")))
    if "emotional_tone" in columns:
        parts.append(F.concat(F.lit("**Emotional Tone:** "), present("emotional_tone"), F.lit(gap)))
    if "key_events" in columns:
        parts.append(section("Key Events", bullets(F.col("key_events"),
                                                   lambda e: F.concat(F.lit("- "), e))))
    if "questions_raised" in columns:
        parts.append(section("Questions Raised", bullets(F.col("questions_raised"),
                                                         lambda q: F.concat(F.lit("- "), q))))
    if "entities" in columns:
        parts.append(section("Entities", bullets(
            F.map_entries("entities"),
            lambda e: F.concat(F.lit("- **"), e["key"], F.lit("**: "), e["value"]))))
    parts += [section(title, F.col(name)) for name, title in EXPORT_FIELDS if name in columns]
    return F.concat_ws("", *parts)
