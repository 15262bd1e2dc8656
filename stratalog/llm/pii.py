"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides.

Base spans (emails, IPv4 addresses, payment cards, international phone numbers) come from
fixed patterns and always stay.  Looser patterns propose further candidates: written-out
emails, IPv6 addresses, cards and phone numbers of the usual grouping where a base match ran on
into other digits, cards with other separators, national phone numbers.  On every
candidate, base ones too, labelers vote yes, no or nothing: the shape of the match, a
gazetteer (top-level domains, card issuers, area codes, address blocks), its checksum or
validity, and the words before it and the characters around it.

What matters about a candidate is its kind and its votes, so the corpus shrinks to counts of
vote patterns, a few hundred rows at any size.  Expectation-maximisation on those counts
estimates for each kind how often a labeler is right about real and false candidates; the
posteriors are soft labels for a logistic classifier over the votes, and candidates whose
probability reaches ``accept`` are added.  Every text is read whole and once.
"""

from __future__ import annotations

import ipaddress
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stratalog.llm.common import bounded_batches, free, others, written

KINDS = ("email", "ip", "card", "phone")

# Base patterns, as linear scans: an email is found at its sign and extended to the left, and
# an address is every four parts of a dotted run, which is what leftmost matching gives.
AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

# Looser candidates.
SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]{1,64})(?: ?[(\[{] ?at ?[)\]}] ?| at )"
                     r"([A-Za-z0-9-]{1,63}(?:(?:\.| ?[(\[{] ?dot ?[)\]}] ?| dot )[A-Za-z0-9-]{1,63})+)",
                     re.IGNORECASE)
IPV6 = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:.])")
LOOSE_CARD = re.compile(r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:([./_ \u00a0\u2010-\u2014-])[0-9]{4})"
                        r"(?:\1[0-9]{4})\1[0-9]{1,7})(?![0-9])")
NATIONAL = re.compile(r"(?<![0-9A-Za-z+(.-])(?:00[ -]?[1-9][0-9 ().-]{6,17}[0-9]"
                      r"|(?:\+[0-9]{1,3}[ -]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4})(?![0-9A-Za-z])")
SPELLED_HINT = re.compile(r"[(\[{ ]at[)\]} ]", re.IGNORECASE)

# Gazetteers and context words: fixed values.
TOP_LEVEL = frozenset("com org net edu gov mil int info biz io eu de fr es it nl be at ch uk ie pt pl "
                      "se no dk fi cz ru jp cn in br mx us ca au nz".split())
WORDS_BEFORE = {
    "email": re.compile(r"e-?mail|contact|correo|courriel|kontakt|write to|mailto", re.I),
    "ip": re.compile(r"\bips?\b|address|host|server|adresse|direcci", re.I),
    "card": re.compile(r"card|visa|credit|tarjeta|carte|karte|payment", re.I),
    "phone": re.compile(r"phone|\btel|call|fax|mobile|cell|tél|móvil|handy|anruf", re.I)}
WORDS_AGAINST = re.compile(r"version|order|isbn|invoice|part|serial|chapter|section|\bid\b|#\s*$", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """kind, start, end of the base spans, by kind and start."""
    out = []
    last = 0
    if "@" in text:
        for m in AT.finditer(text):
            start = m.start()
            while start > last and text[start - 1] in LOCAL:
                start -= 1
            if start < m.start():
                out.append((0, start, m.end()))
                last = m.end()
    if not DIGIT.search(text):
        return out
    for m in DOTTED.finditer(text):
        if m[0].count(".") >= 3:
            parts = [p.span() for p in re.compile("[0-9]+").finditer(text, *m.span())]
            for k in range(0, len(parts) - 3, 4):
                four = parts[k:k + 4]
                if all(len(d := text[a:b].lstrip("0")) <= 3 and int(d or 0) <= 255 for a, b in four):
                    out.append((1, four[0][0], four[3][1]))
    for m in DIGITS.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((3, *m.span()))
    return out


def loose_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Further candidates that overlap no base span."""
    found = []
    if SPELLED_HINT.search(text):
        found += [(0, *m.span()) for m in SPELLED.finditer(text)]
    if ":" in text:
        found += [(1, *m.span()) for m in IPV6.finditer(text)]
    if DIGIT.search(text):
        found += [(2, *m.span()) for m in LOOSE_CARD.finditer(text)]
        found += [(3, *m.span()) for m in NATIONAL.finditer(text)]
    if base and found:
        # Of the base spans that begin before a candidate's end, the one that ends last decides.
        begins = sorted((a, b) for _, a, b in base)
        last = list(accumulate((b for _, b in begins), max))
        starts = [a for a, _ in begins]
        found = [f for f in found if not (k := bisect_left(starts, f[2])) or last[k - 1] <= f[1]]
    return found


def votes(text: str, kind: int, start: int, end: int) -> str:
    """One of + - 0 per labeler: shape, gazetteer, validity, words before, surroundings."""
    return "".join("+" if v > 0 else "-" if v < 0 else "0" for v in (
        *LABELERS[kind](text[start:end]), *_context(text, kind, start, end)))


def _context(text: str, kind: int, start: int, end: int) -> tuple[int, int]:
    before = text[max(0, start - 40):start]
    words = 1 if WORDS_BEFORE[KINDS[kind]].search(before) else -1 if WORDS_AGAINST.search(before) else 0
    around = text[start - 1:start] + text[end:end + 1]
    return words, -1 if any(c.isalnum() or c in "=/_" for c in around) else 1


def _email(m: str) -> tuple[int, int, int]:
    plain = "@" in m
    domain = re.split(r"\.|[(\[{ ]+dot[)\]} ]+", m.rpartition("@")[2] if plain else m, flags=re.I)
    marked = bool(re.search(r"[(\[{]", m))
    return (1 if plain or marked else -1, 1 if domain[-1].lower() in TOP_LEVEL else -1,
            1 if domain[-1].isalpha() and len(domain[-1]) >= 2 and not m.startswith(".") else -1)


def _ip(m: str) -> tuple[int, int, int]:
    try:
        ip = ipaddress.ip_address(m)
    except ValueError:
        return (1 if "." in m else -1), 0, -1
    return (1 if "." in m or m.count(":") >= 4 else -1,
            -1 if ip.is_multicast or ip.is_unspecified or ip.is_loopback else 1, 1)


def _card(m: str) -> tuple[int, int, int]:
    digits = re.sub(r"[^0-9]", "", m)
    issued = re.match(r"4|5[1-5]|2[2-7]|3[47]|6011|65|35|62", digits)
    groups = {len(g) for g in re.split(r"[^0-9]", m)}
    return (1 if groups in ({len(digits)}, {4}, {4, 6, 5}, {4, 3}) else -1, 1 if issued else -1,
            1 if 13 <= len(digits) <= 19 and luhn(digits) else -1)


def _phone(m: str) -> tuple[int, int, int]:
    digits = re.sub(r"[^0-9]", "", m)
    national = digits[-10:]
    return (1 if m[0] in "+(" else 0 if m.startswith("00") else -1,
            1 if len(national) == 10 and national[0] > "1" and national[3] > "1" else -1,
            1 if 9 <= len(digits) <= 15 and len(set(digits)) > 2 else -1)


LABELERS = (_email, _ip, _card, _phone)
SCAN = ("base array<struct<kind: int, start: long, end: long>>, "
        "found array<struct<kind: int, start: long, end: long, base: boolean, votes: string>>")
_SPAN = [("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]
_SCAN = pa.struct([("base", pa.list_(pa.struct(_SPAN))),
                   ("found", pa.list_(pa.struct([*_SPAN, ("base", pa.bool_()),
                                                 ("votes", pa.string())])))])


def _scan(text: str) -> dict:
    base = base_spans(text)
    more = loose_spans(text, base)
    found = [{"kind": k, "start": a, "end": b, "base": is_base, "votes": votes(text, k, a, b)}
             for spans, is_base in ((base, True), (more, False)) for k, a, b in spans]
    return {"base": [{"kind": k, "start": a, "end": b} for k, a, b in base], "found": found}


def reliabilities(patterns: list[tuple[str, float]], rounds: int = 50
                  ) -> tuple[float, np.ndarray, np.ndarray]:
    """EM over counts of vote patterns of one kind: share of real ones, P(vote | class), posteriors.

    Votes are independent given the class; a labeler that says nothing says something too.
    The start is the majority of the votes; one count is added to every cell.
    """
    seen = np.array([["-0+".index(v) for v in p] for p, _ in patterns])
    n = np.array([c for _, c in patterns], float)
    real = np.clip(0.5 + 0.4 * (seen - 1).mean(axis=1), 0.05, 0.95)
    rate, given = 0.5, np.empty((2, seen.shape[1], 3))
    for _ in range(rounds):
        for y, weight in enumerate((n * (1 - real), n * real)):
            for j in range(seen.shape[1]):
                cell = np.bincount(seen[:, j], weight, 3) + 1
                given[y, j] = cell / cell.sum()
        rate = ((n * real).sum() + 1) / (n.sum() + 2)
        at = np.arange(seen.shape[1])
        odds = np.log(rate / (1 - rate)) + (
            np.log(given[1, at, seen]) - np.log(given[0, at, seen])).sum(axis=1)
        real = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
    return rate, given, real


def classifier(patterns: list[tuple[str, float]], soft: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights (bias, then yes and no of each labeler) of a logistic fit to the soft labels."""
    x, n = _features([p for p, _ in patterns]), np.array([c for _, c in patterns], float)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        pull = x.T @ (n * (soft - p)) - ridge * w
        bend = (x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.clip(np.linalg.solve(bend, pull), -3, 3)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _features(patterns: list[str]) -> np.ndarray:
    return np.array([[1.0, *(float(v == "+") for v in p), *(float(v == "-") for v in p)]
                     for p in patterns])


def accepted(counts: list[tuple[int, str, int]], accept: float) -> set[str]:
    """kind:votes of the patterns whose candidates are added."""
    out = set()
    for kind in range(len(KINDS)):
        patterns = [(v, float(n)) for k, v, n in sorted(counts) if k == kind]
        if patterns:
            _, _, real = reliabilities(patterns)
            w = classifier(patterns, real)
            p = 1 / (1 + np.exp(-np.clip(_features([v for v, _ in patterns]) @ w, -30, 30)))
            out |= {f"{kind}:{v}" for (v, _), x in zip(patterns, p) if x >= accept}
    return out


def find_personal(docs: DataFrame, text: str = "text", accept: float = 0.9) -> DataFrame:
    """The rows without their text, with base and all spans (kind, start, end; code points).

    Spans are ordered by kind (email, ip, card, phone) and start, ends are exclusive.  Null and
    empty texts have none; repeated rows are all reported; columns named base or spans are
    replaced; an empty table gives an empty one.
    """
    bounded_batches(docs.sparkSession)

    @F.arrow_udf(SCAN)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([_scan(t or "") for t in batch.to_pylist()], _SCAN)

    kept = others(docs, (text, "base", "spans"))
    name = free("_scan", kept)
    scanned = written(docs.select(*kept, scan(F.col(text)).alias(name)), "scanned")
    counts = (scanned.select(F.explode(f"{name}.found").alias("f"))
              .groupBy("f.kind", "f.votes").agg(F.count(F.lit(1)).alias("n")).collect())
    good = sorted(accepted([(r["kind"], r["votes"], r["n"]) for r in counts], accept))

    def added(f: Column) -> Column:
        return ~f["base"] & F.concat_ws(":", f["kind"], f["votes"]).isin(good)

    plain = F.transform(F.filter(f"{name}.found", added), lambda f: F.struct(
        f["kind"].alias("kind"), f["start"].alias("start"), f["end"].alias("end")))
    return scanned.select(*kept, F.col(f"{name}.base").alias("base"),
                          F.array_sort(F.concat(f"{name}.base", plain)).alias("spans"))


def written_out(spans: str) -> Column:
    """``email:3:17,phone:40:52``: the spans as one string."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def count_of(spans: str, kind: str) -> Column:
    number = KINDS.index(kind)
    return F.size(F.filter(spans, lambda s: s["kind"] == number)).cast("long")
