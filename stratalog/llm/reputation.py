"""URL filter by host reputation: beta-binomial shrinkage from host to domain to suffix.

Rules name a host and a path prefix and decide the urls they fit; a rule's decisions are
the labelled outcomes of the pages under it (or the caller brings outcomes of their own).
Every url without a rule is judged by its host.  A host has few outcomes or none, so its
rate of bad pages is shrunk to the rate of its registered domain, that to the rate of its
suffix, and that to the rate of all pages.  How strongly one level holds the next is
estimated from the data: the method of moments for the overdispersion of a beta-binomial
around its parent's rate.  A url is blocked when the lower bound of the posterior of its
host's bad rate reaches ``threshold``: a host must be known to be bad.

All of it is built-in functions and joins on host, domain and suffix.  Counts are
pre-aggregated by host, so a host with a third of all pages is one small row; the two
scalars per level come from one-row aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from stratalog.llm.common import lower_ascii, others


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def rules(*lines: str) -> list[Rule]:
    """``"block example.com/en/"`` -> a rule for that host, its subdomains and that path."""
    out = []
    for line in lines:
        verdict, _, rest = line.partition(" ")
        host, slash, path = rest.partition("/")
        out.append(Rule(verdict, host, slash + path))
    return out


# Suffixes of two labels under which domains are registered.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au",
                      "co.jp", "ne.jp", "or.jp", "co.nz", "com.br", "co.in", "com.cn")
RHO_LEAST, RHO_MOST = 0.001, 0.999


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://`` or for null."""
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    at = F.coalesce(url, F.lit(""))
    return lower_ascii(F.regexp_extract(at, shape, 1)), F.regexp_extract(at, shape, 2)


def fitting_rule(host: Column, path: Column, given: Sequence[Rule], value: str) -> Column:
    """``name`` or ``verdict`` of the longest rule that fits; null without one."""
    out = F.lit(None).cast("string")
    for rule in sorted(given, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.lit(getattr(rule, value))).otherwise(out)
    return out


def suffix_of(host: Column, two_label: Sequence[str] = TWO_LABEL_SUFFIXES) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*two_label), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, two_label: Sequence[str] = TWO_LABEL_SUFFIXES) -> Column:
    """The suffix and one label more: what somebody registered."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*two_label), F.substring_index(host, ".", -3)).otherwise(two)


def _level(counts: DataFrame, prior: Column, out: str) -> DataFrame:
    """Posterior means of rows ``n, bad`` whose parents' rates are ``prior``, as column out.

    rho, the overdispersion around the parents, is (S - V) / W with S = sum n (r - m)^2,
    V = sum m (1 - m) and W = sum (n - 1) m (1 - m) over rows with outcomes; a prior then
    weighs as 1 / rho - 1 outcomes.
    """
    m, n = F.col("_m"), F.col("n")
    rows = counts.withColumn("_m", prior)
    r = F.col("bad") / n
    seen = n > 0
    s = F.sum(F.when(seen, n * (r - m) * (r - m)))
    v = F.sum(F.when(seen, m * (1 - m)))
    w = F.sum(F.when(seen, (n - 1) * m * (1 - m)))
    one = rows.agg(s.alias("s"), v.alias("v"), w.alias("w")).first()
    rho = (one.s - one.v) / one.w if one.w else RHO_MOST
    strength = 1 / min(max(rho, RHO_LEAST), RHO_MOST) - 1
    held = F.lit(strength)
    return (rows.withColumn(out, (m * held + F.col("bad")) / (held + n))
            .withColumn("_strength", held + n).drop("_m"))


def host_posteriors(outcomes: DataFrame, z: float = 1.645,
                    two_label: Sequence[str] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """host, domain, suffix, n, bad, mean, lower: the posterior of each host's bad rate.

    ``outcomes`` has host and bad (1, 0, or null for a page without an outcome).  Hosts that
    are null count as the empty host.  An empty table gives an empty table.
    """
    hosts = (outcomes.select(F.coalesce("host", F.lit("")).alias("host"), "bad")
             .groupBy("host").agg(F.count("bad").alias("n"),
                                  F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad"))
             .withColumns({"domain": domain_of(F.col("host"), two_label),
                           "suffix": suffix_of(F.col("host"), two_label)}))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    # Half an outcome of either kind keeps the rate inside (0, 1) when only one kind was seen.
    rate = ((total.bad or 0) + 0.5) / ((total.n or 0) + 1.0)
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"),
                                                    F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = _level(suffixes, F.lit(rate), "suffix_rate").select("suffix", "suffix_rate")
    domains = _level(domains.join(suffixes, "suffix"), F.col("suffix_rate"), "domain_rate")
    hosts = _level(hosts.join(domains.select("domain", "domain_rate"), "domain"),
                   F.col("domain_rate"), "mean")
    mean, weight = F.col("mean"), F.col("_strength")
    sd = F.sqrt(mean * (1 - mean) / (weight + 1))
    return hosts.select("host", "domain", "suffix", "n", "bad", "mean",
                        (mean - F.lit(z) * sd).alias("lower"))


def judge_urls(pages: DataFrame, given: Sequence[Rule], outcome: Column | None = None,
               z: float = 1.645, threshold: float = 0.5, url: str = "url") -> DataFrame:
    """The pages with host, path, rule, verdict and the posterior's mean and lower bound.

    ``outcome`` (1 bad, 0 good, null unknown) defaults to the rules' own decisions.  Columns
    of the input with one of the new names are replaced.  Null urls and urls without ``://``
    have an empty host and path, fit no rule and are judged by the rate of all pages; repeated
    rows are judged alike; an empty table gives an empty table.
    """
    host, path = url_parts(F.col(url))
    kept = others(pages, ("host", "path", "rule", "verdict", "mean", "lower"))
    row = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.struct(F.lit(0).alias("_"))
    bad = outcome.cast("int") if outcome is not None else F.lit(None).cast("int")
    h, p = F.col("host"), F.col("path")
    placed = (pages.select(row.alias("row"), host.alias("host"), path.alias("path"), bad.alias("bad"))
              .withColumns({"rule": fitting_rule(h, p, given, "name"),
                            "ruled": fitting_rule(h, p, given, "verdict")}))
    if outcome is None:
        placed = placed.withColumn("bad", F.when(F.col("ruled") == "block", 1)
                                   .when(F.col("ruled") == "allow", 0))
    known = host_posteriors(placed.select("host", "bad"), z).select("host", "mean", "lower")
    verdict = F.coalesce("ruled", F.when(F.col("lower") >= threshold, "block").otherwise("allow"))
    return placed.join(known, "host", "left").select(
        *[F.col(f"row.`{c}`").alias(c) for c in kept], "host", "path", "rule",
        verdict.alias("verdict"), "mean", "lower")
