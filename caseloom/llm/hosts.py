"""Reputation of hosts, and a url filter on top of it.

A host's share of bad pages is shrunk: a beta prior centred on its registered
domain, whose own share is shrunk to its suffix's, whose share is shrunk to that
of all pages. How strongly a level shrinks is estimated from the counts
themselves (moments of the beta-binomial): levels whose members hardly differ
shrink hard. A host is blocked when the lower bound of its posterior share is
above ``limit``. Fixed rules come first; the longest one that fits decides.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT = 0.5
# Standard deviations below the mean: the lower end of a 90 % interval.
BOUND = 1.645
# Weakest and strongest prior, in pages.
LEAST_PRIOR, MOST_PRIOR = 0.5, 100_000.0

Rule = tuple[str, str, str]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z in lower case, and path; both empty for null and without ``://``."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest of ``rules`` (verdict, host, path) that fits; null if none does.

    A rule fits its host and all subdomains when the path starts with its path.
    """
    text = verdict = F.lit(None).cast("string")
    for decided, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        text = F.when(fits, F.lit(rule_host + rule_path)).otherwise(text)
        verdict = F.when(fits, F.lit(decided)).otherwise(verdict)
    return text, verdict


def domain_of(host: Column) -> Column:
    """Registered domain: the last two labels."""
    return F.substring_index(host, ".", -2)


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def _prior_strength(groups: DataFrame) -> Column:
    """Prior size, in pages, of a level whose groups have ``n`` pages and ``bad`` bad ones; a scalar.

    The share of variance between groups, from the mean squares between and
    within them, gives the size of the beta prior.
    """
    share = F.col("bad") / F.col("n")
    total = groups.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count("*").alias("k"),
                       F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("n") * share * share).alias("npp"))
    mean = F.col("bad") / F.col("n")
    between = (F.col("npp") - F.col("n") * mean * mean) / (F.col("k") - 1)
    within = (F.col("bad") - F.col("npp")) / (F.col("n") - F.col("k"))
    size = (F.col("n") - F.col("nn") / F.col("n")) / (F.col("k") - 1)
    alike = (between - within) / (between + (size - 1) * within)
    strength = F.when((F.col("k") > 1) & (F.col("n") > F.col("k")) & (between > within),
                      F.greatest(F.lit(LEAST_PRIOR), F.least(F.lit(MOST_PRIOR), (1 - alike) / alike)))
    return total.select(F.coalesce(strength, F.lit(MOST_PRIOR))).scalar()


def reputation(outcomes: DataFrame) -> DataFrame:
    """Posterior of every host of ``outcomes`` (host, bad: 0, 1 or null for pages without a label).

    Returns host, n, bad, ``mean`` and ``low``. Labels fold to one row per host
    before any join, so a hot host costs one row per task. Without any label the
    shares are those of an even prior.
    """
    hosts = (outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
             .select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"),
                     "n", "bad"))

    def level(name: str) -> DataFrame:
        return hosts.groupBy(name).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))

    domains = (hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    suffixes, seen = level("suffix"), "n > 0"
    overall = suffixes.agg((F.coalesce(F.sum("bad"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).scalar()

    def shrunk(strength: Column, prior: Column) -> Column:
        return (F.col("bad") + strength * prior) / (F.col("n") + strength)

    by_suffix = suffixes.select("suffix", shrunk(_prior_strength(suffixes.where(seen)), overall).alias("suffix_mean"))
    by_domain = (domains.join(by_suffix, "suffix")
                 .select("domain", shrunk(_prior_strength(domains.where(seen)), F.col("suffix_mean")).alias("domain_mean")))
    strength = _prior_strength(hosts.where(seen))
    posterior = hosts.join(by_domain, "domain").select(
        "host", "n", "bad", (F.col("bad") + strength * F.col("domain_mean")).alias("a"),
        (F.col("n") - F.col("bad") + strength * (1 - F.col("domain_mean"))).alias("b"))
    mean, size = F.col("a") / (F.col("a") + F.col("b")), F.col("a") + F.col("b")
    return posterior.select("host", "n", "bad", mean.alias("mean"),
                            (mean - BOUND * F.sqrt(mean * (1 - mean) / (size + 1))).alias("low"))


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[Rule], limit: float = LIMIT) -> DataFrame:
    """page_id, host, path, rule and verdict of every page; one row per row.

    ``labels`` has the outcomes of crawled documents (doc_id, quality, toxic); a
    page shows the document whose number is the first in its path, and is bad if
    that one is toxic or of no quality. Labels that repeat a document count as
    bad if any of them does; null marks count as no finding. Pages without a
    label count for nothing. Only page_id and url are read, so other columns may
    have any name; a null url has an empty host, judged like any other.
    """
    host, path = split_url(F.col("url"))
    split = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    bad = F.greatest(F.col("toxic").cast("int"), 1 - F.col("quality").cast("int"))
    found = (labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("document"))
             .agg(F.max(bad).alias("bad")))
    number = F.regexp_extract("path", r"/([0-9]{1,18})", 1)
    outcomes = (split.select("host", F.when(number != "", number.cast("bigint")).alias("document"))
                .join(found, "document", "left"))
    text, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    judged = reputation(outcomes).select(
        "host", F.when(F.col("low") > limit, "block").otherwise("allow").alias("earned"))
    return (split.withColumn("rule", text).withColumn("ruled", verdict).join(judged, "host", "left")
            .select("page_id", "host", "path", "rule",
                    F.coalesce("ruled", "earned", F.lit("allow")).alias("verdict")))


def judge_sql(rules: Sequence[Rule], limit: float = LIMIT) -> str:
    """What ``judge`` returns for the tables pages and labels, as SQL of another engine."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))

    def case(pick) -> str:
        whens = " ".join(
            f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{pick(v, h, p)}'"
            for v, h, p in ordered)
        return f"CASE {whens} END"

    def strength(level: str) -> str:
        return f"""(SELECT coalesce(CASE WHEN k > 1 AND n > k AND msb > msw THEN
          greatest({LEAST_PRIOR}, least({MOST_PRIOR}, (1 - rho) / rho)) END, {MOST_PRIOR})
          FROM (SELECT *, (msb - msw) / (msb + (size - 1) * msw) AS rho FROM (
            SELECT k, n, (npp - n * (bad / n) * (bad / n)) / nullif(k - 1, 0) AS msb,
              (bad - npp) / nullif(n - k, 0) AS msw, (n - nn / n) / nullif(k - 1, 0) AS size
            FROM (SELECT sum(n)::DOUBLE n, sum(bad)::DOUBLE bad, count(*)::DOUBLE k, sum(n * n)::DOUBLE nn,
              sum(n * (bad / n) * (bad / n))::DOUBLE npp FROM {level} WHERE n > 0))))"""

    return f"""
    WITH rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END r
      FROM pages),
    split AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), '{string.ascii_uppercase}',
        '{string.ascii_lowercase}') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
    found AS (SELECT doc_id, max(greatest(toxic, 1 - quality)) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
    outcomes AS (SELECT host, bad FROM split LEFT JOIN found
      ON doc_id = try_cast(regexp_extract(path, '/([0-9]{{1,18}})', 1) AS BIGINT)),
    hosts AS (SELECT host, list_reverse(string_split(host, '.')) AS parts, count(bad)::DOUBLE n,
      coalesce(sum(bad), 0)::DOUBLE bad FROM outcomes GROUP BY host),
    named AS (SELECT host, n, bad, parts[1] AS suffix,
      CASE WHEN len(parts) > 1 THEN parts[2] || '.' || parts[1] ELSE parts[1] END AS domain FROM hosts),
    domains AS (SELECT domain, suffix, sum(n) n, sum(bad) bad FROM named GROUP BY ALL),
    suffixes AS (SELECT suffix, sum(n) n, sum(bad) bad FROM named GROUP BY ALL),
    overall AS (SELECT (coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 2) AS m FROM suffixes),
    by_suffix AS (SELECT suffix, (bad + s * m) / (n + s) AS m FROM suffixes, overall, (SELECT {strength("suffixes")} s)),
    by_domain AS (SELECT domain, (d.bad + s * m) / (d.n + s) AS m FROM domains d JOIN by_suffix USING (suffix),
      (SELECT {strength("domains")} s)),
    posterior AS (SELECT host, h.bad + s * m AS a, h.n - h.bad + s * (1 - m) AS b
      FROM named h JOIN by_domain USING (domain), (SELECT {strength("named")} s)),
    judged AS (SELECT host, CASE WHEN a / (a + b) - {BOUND} * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1))
      > {limit} THEN 'block' ELSE 'allow' END AS earned FROM posterior)
    SELECT page_id, host, path, {case(lambda v, h, p: h + p)} AS rule,
      coalesce({case(lambda v, h, p: v)}, earned, 'allow') AS verdict
    FROM split LEFT JOIN judged USING (host)"""
