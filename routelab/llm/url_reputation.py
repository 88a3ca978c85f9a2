"""URL rules and empirical-Bayes host reputation, in SQL functions only.

Labelled page outcomes are counted by host, registered domain and suffix, port cut
off: the suffix is the last label, or the last two where ``suffixes`` lists them, and the domain has one label more. Each level's bad rate
is shrunk towards that of the level above by a beta-binomial prior whose strength is estimated from the spread of the level's
groups (method of moments): groups that differ no more than chance has it give a prior that outweighs any labels of their own, so that
noise blocks nobody, and groups that differ give a weak one. A host is blocked when the lower bound of its posterior bad rate, ``z`` standard deviations
below its mean, passes ``limit``: by default the bad rate of all labelled pages, so that whatever share of a corpus is bad, hosts
that are worse than it with good odds go.

Defined cases: a null url, or one without ``://``, has an empty host and path; its labels count for no host, and it is judged like
a host without labels. Such a host has its domain's (suffix', corpus') rate. A page whose label is null, or that has none, adds
nothing; of repeated labels of a page the worst counts once. Repeated pages are judged each. With no labels at all every host is
allowed; empty tables give no rows. Urls of any length are read whole; ties of equal rules can't occur (of rules as long the first in string order goes).
Extra columns of either table are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routelab.llm.common import staged

#: Bounds of a level's intra-class correlation, for the numbers' sake only: below the least a prior is worth millions of labels.
LEAST_RHO, MOST_RHO = 1e-7, 1 - 1e-7

#: The alphabet whose letters are lower-cased in hosts.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Suffixes of two labels under which names are registered: the common ones; pass a longer list where the pages need it.
TWO_LABEL_SUFFIXES = tuple(
    f"{second}.{top}"
    for top, seconds in {
        "uk": "ac co gov ltd me net nhs org plc sch", "au": "asn com edu gov id net org", "nz": "ac co geek gen govt net org school", "jp": "ac ad co ed go gr lg ne or", "kr": "ac co go ne or re",
        "in": "ac co edu firm gen gov ind net org res", "br": "com edu gov net org", "cn": "ac com edu gov net org", "tw": "com edu gov idv net org", "hk": "com edu gov idv net org", "sg": "com edu gov net org per",
        "za": "ac co gov net org web", "mx": "com edu gob net org", "ar": "com edu gob net org", "tr": "com edu gov net org", "il": "ac co gov net org", "id": "ac co go or web", "th": "ac co go in or", "my": "com edu gov net org",
    }.items()
    for second in seconds.split()
)


def domain_suffix(host: Column, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and suffix of a host; a port is none of either."""
    name = F.regexp_replace(host, ":[0-9]*$", "")
    last = lambda n: F.substring_index(name, ".", -n)
    listed = last(2).isin(*suffixes) if suffixes else F.lit(False)
    return F.when(listed, last(3)).otherwise(last(2)), F.when(listed, last(2)).otherwise(last(1))


def url_host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) after the first ``://`` and the path after it, both empty where there is none."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def matching_rule(rules: list[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """Verdict and text of the longest (verdict, 'host/path') rule that fits a url, else nulls."""
    verdict = rule = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, _, rest = text.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(f"/{rest}")
        verdict, rule = F.when(fits, kind).otherwise(verdict), F.when(fits, text).otherwise(rule)
    return verdict, rule


def prior_strength(level: DataFrame) -> float:
    """Weight, in labels, of a level's prior: (1 - rho) / rho of its groups' (n, k, up), rho kept within its bounds."""
    spread = F.sum(F.expr("n * pow(k / n - up, 2) / (up * (1 - up))"))
    free = F.sum("n") - F.sum(F.col("n") * F.col("n")) / F.sum("n") - F.count("*") + 1
    spread, free = level.agg((spread - F.count("*") + 1).alias("s"), free.alias("f")).first()
    rho = min(max(spread / free if free else 0.0, LEAST_RHO), MOST_RHO)
    return (1 - rho) / rho


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], z: float = 0.674, limit: float | None = None, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """page_id, host, path, rule and verdict of every page; ``outcomes`` has page_id and bad (1: a bad page).

    Counts by host are staged once; the levels above are aggregates of that narrow table, and only each level's prior strength
    (one number) comes to the driver. The default ``z`` asks for odds of three to one, ``limit`` of None is the labelled base rate.
    """
    host, path = url_host_path(F.col("url"))
    page = pages.select("page_id", host.alias("host"), path.alias("path"))
    outcome = outcomes.filter("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    own = F.when(F.col("host") != "", F.col("bad"))
    counts = page.join(outcome, "page_id", "left").groupBy("host").agg(F.count(own).alias("n"), F.coalesce(F.sum(own), F.lit(0)).alias("k"))
    domain, suffix = domain_suffix(F.col("host"), suffixes)
    counts = staged(counts, "hosts").withColumns({"domain": domain, "suffix": suffix})

    labelled = counts.filter("n > 0")
    domains = labelled.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    n, k = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("k"), F.lit(0))).first()
    base = (k + 0.5) / (n + 1) if n else 0.0
    limit = base if limit is None else limit

    def shrunk(level: DataFrame, strength: float) -> Column:
        return (level["k"] + strength * level["up"]) / (level["n"] + strength)

    suffixes = suffixes.withColumn("up", F.lit(base))
    suffixes = suffixes.select("suffix", shrunk(suffixes, prior_strength(suffixes)).alias("suffix_rate"))
    domains = domains.join(suffixes, "suffix").withColumnRenamed("suffix_rate", "up")
    domains = domains.select("domain", shrunk(domains, prior_strength(domains)).alias("domain_rate"))
    hosts = counts.join(domains, "domain", "left").join(suffixes, "suffix", "left")
    hosts = hosts.select("host", "n", "k", F.coalesce("domain_rate", "suffix_rate", F.lit(base)).alias("up"))
    strength = prior_strength(hosts.filter("n > 0"))
    a, b = F.col("k") + strength * F.col("up"), F.col("n") - F.col("k") + strength * (1 - F.col("up"))
    low = a / (a + b) - z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    judged = hosts.select("host", F.when(low > limit, "block").otherwise("allow").alias("judged"))

    verdict, rule = matching_rule(rules, F.col("host"), F.col("path"))
    out = page.join(judged, "host", "left")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, "judged").alias("verdict"))
