"""URL filters: explicit rules, then empirical-Bayes host reputation; DataFrame operations only.

Reputation: labelled page outcomes (bad or not) are counted by host, registered
domain and suffix.  Each level's bad rate is a beta-binomial posterior whose prior
mean is its parent's posterior mean; the prior's strength at each level is fitted
from the spread of all its groups (method of moments).  A host is blocked where a
lower posterior bound of its bad rate (mean less ``z`` standard deviations) is over
``limit``: few or mixed outcomes shrink to the parent and allow.

Suffixes are a table of public suffix rules ("co.uk", "*.ck" for any one label before
ck, "!www.ck" for an exception); the longest fitting rule wins, an exception before all, and
the last label is the suffix where none fits.  The registered domain is one label more.

Null urls and urls without :// have an empty host and path.  Null outcomes do not
count.  Rules: host and path of a rule; it fits its host and all subdomains where
the url's path starts with its path; the longest fitting one wins (then by text).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import written

#: Suffixes of two labels under which names are registered (fixed values).
TWO_LABEL_SUFFIXES = ["co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "co.kr", "co.in", "com.br", "com.mx", "com.tr", "com.cn", "co.za"]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _tails(host: Column) -> Column:
    """The host and what is left of it without its first labels, down to the last."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def suffix_table(spark: SparkSession, rules: list[str] | None = None) -> DataFrame:
    """(suffix_rule) of public suffix rules, by default TWO_LABEL_SUFFIXES; a full list goes here."""
    return spark.createDataFrame([(r,) for r in sorted({r.strip().lower() for r in (TWO_LABEL_SUFFIXES if rules is None else rules)})], "suffix_rule string")


def with_suffix(hosts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """hosts (host, distinct, ...) with suffix and domain (its registered domain; the suffix itself has none of its own and stands for it)."""
    labels = lambda c: F.size(F.split(c, r"\."))
    after = F.regexp_replace("tail", r"^[^.]*\.?", "")
    forms = F.array(F.struct(F.col("tail").alias("rule"), F.lit(0).alias("kind"), F.col("tail").alias("suffix")), F.struct(F.concat(F.lit("*."), after).alias("rule"), F.lit(0).alias("kind"), F.col("tail").alias("suffix")), F.struct(F.concat(F.lit("!"), F.col("tail")).alias("rule"), F.lit(1).alias("kind"), after.alias("suffix")))
    fitting = hosts.select("host", F.explode(_tails(F.col("host"))).alias("tail")).select("host", F.explode(forms).alias("f")).select("host", "f.*").join(suffixes.select(F.col("suffix_rule").alias("rule")), "rule")
    best = fitting.groupBy("host").agg(F.max(F.struct("kind", labels("suffix").alias("n"), "suffix"))["suffix"].alias("_suffix"))
    out = hosts.join(best, "host", "left").withColumn("suffix", F.coalesce("_suffix", F.substring_index("host", ".", -1))).drop("_suffix")
    size = labels("suffix")
    return out.withColumn("domain", F.array_join(F.slice(F.split("host", r"\."), -F.least(size + 1, labels("host")), size + 1), "."))


@dataclass(frozen=True)
class Policy:
    limit: float = 0.5  #: bad rate
    z: float = 1.0  #: standard deviations that the bound lies below the mean


def _posterior(level: DataFrame) -> DataFrame:
    """(..., bad, n, prior) -> the same with mean and strength of the level's beta-binomial posterior."""
    mu = F.col("prior")
    got = level.agg(
        F.sum(F.pow(F.col("bad") - F.col("n") * mu, 2) - F.col("n") * mu * (1 - mu)).alias("excess"),
        F.sum(F.col("n") * (F.col("n") - 1) * mu * (1 - mu)).alias("scale"),
    ).first()
    rho = (got["excess"] or 0.0) / got["scale"] if got["scale"] else 0.0
    m = 1 / min(max(rho, 0.005), 0.5) - 1  # prior observations; two numbers reach the driver
    return level.withColumn("strength", F.lit(m) + F.col("n")).withColumn("mean", (F.col("bad") + F.lit(m) * mu) / F.col("strength"))


def host_reputation(outcomes: DataFrame, policy: Policy = Policy(), suffixes: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """outcomes (host, bad 0 or 1) -> (hosts, domains, suffixes), each (its key, bad, n, mean, bound).

    Outcomes are counted once, into a written table of one row for each host, from which all levels come.
    """
    o = outcomes.where(F.col("bad").isNotNull() & (F.col("host") != ""))
    hosts = o.groupBy("host").agg(F.sum(F.col("bad").cast("long")).alias("bad"), F.count("*").alias("n"))
    hosts = written(with_suffix(written(hosts), suffixes if suffixes is not None else suffix_table(o.sparkSession)))
    total = hosts.agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")).first()
    base = ((total["bad"] or 0) + 0.5) / ((total["n"] or 0) + 1.0)
    tops = _posterior(hosts.groupBy("suffix").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")).withColumn("prior", F.lit(base)))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    domains = _posterior(written(domains.join(tops.select("suffix", F.col("mean").alias("prior")), "suffix")))
    hosts = _posterior(written(hosts.drop("suffix").join(domains.select("domain", F.col("mean").alias("prior")), "domain")))
    bound = F.col("mean") - policy.z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("strength") + 1))
    return tuple(x.select(k, "bad", "n", "mean", bound.alias("bound")) for x, k in ((hosts, "host"), (domains, "domain"), (tops, "suffix")))


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """rules (verdict, 'host/path') -> (rule, rule_host, rule_path, rule_verdict)."""
    rows = [(r, r.split("/", 1)[0], "/" + r.split("/", 1)[1] if "/" in r else "", v) for v, r in rules]
    return spark.createDataFrame(rows, "rule string, rule_host string, rule_path string, rule_verdict string")


def judge_urls(pages: DataFrame, rules: DataFrame, outcomes: DataFrame, policy: Policy = Policy(), suffixes: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule (null where none fits), verdict (allow or block), bound (of the host's
    bad rate, or its domain's, suffix's or null), for every row of pages (page_id, url).

    What is known of a host is a written table of one row for each, so that the join back to the pages is
    a plain one, which adaptive execution splits where a host is hot.
    """
    if suffixes is None:
        suffixes = suffix_table(pages.sparkSession)
    hosts, domains, tops = host_reputation(outcomes, policy, suffixes)
    seen = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    names = written(with_suffix(written(seen.select("host").distinct()), suffixes))
    fitting = names.select("host", F.explode(_tails(F.col("host"))).alias("rule_host")).join(rules, "rule_host")
    fitting = fitting.groupBy("host").agg(F.sort_array(F.collect_list(F.struct(F.length("rule").alias("size"), "rule", "rule_path", "rule_verdict")), asc=False).alias("rules"))
    rated = names.join(hosts.select("host", F.col("bound").alias("h")), "host", "left").join(domains.select("domain", F.col("bound").alias("d")), "domain", "left").join(tops.select("suffix", F.col("bound").alias("s")), "suffix", "left")
    known = written(rated.select("host", F.coalesce("h", "d", "s").alias("bound")).join(fitting, "host", "left"))
    out = seen.join(known, "host", "left").withColumn("_r", F.get(F.filter("rules", lambda r: F.startswith(F.col("path"), r["rule_path"])), 0))
    own = F.when(F.col("bound") > policy.limit, "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("_r.rule").alias("rule"), F.coalesce("_r.rule_verdict", own).alias("verdict"), "bound")
