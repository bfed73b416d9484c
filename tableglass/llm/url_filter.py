"""Host reputation by empirical Bayes: page outcomes shrunk from host to registered domain to suffix; rules come first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableglass.llm.common import ascii_lower, lookup, stored

#: Suffixes of two labels under which names are registered (fixed values; give more with ``two_label_suffixes``).
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "com.br", "co.jp", "co.in", "co.nz", "co.za", "com.cn")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column, two_labels: Sequence[str] = TWO_LABEL_SUFFIXES) -> Column:
    return F.when(F.substring_index(host, ".", -2).isin(*two_labels), F.substring_index(host, ".", -2)).otherwise(
        F.substring_index(host, ".", -1))


def domain_of(host: Column, two_labels: Sequence[str] = TWO_LABEL_SUFFIXES) -> Column:
    """The registered domain: the suffix and one label before it."""
    return F.when(F.substring_index(host, ".", -2).isin(*two_labels), F.substring_index(host, ".", -3)).otherwise(
        F.substring_index(host, ".", -2))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, null if none. A rule ``com/a/`` fits the host com and its subdomains
    where the path starts with /a/."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _rates(hosts: DataFrame, by: Sequence[str]) -> DataFrame:
    return hosts.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("n_pages").alias("n_pages"), F.count(F.lit(1)).alias("hosts"))


def _weight(groups: DataFrame, strength: float) -> Column:
    """The prior's weight in pages, one number: fitted by moments to how far the groups' rates are spread beyond what chance
    gives, between 1 and 1000; ``strength`` where too few groups have two outcomes."""
    mean = groups.agg(((F.sum("bad") + 0.5) / (F.sum("n") + 1)).alias("m")).scalar()
    some = groups.filter("n > 1").select("n", "bad", F.coalesce(mean, F.lit(0.5)).alias("m"))
    k, pages, chance = F.count(F.lit(1)), F.sum("n"), F.max(F.col("m") * (1 - F.col("m")))
    between = F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("m"), 2))
    rho = (between / chance - k) / (pages - k)  # E[between] = chance * (k + (pages - k) * rho)
    fitted = F.when(k > 1, F.when(rho > 0, F.greatest(F.lit(1.0), F.least(F.lit(1000.0), 1 / rho - 1))).otherwise(1000.0))
    return F.coalesce(some.agg(fitted.otherwise(strength).alias("w")).scalar(), F.lit(strength))


def reputation(pages: DataFrame, outcomes: DataFrame, strength: float = 10.0, z: float = 1.645,
               two_labels: Sequence[str] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """(host, n_pages, n_labelled, n_bad, rate, lower): one row for each host.

    ``pages`` has (key, host), ``outcomes`` (key, bad) with bad 0 or 1. The prior of a suffix is centred at the overall rate,
    that of a domain at its suffix's posterior mean, that of a host at its domain's; the weight of each level's prior is
    fitted to the spread of the rates in that level. ``lower`` is the posterior mean less ``z`` standard deviations of the
    posterior beta distribution, at least 0.
    """
    labelled = outcomes.filter("bad IS NOT NULL AND key IS NOT NULL").groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.sum("bad").cast("double").alias("bad"))
    hosts = pages.join(labelled, "key", "left").groupBy("host").agg(
        F.count(F.lit(1)).alias("n_pages"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0.0)).alias("bad"))
    hosts = stored(hosts.select("*", domain_of(F.col("host"), two_labels).alias("domain"),
                                suffix_of(F.col("host"), two_labels).alias("suffix")), "hosts")
    domains, suffixes, n_hosts = _rates(hosts, ["domain", "suffix"]), _rates(hosts, ["suffix"]), hosts.count()
    overall = hosts.agg(((F.sum("bad") + 0.5) / (F.sum("n") + 1)).alias("m")).scalar()

    def mean(groups: DataFrame, prior: Column, level: DataFrame) -> DataFrame:
        w = _weight(level, strength)
        return groups.withColumn("a", prior * w + F.col("bad")).withColumn("b", (1 - prior) * w + F.col("n") - F.col("bad")).withColumn(
            "rate", F.col("a") / (F.col("a") + F.col("b")))

    s = mean(suffixes, overall, suffixes).select("suffix", F.col("rate").alias("prior"), "hosts")
    d = mean(lookup(domains.drop("hosts"), s, ["suffix"], "hosts", n_hosts).drop("hosts").join(
        domains.select("domain", "hosts"), "domain"), F.col("prior"), domains).select("domain", F.col("rate").alias("prior"), "hosts")
    h = mean(lookup(hosts, d, ["domain"], "hosts", n_hosts), F.col("prior"), hosts)
    deviation = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("a") + F.col("b") + 1))
    return h.select("host", "n_pages", F.col("n").alias("n_labelled"), F.col("bad").alias("n_bad"), "rate",
                    F.greatest(F.lit(0.0), F.col("rate") - z * deviation).alias("lower"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = (), url: str = "url", id_col: str = "page_id",
          key: Column | None = None, max_bad: float = 0.5, strength: float = 10.0, z: float = 1.645,
          two_labels: Sequence[str] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """(id, host, path, rule, verdict, rate, lower), one row for each page: the longest fitting rule's verdict, else ``block``
    where the host's lower posterior bound of the share of bad pages exceeds ``max_bad``, else ``allow``.

    ``outcomes`` has (key, bad); ``key`` is the expression over ``pages`` that finds a page's outcomes, its id if not given.
    Outcomes with a null key or a null bad are left out; several of one page all count. A null url or one without :// has an
    empty host and path; such pages share one reputation. Null ids and repeated rows are judged like others. Other columns are
    not read. An empty table gives an empty result; without outcomes every host has the neutral prior of one half.
    """
    df = pages.select(F.col(id_col).alias("id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"),
                      (F.col(id_col) if key is None else key).alias("key"))
    hosts = stored(reputation(df.select("key", "host"), outcomes, strength, z, two_labels), "reputation")
    judged = lookup(df.drop("key"), hosts.select("host", "n_pages", "rate", "lower"), ["host"], "n_pages", pages.count()).withColumn(
        "found", rule_for(F.col("host"), F.col("path"), rules))
    by_method = F.when(F.col("lower") > max_bad, "block").otherwise("allow")
    return judged.select(F.col("id").alias(id_col), "host", "path", F.col("found.rule").alias("rule"),
                         F.coalesce(F.col("found.verdict"), by_method).alias("verdict"), "rate", "lower")
