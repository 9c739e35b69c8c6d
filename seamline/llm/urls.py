"""URL filters: host and path rules, and trust propagated over the link graph.

Where no rule fits a page, its host decides. Hosts with allowed pages are seeds of
trust, which a personalised PageRank carries along links; hosts with blocked pages are
seeds of distrust, which the same walk carries against them, to those who link there.
Rank thins out with every link it is shared over, so a host is judged by its share: its
rank divided by what the same walk brings it when every host is a seed of 1. That is a
weighted mean of the seeds that reach the host, from 0 to 1. A page without a rule is
blocked if its host's share of distrust is large enough and larger than that of trust.
Everything is DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.llm.common import if_small
from seamline.storage import store

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Targets of links that name a host; relative links stay on theirs.
_LINK = r"""(?i)(?:^|[^0-9a-z_])href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""
#: Hosts whose rules or ranks are handed to every task; more are joined by shuffle.
_HANDED_OUT = 20_000


@dataclass(frozen=True)
class UrlFilter:
    """Parameters.

    ``rules``       (verdict, host, path): a rule fits its host and all subdomains if
                    the path starts with the rule's; the longest host and path win
    ``damping``     share of rank that follows links, the rest returns to the seeds
    ``iterations``  of the walk, the same for any input
    ``threshold``   share of distrust above which a host is blocked, if it is more than
                    that of trust; an unlinked host has the share of its blocked pages
    """

    rules: tuple[tuple[str, str, str], ...] = (
        ("block", "net", "/"),
        ("allow", "example.net", "/en/"),
        ("block", "example.com", "/de/"),
        ("allow", "org", "/fr/"),
    )
    damping: float = 0.85
    iterations: int = 20
    threshold: float = 0.5


def rule_table(spark: SparkSession, rules: tuple[tuple[str, str, str], ...]) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def host_of(url: str) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_rest(url), r"\A[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: str) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without a ``://``."""
    return F.regexp_extract(_rest(url), r"\A[^/?#]*([^?#]*)", 1)


def _rest(url: str) -> Column:
    at = F.locate("://", F.col(f"`{url}`"))
    return F.when(at > 0, F.substring(F.col(f"`{url}`"), at + 3, F.length(F.col(f"`{url}`")))).otherwise(F.lit(""))


def filter_urls(
    pages: DataFrame,
    rules: DataFrame | None = None,
    config: UrlFilter = UrlFilter(),
    id_column: str = "page_id",
    url_column: str = "url",
    html_column: str = "html",
) -> DataFrame:
    """One row per page: id, ``host``, ``path``, ``rule`` (null if none fits), ``verdict``.

    ``rules`` (``verdict``, ``host``, ``path``) may be a table of any size; by default
    those of ``config``. A null url, and one without ``://``, has an empty host and path,
    which no rule fits and no link reaches: it is allowed. Null html has no links.
    Repeated rows are judged alike, null ids stay null, other columns are not read, and
    an empty table gives an empty result.
    """
    rules = rule_table(pages.sparkSession, config.rules) if rules is None else rules
    rows = pages.select(
        F.col(f"`{id_column}`").alias("page"),
        host_of(url_column).alias("host"),
        path_of(url_column).alias("path"),
    )
    own = _rules_by_host(rows.select("host").distinct(), rules)
    fitting = F.filter("rules", lambda r: F.col("path").startswith(r["path"]))
    # Rules come longest first.
    chosen = F.get(fitting, F.lit(0))
    ruled = rows.join(if_small(own, _HANDED_OUT).withColumnRenamed("host", "of"), F.col("host") == F.col("of"), "left")
    ruled = store(
        ruled.select("page", "host", "path", chosen.alias("chosen")).select(
            "page", "host", "path", F.col("chosen.rule").alias("rule"), F.col("chosen.verdict").alias("verdict")
        ),
        "ruled",
    )
    seeds = ruled.where("host <> ''").groupBy("host").agg(
        (F.count_if(F.col("verdict") == "allow") / F.count(F.lit(1))).alias("trust"),
        (F.count_if(F.col("verdict") == "block") / F.count(F.lit(1))).alias("distrust"),
    )
    ranks = host_ranks(seeds, host_links(pages, url_column, html_column), config)
    bad = (F.col("distrust") > config.threshold) & (F.col("distrust") > F.col("trust"))
    blocked = if_small(ranks.where(bad).select(F.col("host").alias("bad")), _HANDED_OUT)
    judged = ruled.join(blocked, F.col("host") == F.col("bad"), "left")
    by_host = F.when(F.col("bad").isNotNull(), "block").otherwise("allow")
    return judged.select(
        F.col("page").alias(id_column), "host", "path", "rule", F.coalesce("verdict", by_host).alias("verdict")
    )


def _rules_by_host(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """Each host with the rules of its domains, longest first."""
    labels = F.split("host", r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    suffixes = hosts.where("host <> ''").select("host", F.explode(domains).alias("domain"))
    known = rules.select(F.col("host").alias("domain"), "path", "verdict").where(
        "domain IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL"
    )
    rule = F.concat("domain", "path")
    ordered = F.struct(F.length(rule).alias("length"), rule.alias("rule"), "path", "verdict")
    return (
        suffixes.join(known, "domain")
        .groupBy("host")
        .agg(F.sort_array(F.collect_list(ordered), asc=False).alias("rules"))
    )


def host_links(pages: DataFrame, url_column: str = "url", html_column: str = "html") -> DataFrame:
    """``(source, target, links)`` between different hosts, counted over all pages."""
    found = F.explode(F.regexp_extract_all(F.col(f"`{html_column}`"), F.lit(_LINK), F.lit(1)))
    links = pages.select(host_of(url_column).alias("source"), found.alias("target"))
    links = links.withColumn("target", F.translate("target", _UPPER, _LOWER))
    return links.where("source <> '' AND source <> target").groupBy("source", "target").agg(
        F.count(F.lit(1)).alias("links")
    )


def host_ranks(seeds: DataFrame, links: DataFrame, config: UrlFilter = UrlFilter()) -> DataFrame:
    """``(host, trust, distrust)`` of all seeds and linked hosts, as shares from 0 to 1.

    ``seeds`` has ``host``, ``trust`` and ``distrust``. Both walks run in one table, with
    the links of one reversed, and ``reach`` is the rank of the same walk from seeds of 1
    everywhere; a share is rank by reach. A host without links to follow keeps its rank.
    """
    links = store(links, "links")
    kinds = F.explode(
        F.array(
            F.struct(F.lit("trust").alias("kind"), F.col("source").alias("from"), F.col("target").alias("to")),
            F.struct(F.lit("distrust").alias("kind"), F.col("target").alias("from"), F.col("source").alias("to")),
        )
    ).alias("e")
    steps = links.select("links", kinds).select("e.kind", "e.from", "e.to", "links")
    hosts = seeds.select("host").union(links.select("source")).union(links.select("target")).distinct()
    both = F.explode(F.array(F.lit("trust"), F.lit("distrust"))).alias("kind")
    start = hosts.join(seeds, "host", "left").select("host", "trust", "distrust", both)
    value = F.when(F.col("kind") == "trust", F.col("trust")).otherwise(F.col("distrust"))
    start = store(start.select("kind", "host", F.coalesce(value, F.lit(0.0)).alias("seed")), "seeds")
    ranks = start.select("kind", "host", F.col("seed").alias("rank"), F.lit(1.0).alias("reach"))
    if not links.isEmpty():
        total = steps.groupBy("kind", "from").agg(F.sum("links").alias("total"))
        shares = steps.join(total, ["kind", "from"]).select(
            "kind", "from", "to", (F.col("links") / F.col("total")).alias("share")
        )
        idle = start.join(total, (start["kind"] == total["kind"]) & (start["host"] == total["from"]), "left_anti")
        stay = idle.select("kind", F.col("host").alias("from"), F.col("host").alias("to"), F.lit(1.0).alias("share"))
        shares = store(shares.union(stay), "shares")
        for _ in range(config.iterations):
            moved = shares.join(ranks.withColumnRenamed("host", "from"), ["kind", "from"])
            moved = moved.groupBy("kind", F.col("to").alias("host")).agg(
                F.sum(F.col("share") * F.col("rank")).alias("rank_in"),
                F.sum(F.col("share") * F.col("reach")).alias("reach_in"),
            )
            rank, reach = (
                (1 - config.damping) * seed + config.damping * F.coalesce(came, F.lit(0.0))
                for seed, came in ((F.col("seed"), "rank_in"), (F.lit(1.0), "reach_in"))
            )
            walked = start.join(moved, ["kind", "host"], "left")
            ranks = store(walked.select("kind", "host", rank.alias("rank"), reach.alias("reach")), "ranks")
    share = F.try_divide("rank", "reach")
    return ranks.groupBy("host").agg(
        F.sum(F.when(F.col("kind") == "trust", share)).alias("trust"),
        F.sum(F.when(F.col("kind") == "distrust", share)).alias("distrust"),
    )
