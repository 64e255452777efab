r"""URL verdicts: longest matching rule first, then trust and distrust that spread over links between hosts.

A rule is a host with a path prefix; it fits the host and its subdomains. Pages that no rule decides get their
host's verdict. Hosts' pages that rules decide are the seeds: a host's share of allowed pages is its trust, its
share of blocked pages its distrust. Trust spreads along links by personalised PageRank, distrust against them
(who links to blocked hosts is suspect). A host is blocked if its distrust exceeds its trust by ``MARGIN`` of what
a wholly blocked host without links gets; otherwise it is allowed, also where nothing reaches it.

Only hosts and aggregated host edges are iterated over, each iteration one join and one pre-aggregated sum, with
the ranks written to the shared folder every few steps, until they hardly change. Links are the absolute and protocol-relative href and src
targets of the html; relative links stay on their host and count for nothing.

Defined cases: a null url, or one without "://", has empty host and path, fits no rule, and is allowed; null html has
no links; repeated pages count as often as they occur; of rules of equal length that fit, the last by host and path
decides; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.common import lower_ascii, materialize, temporary

DAMPING, STEPS, SAVE_EVERY, MARGIN = 0.85, 60, 4, 0.5
#: Steps end when less than this part of the seeds' sum moved in the last one; 0.85 ** 60 is below it.
TOLERANCE = 1e-4

#: The rules of the contract as (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


@dataclass(frozen=True)
class Spread:
    """How trust spreads: damping, most steps, the margin of distrust over trust that blocks, and what change ends the steps (0: none)."""

    damping: float = DAMPING
    steps: int = STEPS
    margin: float = MARGIN
    tolerance: float = TOLERANCE


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits, or nulls. The number of rules is a few; a rule's text is host and path."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(kind)).otherwise(verdict)
    return text, verdict


def judged_pages(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and the rule's verdict."""
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    return split.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): links from pages of src to other hosts, counted."""
    pattern = r"""(?i)(?:href|src)\s*=\s*["']?((?:https?:)?//[^\s"'<>]+)"""
    links = pages.where(F.col("html").contains("//")).select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(pattern), F.lit(1))).alias("link"))
    target = F.when(F.col("link").startswith("//"), F.concat(F.lit("x:"), F.col("link"))).otherwise(F.col("link"))
    links = links.select("src", host_of(target).alias("dst")).where("src <> '' AND dst <> '' AND src <> dst")
    return links.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def host_seeds(judged: DataFrame) -> DataFrame:
    """(host, trust, distrust): the shares of a host's pages that rules allow and block."""
    share = lambda kind: F.avg(F.when(F.col("ruled") == kind, 1.0).otherwise(0.0))
    return judged.where("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))


def personalised_rank(edges: DataFrame, seeds: DataFrame, spread: Spread = Spread()) -> DataFrame:
    """(host, score) by PageRank whose teleports go to seeds (host, seed); edges: (src, dst, weight). Without scaling: the seeds sum as they are."""
    total = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    steps = materialize(edges.join(total, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")), "url-edges")
    base = (1 - spread.damping) * F.col("seed")
    start = ranks = seeds.where("seed > 0").select("host", base.alias("score"))
    # of what was written last and now, every few steps; each step changes the sum of all scores by a part of the damping at most
    seeded = (start.agg(F.sum("score")).first()[0] or 0.0) / (1 - spread.damping)
    last = 0.0
    for step in range(1, spread.steps + 1):
        moved = steps.join(ranks.withColumnRenamed("host", "src"), "src").select(F.col("dst").alias("host"), (spread.damping * F.col("share") * F.col("score")).alias("score"))
        ranks = start.unionByName(moved).groupBy("host").agg(F.sum("score").alias("score"))
        if step % SAVE_EVERY == 0:
            ranks = materialize(ranks, "url-ranks")
            # scores only grow from step to step, so their sum tells how much is still to come
            total = ranks.agg(F.sum("score")).first()[0] or 0.0
            if spread.tolerance and total - last <= spread.tolerance * seeded:
                break
            last = total
    return ranks


def _host_verdicts(pages: DataFrame, judged: DataFrame, spread: Spread = Spread()) -> DataFrame:
    """(host, trust, distrust, host_verdict) for every host of a page."""
    seeds = materialize(host_seeds(judged), "url-seeds")
    edges = materialize(host_edges(pages), "url-links")
    if edges.isEmpty():
        # nothing to spread: a host keeps the teleports of its own seeds
        ranks = seeds.select("host", *[((1 - spread.damping) * F.col(c)).alias(c) for c in ("trust", "distrust")])
    else:
        trust = personalised_rank(edges, seeds.select("host", F.col("trust").alias("seed")), spread)
        back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
        distrust = personalised_rank(back, seeds.select("host", F.col("distrust").alias("seed")), spread)
        both = trust.select("host", F.col("score").alias("trust"), F.lit(0.0).alias("distrust")).unionByName(distrust.select("host", F.lit(0.0).alias("trust"), F.col("score").alias("distrust")))
        both = seeds.select("host", F.lit(0.0).alias("trust"), F.lit(0.0).alias("distrust")).unionByName(both)
        ranks = both.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
    blocked = F.col("distrust") - F.col("trust") >= spread.margin * (1 - spread.damping)
    return ranks.select("host", "trust", "distrust", F.when(blocked, "block").otherwise("allow").alias("host_verdict"))


def host_verdicts(pages: DataFrame, judged: DataFrame, spread: Spread = Spread()) -> DataFrame:
    """(host, trust, distrust, host_verdict) for every host of a page, as a stored table."""
    with temporary(pages.sparkSession):
        return materialize(_host_verdicts(pages, judged, spread), "url-hosts", outer=True)


def url_verdicts(pages: DataFrame, rules=RULES, spread: Spread = Spread()) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's trust and distrust, of every page."""
    judged = judged_pages(pages, rules)
    hosts = host_verdicts(pages, judged, spread)
    # few rows need their host, and the join may split a host that holds many pages
    joined = judged.join(hosts, "host", "left")
    verdict = F.coalesce("ruled", "host_verdict", F.lit("allow"))
    return joined.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")
