"""URL filters: rules first, then trust and distrust spread over the link graph, by DataFrame operations only.

Edges go from the host of a page to the hosts of the absolute links in its html, one for each pair of hosts with the number
of links. Trust is personalised PageRank from seeds whose pages a rule allows; distrust is the same on reversed edges
from seeds whose pages a rule blocks, so hosts that link to blocked ones become suspect. What rules say of a host's own pages
comes before what others pass on: the share of its ruled pages that are allowed (or blocked) is added to its rank, which is
below 1. A host is blocked where its distrust is greater than ``RATIO`` times its trust and than ``LEAST``; else allowed.
Pages that a rule fits have its verdict.

Defined cases: a null url, or one without ``://``, has an empty host and path, no rule, and is allowed unless its (empty)
host is blocked; null html has no links; very long html and urls are read whole; hosts are compared with A-Z as a-z, other
letters as they are; a link that a page repeats counts once for the page; links of a host to itself are ignored; without
edges, scores are those of the seeds; a host whose links lead nowhere passes nothing on; equal trust and distrust allow;
repeated rows count as more pages; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgewise.functions.session import cut, prepare

# Verdict, host and path of each rule.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
DAMPING = 0.85
TOLERANCE = 1e-6
#: A round changes the scores by DAMPING times what the round before did at most, so the tolerance is met by then.
ROUNDS = math.ceil(math.log(TOLERANCE / 2) / math.log(DAMPING)) + 1
RATIO = 1.0
LEAST = 1e-12
LINK = r"""(?i)href\s*=\s*["']?\s*([a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def small(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(frame: DataFrame) -> DataFrame:
    """Add host and path from ``url``."""
    at = F.position(F.lit("://"), F.col("url"))
    rest = F.when(at > 0, F.substr("url", at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return frame.withColumns({"host": F.coalesce(small(host), F.lit("")), "path": F.coalesce(path, F.lit(""))})


def matched_rule(rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits host and path, as ``host/path``, and its verdict; nulls where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, links between different hosts."""
    hosts = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(2)), small))
    links = pages.select(F.col("host").alias("src"), F.explode(hosts).alias("dst"))
    return links.where("src <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("links"))


def spread(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """host, score: personalised PageRank from ``seeds`` (host, weight; weights of a sum of 1) over edges (src, dst, links)."""
    totals = edges.groupBy("src").agg(F.sum("links").alias("all_links"))
    shares = cut(edges.join(totals, "src").select("src", "dst", (F.col("links") / F.col("all_links")).alias("share")))
    scores = cut(seeds.select("host", F.col("weight").alias("score")))
    if shares.isEmpty():
        return scores
    base = seeds.select("host", (F.col("weight") * (1 - DAMPING)).alias("part"))
    for _ in range(rounds):
        passed = shares.join(scores, shares["src"] == scores["host"]).select(F.col("dst").alias("host"), (F.col("score") * F.col("share") * DAMPING).alias("part"))
        now = cut(base.union(passed).groupBy("host").agg(F.sum("part").alias("score")))
        old = scores.select(F.col("host").alias("h"), F.col("score").alias("s"))
        change = now.join(old, F.col("host") == F.col("h"), "full").agg(F.sum(F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("s", F.lit(0.0))))).first()[0]
        scores = now
        if (change or 0.0) < TOLERANCE:
            break
    return scores


def judge_pages(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict, and the host's trust and distrust."""
    prepare(pages.sparkSession)
    split = split_url(pages.select("page_id", "url", "html"))
    rule, verdict = matched_rule(rules)
    ruled = split.withColumns({"rule": rule, "ruled": verdict})
    hosts = cut(ruled.groupBy("host").agg(F.count_if(F.col("ruled") == "allow").alias("allowed"), F.count_if(F.col("ruled") == "block").alias("blocked")))
    totals = hosts.agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked")).first()
    edges = cut(host_edges(split))

    def seeds(column: str) -> DataFrame:
        return hosts.where(F.col(column) > 0).select("host", (F.col(column) / F.lit(float(totals[column] or 1))).alias("weight"))

    trust = spread(edges, seeds("allowed")).withColumnRenamed("score", "trust")
    distrust = spread(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "links"), seeds("blocked")).withColumnRenamed("score", "distrust")
    ranks = trust.join(distrust, "host", "full")
    # Hosts with a rule are seeds, so each of them has a rank.
    own = hosts.where("allowed + blocked > 0").select(F.col("host").alias("ruled_host"), (F.col("allowed") / (F.col("allowed") + F.col("blocked"))).alias("own"))
    ranks = ranks.join(own, F.col("host") == F.col("ruled_host"), "left")
    trust_sum = F.coalesce("trust", F.lit(0.0)) + F.coalesce("own", F.lit(0.0))
    distrust_sum = F.coalesce("distrust", F.lit(0.0)) + F.coalesce(1 - F.col("own"), F.lit(0.0))
    scored = ranks.select(F.col("host").alias("h"), trust_sum.alias("trust"), distrust_sum.alias("distrust"))
    out = ruled.select("page_id", "host", "path", "rule", "ruled").join(cut(scored), F.col("host") == F.col("h"), "left")
    trust_of, distrust_of = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    method = F.when((distrust_of > RATIO * trust_of) & (distrust_of > LEAST), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), F.round(trust_of, 9).alias("trust"), F.round(distrust_of, 9).alias("distrust"))
