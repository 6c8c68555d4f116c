"""URL filter by trust and distrust over the host graph, in DataFrame operations only.

Rules (host, path prefix) decide the urls they fit: the host or a subdomain of it, and a path
that starts with the prefix; the longest rule wins. They also seed the graph: a host's trust seed is the
share of its pages that rules allow, its distrust seed the share they block.

Host edges are the links of the pages (``href`` with a host of its own), counted per pair of hosts; links within a host are
left out. Trust flows along links (personalised PageRank from the trusted seeds), distrust against
them (the same walk on reversed edges from the blocked seeds): who links to bad hosts is bad. A url
without a rule is blocked where its host's distrust exceeds ``ratio`` times its trust.

One frame holds both walks, so a step is one join and one aggregate. Edges are pre-aggregated; a host with very many
edges is a skewed side that the join can split, and sums are partial before the shuffle. Steps are written to
the shared folder. With damping ``d`` a walk takes ``log(tolerance) / log(d)`` steps, after which all of it that is left
is below ``tolerance`` of the seeds; it never stops earlier, because verdicts compare scores however small they are.

Edge cases: a null url or one without ``://`` has an empty host and path and is allowed unless a rule says
otherwise (rules name hosts, so none fits); without rules everything is allowed; a null html has no links; repeated pages count as often as they
come; hosts that are only linked to take part in the graph.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import new_folder, remove, written

#: (verdict, rule); a rule is a host and the path prefix that follows it.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
LINK_HOST = r"""(?i)href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""
#: Steps of a walk in one job; then the scores are written.
STEPS_AT_ONCE = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_parts(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def matching_rule(host: Column, path: Column, rules) -> Column:
    """(verdict, rule) of the longest rule that fits, or null; ``rules`` is a short literal list."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # later ones take precedence
        name, prefix = rule_parts(rule)
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(prefix)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts; ``pages`` has host and html."""
    found = F.regexp_extract_all("html", F.lit(LINK_HOST), F.lit(1))
    links = pages.where("host <> '' AND html IS NOT NULL").select("host", F.explode(found).alias("to"))
    bare = F.translate(F.regexp_replace(F.regexp_replace("to", r"^.*@", ""), r":\d*$", ""), UPPER, LOWER)
    links = links.select(F.col("host").alias("src"), bare.alias("dst")).where("dst <> '' AND src <> dst")
    return links.groupBy("src", "dst").agg(F.count("*").alias("n"))


def walks(edges: DataFrame, seeds: DataFrame, *, damping: float, tolerance: float) -> DataFrame:
    """(kind, host, score) of both walks; ``seeds`` has kind, host, seed."""
    spark = edges.sparkSession
    folder = new_folder(spark, "link-trust")
    both = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("from"), F.col("dst").alias("to"), "n").unionByName(
        edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("from"), F.col("src").alias("to"), "n"))
    both = written(both, f"{folder}/edges")
    totals = both.groupBy("kind", "from").agg(F.sum("n").alias("total"))
    steps = written(both.join(totals, ["kind", "from"]).select(
        "kind", F.col("from").alias("host"), "to", (damping * F.col("n") / F.col("total")).alias("share")), f"{folder}/steps")
    start = seeds.select("kind", "host", ((1 - damping) * F.col("seed")).alias("score"))
    start = written(start, f"{folder}/start")
    score, step = start, 0
    most = math.ceil(math.log(tolerance) / math.log(damping)) if not steps.isEmpty() else 0
    while step < most:
        new = score
        before, at_once = step, min(STEPS_AT_ONCE, most - step)
        for _ in range(at_once):
            sent = new.join(steps, ["kind", "host"]).select(
                "kind", F.col("to").alias("host"), (F.col("score") * F.col("share")).alias("score"))
            new = sent.unionByName(start).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        step += at_once
        score = written(new, f"{folder}/score-{step}")
        remove(spark, f"{folder}/score-{before}")
    kept = written(score, new_folder(spark, "link-trust-scores"))
    remove(spark, folder)
    return kept


def filter_urls(pages: DataFrame, *, rules=RULES, damping: float = 0.85, tolerance: float = 1e-4, ratio: float = 1.0) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for every row of ``pages`` (page_id, url, html)."""
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), host_of(url).alias("host"),
                        path_of(url).alias("path"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("match", matching_rule(F.col("host"), F.col("path"), rules))
    verdict = F.col("match.verdict")
    hosts = rows.where("host <> ''").groupBy("host").agg(
        F.mean(F.when(verdict == "allow", 1.0).otherwise(0.0)).alias("trust"),
        F.mean(F.when(verdict == "block", 1.0).otherwise(0.0)).alias("distrust"))
    seeds = hosts.select("host", F.explode(F.create_map(
        F.lit("trust"), F.col("trust"), F.lit("distrust"), F.col("distrust"))).alias("kind", "seed")).where("seed > 0")
    score = walks(host_edges(rows), seeds, damping=damping, tolerance=tolerance)
    by_host = score.groupBy("host").agg(*[
        F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0)).alias(k) for k in ("trust", "distrust")])
    judged = rows.drop("html").join(by_host, "host", "left").fillna(0.0, ["trust", "distrust"])
    own = F.when(F.col("distrust") > ratio * F.col("trust"), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("match.rule").alias("rule"),
                         F.coalesce(verdict, own).alias("verdict"), "trust", "distrust")
