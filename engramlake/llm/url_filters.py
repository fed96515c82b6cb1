"""URL filters: host and path rules, then link-graph propagation for everything the rules leave open.

Pages that a rule allows are the trusted seeds of their host, pages that a rule blocks its distrusted
seeds. Personalised PageRank carries trust along host links, and distrust against them: a host that
links to distrusted hosts earns distrust. What reaches a host without a way on returns to the seeds, so none of
either kind is lost; a host is blocked when distrust is more than ``THRESHOLD`` of both, and allowed when neither
reaches it. Host edges are
counted before they are shuffled, and ranks are summed per host on the map side, so a host with a
third of all pages or links is a few rows. Only DataFrame functions run, on the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramlake.llm.store import keep

Rule = tuple[str, str]
RULES: tuple[Rule, ...] = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
DAMPING = 0.85
ROUNDS = 30  # enough for a graph without long ways and cycles; propagation itself has no limit
TOLERANCE = 1e-6  # of every host's mass
THRESHOLD = 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> Column:
    """The longest rule whose host is ``host`` or a domain above it and whose path starts ``path``; else null."""
    found = []
    for _, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        domain, _, prefix = rule.partition("/")
        fits = (F.concat(F.lit("."), host).endswith("." + domain)) & path.startswith("/" + prefix)
        found.append(F.when(fits, F.lit(rule)))
    return F.coalesce(*found, F.lit(None).cast("string"))


def verdict_of(rule: Column, rules: Sequence[Rule] = RULES) -> Column:
    blocked = [r for v, r in rules if v == "block"]
    return F.when(rule.isNull(), None).when(rule.isin(blocked), "block").otherwise("allow")


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, links): links between different hosts, from the link addresses in each page's html."""
    found = F.regexp_extract_all(F.coalesce(F.col("html").cast("string"), F.lit("")), F.lit(_LINK), F.lit(1))
    links = pages.select(F.col("host").alias("src"), F.explode(found).alias("dst"))
    links = links.select("src", F.translate("dst", _UPPER, _LOWER).alias("dst"))
    return links.filter("src != '' and dst != '' and src != dst").groupBy("src", "dst").agg(F.count("*").alias("links"))


def propagate(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(host, trust, distrust, trust_gain, distrust_gain): personalised PageRank from ``seeds`` (host, trust, distrust) over ``edges``.

    Trust leaves a host in proportion to its links, distrust enters it in proportion to the links that
    its targets receive. Mass that stays at hosts without a way on returns to the seeds in proportion to
    theirs. As all seeds of a kind gain by the same factor each time, so do all hosts: trust and distrust are the
    masses before any return, and times the gain of their kind, which makes the sum that of the seeds, the
    masses with all returns. Rounds go on until none adds more than ``TOLERANCE`` of its mass to any host,
    so also until no new host is reached.
    """
    edges = keep(edges, "host-edges")
    if edges.isEmpty():
        return seeds.select("*", F.lit(1.0).alias("trust_gain"), F.lit(1.0).alias("distrust_gain"))
    forward = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "links")
    backward = edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), "links")
    ways = forward.union(backward)
    totals = ways.groupBy("kind", "host").agg(F.sum("links").alias("total"))
    ways = keep(ways.join(totals, ["kind", "host"]).select("kind", "host", "to", (F.col("links") / F.col("total")).alias("share")), "host-ways")
    start = seeds.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), "host", F.col(k).cast("double").alias("mass")) for k in ("trust", "distrust")])).alias("s"))
    first = (1 - DAMPING) * F.col("mass")
    ranks = keep(start.select("s.*").filter("mass > 0").select("kind", "host", first.alias("mass"), first.alias("added")), "seed-mass")
    while True:
        moved = ranks.filter("added > 0").join(ways, ["kind", "host"]).select("kind", F.col("to").alias("host"), (DAMPING * F.col("added") * F.col("share")).alias("added"))
        both = ranks.select("kind", "host", "mass", F.lit(0.0).alias("added")).union(moved.select("kind", "host", F.col("added").alias("mass"), "added"))
        ranks = keep(both.groupBy("kind", "host").agg(F.sum("mass").alias("mass"), F.sum("added").alias("added")), "ranks")
        change = ranks.agg(F.max(F.col("added") / F.col("mass"))).first()[0]
        if (change or 0.0) <= TOLERANCE:
            break
    reached = {r.kind: r.mass for r in ranks.groupBy("kind").agg(F.sum("mass").alias("mass")).collect()}
    given = seeds.agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")).first()
    kinds = [F.sum(F.when(F.col("kind") == k, F.col("mass")).otherwise(0.0)).alias(k) for k in ("trust", "distrust")]
    gains = [F.lit(float(given[k]) / reached[k] if reached.get(k) else 1.0).alias(f"{k}_gain") for k in ("trust", "distrust")]
    return ranks.groupBy("host").agg(*kinds).select("*", *gains)


def judge_pages(pages: DataFrame, rules: Sequence[Rule] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for every row of ``pages`` (page_id, url, html).

    ``trust`` and ``distrust`` are the masses that links bring in seed pages, before returns; the verdict weighs them with the
    returns of each kind. A null url or one without ``://`` has an empty host and path, no rule and no links, and is allowed.
    Null html has no links. Repeated rows return repeated rows and count as seeds each. Other columns
    are ignored; an empty table gives no rows.
    """
    urls = pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), "html")
    parts = urls.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    named = parts.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
    given = named.withColumn("given", verdict_of(F.col("rule"), rules))
    seeds = given.filter("given is not null").groupBy("host").agg(
        F.count(F.when(F.col("given") == "allow", 1)).alias("trust"), F.count(F.when(F.col("given") == "block", 1)).alias("distrust")
    )
    scores = propagate(keep(seeds, "host-seeds"), host_edges(parts))
    trust, distrust = F.col("trust") * F.col("trust_gain"), F.col("distrust") * F.col("distrust_gain")
    blocked = (trust + distrust > 0) & (distrust > threshold * (trust + distrust))
    hosts = scores.select("host", "trust", "distrust", F.when(blocked, "block").otherwise("allow").alias("host_verdict"))
    return given.drop("html").join(hosts, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("given", "host_verdict", F.lit("allow")).alias("verdict"),
        F.coalesce(F.col("trust").cast("double"), F.lit(0.0)).alias("trust"), F.coalesce(F.col("distrust").cast("double"), F.lit(0.0)).alias("distrust"),
    )
