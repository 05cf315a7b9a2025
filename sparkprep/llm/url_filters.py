"""URL filters: rules first, then trust and distrust that links carry from host to host.

A rule is a host and the beginning of a path; it fits its host and all subdomains, and the longest fitting rule
decides. Where none fits, the host decides: allowed pages make their host a trusted seed and blocked ones a blocked seed,
by their share of the host's pages. Personalised PageRank starts from the trusted seeds and goes along links, and from the
blocked seeds against them, since whoever links to a blocked host is suspect; a host's rank is divided among the hosts
that it goes to. Ranks shrink where many hosts share one, so they are held against the same walk started from all hosts alike:
of what links bring to a host, the part that began at trusted (blocked) seeds. That part lies between 0 and 1 whatever the size of the
graph. A host's trust and distrust are ``1 - DAMPING`` of its own share plus ``DAMPING`` of that part. A host is blocked if its
distrust is at least that of an own share of ``LEAST`` and more than ``THRESHOLD`` of both together; a host without evidence is allowed.

Pages are read twice, by column: links once, urls once. Links are reduced to edges between hosts with a count
before anything iterates; each round is one join and one sum over edges, and its result is written to the shared
folder. Only the blocked hosts come back to the pages, by broadcast up to ``BROADCAST_HOSTS``.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and is allowed. Null
html has no links. Links of a host to itself and relative links carry nothing. Repeated pages count again, as
seeds and in edges. Equal rules are one. An empty table gives an empty result. Columns other than those named are
not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .text import column, if_small, keep

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)(?:href|src)\s*+=\s*+["']?\s*+(?:[a-z][a-z0-9+.-]*+:)?//([^/?#"'\s<>]+)"""

#: Share of a rank that is passed on in each round, and rounds (at least one).
DAMPING = 0.7
ROUNDS = 12

THRESHOLD = 0.5
#: The blocked share of a host's own pages that suffices without links; its score is (1 - DAMPING) * LEAST.
LEAST = 0.05

#: Blocked hosts (some 50 bytes each) up to which they are broadcast.
BROADCAST_HOSTS = 200_000


@dataclass(frozen=True)
class Rule:
    """``text`` is a host and the beginning of a path, such as ``example.org/a/``."""

    text: str
    allow: bool


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def rule_for(host: Column, path: Column, rules) -> Column:
    """Text and verdict of the longest fitting rule, or null."""
    found = F.lit(None).cast("struct<rule:string,allow:boolean>")
    for rule in sorted(set(rules), key=lambda r: (len(r.text), r.text)):
        rule_host, slash, rest = rule.text.partition("/")
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(slash + rest))
        found = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.allow).alias("allow"))).otherwise(found)
    return found


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Links between different hosts: src, dst and the number of pages that have one."""
    linked = F.array_distinct(F.regexp_extract_all(F.coalesce(column(html), F.lit("")), F.lit(LINK), F.lit(1)))
    pairs = pages.select(host_of(column(url)).alias("src"), F.explode_outer(linked).alias("link"))
    pairs = pairs.select("src", F.translate("link", UPPER, LOWER).alias("dst"))
    return pairs.where("dst is not null and src <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """Per host, from seeds (host, trusted, blocked) over edges (src, dst, n): trust_rank and distrust_rank, the
    personalised PageRanks along links and against them, and trust and distrust, which no number of hosts makes smaller.
    """
    edges = keep(edges, "url-edges")
    none = F.lit(0.0)
    part = F.col("n") / F.col("all_n")
    step = lambda a, b, t, d: (F.col(a).alias("from"), F.col(b).alias("to"), t.alias("t"), d.alias("d"))
    outward = edges.groupBy("src").agg(F.sum("n").alias("all_n"))
    inward = edges.groupBy("dst").agg(F.sum("n").alias("all_n"))
    along = edges.join(outward, "src").select(*step("src", "dst", part, none))
    against = edges.join(inward, "dst").select(*step("dst", "src", none, part))
    steps = keep(along.union(against), "url-steps")
    hosts = seeds.select("host").union(edges.select("src")).union(edges.select("dst")).distinct()
    seeds = keep(hosts.join(seeds, "host", "left").na.fill(0.0, ["trusted", "blocked"]), "url-seeds")
    # Each rank (what seeds it, which weight carries it), and the same walk from all hosts alike.
    ranks = {"trust": (F.col("trusted"), "t"), "distrust": (F.col("blocked"), "d")}
    ranks |= {f"any_{name}": (F.lit(1.0), weight) for name, (_, weight) in ranks.items()}
    state = seeds.select("host", *[seed.alias(name) for name, (seed, _) in ranks.items()])
    for _ in range(rounds):
        flow = steps.join(state, steps["from"] == state["host"]).groupBy("to").agg(
            *[F.sum(F.col(weight) * F.col(name)).alias(f"{name}_in") for name, (_, weight) in ranks.items()])
        after = seeds.join(flow, seeds["host"] == flow["to"], "left").na.fill(0.0, [f"{name}_in" for name in ranks])
        state = keep(after.select("host", "trusted", "blocked", *[f"{name}_in" for name in ranks], *[
            ((1 - damping) * seed + damping * F.col(f"{name}_in")).alias(name) for name, (seed, _) in ranks.items()
        ]), "url-state")
    linked = lambda name: F.when(F.col(f"any_{name}_in") > 0, F.col(f"{name}_in") / F.col(f"any_{name}_in")).otherwise(none)
    score = lambda name: ((1 - damping) * ranks[name][0] + damping * linked(name)).alias(name)
    return state.select(
        "host", F.col("trust").alias("trust_rank"), F.col("distrust").alias("distrust_rank"), score("trust"), score("distrust"))


def judge(pages: DataFrame, rules, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: its id (by its own name), host, path, rule and verdict (allow or block)."""
    seen = pages.select(column(page).alias("page"), host_of(column(url)).alias("host"), path_of(column(url)).alias("path"))
    ruled = seen.withColumn("r", rule_for(F.col("host"), F.col("path"), rules))
    share = lambda allow: F.avg(F.coalesce((F.col("r.allow") == allow).cast("double"), F.lit(0.0)))
    seeds = ruled.where("host <> ''").groupBy("host").agg(share(True).alias("trusted"), share(False).alias("blocked"))
    state = propagate(keep(seeds, "url-hosts"), host_edges(pages, url, html))
    suspect = (F.col("distrust") >= (1 - DAMPING) * LEAST) & (F.col("distrust") > THRESHOLD * (F.col("trust") + F.col("distrust")))
    blocked = keep(state.where(suspect).select("host", F.lit(True).alias("suspect")), "url-blocked")
    judged = ruled.join(if_small(blocked, BROADCAST_HOSTS), "host", "left")
    allowed = F.coalesce("r.allow", ~F.coalesce("suspect", F.lit(False)))
    return judged.select(
        F.col("page").alias(page), "host", "path", F.col("r.rule").alias("rule"),
        F.when(allowed, "allow").otherwise("block").alias("verdict"),
    )
