"""URL verdicts: explicit rules first, then trust and distrust spread over the graph of hosts.

Rules block or allow a host with its subdomains below a path; the longest one that fits
wins. Pages that a rule allows or blocks make their host a seed, by the share of its pages so ruled.

Trust is personalised PageRank from the trusted seeds along links; distrust is personalised PageRank from the
blocked seeds against the links, from blocked hosts to those that link there. Each has a teleport vector of sum 1
and damping ``DAMPING``; what hosts without links hold goes back to the seeds. Such ranks shrink as the graph grows and as
many hosts link to one. The verdict therefore compares, for each host, what reaches it from the seeds with what reaches it from all hosts alike
(PageRank on the same links with teleport to every host): ``distrust_share`` is the part of what comes in against its links that
started at blocked seeds, ``trust_share`` the part of what comes in along links that started at trusted ones; a seed has at
least its own share. Both lie between 0 and 1 whatever the size of the graph. Pages without a rule are
blocked if their host's distrust_share is at least ``THRESHOLD`` and above its trust_share.

Both ranks are sums over walks, computed without normalising: returning the mass of hosts without links to the
teleport vector only scales the sum, so one division at the end gives the normalised rank.

Everything is keyed by host: votes of pages and links are aggregated before they are shuffled, so a host with a third of all pages
is a few rows in each task. Rounds are written each ``WRITE_EACH``, so plans stay short and lost executors cost little.

Defined cases: a null url or one without "://" has an empty host and path, which no rule
fits and no link reaches: allowed; null html has no links; links inside of comments, scripts and styles aren't links; repeated pages vote each on
their own; an empty table gives no rows; links inside a host carry nothing; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geofold.llm.common import stash, unstash

DAMPING = 0.85
ROUNDS = 20
#: Rounds after which ranks are written, so that plans stay short.
WRITE_EACH = 5
THRESHOLD = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_NO_LINKS = r"(?is)<!--.*?(?:-->|\z)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|\z)"
_LINK = r"(?is)<(?:a|area)\s[^>]*?\bhref\s*=\s*[\"']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#\"'\s>\\]+)"


def lowered(column):
    return F.translate(column, UPPER, LOWER)


def split_url(url):
    """(host, path) columns."""
    return F.coalesce(lowered(F.regexp_extract(url, _URL, 1)), F.lit("")), F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def ruled(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """pages (with host and path) with rule and rule_verdict, null where no rule fits. rules: (verdict, host/path)."""
    fits = []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        host, slash, path = rule.partition("/")
        of_host = (F.col("host") == host) | F.endswith("host", F.lit("." + host))
        fits.append((of_host & F.startswith("path", F.lit(slash + path)), verdict, rule))
    choose = lambda i: reduce(lambda rest, f: F.when(f[0], F.lit(f[i])).otherwise(rest), reversed(fits), F.lit(None).cast("string"))
    return pages.withColumn("rule", choose(2)).withColumn("rule_verdict", choose(1))


def host_links(pages: DataFrame) -> DataFrame:
    """(host, to, pages): pages of a host that link to another one. pages: host and html."""
    shown = F.regexp_replace(F.coalesce("html", F.lit("")), _NO_LINKS, "")
    targets = F.array_distinct(F.transform(F.regexp_extract_all(shown, F.lit(_LINK), 1), lowered))
    return pages.select("host", F.explode(targets).alias("to")).where("host != to AND host != ''").groupBy("host", "to").agg(F.count("*").alias("pages"))


def spread(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(way, host, seed, every, from_seeds, from_all): walks of up to ``rounds`` steps that end at a host.

    edges: (way, from, to, share), shares of a host's edges of one way sum to 1; seeds: (way, host, seed, every) for
    each host of each way, seed and every being two teleport vectors. A walk of n steps counts damping ** n;
    from_seeds and from_all weigh it by where it starts and leave out walks of no step.
    """
    rank, written = seeds.select("way", "host", "seed", "every", F.lit(0.0).alias("from_seeds"), F.lit(0.0).alias("from_all")), None
    for i in range(rounds):
        now = rank.select("way", F.col("host").alias("from"), (F.col("seed") + F.col("from_seeds")).alias("a"), (F.col("every") + F.col("from_all")).alias("b"))
        flow = edges.join(now, ["way", "from"]).groupBy("way", "to").agg(F.sum(F.col("a") * F.col("share") * damping).alias("from_seeds"), F.sum(F.col("b") * F.col("share") * damping).alias("from_all"))
        rank = seeds.join(flow.withColumnRenamed("to", "host"), ["way", "host"], "left").fillna(0.0, ["from_seeds", "from_all"])
        if i % WRITE_EACH == WRITE_EACH - 1 or i == rounds - 1:
            after = stash(rank, "ranks")
            unstash(written)
            rank = written = after
    return rank


def ranked(hosts: DataFrame, links: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust, trust_share, distrust_share) of each host that has pages or links.

    hosts: (host, allowed, blocked), shares of their pages; links: (host, to, pages).
    """
    ways = F.explode(F.array(F.lit("forth"), F.lit("back"))).alias("way")
    known = hosts.select("host", "allowed", "blocked").unionByName(links.select(F.col("to").alias("host"), F.lit(0.0).alias("allowed"), F.lit(0.0).alias("blocked")))
    nodes = known.groupBy("host").agg(F.max("allowed").alias("allowed"), F.max("blocked").alias("blocked"))
    seeds = stash(nodes.select("host", ways, "allowed", "blocked").select("way", "host", F.when(F.col("way") == "forth", F.col("allowed")).otherwise(F.col("blocked")).alias("seed"), F.lit(1.0).alias("every")), "seeds")
    both = links.select(ways, "host", "to", "pages").select("way", F.when(F.col("way") == "forth", F.col("host")).otherwise(F.col("to")).alias("from"), F.when(F.col("way") == "forth", F.col("to")).otherwise(F.col("host")).alias("to"), "pages")
    out = both.groupBy("way", "from").agg(F.sum("pages").alias("all"))
    edges = stash(both.join(out, ["way", "from"]).select("way", "from", "to", (F.col("pages") / F.col("all")).alias("share")), "host-edges")
    found = spread(edges, seeds, damping, rounds)
    share = F.greatest(F.coalesce(F.try_divide("from_seeds", "from_all"), F.lit(0.0)), F.col("seed"))
    sums = {r["way"]: r["total"] for r in found.groupBy("way").agg(F.sum(F.col("seed") + F.col("from_seeds")).alias("total")).collect()}
    of = lambda way: F.max(F.when(F.col("way") == way, (F.col("seed") + F.col("from_seeds")) / (sums.get(way) or 1.0)))
    own = lambda way: F.max(F.when(F.col("way") == way, share))
    return found.groupBy("host").agg(of("forth").alias("trust"), of("back").alias("distrust"), own("forth").alias("trust_share"), own("back").alias("distrust_share"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = THRESHOLD, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust, trust_share, distrust_share) of every row."""
    host, path = split_url(pages[url_col])
    rows = ruled(pages.select(pages[id_col].cast("long").alias("page_id"), host.alias("host"), path.alias("path")), rules)
    votes = lambda verdict: F.avg((F.coalesce("rule_verdict", F.lit("")) == verdict).cast("double"))
    hosts = stash(rows.groupBy("host").agg(votes("allow").alias("allowed"), votes("block").alias("blocked")).where("host != ''"), "hosts")
    links = stash(host_links(pages.select(host.alias("host"), pages[html_col].cast("string").alias("html"))), "links")
    ranks = stash(ranked(hosts, links, damping, rounds), "host-ranks")
    bad = (F.col("distrust_share") >= threshold) & (F.col("distrust_share") > F.col("trust_share"))
    verdict = F.coalesce("rule_verdict", F.when(bad, F.lit("block")).otherwise(F.lit("allow")))
    measures = ("trust", "distrust", "trust_share", "distrust_share")
    return rows.join(ranks, "host", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), *(F.coalesce(m, F.lit(0.0)).alias(m) for m in measures))
