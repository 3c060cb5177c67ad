"""Ranks of hosts against plain PageRank, and verdicts that don't depend on the graph's size."""

import numpy as np
import pytest
from geofold.llm import url_rules
from geofold.llm.queries import URL_RULES

PAGES = "page_id long, url string, html string"


def test_many_linkers_of_a_blocked_host_are_each_blocked(spark):
    pages = [(0, "http://bad.net/", "")]
    pages += [(1 + i, f"http://linker{i}.com/", "<a href='http://bad.net/'>") for i in range(30)]
    pages += [(100, "http://mixed.com/", "<a href='http://bad.net/'><a href='http://fine.com/'><a href='http://good.com/'>"), (101, "http://fine.com/", ""), (102, "http://second.com/", "<a href='http://linker3.com/'>")]
    got = {r.page_id: r for r in url_rules.judge(spark.createDataFrame(pages, PAGES), [("block", "net/")]).collect()}
    assert all(got[1 + i].verdict == "block" and got[1 + i].distrust_share == pytest.approx(1) for i in range(30))
    assert got[100].verdict == got[101].verdict == got[102].verdict == "allow" and 0 < got[102].distrust_share < got[100].distrust_share * 2


def plain_pagerank(links, n, teleport, damping=0.85, rounds=400):
    """links: weight of i to j; what hosts without links hold goes to the teleport vector."""
    out = links.sum(axis=1)
    step = np.divide(links, out[:, None], where=out[:, None] > 0, out=np.zeros_like(links))
    v = teleport / teleport.sum()
    r = v.copy()
    for _ in range(rounds):
        r = (1 - damping) * v + damping * (r @ step + r[out == 0].sum() * v)
    return r


def test_ranks_are_those_of_plain_pagerank_and_decide_both_ways(spark):
    rng = np.random.default_rng(12)
    n = 240
    hosts = [f"h{i}.org" if i % 3 == 0 else f"h{i}.net" if i % 10 == 1 else f"h{i}.com" for i in range(n)]
    links = np.zeros((n, n))
    pages = []
    for i in range(n):
        for k in range(int(rng.integers(1, 3))):
            bad, good = rng.random() < 0.3, rng.random() < 0.3
            to = {int(x) for x in rng.integers(0, n, int(rng.integers(0, 6)))} if i % 7 else set()  # every seventh host has no links
            to |= {0} if i % 7 and rng.random() < 0.6 else set()  # a hub
            to |= {(i + 1) % n} if i % 5 == 2 else set()  # cycles
            to = {x for x in to if bad == (x % 10 == 1) or x == 0} | ({3 * int(rng.integers(0, n // 3))} if good and i % 7 else set())
            to -= {i}
            for j in to:
                links[i, j] += 1
            shown = "".join(f"<p><a class=x href='https://{hosts[j]}/p'>x</a>" for j in sorted(to))
            hidden = "<!-- <a href='http://h1.net/'> --><script>var a=\"<a href='http://h11.net/'>\"</script><a href=/own>"
            pages.append((len(pages), f"http://{hosts[i]}/{'fr/' if i % 3 == 0 and k == 0 else ''}{k}", hidden + shown * 2))
    got = {r.host: r for r in url_rules.judge(spark.createDataFrame(pages, PAGES), URL_RULES, rounds=60).collect()}
    allowed, blocked = np.zeros(n), np.zeros(n)
    for i, h in enumerate(hosts):
        own = [p[1].split("/", 3)[3] for p in pages if f"//{h}/" in p[1]]
        allowed[i] = np.mean([h.endswith(".org") and x.startswith("fr/") for x in own])
        blocked[i] = h.endswith(".net")
    trust, distrust = plain_pagerank(links, n, allowed), plain_pagerank(links.T, n, blocked)
    for i, h in enumerate(hosts):
        assert got[h].trust == pytest.approx(trust[i], abs=2e-5) and got[h].distrust == pytest.approx(distrust[i], abs=2e-5), h
    # shares: what comes in from seeds over what comes in from all, by solving the linear systems
    for way, seeds, name in ((links, allowed, "trust_share"), (links.T, blocked, "distrust_share")):
        out = way.sum(axis=1)
        step = np.divide(way, out[:, None], where=out[:, None] > 0, out=np.zeros_like(way))
        walks = lambda v: np.linalg.solve(np.eye(n) - 0.85 * step.T, v) - v  # noqa: B023, E731
        mine, every = walks(seeds), walks(np.ones(n))
        want = np.maximum(np.divide(mine, every, where=every > 0, out=np.zeros(n)), seeds)
        assert [got[h].__getattr__(name) for h in hosts] == pytest.approx(want.tolist(), abs=1e-3)
    free = [r for r in got.values() if r.rule is None and not r.host.endswith(".net")]
    blocked_by_rank = [r for r in free if r.verdict == "block"]
    assert len(blocked_by_rank) >= 3 and len([r for r in free if r.distrust_share > 0.05 and r.verdict == "allow"]) >= 5
    assert all((r.verdict == "block") == (r.distrust_share >= 0.5 and r.distrust_share > r.trust_share) for r in free)


def test_clashing_columns_long_pages_and_no_links(spark):
    long = "<p>x</p>" * 200_000 + "<a href='//b.net'>"
    pages = [(1, "http://a.com/", long), (1, "http://a.com/", long), (2, "http://b.net/", None), (None, "http://c.com", "<a title=x"), (3, None, long)]
    df = spark.createDataFrame([(*p, "h", 1.0, "v") for p in pages], PAGES + ", host string, trust double, verdict string")
    got = sorted((r.page_id or 0, r.verdict) for r in url_rules.judge(df, URL_RULES, rounds=3).collect())
    assert got == [(0, "allow"), (1, "block"), (1, "block"), (2, "block"), (3, "allow")]
    alone = url_rules.judge(df.where("page_id = 2"), URL_RULES).collect()
    assert [(r.verdict, r.distrust, r.distrust_share, r.trust) for r in alone] == [("block", 1.0, 1.0, 0.0)]
