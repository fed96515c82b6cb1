"""Propagation with returns, against the fixed point found by linear algebra."""

from __future__ import annotations

import numpy as np
import pytest

from engramlake.llm import url_filters


def fixed_points(seeds, links):
    """{host: (trust, distrust)}: what stays at hosts without a way on goes back to the seeds."""
    hosts = sorted({h for edge in links for h in edge} | set(seeds))
    at = {h: k for k, h in enumerate(hosts)}
    out = []
    for kind in (0, 1):
        s = np.array([seeds.get(h, (0, 0))[kind] for h in hosts], float)
        ways = np.zeros((len(hosts), len(hosts)))
        for (a, b), n in links.items():
            ways[(at[b], at[a]) if kind == 0 else (at[a], at[b])] += n
        left = ways.sum(0)
        ways = np.where(left > 0, ways / np.maximum(left, 1e-300), s[:, None] / s.sum())
        out.append(np.linalg.solve(np.eye(len(hosts)) - 0.85 * ways, 0.15 * s))
    return {h: (out[0][k], out[1][k]) for h, k in at.items()}


def page(*hosts):
    return "".join(f"<a href='http://{h}/'>x</a>" for h in hosts)


def test_returns_and_long_ways(pages):
    chain = [f"c{k}.com" for k in range(40)]
    rows = [(k, "http://t.org/fr/", page("h.com") if k == 0 else "") for k in range(10)]
    rows += [(100 + k, "http://b.net/x", page("h.com") if k == 0 else "") for k in range(13)]
    rows += [(200, "http://h.com/", page("b.net"))]
    rows += [(300 + k, f"http://{h}/", page(chain[k - 1] if k else "b.net")) for k, h in enumerate(chain)]
    links = {("t.org", "h.com"): 1, ("b.net", "h.com"): 1, ("h.com", "b.net"): 1, ("c0.com", "b.net"): 1}
    small = fixed_points({"t.org": (10, 0), "b.net": (0, 13)}, {k: n for k, n in links.items() if k[0] != "c0.com"})
    assert small["h.com"] == pytest.approx((4.60, 5.00), abs=0.01)  # worked out by hand
    for k in range(1, 40):
        links[chain[k], chain[k - 1]] = 1

    def hosts_of(rows):
        return {r.host: r for r in url_filters.judge_pages(pages(rows)).collect()}

    assert hosts_of([r for r in rows if r[0] < 300])["h.com"].verdict == "block"
    want, got = fixed_points({"t.org": (10, 0), "b.net": (0, 13)}, links), hosts_of(rows)
    for kind in (0, 1):
        name = ("trust", "distrust")[kind]
        gain = (10, 13)[kind] / sum(getattr(r, name) for r in got.values())
        for host, r in got.items():
            assert getattr(r, name) * gain == pytest.approx(want[host][kind], rel=1e-4, abs=1e-12)
    for host, r in got.items():
        trust, distrust = want[host]
        assert r.verdict == ("block" if host == "b.net" or host != "t.org" and distrust > trust else "allow")
    assert got["c39.com"].distrust > 0 and got["c39.com"].verdict == "block"
