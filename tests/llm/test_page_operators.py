"""The operators over pages, and the pipeline."""

from __future__ import annotations

import gzip
import hashlib
import resource
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from engramlake.llm import html_extract, url_filters, warc
from engramlake.llm.html_blocks import blocks
from engramlake.session import scratch_path

from . import brute

URLS = {
    None: ("", "", None),
    "": ("", "", None),
    "mailto:x@example.net": ("", "", None),
    "https://Example.NET/en/x?q=/fr/": ("example.net", "/en/x", "example.net/en/"),
    "http://a.b.example.net/en": ("a.b.example.net", "/en", "net/"),
    "http://badexample.net/en/": ("badexample.net", "/en/", "net/"),
    "http://example.net?x": ("example.net", "", None),
    "x://blog.example.com/de/#/": ("blog.example.com", "/de/", "example.com/de/"),
    "http://example.com/DE/": ("example.com", "/DE/", None),
    "http://org/fr/": ("org", "/fr/", "org/fr/"),
    "http://forg/fr/": ("forg", "/fr/", None),
    "http://a://b/": ("a:", "//b/", None),
}


def test_rules(pages):
    rows = [(k, url, None) for k, url in enumerate(URLS)]
    got = {r.page_id: (r.host, r.path, r.rule) for r in url_filters.judge_pages(pages(rows)).collect()}
    assert got == {k: want for k, want in enumerate(URLS.values())}


def link(*hosts):
    return "".join(f"<a class=x href='https://{h}/p'>t</a> <a href=\"/local\">u</a>" for h in hosts)


def test_propagation(pages):
    """Against plain power iteration on a small graph."""
    rows = [
        (1, "http://good.org/fr/1", link("friend.com", "Friend.com")),
        (2, "http://friend.com/a", link("other.com", "friend.com")),
        (3, "http://farm.com/a", link("bad.net", "spam.example.com")),
        (4, "http://bad.net/x", link("friend.com")),
        (5, "http://spam.example.com/de/", None),
        (6, "http://lone.com/", ""),
        (7, "http://hub.com/", link("farm.com")),
        (7, "http://hub.com/", link("farm.com")),
    ]
    got = {r.page_id: r for r in url_filters.judge_pages(pages(rows)).collect()}
    edges = Counter()
    for _, url, html in rows:
        for h in blocks_links(html):
            if h != url.split("/")[2]:
                edges[url.split("/")[2], h] += 1
    trust, distrust = {"good.org": 1.0}, {"bad.net": 1.0, "spam.example.com": 1.0}

    def rank(seed, ways):
        total = Counter()
        for (a, _), n in ways.items():
            total[a] += n
        r = dict(seed)
        for _ in range(url_filters.ROUNDS):
            new = {h: 0.15 * m for h, m in seed.items()}
            for (a, b), n in ways.items():
                new[b] = new.get(b, 0) + 0.85 * r.get(a, 0) * n / total[a]
            r = new
        return r

    t, d = rank(trust, edges), rank(distrust, {(b, a): n for (a, b), n in edges.items()})
    for r in got.values():
        assert r.trust == pytest.approx(t.get(r.host, 0), abs=1e-5) and r.distrust == pytest.approx(d.get(r.host, 0), abs=1e-5)
    assert {k: r.verdict for k, r in got.items()} == {1: "allow", 2: "allow", 3: "block", 4: "block", 5: "block", 6: "allow", 7: "block"}
    assert url_filters.judge_pages(pages(rows)).count() == len(rows)
    assert url_filters.judge_pages(pages([])).count() == 0


def blocks_links(html):
    import re

    return [h.lower() for h in re.findall(r"https://([^/']+)/", html or "")]


PAYLOADS = [None, "", "short", "x" * 999, "y" * 1000, "é" * 500, "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 30]


def test_archives(pages, spark):
    rows = [(k, f"http://h{k % 3}.com/a b?{k}\r\nX: y" if k % 4 else None, PAYLOADS[k % len(PAYLOADS)]) for k in range(40)]
    rows += [(100, "http://same/", "z" * 2000), (100, "http://same/", "z" * 2000), (99, "http://same/", "z" * 2000), (None, None, "n" * 1200)]
    folder = scratch_path(spark, "test-archives")
    warc.write_archives(pages(rows), folder)
    found = warc.assemble(warc.read_records(spark, folder)).collect()
    top, want = {}, Counter()
    for page, _, html in rows:
        top[html or ""] = max(top.get(html or "", -1), -1 if page is None else page)
    for page, _, html in rows:
        data = (html or "").encode()
        again = len(data) >= 1000 and page is not None and page != top[html]
        want[page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response"] += 1
    got = Counter()
    for r in found:
        page = r.metadata_fields.get("pageId")
        got[None if page is None else int(page), r.payload_bytes, r.payload_digest, r.response.record_type] += r.copies
        assert r.request.http_head.startswith("GET ") and r.request.record_id != r.metadata.record_id
        if r.response.record_type == "response":
            assert hashlib.sha1(r.response.payload).hexdigest() == r.payload_digest == r.response.named_digest
        else:
            assert r.response.payload is None
    assert got == want


def test_parse_many_members_and_broken_files():
    record = b"WARC/1.0\r\nWARC-Type: resource\r\nX-Long: a\r\n b\r\nContent-Length: 4\r\n\r\n\r\n\r\n\r\n\r\n"
    data = gzip.compress(record) + gzip.compress(record)
    assert [(h["x-long"], b) for h, b in warc.parse_records(data)] == [("a b", b"\r\n\r\n")] * 2
    assert list(warc.parse_records(b"")) == []
    with pytest.raises(ValueError):
        list(warc.parse_records(record[:-7]))


def test_blocks():
    page = "<title>T</title><p>a <b>b&amp;c</b><br>d<p>e&nbsp;\n f<script>x='</p>'</script><ul><li>g<li>h</ul><div id='x y' CLASS=ad>i<!-- j --> k<"
    assert [t for t, _, _ in blocks(page)] == ["T", "a b&c", "d", "e f", "g", "h", "i k<"]
    assert blocks(page)[-1][1] == ("div", "@x", "@y", "@ad")
    assert blocks(page)[4][1] == ("ul", "li")
    assert blocks("") == [] and blocks("<" * 50)[0][0] == "<" * 50
    assert blocks("<p " + "a='" * 3000) is not None


def test_lstm_gradients():
    rng = np.random.default_rng(0)
    model = html_extract.BlockLabeller(6, hidden=3)
    x = rng.normal(size=(4, 2, 6)).astype(np.float32)
    mask = np.array([[1, 1], [1, 1], [1, 0], [1, 0]], np.float32)
    y = rng.integers(0, 2, (4, 2)).astype(np.float32)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    _, grads = model.gradients(x, mask, y)
    for name, p in model.p.items():
        for at in list(np.ndindex(p.shape))[:: max(1, p.size // 7)]:
            old = p[at]
            p[at] = old + 1e-3
            up, _ = model.gradients(x, mask, y)
            p[at] = old - 1e-3
            down, _ = model.gradients(x, mask, y)
            p[at] = old
            assert grads[name][at] == pytest.approx((up - down) / 2e-3, abs=2e-3)


NEW_SITES = [
    ("<body><header><h1>Site</h1></header><main><h1>Head</h1><p>One two.</p><aside><p>Side</p></aside><p>Three.</p></main><footer>F</footer>", "Head One two. Three."),
    ("<body><div class=cookie-notice><p>We use cookies</p></div><article><h2>A</h2><ul><li>x</li></ul><div class='ad banner'>Buy</div><form>Mail <button>Go</button></form><p>End</article>", "A x End"),
    ("<body><article><p>Text here.</p></article><section class=comments><div id=comment-1><p>First!</p></div></section>", "Text here."),
]


def test_main_text(spark, pages):
    html = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    rows = [(k, f"u{k}", page) for k, page in enumerate(html)]
    rows += [(1000 + k, None, page) for k, (page, _) in enumerate(NEW_SITES)] + [(2000, "x", None), (2001, "x", ""), (2002, "x", "<nav>only</nav>"), (None, None, "<article>q</article>")]
    got = {r.page_id: r for r in html_extract.extract_main_text(pages(rows)).collect()}
    assert len(got) == len(rows)
    for k, page in enumerate(html):
        found = blocks(page)
        paths = [p for _, p, _ in found]
        assert got[k].text == " ".join(t for t, p, _ in found if html_extract.is_main(p, paths))
    assert [got[1000 + k].text for k in range(3)] == [want for _, want in NEW_SITES]
    assert got[2000].text == got[2001].text == "" and all(r.n_chars == len(r.text) for r in got.values())
    assert html_extract.extract_main_text(pages([])).count() == 0


def test_pipeline_stages(spark):
    """Every stage but the first against plain versions, on its own input."""
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    items = {r.item_id: brute.shingles(r.text) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()}
    rows = docs.collect() + [docs.first()]  # a repeated row
    docs = spark.createDataFrame(rows, docs.schema).select("text", "n_chars", "source", "lang", "doc_id", F.lit(1).alias("g"))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    kept = {r.doc_id: r.text for r in rows}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        if name == "packed":
            assert {r.doc_id for r in out.collect()} == set(kept)
            assert sum(r.length for r in out.collect()) == sum({r.doc_id: r.doc_tokens for r in out.collect()}.values())
            break
        assert tuple(out.columns) == corpus_pipeline.COLUMNS
        left = out.collect()
        if name == "quality":
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
            gone = set(kept) - {r.doc_id for r in left}
            assert sum(labels.get(d) == 1 for d in gone) <= 2 and sum(labels.get(d) == 0 for d in gone) >= 0.8 * sum(q == 0 and d in kept for d, q in labels.items())
            want = {d: t for d, t in kept.items() if d not in gone}
        elif name == "exact_duplicates":
            last = {t: d for d, t in sorted(kept.items())}
            want = {d: t for d, t in kept.items() if last[t] == d}
            assert len(left) == len(want)
        elif name == "near_duplicates":
            classes = brute.similar_classes(list(kept.items()))
            want = {d: t for d, t in kept.items() if classes[d][1] == d}
        else:
            sets = {d: brute.shingles(t) for d, t in kept.items()}
            want = {d: t for d, t in kept.items() if not any(100 * len(i & sets[d]) >= 80 * len(i) for i in items.values() if i)}
        assert {r.doc_id: r.text for r in left} == want, name
        kept, docs = want, spark.createDataFrame(left, out.schema) if left else out




def test_a_long_page_is_labelled_in_bounded_memory():
    page = "<html><body><nav><p>Menu</p></nav><article><table>" + "<tr><td>cell text</td></tr>" * 75_000 + "</table></article><footer><p>End</p></footer></body></html>"
    model = html_extract.BlockLabeller(html_extract.PATH_BITS + html_extract.WORD_BITS + 5)
    parsed = [blocks(page)] + [blocks(f"<article><p>{k}</p></article>") for k in range(31)]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    labels = model.label(parsed)
    assert len(page) > 2 << 20 - 1 and len(labels[0]) == 75_002
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024 < 300
    few = parsed[0][:20]
    x, mask, _ = html_extract.padded([html_extract.vectors(few)], None)
    assert np.allclose(model.scores(x, mask)[:, 0], model.long_scores(few), atol=1e-4)


def test_long_scores_do_not_depend_on_the_cut(monkeypatch):
    page = blocks("<article>" + "".join(f"<p>text {k}</p><div class='ad'>x</div>" for k in range(40)) + "</article>")
    model = html_extract.BlockLabeller(html_extract.PATH_BITS + html_extract.WORD_BITS + 5)
    whole = model.long_scores(page)
    monkeypatch.setattr(html_extract, "CELLS", 7)
    assert np.allclose(whole, model.long_scores(page), atol=1e-4)
