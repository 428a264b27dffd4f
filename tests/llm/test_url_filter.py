import numpy as np

from tessera.llm import url_filter

URLS = [
    "http://example.com/en/7", "https://a.b.example.com/en/71?x=1", "https://EXAMPLE.com/en/8", "http://notexample.com/en/7", "http://com/en/", "http://net/de/", "https://x.example.net/de/8", "https://x.example.net/de/9",
    "http://y.org/es/#f", "http://y.org", "http://y.org?q=/es/", "no scheme", "", None, "://", "a://b://c/d", "http://internet/de/", "https://spam-farm.example.org/fr/1", "https://spam-farm.example.org/fr/1", "http://" + "h" * 20_000 + ".com/en/" + "p" * 50_000,
    "http://ÉX.com/en/Ü", "mailto:a://x.org/es/?", "http://x.org/ES/", "http://x\ny.org/es/\nz",
]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    n = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[n:]
    m = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:n]), tail[:m]


def rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, default=(0, None, None))[1:]


def test_parts_rules_and_verdicts(spark):
    pages = spark.createDataFrame([(i, u, "kept") for i, u in enumerate(URLS)], "page_id long, url string, node string").repartition(3)
    rows = {r.page_id: r for r in url_filter.judge(pages).collect()}
    for i, url in enumerate(URLS):
        host, path = parts(url)
        name, verdict = rule(host, path)
        assert (rows[i].host, rows[i].path, rows[i].rule, rows[i].node) == (host, path, name, "kept"), url
        own = url_filter.default_model().probabilities([host.encode()], [path.encode()])[0] if host or path else 0.0
        assert np.isclose(rows[i].score, own) and rows[i].verdict == (verdict or ("block" if own >= 0.5 else "allow"))
    assert rows[17].verdict == "block" and rows[11].verdict == "allow"
    assert url_filter.query(pages).columns == ["page_id", "host", "path", "rule", "verdict", "score"]
    assert url_filter.query(pages.limit(0)).count() == 0


def test_model_learns_its_table_and_holds_out():
    held = url_filter.LABELLED[::5]
    model = url_filter.train([x for x in url_filter.LABELLED if x not in held])
    split = lambda rows: [url_filter.split_url(u) for u, _ in rows]
    score = lambda rows, m: np.mean([(p >= 0.5) == y for p, (_, y) in zip(m.probabilities(*map(list, zip(*split(rows)))), rows)])
    assert score(url_filter.LABELLED, url_filter.train()) == 1
    assert score(held, model) >= 0.7


def test_features_equal_a_plain_count():
    hosts, joint = [b"abc", b"", b"xabcx"], url_filter.features([b"abc", b"", b"xabcx"])
    for i, h in enumerate(hosts):
        alone = url_filter.features([h])[0]
        assert sorted(joint[0][joint[1] == i].tolist()) == sorted(alone.tolist())
        n = len(h) + 2
        assert len(alone) == sum(max(0, n - k + 1) for k in url_filter.SIZES)
