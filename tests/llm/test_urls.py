import re

import pytest

from seamline.llm.urls import UrlFilter, filter_urls, host_links, host_ranks, rule_table

SCHEMA = "page_id bigint, url string, html string, host string, rule string, verdict int"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def brute_force(pages, config):
    hosts, rows = {}, []
    for page, url, html in pages:
        host, path = parts(url)
        fit = [
            (len(h + p), h + p, v)
            for v, h, p in config.rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)
        ]
        rule, verdict = max(fit)[1:] if fit else (None, None)
        rows.append([page, host, path, rule, verdict])
        if host:
            hosts.setdefault(host, []).append(verdict)
    edges = {}
    for page, url, html in pages:
        source = parts(url)[0]
        for target in re.findall(r"""(?i)(?:^|[^0-9a-z_])href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)""", html or ""):
            target = re.sub("[A-Z]", lambda m: m[0].lower(), target)
            if source and source != target:
                edges[source, target] = edges.get((source, target), 0) + 1
    names = set(hosts) | {h for e in edges for h in e}
    ranks = {}
    for kind, word in (("trust", "allow"), ("distrust", "block")):
        seed = {h: hosts[h].count(word) / len(hosts[h]) if h in hosts else 0.0 for h in names}
        walk = edges if kind == "trust" else {(b, a): n for (a, b), n in edges.items()}
        out = {}
        for (a, _), n in walk.items():
            out[a] = out.get(a, 0) + n
        walks = []
        for start in (seed, dict.fromkeys(names, 1.0)):
            rank = dict(start)
            for _ in range(config.iterations if edges else 0):
                new = {h: (1 - config.damping) * start[h] + (0 if h in out else config.damping * rank[h]) for h in names}
                for (a, b), n in walk.items():
                    new[b] += config.damping * rank[a] * n / out[a]
                rank = new
            walks.append(rank)
        ranks[kind] = {h: walks[0][h] / walks[1][h] for h in names}
    for row in rows:
        if row[4] is None:
            bad = ranks["distrust"].get(row[1], 0)
            blocked = row[1] and bad > config.threshold and bad > ranks["trust"].get(row[1], 0)
            row[4] = "block" if blocked else "allow"
    return sorted(map(tuple, rows), key=repr), ranks


def link(*targets):
    return "".join(f'<a HREF = "{t}">x</a>' for t in targets)


PAGES = [
    (1, "http://A.net/x", link("//hub.com/", "https://friend.com/a?b")),
    (2, "http://www.a.net/", link("http://a.net/")),
    (3, "http://example.net/en/x?y=/de/", None),
    (4, "http://example.net/EN/x", ""),
    (5, "https://m.example.com/de/", link("http://bad.info/x", "/relative", "page.html")),
    (6, "https://m.example.com/en/", link("http://BAD.info:80/x")),
    (7, "http://x.org/fr/1", link("http://friend.com", "http://friend.com/2", "http://hub.com")),
    (8, "http://notorg/fr/", None),
    (9, "http://friend.com#f", link("http://hub.com", "http://a.net/y", "ftp://a.net/z")),
    (10, "http://hub.com?q", link(*[f"http://a.net/{i}" for i in range(9)])),
    (11, "http://farm.com", link(*[f"http://a.net/{i}" for i in range(9)])),
    (12, None, link("http://a.net")),
    (13, "no scheme", None),
    (14, "http://", None),
    (15, "http:///path", None),
    (None, "http://x.net", None),
    (None, "http://x.net", None),
    (16, "http://x.net/p/q", None),
    *[(20 + i, "http://z.net" + "/a" * i, None) for i in range(4)],
    (17, "://Ünï.ORG/fr/ü", None),
    (18, "a://b://c.net/", None),
]


@pytest.mark.parametrize("threshold", [0.05, 0.5])
def test_equals_brute_force(spark, threshold):
    config = UrlFilter(threshold=threshold)
    pages = spark.createDataFrame([(*p, "h", "r", 1) for p in PAGES], SCHEMA)
    expected, ranks = brute_force(PAGES, config)
    found = filter_urls(pages, config=config)
    assert found.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted(map(tuple, found.collect()), key=repr) == expected
    assert {v for *_, r, v in expected if r is None} == {"allow", "block"}
    rows = [(h, t, ranks["distrust"][h]) for h, t in ranks["trust"].items()]
    seeds = spark.createDataFrame([(h, 1.0 if h == "x.org" else 0.0, 0.0) for h, *_ in rows], "host string, trust double, distrust double")
    walked = {r["host"]: r["trust"] for r in host_ranks(seeds, host_links(pages), config).collect()}
    assert min(walked["friend.com"], walked["hub.com"], walked["a.net"]) > walked["farm.com"] == 0


def test_links_neither_save_a_bad_host_nor_condemn_a_good_one(spark):
    """Hosts with 60 % blocked pages and 0, 1, 2 or 10 linkers are blocked, those who link there by their share."""
    config = UrlFilter(rules=(("block", "com", "/bad/"), ("allow", "org", "/")))
    pages = []
    for linkers in (0, 1, 2, 10):
        spam = f"http://spam{linkers}.com"
        pages += [(f"{spam}/bad/{i}", None) for i in range(6)] + [(f"{spam}/{i}", None) for i in range(4)]
        for i in range(linkers):
            pages.append((f"http://only{linkers}x{i}.info/", link(spam)))
            pages.append((f"http://mixed{linkers}x{i}.info/", link(spam, *[f"http://good{j}.org/" for j in range(9)])))
    pages += [(f"http://good{j}.org/", link("http://blog.info/")) for j in range(9)] + [("http://blog.info/", None)]
    # A page of its own counts as one seed; two blocked hosts that nobody else links to outweigh it.
    pages += [(f"http://pit{i}.com/bad/", None) for i in range(3)]
    pages += [("http://farm.info/", link("http://pit0.com", "http://pit1.com")), ("http://one.info/", link("http://pit2.com"))]
    rows = [(i, *p) for i, p in enumerate(pages)]
    expected, _ = brute_force(rows, config)
    found = filter_urls(spark.createDataFrame([(*r, "h", "r", 1) for r in rows], SCHEMA), config=config).collect()
    assert sorted(map(tuple, found), key=repr) == expected
    blocked = {r["host"] for r in found if r["rule"] is None and r["verdict"] == "block"}
    assert blocked == {"spam0.com", "spam1.com", "spam2.com", "spam10.com", "farm.info"}


def test_long_rule_lists_and_ties(spark):
    rules = rule_table(spark, UrlFilter().rules + tuple(("block", f"d{i}.com", f"/p{i}/") for i in range(2000)) + (("allow", None, "/"),))
    pages = spark.createDataFrame([(1, "http://www.d7.com/p7/x", None, "h", "r", 1), (2, "http://d7.com/p8/", None, "h", "r", 1)], SCHEMA)
    found = {r["page_id"]: (r["rule"], r["verdict"]) for r in filter_urls(pages, rules).collect()}
    assert found == {1: ("d7.com/p7/", "block"), 2: (None, "allow")}


def test_empty_table(spark):
    assert filter_urls(spark.createDataFrame([], SCHEMA)).collect() == []
