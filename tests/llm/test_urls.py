import re

from millpond.llm import urls

URLS = [
    None, "", "no scheme", "http://", "http:///p", "HTTP://A.Example.NET/En/x", "https://m.x.example.net/en/1?q=/de/", "https://example.net/en/", "https://example.net/en",
    "http://net/x", "http://net", "http://internet/x", "ftp://example.com/de/1#f", "https://a.example.com/de/", "https://b.org/fr/9", "https://b.org?x/fr/", "http://x://y/z",
    "http://É.org/fr/ü", "http://a.net\n/b\n?c", "https://www.free-casino.example.com/en/2", "https://www.village-library.example.com/en/2", "http://" + "a" * 50_000 + ".net/" + "b" * 50_000,
]


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :]).group()


def rule(host, path):
    fits = [(len(h + p), h + p, kind) for kind, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_parts_and_rules_equal_a_plain_version(spark):
    rows = [(i, u, "h", "v") for i, u in enumerate(URLS)] + [(3, URLS[3], "h", "v"), (None, "http://q.net/", "h", "v")]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string, host string, verdict string")).collect()
    assert len(got) == len(rows)
    want = []
    for i, u, *_ in rows:
        host, path = parts(u)
        want.append((i, host, path, rule(host, path)[0]))
    assert sorted(((r.page_id, r.host, r.path, r.rule) for r in got), key=repr) == sorted(want, key=repr)
    for r in got:
        assert r.verdict == (rule(r.host, r.path)[1] or ("block" if r.score > 0.5 else "allow"))
        assert (r.score is None) == (r.rule is not None)
    by_id = {r.page_id: r.verdict for r in got}
    assert by_id[19] == "block" and by_id[20] == "allow" and by_id[0] == by_id[1] == "allow"
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_fit_tells_unseen_names_apart():
    import numpy as np

    from millpond.llm.ngrams import Distinct

    weights, bias = urls.fit(urls.labelled_urls())
    score = lambda t: weights[Distinct(urls.SIZES, urls.BITS)(f"^{t}$")].sum() + bias
    assert min(score(f"{x}.example.org/en/7") for x in ("casino-palace", "cheap-viagra", "online-casino", "www.slots-club")) > 0
    assert max(score(f"{x}.example.org/en/7") for x in ("thousands", "museum-news", "thither", "the-library")) < 0
    assert np.isfinite(bias)
