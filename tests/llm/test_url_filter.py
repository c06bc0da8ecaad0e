import random

import numpy as np
import pytest

from promolift.llm import url_filter as U
from tests.llm.conftest import rows_of


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), tail[:end]


def brute(url, listed):
    host, path = brute_parts(url)
    fit = [r for r in U.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: (len(r.text), len(r.host)), default=None)
    bad = any(host == h or host.endswith("." + h) for h in listed) and host != ""
    return host, path, best.text if best else None, best.action if best else ("block" if bad else "allow")


URLS = [None, "", "no scheme", "://", "http://", "http:///x", "http://COM/", "http://example.com", "http://example.com/en", "http://example.com/en/",
        "https://www.example.com/en/x?q=/fr/", "https://a.www.example.com/en/", "http://badexample.com/en/", "http://net/fr/", "http://x.net/es/1",
        "http://x.net/fr#/es/", "http://ÀB.net/es/", "x://y://z.com/", "http://spam.org/a", "http://a.spam.org", "http://notspam.org/", "http://x.com?/en/",
        "http://x.com\n/a", "http://.com/", "http://a..com/", "ftp://u:p@host.com:80/p", "http://" + "a." * 300 + "net/fr/" + "p" * 5000]


def pages(spark, urls, extra=""):
    return spark.createDataFrame([(i, u, *(["x"] if extra else [])) for i, u in enumerate(urls)], "page_id long, url string" + extra).repartition(3)


@pytest.mark.parametrize("n_bytes", [64 << 20, 8])
def test_verdicts_equal_brute_force(spark, n_bytes):
    rng = random.Random(2)
    urls = URLS + [f"http{rng.choice(['', 's'])}://{rng.choice(['', 'www.', 'm.'])}h{rng.randrange(60)}.{rng.choice(['com', 'net', 'org', 'example.com'])}"
                   f"{rng.choice(['', '/', '/en/', '/es/a', '/fr'])}" for _ in range(400)] + URLS[:5]
    listed = ["spam.org"] + [f"h{i}.org" for i in range(0, 60, 2)] + ["absent.example"]
    hosts = spark.createDataFrame([(h,) for h in [*listed, None]], "host string")
    got = {r["page_id"]: r for r in rows_of(U.filter_urls(pages(spark, urls, ", _c string"), block_hosts=hosts, max_filter_bytes=n_bytes))}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == brute(u, listed), u
        assert got[i]["_c"] == "x"


def test_cascade_is_exact_over_its_universe(spark):
    rng = np.random.default_rng(1)
    one, two = rng.integers(-2**62, 2**62, 5000), rng.integers(-2**62, 2**62, 5000)
    listed = rng.random(5000) < 0.3
    universe = spark.createDataFrame(list(zip(one.tolist(), two.tolist(), listed.tolist(), strict=True)), "one long, two long, listed boolean")
    levels = U.build_cascade(universe)
    assert len(levels) > 2
    assert (U.member(levels, one, two) == listed).all()


def test_empty_and_no_rules(spark):
    empty = pages(spark, []).where("false")
    assert U.filter_urls(empty, block_hosts=U.spam_hosts(empty)).count() == 0
    got = rows_of(U.filter_urls(pages(spark, ["http://example.com/en/", None]), rules=(), block_hosts=None))
    assert [(r["verdict"], r["rule"]) for r in got] == [("allow", None)] * 2


def test_spam_hosts(spark):
    got = {r["host"] for r in rows_of(U.spam_hosts(pages(spark, ["http://www.cheap-pills.com/x", "http://casinos.org", "http://m.ads.net", "http://loads.net", None])))}
    assert got == {"www.cheap-pills.com", "m.ads.net"}
