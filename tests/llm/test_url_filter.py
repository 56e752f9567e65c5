"""URL rules and list against a plain version."""

from wavepanel.llm import url_filter as U


def plain_host(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    end = min((rest.index(c) for c in "?#" if c in rest), default=len(rest))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), rest[:end]


def plain(url, listed):
    host, path = plain_host(url)
    fits = [(h + p, v) for v, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, *max(fits, key=lambda f: len(f[0]))
    return host, path, None, "block" if listed else "allow"


URLS = [
    "http://a.net/x", "http://NET/", "http://net", "http://net?x=/", "http://planet/", "https://example.net/en/1", "https://x.example.net/en/", "https://x.example.net/en",
    "http://m.example.com/de/5#a", "http://example.com/DE/5", "http://b.org/fr/?q=1", "http://org/fr/", "http://b.org/fr", "nothing", "", None, "x://", "://h/p", "a://b://c.net/d",
    "http://ÄÖ.COM/é?x#y", "http://h.com\n/x", "http://h.com/" + "p" * 50_000,
]


def test_rules_and_list(spark):
    listed = ["h.com/bad", "spam.org/fr/x", "spam.com/?a=1", "q.com"]
    more = ["http://www.h.com/bad/?utm_source=a#x", "https://h.com/bad?ref=2", "http://h.com/bad?x=1", "http://spam.org/fr/x", "http://SPAM.com/?a=1", "http://q.com/", "ftp://q.com?fbclid=1", "http://q.com/a"]
    on_list = {more[0], more[1], more[3], more[5], more[6]}
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate([*URLS, *more, *URLS[:3]])], "page_id long, url string, host string")
    names = spark.createDataFrame([(x,) for x in [*listed, "h.com/bad", None]], "canon string")
    out = U.url_filter(pages, names).collect()
    assert len(out) == len(URLS) + len(more) + 3
    for r in out:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == plain(r["url"], r["url"] in on_list), r["url"]
        assert r["listed"] == (r["url"] in on_list) or r["url"] == more[4]
        assert r["maybe"] or not r["listed"]


def test_full_filter_still_decides_by_the_list(spark):
    """One block for hundreds of URLs passes nearly everything; the join removes what isn't listed."""
    pages = spark.createDataFrame([(i, f"http://h.com/{i}") for i in range(600)], "page_id long, url string")
    names = spark.createDataFrame([(f"h.com/{i}",) for i in range(0, 600, 2)], "canon string")
    out = U.url_filter(pages, names, most_blocks=1).collect()
    assert sum(r["maybe"] for r in out) > 500 and all(r["listed"] == (r["page_id"] % 2 == 0) for r in out)
    out = U.url_filter(pages, names).collect()
    assert sum(r["maybe"] for r in out) < 350 and all(r["listed"] == (r["page_id"] % 2 == 0) for r in out)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "canon string")
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert U.url_filter(pages, none).first()["verdict"] == "allow"
    assert U.url_filter(pages.limit(0), none).count() == 0
