import numpy as np
import pytest

from txsentinel.llm import url_filter as uf
from txsentinel.llm.queries import URL_RULES

URLS = ["https://WWW.Example.com/en/x?q#f", "http://example.com/en/", "http://a.example.com/en", "http://com/x",
        "ftp://notexample.com/en/1", "http://x.net/es/1", "http://x.net/de/1", "https://shop.com", None, "", "no url",
        "http://x.org/://net/fr/", "a://b.net/fr/?x", "http://www.example.com./en/", "http:///en/", "http://é.net/fr/é"]


def brute(url, rules):
    host, path = uf.split_url(url)
    best = None
    for h, p, v in rules:
        if host and (host == h or host.endswith("." + h)) and path.startswith(p):
            if best is None or (len((h + p).encode()), len(h)) > (len((best[0] + best[1]).encode()), len(best[0])):
                best = (h, p, v)
    return (best[0] + best[1], best[2]) if best else (None, "allow")


@pytest.mark.parametrize("max_rules", [1, 2, 100])
def test_matches_brute_force(spark, max_rules):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS + URLS[:3])],
                                  "page_id long, url string, rule string")
    rows = uf.judge_urls(pages, URL_RULES, max_rules=max_rules).orderBy("page_id").collect()
    assert [(r["rule"], r["verdict"]) for r in rows] == [brute(u, URL_RULES) for u in URLS + URLS[:3]]
    assert rows[0]["host"] == "www.example.com" and rows[0]["path"] == "/en/x"
    assert (rows[8]["host"], rows[8]["path"]) == ("", "")


def test_colliding_keys_are_confirmed(monkeypatch, tmp_path):
    monkeypatch.setattr(uf, "keys_of", lambda strings: np.array([len(s) % 2 for s in strings], np.uint64))
    path = tmp_path / "rules.bin"
    path.write_bytes(uf.write_array(URL_RULES))
    array = uf.DigestArray(str(path))
    parts = [uf.split_url(u) for u in URLS]
    found = array.probe([h for h, _ in parts], [p for _, p in parts])
    assert [(f[0], f[1]) if f else (None, "allow") for f in found] == [brute(u, URL_RULES) for u in URLS]


def test_no_rules_and_empty_table(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert uf.judge_urls(pages, []).first()["verdict"] == "allow"
    assert uf.judge_urls(pages.where("false"), URL_RULES).count() == 0
