from __future__ import annotations

import re

import pytest

from sondeframe.llm import url_filter as U


def translated(rule: U.Rule) -> re.Pattern:
    part = lambda text, stop: "".join(f"[^{stop}]*" if c == "*" else f"[^{stop}]" if c == "?" else re.escape(c) for c in text)
    return re.compile(r"(?s)(?:^|.*\.)" + part(rule.host.lower(), "\x00") + "\x00" + part(rule.path, "\x00"))


HOSTS = ["", "net", "example.net", "www.example.net", "notexample.net", "example.com", "a.example.com", "b.org", "org", "ads1.example.com", "ads12.example.com"]
PATHS = ["", "/", "/en/", "/en", "/de/x", "/fr/", "/fr/y/z", "/shop/9/cart", "/shop/99/cart/q"]


def test_automaton_against_regular_expressions():
    rules = [*U.RULES, U.Rule("block", "ads?.example.com", "/"), U.Rule("block", "*", "/shop/*/cart"), U.Rule("allow", "a*.com", "/d?/"), *[U.Rule("block", f"long{k}-host-name.example.org", "/path/") for k in range(9)]]
    own = U.Automaton(rules)
    assert own.masks.shape[1] > 1
    urls = [(h, p) for h in [*HOSTS, "long7-host-name.example.org"] for p in [*PATHS, "/path/x"]]
    hit = own.matches([b"." + h.encode() + bytes([U.SEPARATOR]) + p.encode() for h, p in urls])
    patterns = [translated(r) for r in rules]
    for (h, p), row in zip(urls, hit, strict=True):
        assert row.tolist() == [bool(x.match(h + "\x00" + p)) for x in patterns], (h, p)


CASES = [
    ("http://a.Example.NET/en/x?q", "a.example.net", "/en/x", "example.net/en/", "allow"),
    ("https://example.net/EN/", "example.net", "/EN/", "net/", "block"),
    ("http://net", "net", "", None, "allow"),
    ("http://org/fr/", "org", "/fr/", "org/fr/", "allow"),
    ("http://x.example.com/de/#a", "x.example.com", "/de/", "example.com/de/", "block"),
    ("http://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
    ("http://h?x=/net/", "h", "", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("a://b.net:80/c://d", "b.net:80", "/c://d", None, "allow"),
    ("x\ny://Ä.NET/\n?", "Ä.net", "/\n", "net/", "block"),
    ("http://" + "a" * 30_000 + ".net/" + "b" * 30_000, "a" * 30_000 + ".net", "/" + "b" * 30_000, "net/", "block"),
]


def test_contract(spark):
    df = spark.createDataFrame([(k, c[0], "clash", "clash") for k, c in enumerate(CASES)], "page_id long, url string, host string, verdict string")
    found = {r["page_id"]: tuple(r)[1:] for r in U.judge_urls(df).collect()}
    assert found == {k: c[1:] for k, c in enumerate(CASES)}


@pytest.mark.parametrize("rules", [(), (U.Rule("block", "*", ""),)])
def test_other_rules_and_empty_table(spark, rules):
    df = spark.createDataFrame([(1, "http://a/b")], "page_id long, url string")
    assert U.judge_urls(df, rules).first()["verdict"] == ("block" if rules else "allow")
    assert U.judge_urls(df.limit(0), rules).count() == 0
