"""Robots decisions: the trie against regular expressions, and hosts of many rules and addresses."""

import random
import re

import pytest

from sitelens.operators import robots
from sitelens.operators.robots import robots_allowed, robots_rules
from sitelens.operators.rule_trie import RuleTrie, decoded

RNG = random.Random(4)


def expected(rules, target):
    def hit(pattern, text):
        end = pattern.endswith("$")
        return re.match("^" + ".*".join(map(re.escape, pattern.removesuffix("$").split("*"))) + (r"\Z" if end else ""), text, re.DOTALL)

    found = [(RuleTrie.length(p), a) for a, p in rules if hit(p, target) or hit("*".join(map(decoded, p.split("*"))), decoded(target))]
    return max(found, default=(-1, True))[1]


def test_trie_against_regular_expressions():
    pieces = ["/", "a", "b", "/a", "/a/b", "ab", "*", "*", "$", "?x=", ".php", "%20", " ", "%zz", "+", "é", "%C3%A9", "("]
    for _ in range(3_000):
        rules = [(RNG.random() < 0.5, "/" + "".join(RNG.choices(pieces, k=RNG.randint(0, 4)))) for _ in range(RNG.randint(0, 6))]
        trie = RuleTrie(rules)
        for _ in range(6):
            target = "/" + "".join(RNG.choices(pieces, k=RNG.randint(0, 6)))
            assert trie.allows(target) == expected(rules, target), (rules, target)


@pytest.mark.parametrize("part", [50_000, 300])
def test_one_row_for_each_address(spark, monkeypatch, part):
    """A host with very many rules and addresses: every address comes out once, in parts, with its other columns."""
    monkeypatch.setattr(robots, "PART_URLS", part)
    patterns = [f"/dir{i}/*x{i % 7}" if i % 3 else f"/dir{i}/" for i in range(2_000)]
    body = "User-agent: *\n" + "\n".join(f"{'Allow' if i % 5 == 0 else 'Disallow'}: {p}" for i, p in enumerate(patterns))
    rules = robots_rules(spark.createDataFrame([("big.example", body), ("small.example", "User-agent: bot\nDisallow: /no")], "host string, body string"))
    urls = [("big.example", "bot", f"https://big.example/dir{i % 2_500}/{'x' + str(i % 7)}", i) for i in range(4_000)]
    urls += [("small.example", "bot", "https://small.example/no", -1), ("small.example", "other", "https://small.example/no", -2), ("none.example", "bot", "https://none.example/", -3), (None, "bot", "x", -4), ("big.example", None, None, -5)]
    urls += urls[:50]
    found = robots_allowed(spark.createDataFrame(urls, "host string, user_agent string, url string, n int").repartition(7), rules).collect()
    assert sorted(r.n for r in found) == sorted(n for *_, n in urls)
    held = [(i % 5 == 0, p) for i, p in enumerate(patterns)]
    near = {i: [held[i]] if i < 2_000 else [] for i in range(2_500)}
    for r in found:
        want = expected(near[r.n % 2_500], r.url.removeprefix("https://big.example")) if r.n >= 0 else {-1: False}.get(r.n, True)
        assert r.allowed == want, r
