"""A trie of many rules of one host: against plain prefixes, and its size and speed."""

import pickle
import random
import time

from tidewright.llm import url_filter


def test_many_rules_of_one_host():
    r = random.Random(1)
    rules = [(r.choice(["allow", "block"]), "a.example", f"/x/{'ab' * r.randrange(4)}{i % 977}") for i in range(8000)]
    began = time.time()
    trie = url_filter.build_trie(rules)
    assert time.time() - began < 1 and len(pickle.dumps(trie)) <= url_filter.trie_bytes(rules)
    last = {p: (f"a.example{p}", v) for v, _, p in rules}
    paths = [f"/x/{'ab' * r.randrange(5)}{r.randrange(10**4)}/t" for _ in range(3000)]
    began = time.time()
    got = [url_filter.longest_match(trie, "www.a.example", p) for p in paths]
    assert time.time() - began < 1
    for path, found in zip(paths, got):
        fit = [p for p in last if path.startswith(p)]
        assert found == (last[max(fit, key=len)] if fit else None)


def test_rules_too_large_to_send_are_joined(spark, monkeypatch):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(["https://a.b.org/x", "http://b.org/es/1", "x", None])], "page_id long, url string")
    rules = [("block", "org", "/"), ("allow", "b.org", "/es/")]
    want = sorted(map(tuple, url_filter.judge_urls(pages, rules).collect()))
    monkeypatch.setattr(url_filter, "MAX_BROADCAST_BYTES", 10)
    joined = url_filter.judge_urls(pages, rules)
    assert sorted(map(tuple, joined.collect())) == want
    assert "MapInArrow" not in joined._jdf.queryExecution().optimizedPlan().toString()
