from wardstone.llm.urls import RULES, RuleIndex, judge_urls, mine_rules, url_tokens


def _host_path(u):
    if u is None or "://" not in u:
        return "", ""
    r = u.split("://", 1)[1]
    n = min([r.find(c) for c in "/?#" if c in r], default=len(r))
    host, t = r[:n], r[n:]
    p = t[: min([t.find(c) for c in "?#" if c in t], default=len(t))]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), p


def _rule(h, p):
    fits = [(len(r), r, v) for v, r in RULES for name, _, rest in [r.partition("/")] if (h == name or h.endswith("." + name)) and p.startswith("/" + rest)]
    return max(fits)[1:] if fits else (None, None)


URLS = [None, "", "no scheme", "http://", "HTTP://A.ORG/x", "http://example.org/es/1", "http://sub.example.org/en/12?x#y", "http://example.org/en/2", "https://notorg/x", "http://x.com/fr/", "http://x.com/fr", "http://com/de/9", "ftp://x.net#a/b", "http://É.org/p?q=/de/", "http://xorg/", "http://a.org", "http://a.org?x/", "x://y://z.org/", "http://" + "a" * 100_000 + ".org/"]


def test_hosts_rules_and_verdicts(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(0, None), (None, "http://a.org/")]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'q' AS host", "'w' AS verdict")
    got = judge_urls(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id is not None:
            h, p = _host_path(URLS[r.page_id])
            rule, verdict = _rule(h, p)
            assert (r.host, r.path, r.rule) == (h, p, rule), URLS[r.page_id]
            assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")


def test_mined_rules_generalise(spark):
    urls = [(f"http://h{i % 7}.example.{t}/{l}/{i}", "block" if l == "xx" else "allow") for i in range(60) for t in ("com", "net") for l in ("xx", "yy")]
    rules = mine_rules(spark.createDataFrame(urls, "url string, verdict string"))
    assert {"tokens": frozenset({"path:xx"}), "verdict": "block", "confidence": 1.0, "support": 0.5} in rules
    assert not any(a["verdict"] == b["verdict"] and a["tokens"] < b["tokens"] and a["confidence"] >= b["confidence"] for a in rules for b in rules)
    assert RuleIndex(rules).best(url_tokens("http://new.site/xx/3"))["verdict"] == "block" and RuleIndex(rules).best(["none"]) is None
    df = spark.createDataFrame([(1, "http://a.test/xx/1"), (2, "http://a.test/yy/1"), (3, "http://a.test/zz")], "page_id long, url string")
    labels = spark.createDataFrame(urls, "url string, verdict string")
    assert {r.page_id: r.verdict for r in judge_urls(df, labels=labels).collect()} == {1: "block", 2: "allow", 3: "allow"}


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    assert judge_urls(df).count() == 0 and mine_rules(spark.createDataFrame([], "url string, verdict string")) == []
