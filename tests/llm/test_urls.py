from creditspark.llm import urls

RULES = (("allow", "com", "/"), ("block", "a.com", "/en/"), ("block", "net", "/es/"))


def verdicts(spark, links, **more):
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(links)], "n long, url string, verdict string")
    return {r.n: (r.host, r.path, r.rule, r.verdict) for r in urls.url_verdicts(df, RULES, **more).collect()}


def test_rules_and_vocabulary(spark):
    links = [
        None, "", "no scheme/xxx", "http://B.COM/x", "http://b.a.com/en/1", "http://xa.com/en/1", "https://q.net/es/", "https://net/es",
        "http://x.org/xxx", "http://x.org/xxxl", "http://x.org/sex", "http://x.org/sex-sex", "http://x.org/SEX/poker", "u://v://w/p?q#r",
        "http://b.com?x", "http://x.org/" + "a" * 50_000 + "/porn",
    ]
    got = verdicts(spark, links)
    assert got[0] == got[1] == ("", "", None, "allow")
    assert got[2] == ("", "", None, "block")
    assert got[3] == ("b.com", "/x", "com/", "allow")
    assert got[4] == ("b.a.com", "/en/1", "a.com/en/", "block")
    assert got[5][2:] == ("com/", "allow")
    assert got[6][2:] == ("net/es/", "block") and got[7][2:] == (None, "allow")
    assert [got[i][3] for i in (8, 9, 10, 11, 12)] == ["block", "allow", "allow", "allow", "block"]
    assert got[13][:2] == ("v:", "//w/p")
    assert got[14] == ("b.com", "", None, "allow")
    assert got[15][3] == "block"


def test_vocabulary_equals_plain_search(spark):
    import random
    import re

    random.seed(3)
    links = ["http://h.org/" + "".join(random.choice(["sex", "xxx", "-", "a", "poker", "/", "1", "loan"]) for _ in range(6)) for _ in range(400)]
    got = verdicts(spark, links)
    has = lambda t, u: re.search(rf"(^|[^a-z0-9]){t}($|[^a-z0-9])", u)
    for i, u in enumerate(links):
        bad = any(has(t, u) for t in urls.STRICT) or sum(bool(has(t, u)) for t in urls.SOFT) >= 2
        assert got[i][3] == ("block" if bad else "allow"), u


def test_empty_table(spark):
    out = urls.url_verdicts(spark.createDataFrame([], "page_id long, url string"), RULES)
    assert out.count() == 0 and {"host", "path", "rule", "verdict"} <= set(out.columns)
