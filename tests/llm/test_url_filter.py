"""URL filter: parts and rules against plain Python, long rule lists by join, held-out accuracy of the regression."""

import random

import pytest
from pyspark.sql import functions as F

from rivermeld.llm import url_filter as uf

URLS = ["http://a.com/x", "https://A.Com", "http://com/", "http://example.com/en/1", "http://sub.example.com/en/1", "http://www.example.com/en/2?q#f",
        "http://m.www.example.com/en/", "http://notexample.com/en/", "http://x.net/es/1", "http://net/fr/", "http://x.net/espana", "http://x.net/fr",
        "http://x.NET/es/?a=b", "ftp://x.org#/es/", "http://x.org?u=http://y.net/es/", "x.net/es/", "", None, "://", "http:///es/", "http://É.com/Ü",
        "http://line\nbreak.com/a\nb?c", "http://user@x.net:80/es/1", "http://" + "a." * 5000 + "com/" + "p/" * 5000, "http://a.com/x"]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    path = rest[:min([rest.index(c) for c in "?#" if c in rest], default=len(rest))]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path, rules):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: (len(r.text), r.verdict == "block", r.text), default=None)


@pytest.fixture(scope="module")
def model(spark):
    return uf.fitted(uf.labelled_urls(spark))


def frame(spark, urls):
    return spark.createDataFrame([(k, u, "h", "p", "j") for k, u in enumerate(urls)], "page_id long, url string, host string, `path` string, judged string")


def test_parts_and_rules(spark, model):
    out, name = uf.judged(frame(spark, URLS), model)
    assert name == "judged_" and out.columns == ["page_id", "url", "host", "path", "judged", name]
    for r in out.collect():
        got = r[name]
        rule = rule_of(*parts(r.url), uf.RULES)
        assert (got.host, got.path) == parts(r.url)
        assert got.rule == (rule.text if rule else None)
        assert got.verdict == (rule.verdict if rule else "block" if got.score > 0.6 else "allow")


def test_long_lists_are_joined_with_the_same_result(spark, model):
    rng = random.Random(3)
    hosts = ["com", "net", "a.com", "b.a.com", "x.net", "org", "w.org"]
    rules = [uf.Rule(rng.choice(["allow", "block"]), rng.choice(hosts), rng.choice(["/", "/e", "/en", "/en/", "/x/y"])) for _ in range(80)]
    rules += [uf.Rule("block", f"site{k}.org", "/") for k in range(300)]
    urls = [f"http://{rng.choice(['', 'q.', 'r.s.'])}{rng.choice(hosts)}{rng.choice(['', '/', '/en/1', '/e', '/x/y/z'])}" for _ in range(300)]
    urls += ["http://www.site7.org/a", None, "http://site301.org/"]
    out, name = uf.judged(frame(spark, urls), model, rules)
    rows = out.collect()
    assert len(rows) == len(urls)
    for r in rows:
        want = rule_of(*parts(r.url), rules)
        assert r[name].rule == (want.text if want else None)
        assert want is None or r[name].verdict == want.verdict


def test_two_fits_are_equal_and_unknown_words_pass(spark, model):
    again = uf.fitted(uf.labelled_urls(spark))
    assert list(model.stages[1].coefficients.toArray()) == list(again.stages[1].coefficients.toArray())
    urls = ["https://blog.quillmarsh.example.org/en/4", "http://m.vortane.example.org/de/1", "https://www.lucky-casino.example.org/en/9", "http://cheapest-pills.example.org/"]
    out, name = uf.judged(frame(spark, urls), model)
    assert [r[name].verdict for r in out.orderBy("page_id").collect()] == ["allow", "allow", "block", "block"]
    assert uf.allowed(frame(spark, urls), model).orderBy("page_id").select("url").collect()[0].url == urls[0]


def test_held_out_accuracy(spark):
    rows = uf.labelled_urls(spark).withColumn("fold", F.pmod(F.xxhash64("url"), F.lit(3)))
    right = total = 0
    for k in range(3):
        out, name = uf.judged(rows.where(F.col("fold") == k), uf.fitted(rows.where(F.col("fold") != k)), rules=())
        right += out.where((F.col(name)["verdict"] == "block") == (F.col("block") == 1)).count()
        total += out.count()
    assert right / total > 0.75


def test_bounds(spark, model):
    with pytest.raises(ValueError):
        uf.fitted(uf.labelled_urls(spark), uf.Fitting(most_rows=5))
    out, name = uf.judged(frame(spark, []), model)
    assert out.count() == 0
