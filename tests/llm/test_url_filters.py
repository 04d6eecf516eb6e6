import random

from daywatch.llm import url_filters
from tests.llm.brute import judge_url

RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
    ("net", "/fr/", "block"), ("a.example.com", "/", "block"), ("example.com", "/en/deep/", "allow"), ("example.com", "", "allow"),
    ("example.com", "/en/", "allow"), (None, "/x", "block"), ("x.net", None, "block"), ("MIXED.net", "/", "block"),
]
SCHEMA = "page_id long, url string, host string, rule int"


def urls():
    rng = random.Random(3)
    hosts = ["com", "example.com", "www.example.com", "a.example.com", "b.a.example.com", "myexample.com", "x.net", "net", "org", "", "Example.COM", "example.com.", "com.example", "mixed.net", "m.Mixed.net"]
    paths = ["", "/", "/en", "/en/", "/en/deep", "/en/deep/x", "/fr/a", "/es/", "/EN/", "?q=/en/", "#/en/", "/en/?a://b", "/en//"]
    out = [rng.choice(["http", "https", ""]) + "://" + rng.choice(hosts) + rng.choice(paths) for _ in range(400)]
    return out + [None, "", "no scheme", "mailto:a@b.com", "http://", "http://x.net/" + "y" * 30_000, "a\nhttp://net/fr/\n"] + out[:5]


def test_against_brute_force(spark):
    pages = [(i, u, "clash", 1) for i, u in enumerate(urls())] + [(None, "http://x.net/fr/", "", 2), (None, None, None, None)]
    got = url_filters.judge_urls(spark.createDataFrame(pages, SCHEMA), spark.createDataFrame(RULES, "host string, path string, verdict string"))
    deduped = {}
    for h, p, v in RULES:
        if h is not None and p is not None:
            key = (h.lower(), p)
            deduped[key] = "block" if "block" in (v, deduped.get(key)) else v
    rules = [(*k, v) for k, v in deduped.items()]
    wanted = [(i, *judge_url(u, rules)) for i, u, *_ in pages]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(wanted, key=repr)


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.com/", "", 0)], SCHEMA)
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    row = url_filters.judge_urls(pages, rules.limit(0), default="block").first()
    assert tuple(row) == (1, "a.com", "/", None, "block")
    assert url_filters.judge_urls(pages.limit(0), rules).count() == 0


def test_allowed_keeps_columns(spark):
    pages = spark.createDataFrame([(i, u, "h", i) for i, u in enumerate(urls())], SCHEMA)
    rules = spark.createDataFrame(RULES[:5], "host string, path string, verdict string")
    got = url_filters.allowed(pages, rules)
    assert got.columns == pages.columns
    wanted = [i for i, u in enumerate(urls()) if judge_url(u, RULES[:5])[3] != "block"]
    assert sorted(r["page_id"] for r in got.collect()) == wanted


def test_no_python_in_the_plan(spark):
    pages = spark.createDataFrame([(1, "http://a.com/", "", 0)], SCHEMA).coalesce(1)
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    plan = url_filters.judge_urls(pages, rules)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
