import math

import pytest
from pyspark.sql import functions as F

from lagweave.llm import url_filter


def beta_tail(a, b, limit):
    """P(share > limit) by a fine sum over the angle."""
    cells = 400_000
    total = over = 0.0
    top = (2 * a - 1) * math.log(math.sqrt(a / (a + b))) + (2 * b - 1) * math.log(math.sqrt(b / (a + b)))
    edge = math.asin(math.sqrt(limit))
    for i in range(cells):
        t = (i + 0.5) * math.pi / 2 / cells
        w = math.exp((2 * a - 1) * math.log(math.sin(t)) + (2 * b - 1) * math.log(math.cos(t)) - top)
        total += w
        over += w * (t > edge)
    return over / total


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    return host, path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]


def fits(host, path, rule):
    at, _, rest = rule.partition("/")
    return (host == at or host.endswith("." + at)) and path.startswith("/" + rest)


def brute(pages, outcomes, rules):
    known = {}
    for page, bad in outcomes:
        if page is not None and bad is not None:
            known[page] = max(known.get(page, 0), int(bad))
    hosts, domains, suffixes = {}, {}, {}
    for page, url in pages:
        host = parts(url)[0]
        n, k = hosts.get(host, (0, 0))
        hosts[host] = (n + (page in known), k + known.get(page, 0))
    domain_of, suffix_of = {}, {}
    for host, (n, k) in hosts.items():
        name = host.rsplit("@")[-1].split(":")[0]
        labels = name.split(".")
        width = 2 if ".".join(labels[-2:]) in url_filter.SUFFIXES else 1
        digits = name.replace(".", "").isdigit()
        domain_of[host] = name if digits else ".".join(labels[-width - 1 :])
        suffix_of[domain_of[host]] = "" if digits else ".".join(labels[-width:])
        old = domains.get(domain_of[host], (0, 0))
        domains[domain_of[host]] = (old[0] + n, old[1] + k)
    for domain, (n, k) in domains.items():
        old = suffixes.get(suffix_of[domain], (0, 0))
        suffixes[suffix_of[domain]] = (old[0] + n, old[1] + k)

    def strength(level, mean):
        more = sum((k - n * mean[x]) ** 2 - n * mean[x] * (1 - mean[x]) for x, (n, k) in level.items())
        most = sum(n * (n - 1) * mean[x] * (1 - mean[x]) for x, (n, k) in level.items())
        within = more / most if most else 0.001
        return 1 / min(max(within, 0.001), 0.5) - 1

    total, bad = sum(n for n, _ in hosts.values()), sum(k for _, k in hosts.values())
    mean = {x: (bad + 0.5) / (total + 1) for x in suffixes}
    m = strength(suffixes, mean)
    mean = {x: (m * mean[x] + k) / (m + n) for x, (n, k) in suffixes.items()}
    mean = {x: mean[suffix_of[x]] for x in domains}
    m = strength(domains, mean)
    mean = {x: (m * mean[x] + k) / (m + n) for x, (n, k) in domains.items()}
    mean = {x: mean[domain_of[x]] for x in hosts}
    m = strength(hosts, mean)
    chance = {x: beta_tail(max(m * mean[x] + k, 0.5), max(m * (1 - mean[x]) + n - k, 0.5), 0.5) for x, (n, k) in hosts.items()}
    out = []
    for page, url in pages:
        host, path = parts(url)
        own = sorted([(v, r) for v, r in rules if fits(host, path, r)], key=lambda x: -len(x[1]))
        verdict, rule = own[0] if own else ("block" if chance[host] >= 0.9 else "allow", None)
        out.append((page, host, path, rule, verdict, *hosts[host]))
    return out, chance


@pytest.mark.parametrize("a, b", [(0.5, 0.5), (0.5, 40.0), (3.0, 2.0), (700.0, 650.0)])
def test_tail_is_the_beta_integral(spark, a, b):
    got = spark.range(1).select(url_filter.tail(F.lit(a), F.lit(b)).alias("p")).first()["p"]
    assert got == pytest.approx(beta_tail(a, b, 0.5), abs=2e-5)
    assert spark.range(1).select(url_filter.tail(F.lit(2e9), F.lit(1e9)).alias("p")).first()["p"] == pytest.approx(1.0)


def test_rules_priors_and_odd_urls_against_plain_python(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "SHARE", 5)  # some hosts and domains count as hot
    pages, outcomes = [], []
    hosts = ["a.good.com", "b.good.com", "WWW.Example.com", "example.com", "x.bad.co.uk", "y.bad.co.uk", "z.bad.co.uk", "10.0.0.1:80", "u@one.net", "bücher.net"]
    for i in range(300):
        host = hosts[(i * i) % 7] if i % 3 else hosts[i % len(hosts)]
        pages.append((i, f"http://{host}/{['en', 'fr', 'es', 'x'][i % 4]}/{i}{['', '?q=/es/', '#a/b'][i % 3]}"))
        if i % 2:
            outcomes.append((i, "bad." in host or i % 11 == 0))
    pages += [(900, None), (901, "no scheme.com/en/"), (902, "http://"), (903, "x://com"), (904, "x://com/"), (905, "x://com?/"), (906, "a://b://net/fr/"),
              (907, "http://NET/fr/x"), (908, "http://xnet/fr/"), (909, "http://a.net/fr"), (None, "http://a.good.com/"), (3, "http://c.bad.co.uk/es/")]
    outcomes += [(3, True), (3, False), (5, None), (None, True), (7777, True)]
    expected, chance = brute(pages, outcomes, url_filter.RULES)
    frame = spark.createDataFrame(pages, "page_id long, url string").withColumn("host", F.lit("clash")).repartition(7)
    got = url_filter.judge(frame, spark.createDataFrame(outcomes, "page_id long, bad boolean"), url_filter.RULES).collect()
    key = lambda r: tuple((x is None, x or 0) if i in (0, 3) else x for i, x in enumerate(r))
    rows = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"], r["labelled"], r["bad"]) for r in got]
    assert sorted(map(repr, rows)) == sorted(map(repr, expected))
    assert key is not None and {r["verdict"] for r in got if r["rule"] is None} == {"allow", "block"}
    for r in got:
        assert r["bad_probability"] == pytest.approx(chance[r["host"]], abs=3e-4)


def test_longest_rule_wins_and_empty_tables(spark):
    rules = (("allow", "a.com/"), ("block", "a.com/x/"), ("allow", "b.a.com/x/"), ("block", "a.com/xyzwv/"))
    urls = ["http://a.com/", "http://a.com/x/1", "http://c.b.a.com/x/", "http://b.a.com/xyzwv/", "http://aa.com/"]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    none = spark.createDataFrame([], "page_id long, bad boolean")
    got = {r["page_id"]: (r["verdict"], r["rule"], r["bad_probability"]) for r in url_filter.judge(frame, none, rules).collect()}
    assert [got[i][:2] for i in range(5)] == [
        ("allow", "a.com/"), ("block", "a.com/x/"), ("allow", "b.a.com/x/"), ("block", "a.com/xyzwv/"), ("allow", None)]
    assert got[0][2] == pytest.approx(0.5)  # nothing is known
    assert [r["rule"] for r in url_filter.judge(frame, none).collect()] == [None] * 5
    assert url_filter.judge(frame.limit(0), none, rules).collect() == []


def test_main_path_has_no_python(spark, small):
    import __spark_entry__

    plan = __spark_entry__.queries()["op11_url_filter"](spark, small)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))
