from urllib.parse import urlsplit

import duckdb
import pandas as pd
import pytest

from foldwise.llm import url_templates
from foldwise.llm.registry import RULES

URLS = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.NET/en/1?x=/de/", "https://a.example.net/en", "https://net/", "http://net",
    "https://a.net?x", "http://example.com/de/", "http://example.com/DE/", "http://xexample.com/de/1", "ftp://b.org/fr/2#f",
    "http://b.org/fr", "a://b://c/d", "http://h/é/ü?q", "http://h//double//", "http://h/*/1", "line\nbreak://host/p\nq", "http://user@Host:80/p",
]


def plain(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
    host, tail = rest[:cut], rest[cut:]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = tail.split("?")[0].split("#")[0]
    fits = []
    for action, rule in RULES:
        name, _, prefix = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + prefix):
            fits.append((len(rule), rule, action))
    _, rule, action = max(fits) if fits else (0, None, None)
    return host, path, rule, action


def test_hosts_paths_and_rules(spark):
    links = spark.createDataFrame([(n, u, "x") for n, u in enumerate(URLS)], "entry_id bigint, url string, host string")
    out = {r.entry_id: r for r in url_templates.judge_links(links, RULES).collect()}
    for n, u in enumerate(URLS):
        host, path, rule, action = plain(u)
        assert (out[n].host, out[n].path, out[n].rule) == (host, path, rule), u
        assert out[n].verdict in ("allow", "block") and (action is None or out[n].verdict == action)
    assert urlsplit(URLS[5]).hostname == out[5].host


def labelled(spark):
    rows = []
    for n in range(400):
        rows.append((f"https://hub.org/user/{n}/post{n}", 0 if n % 10 else None))
        rows.append((f"https://hub.org/spam/{n}/offer", 1 if n % 2 else None))
        rows.append((f"https://hub.org/misc{n % 3}/{n}", n % 2))
        rows.append((f"https://new.org/a/{n}", None))
    return spark.createDataFrame([(i, u, b, "x") for i, (u, b) in enumerate(rows)], "entry_id bigint, url string, bad int, node string")


def test_templates_generalise_merge_and_reject(spark):
    out = url_templates.judge_links(labelled(spark), [], label="bad").toPandas()
    by = out.groupby("template").agg(n=("verdict", "size"), verdict=("verdict", "first"), purity=("purity", "first"))
    assert by.verdict.to_dict() == {
        "hub.org/{misc0,misc1,misc2}/*": "allow", "hub.org/spam/*/offer": "block", "hub.org/user/*/*": "allow", "new.org/a/*": "allow",
    }
    assert by.loc["hub.org/spam/*/offer", "purity"] == pytest.approx(201 / 202)
    assert by.loc["new.org/a/*", "purity"] == 0.5 and by.n.sum() == 1600


def test_equal_to_sql(spark):
    rows = [(n, f"https://s{n % 4}.example.{('com', 'net', 'org')[n % 3]}/{('en', 'de', 'fr')[n // 3 % 3]}/{n}/{n % 5}/x/y") for n in range(3000)]
    rows += list(enumerate(URLS)) + rows[:20] + [(None, None)]
    links = spark.createDataFrame(rows, "page_id bigint, url string")
    out = url_templates.judge_links(links, RULES, "page_id").toPandas().rename(columns={"entry_id": "page_id"})
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(rows, columns=["page_id", "url"]).astype({"page_id": "Int64"}))
    expected = con.execute(url_templates.oracle(RULES, "pages", "page_id", "url")).df()
    key = lambda d: sorted(map(str, d[["page_id", "host", "path", "rule", "verdict"]].astype(object).where(d.notna(), None).values.tolist()))
    as_int = lambda d: d.assign(page_id=d.page_id.astype("Int64").astype(str))
    assert key(as_int(out)) == key(as_int(expected))


def test_no_rows(spark):
    assert url_templates.judge_links(spark.createDataFrame([], "entry_id bigint, url string"), RULES).count() == 0


def test_branches_below_the_third_segment(spark):
    rows = [(n, f"https://host/a/b/c/{('good', 'bad')[n % 2]}/{n // 2 % 2}", n % 2) for n in range(200)]
    links = spark.createDataFrame(rows, "entry_id bigint, url string, label int")
    out = url_templates.judge_links(links, [], label="label").collect()
    assert {(r.path.split("/")[4], r.verdict) for r in out} == {("good", "allow"), ("bad", "block")}
    assert {r.template for r in out} == {"host/a/b/c/good/{0,1}", "host/a/b/c/bad/{0,1}"}


def test_trap_of_many_segments_ends_at_once(spark, monkeypatch):
    """A link of 500 segments, alone or repeated, costs no rounds beyond those of its company."""
    rounds, branches = [], url_templates._branches
    monkeypatch.setattr(url_templates, "_branches", lambda links: rounds.append(1) or branches(links))
    deep = "https://trap.org" + "".join(f"/d{k}" for k in range(500))
    twice = "https://twin.org" + "/loop" * 400
    rows = [(1, deep), (2, twice), (3, twice), *[(10 + n, f"https://trap.org/page{n}/x") for n in range(30)], (50, "https://trap.org")]
    out = {r.entry_id: r.template for r in url_templates.judge_links(spark.createDataFrame(rows, "entry_id bigint, url string"), RULES).collect()}
    assert out[1] == "trap.org" + "/*" * 500 and out[2] == out[3] == "twin.org" + "/loop" * 400
    assert out[10] == "trap.org/*/x" and out[50] == "trap.org" and len(out) == 34
    assert len(rounds) <= 2 + 2
