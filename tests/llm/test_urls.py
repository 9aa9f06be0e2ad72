import os
import random
from collections import Counter
from itertools import combinations

from termsieve.llm import registry, urls

from ..compare import connection, differences

GIVEN = registry.URL_RULES


def parsed(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[cut:]
    end = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), path[:end]


def ruled(host, path):
    fits = [(len(h) + len(p), v, h + p) for v, h, p in GIVEN if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


ODD = [
    None, "", "no scheme", "://", "http://", "http://NET/", "http://net", "https://a.b.EXAMPLE.net/en/1?x=1", "https://example.net/EN/", "http://notexample.net/en/", "http://net?/en/", "http://org/fr/#/x",
    "http://x.org/fr", "http://x.org/fr/ü?", "http://example.com#/de/", "http://example.com/de/", "http://myexample.com/de/", "a://b://c.net/d", "http://é.NET/ä\nb?c", "http://" + "l." * 3000 + "net/" + "p/" * 9000, "HTTP://x.com/?a=b&a=c&=d&e",
]


def pages(spark, rows):
    return spark.createDataFrame([(i, u, "h", "x", "y", True) for i, u in rows], "page_id long, url string, html string, host string, verdict string, bad boolean")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_parts_and_given_rules(spark):
    rows = [*enumerate(ODD), (None, "http://a.net/"), (5, "http://NET/"), (5, "http://NET/")]
    got = urls.filter_urls(pages(spark, rows), labels(spark, []), GIVEN)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    want = [(i, *parsed(u), ruled(*parsed(u))[1], ruled(*parsed(u))[0] or "allow") for i, u in rows]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert urls.filter_urls(pages(spark, []), labels(spark, []), GIVEN).collect() == []


def spam_table(n=5000, seed=2):
    """Bad are pages of two hosts, of one only beside a path, and a few at random."""
    r = random.Random(seed)
    rows, marks = [], []
    for i in range(n):
        host = r.choice(["spam-farm.example.com", "www.shop.example.com", "fine.example.com", "good.example.com", "tea.example.com", "news.example.org", "m.mixed.example.com", "ok.example.net"])
        path = r.choice(["/en/", "/de/", "/win/", "/a/b/"])
        url = f"{r.choice(['http', 'https'])}://{host}{path}{i}{r.choice(['', '.html', '/', '?page=2&ref=x', '#top'])}"
        rows.append((i, url))
        bad = "spam-farm" in host or ("mixed" in host and "win" in path) or r.random() < 0.05
        if r.random() < 0.6:
            marks.append((i, 0 if bad and i % 3 else 1, 1 if bad and i % 3 == 0 else 0))
    return rows, marks + [(None, 0, 1), (7, None, None), (9, 5, None)]


def test_mined_rules_equal_brute_force(spark):
    rows, marks = spam_table()
    marked = urls.labelled(pages(spark, rows), labels(spark, marks))
    got = urls.mined(marked)
    sets = [(frozenset(t), b) for t, b in marked.select(urls.tokens(marked["url"], *urls.parts(marked["url"])), "bad").collect()]
    need = max(urls.LEAST, -(-len(sets) * 5 // 1000))
    every, bad = Counter(), Counter()
    for items, b in sets:
        for k in range(1, len(items) + 1):
            for some in combinations(sorted(items), k):
                every[frozenset(some)] += 1
                bad[frozenset(some)] += b
    rules = {s: bad[s] / every[s] for s in every if bad[s] >= need and bad[s] >= urls.CONFIDENCE * every[s]}
    want = {s: c for s, c in rules.items() if not any(rules.get(frozenset(t), -1) >= c for k in range(1, len(s)) for t in combinations(s, k))}
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-12 for s in want)
    assert frozenset(["host2:spam-farm"]) in got and any({"host2:mixed", "path:win"} <= s for s in got)
    found = {r.page_id: r.verdict for r in urls.judge(pages(spark, rows), GIVEN, got).collect()}
    for i, u in rows:
        own = ruled(*parsed(u))[0]
        assert found[i] == (own or ("block" if "spam-farm" in u or ("mixed" in u and "/win/" in u) else "allow")), u


def test_equals_sql_with_mined_rules(spark, tmp_path):
    rows, marks = spam_table()
    for name, df in (("pages", pages(spark, rows + [(9000 + k, u) for k, u in enumerate(ODD)])), ("labels", labels(spark, marks))):
        os.makedirs(tmp_path / "in", exist_ok=True)
        df.write.parquet(str(tmp_path / "in" / f"{name}.parquet"))
    d = str(tmp_path / "in")
    assert registry.op13_url_rules(spark, d).where("rule IS NULL AND verdict = 'block'").count() > 300
    assert not differences(registry.op13_url_rules(spark, d), connection(d), registry.oracle_sql()["op13_url_rules"])


def test_rows_with_very_many_tokens_in_common(spark):
    """A url that a third of the rows share has many subsets; mining takes the tokens that tell most."""
    hot = "http://hot.example.com/" + "/".join(f"w{chr(97 + k)}" for k in range(26)) + "/1?" + "&".join(f"q{chr(97 + k)}=1" for k in range(26))
    rows = [(k, hot) for k in range(300)] + [(1000 + k, f"http://fine.example.org/en/{1000 + k}") for k in range(600)]
    rules = urls.mined(urls.labelled(pages(spark, rows), labels(spark, [(1, 0, 0)] + [(1000 + k, 1, 0) for k in range(600)])))
    found = Counter(r.verdict for r in urls.judge(pages(spark, rows), GIVEN, rules).collect())
    assert found == {"block": 300, "allow": 600} and len(rules) <= urls.MOST


def test_index_and_pruning():
    f = frozenset
    index = urls.Index([f("ab"), f("c"), f("bcd")])
    assert [index.matches(x) for x in ("a", "b", "ab", "bca", "c", "bd", "", "xyz", "aa")] == [False, False, True, True, True, False, False, False, False]
    assert urls.pruned({f("a"): 0.8, f("ab"): 0.8, f("ac"): 0.9, f("acd"): 0.85, f("cd"): 0.8}) == {f("a"): 0.8, f("ac"): 0.9, f("cd"): 0.8}


def test_no_token_is_left_out_of_mining(spark, tmp_path):
    """Eleven tokens tell more than `zz`, which a rule needs all the same."""
    long = "http://h.example.com/" + "/".join(f"w{chr(97 + k)}" for k in range(11))
    rows = [(k, f"{long}{'/zz' if k < 25 else ''}/{k}") for k in range(60)] + [(1000 + k, f"http://fine.example.org/en/{1000 + k}") for k in range(300)]
    marks = [(k, 0, 0) for k in range(60)] + [(1000 + k, 1, 0) for k in range(300)]
    os.makedirs(tmp_path / "in")
    for name, df in (("pages", pages(spark, rows + [(5000, "http://fine.example.org/zz/5000"), (5001, "http://fine.example.org/yy/5001")])), ("labels", labels(spark, marks))):
        df.write.parquet(str(tmp_path / "in" / f"{name}.parquet"))
    d = str(tmp_path / "in")
    got = registry.op13_url_rules(spark, d)
    assert {r.page_id: r.verdict for r in got.where("page_id >= 5000").collect()} == {5000: "block", 5001: "allow"}
    assert not differences(got, connection(d), registry.oracle_sql()["op13_url_rules"])
