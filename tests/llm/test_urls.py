import re

import pandas as pd
from pyspark.sql import functions as F

from reelframe.llm.urls import RULES, filter_urls, host_path, splitter

URLS = [None, "", "no scheme", "http://", "http://A.Example.NET/en/x?q#f", "http://example.net/en/", "http://example.net/en", "http://x.example.com/de/", "http://notexample.com/de/", "https://a.org/fr/b", "https://org/fr/",
        "https://a.org?x=/fr/", "https://a.org#/fr/", "ftp://h/p://q/r", "x://y://z/w", "http://net", "http://net/", "http://ÄÖ.net/Pfad", "http://a.net/\nb", "http://" + "casino" * 30 + ".example.com/" + "a" * 5000]


def expected(url):
    m = re.search(r"://", url or "")
    if not m:
        return "", ""
    rest = url[m.end():]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def rule(host, path):
    fits = []
    for r, verdict in RULES:
        name, _, rest = r.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            fits.append((len(r), r, verdict))
    return max(fits)[1:] if fits else (None, None)


def pages(spark, urls, html="<title>win the game</title>"):
    return spark.createDataFrame([(i, u, html, "h", 1) for i, u in enumerate(urls)], "page_id long, url string, html string, host string, n int")


def test_hosts_paths_and_rules(spark):
    df = filter_urls(pages(spark, URLS))
    assert df.columns[:5] == ["page_id", "host", "path", "rule", "verdict"]
    rows = {r.page_id: r for r in df.collect()}
    assert len(rows) == len(URLS)
    for i, u in enumerate(URLS):
        host, path = expected(u)
        assert (rows[i].host, rows[i].path) == (host, path), u
        r, verdict = rule(host, path)
        assert rows[i].rule == r, u
        assert rows[i].verdict == (verdict or ("block" if rows[i].score > 0.5 else "allow"))
        assert 0 <= rows[i].score <= 1


def test_viterbi_is_the_most_probable_split():
    counts = {"a": 5, "ab": 7, "abc": 2, "b": 3, "c": 9, "bc": 6, "ca": 4}
    total, longest = 100.0, 5
    import itertools
    import math

    def cost(parts):
        return sum(math.log(counts[p] / total) if p in counts else -math.log(total) - len(p) * math.log(10) for p in parts)

    split = splitter(total, longest).func
    for n in (1, 3, 5):
        for letters in itertools.product("abcx", repeat=n):
            name = "".join(letters)
            found = [{"start": i, "size": j - i, "n": counts[name[i:j]]} for i in range(n) for j in range(i + 1, n + 1) if name[i:j] in counts]
            got = list(split(pd.Series([name]), pd.Series([found]))[0])
            cuts = [[name[i:j] for i, j in zip((0, *c), (*c, n))] for k in range(n) for c in itertools.combinations(range(1, n), k)]
            best = max(cost(p) for p in cuts if all(len(x) <= longest for x in p))
            assert "".join(got) == name and abs(cost(got) - best) < 1e-9, (name, got)
    assert list(split(pd.Series(["zz"]), pd.Series([None]))[0]) == ["zz"]


def test_glued_names_are_found(spark):
    good = [f"https://www.{a}{b}.example.com/en/{i}" for i, (a, b) in enumerate((a, b) for a in ("city", "travel", "music", "book") for b in ("club", "shop", "news") for _ in range(4))]
    bad = [f"https://{a}{b}.example.com/en/{i}" for i, (a, b) in enumerate((a, b) for a in ("casino", "porn", "viagra") for b in ("win", "free", "cash") for _ in range(2))]
    rows = filter_urls(pages(spark, good + bad + ["https://m.casino-win.example.com/"])).collect()
    blocked = {r.page_id for r in rows if r.verdict == "block"}
    assert blocked == set(range(len(good), len(good) + len(bad) + 1))
    words = {r.host.split(".")[0]: r.words for r in rows}
    assert words["casinowin"].startswith("casino win ")


def test_repeated_rows_and_empty_table(spark):
    df = pages(spark, ["http://a.net/x"]).unionByName(pages(spark, ["http://a.net/x"]))
    assert [r.rule for r in filter_urls(df).collect()] == ["net/", "net/"]
    assert filter_urls(pages(spark, ["x"]).limit(0)).collect() == []
    host, path = host_path(F.lit("q://H/p"))
    assert tuple(spark.range(1).select(host, path).first()) == ("h", "/p")
