"""Url filter: host and path rules, else naive Bayes over the words of segmented host and path names."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from reelframe.llm.words import ascii_lower
from reelframe.session import staged

GAP = r"[^\p{L}\p{N}]+"

# fixed values: (host and path, verdict); the longest that fits decides
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]

# fixed values: names that mark a page as unwanted when the classifier is fitted
MARKS = ["adult", "ads", "bets", "casino", "gambling", "lottery", "malware", "phishing", "pills", "poker", "porn", "sex", "slots", "spam", "track", "viagra", "warez", "xxx"]

# fixed values: further words that names are glued from
NAMES = ["best", "bet", "blog", "book", "buy", "cash", "cheap", "city", "click", "club", "deal", "farm", "forum", "free", "fun", "game", "games", "gold", "health", "home", "hot", "info", "live", "loan", "mail",
         "media", "money", "music", "news", "online", "party", "photo", "play", "post", "pro", "sale", "search", "shop", "site", "store", "super", "tech", "time", "top", "travel", "video", "web", "win", "wiki", "world"]


def host_path(url: Column) -> tuple[Column, Column]:
    """Host after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path from there to `?`, `#` or the end. Null and other urls: empty."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    got = lambda i: F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), parts, i)
    return ascii_lower(got(1)), got(2)


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule whose host is the url's or a parent of it and whose path the url's path starts with."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def splitter(total: float, longest: int):
    """Pandas UDF (piece, found words with start, length and count) -> the most probable split under unigram counts. Characters of no known
    word form words of their own, at ten times less per character than a word seen once. Of equal splits the one with the longest last word."""

    @pandas_udf("array<string>")
    def split(piece: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for name, words in zip(piece, found):
            ends: dict[int, list[tuple[int, float]]] = {}
            for w in words if words is not None else ():
                ends.setdefault(w["start"] + w["size"], []).append((w["start"], math.log(w["n"] / total)))
            best, back = [0.0], [0]
            for end in range(1, len(name) + 1):
                options = [(best[start] + p, -start) for start, p in ends.get(end, ())]
                options += [(best[start] - math.log(total) - (end - start) * math.log(10), -start) for start in range(max(0, end - longest), end)]
                score, start = max(options)
                best.append(score)
                back.append(-start)
            parts, end = [], len(name)
            while end:
                parts.append(name[back[end]:end])
                end = back[end]
            out.append(parts[::-1])
        return pd.Series(out)

    return split


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", rules: list[tuple[str, str]] = RULES, marks: list[str] = MARKS,
                mark_count: int = 20, least_hosts: int = 5, longest: int = 24) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, score, words.

    verdict is that of the longest fitting rule, else block where `score` is over 0.5. Urls that are null or have no `://` have an empty host and
    path, no words, no rule and the score of the prior alone. Rows that repeat are rows of their own; other columns are not looked at.

    Unigram counts are those of all letter words in page titles, of names in the urls of at least `least_hosts` hosts (a count per host),
    and `mark_count` for each of `marks` and NAMES, so that names glued from them come apart. Each distinct name meets the counts by a join on its substrings of up to `longest` characters; Viterbi then sees
    only the words found in that name. Digits in paths count as one symbol, so urls fall into far fewer shapes (host, path) than rows; all
    model work is on counted shapes. Naive Bayes is fitted on all shapes weighted by their pages: class 1 where a word is one of marks.
    """
    spark = pages.sparkSession
    host, path = host_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), F.coalesce(F.col(body_col).cast("string"), F.lit("")).alias("body"))
    shape = F.regexp_replace(F.lower("path"), "[0-9]+", "0")
    rows = rows.withColumn("shape", shape)
    shapes = rows.groupBy("host", "shape").agg(F.count("*").alias("n"))
    shapes = shapes.withColumn("names", F.array_remove(F.split(F.concat_ws(" ", "host", "shape"), GAP), ""))
    shapes = staged(shapes, "url-shapes")

    title = F.regexp_extract("body", r"(?is)<title[^>]*>(.*?)</title", 1)
    letters = r"[^\p{L}]+"
    seen = rows.select(F.explode(F.split(F.lower(title), letters)).alias("word"), F.lit(1).cast("long").alias("n"))
    # a name of few hosts may be glued from words, and its own count would keep it in one piece
    common = shapes.select("host", F.explode("names").alias("word")).distinct().groupBy("word").agg(F.count("*").alias("n"))
    seen = seen.unionByName(common.filter(F.col("n") >= least_hosts))
    seen = seen.unionByName(spark.createDataFrame([(m, mark_count) for m in dict.fromkeys([*marks, *NAMES])], "word string, n long"))
    unigrams = staged(seen.filter((F.col("word") != "") & (F.length("word") <= longest)).groupBy("word").agg(F.sum("n").alias("n")), "url-unigrams")
    total = float(unigrams.agg(F.sum("n")).first()[0] or 1)

    names = shapes.select(F.explode("names").alias("name")).distinct()
    length = F.length("name")
    start = names.filter(length > 0).select("name", F.explode(F.sequence(F.lit(1), length)).alias("start"))
    spans = start.select("name", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), length - F.col("start") + 1))).alias("size"))
    spans = spans.withColumn("word", F.substring("name", F.col("start"), F.col("size"))).filter(F.length("word") == F.col("size"))
    found = spans.join(unigrams, "word").groupBy("name").agg(F.collect_list(F.struct((F.col("start") - 1).alias("start"), "size", "n")).alias("found"))
    cut = names.join(found, "name", "left").select("name", splitter(total, longest)("name", "found").alias("words"))
    cut = staged(cut, "url-names")

    each = shapes.select("host", "shape", "n", F.posexplode("names").alias("at", "name")).join(cut, "name")
    worded = each.groupBy("host", "shape", "n").agg(F.array_sort(F.collect_list(F.struct("at", "words"))).alias("w"))
    worded = worded.select("host", "shape", "n", F.flatten(F.col("w.words")).alias("words"))
    worded = worded.withColumn("bad", F.arrays_overlap("words", F.array(*map(F.lit, marks))).cast("long"))
    worded = staged(worded, "url-words")

    bad, good = F.sum(F.col("n") * F.col("bad")), F.sum(F.col("n") * (1 - F.col("bad")))
    counts = staged(worded.select("n", "bad", F.explode("words").alias("word")).groupBy("word").agg(bad.alias("n1"), good.alias("n0")), "url-counts")
    w1, w0, kinds = (float(x or 0) for x in counts.agg(F.sum("n1"), F.sum("n0"), F.count("*")).first())
    d1, d0 = (float(x or 0) for x in worded.agg(bad, good).first())
    prior = math.log((d1 + 1) / (d0 + 1))
    odds = F.log((F.col("n1") + 1) / (w1 + kinds + 1)) - F.log((F.col("n0") + 1) / (w0 + kinds + 1))
    scored = worded.select("host", "shape", "words", F.explode("words").alias("word")).join(counts.select("word", odds.alias("odds")), "word")
    scored = scored.groupBy("host", "shape", "words").agg(F.sum("odds").alias("odds"))
    scored = staged(scored, "url-scores")

    fit = fitting_rule(F.col("host"), F.col("path"), rules)
    out = rows.select("page_id", "host", "path", "shape", fit.alias("fit")).join(scored, ["host", "shape"], "left")
    score = 1 / (1 + F.exp(-(F.coalesce("odds", F.lit(0.0)) + prior)))
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", F.when(score > 0.5, "block").otherwise("allow")).alias("verdict"),
                      score.alias("score"), F.array_join("words", " ").alias("words"))
