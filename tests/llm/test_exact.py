import hashlib

from pyspark.sql import functions as F

from reelframe.llm.exact import exact_groups


def expected(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        ids = groups[t or ""]
        top = max((x for x in ids if x is not None), default=None)
        out.append((i, top, len(ids), i == top, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    assert df.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return sorted(map(tuple, df.collect()), key=repr)


def test_groups_of_equal_texts(table, prose, odd):
    rows = odd + [(100 + i, prose(i % 7, 30)) for i in range(40)]
    assert got(exact_groups(table(rows))) == expected(rows)


def test_texts_that_share_a_digest_stay_apart(table, prose, odd):
    rows = odd + [(100 + i, prose(i % 9, 5)) for i in range(40)]
    weak = lambda c: F.substring(F.sha2(c, 256), 1, 1)
    assert got(exact_groups(table(rows), digest=weak)) == expected(rows)


def test_hot_text_and_empty_table(table):
    rows = [(i, "the same") for i in range(500)] + [(1000, "other")]
    assert got(exact_groups(table(rows, 8), salts=4)) == expected(rows)
    assert got(exact_groups(table([]))) == []
