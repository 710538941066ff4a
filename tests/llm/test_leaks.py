import math
import re

from reelframe.llm.leaks import find_leaks


def shingles(text, k=5):
    w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def expected(docs, items):
    out = set()
    for i, t in docs:
        d = shingles(t)
        for j, b in items:
            q = shingles(b)
            if q and len(q & d) >= math.ceil(0.8 * len(q) - 1e-9):
                out.add((i, j, len(q & d), len(q)))
    return sorted(out, key=repr)


def got(df):
    assert df.columns == ["doc_id", "item_id", "n_shared", "n_item", "containment"]
    rows = df.collect()
    assert all(abs(r.containment - r.n_shared / r.n_item) < 1e-12 for r in rows)
    return sorted((tuple(r)[:4] for r in rows), key=repr)


def case(prose):
    items = [(j, prose(50 + j, 12 + 3 * j)) for j in range(12)] + [(20, "one"), (21, None), (22, ""), (23, prose(50, 12)), (None, prose(70, 20)), (24, "a b c d e")]
    docs = []
    for j in range(12):
        w = items[j][1].split()
        for cut in range(0, len(w), 4):
            changed = w[:cut] + ["zzz"] + w[cut + 1:]
            docs.append((100 * (j + 1) + cut, prose(j, 150) + ". " + ", ".join(changed).upper() + "! " + prose(j + 30, 400)))
        docs.append((100 * (j + 1) + 99, prose(j, 40) + " " + items[j][1] + " " + items[(j + 1) % 12][1]))
    docs += [(9000, prose(70, 20)), (9001, "A, b-c D e."), (9001, "A, b-c D e."), (None, "a b c d e f")]
    return docs, items


def test_containment_like_brute_force(spark, table, prose, odd):
    docs, items = case(prose)
    bench = spark.createDataFrame([(j, t, "x", 1) for j, t in items], "item_id long, text string, item string, h int")
    want = expected(docs + odd, items)
    assert len(want) > 15
    assert got(find_leaks(table(docs + odd), bench)) == want
    assert got(find_leaks(table(docs + odd), bench, broadcast_rows=0)) == want


def test_empty_tables(spark, table, prose):
    bench = spark.createDataFrame([(1, prose(1, 20))], "item_id long, text string")
    assert got(find_leaks(table([]), bench)) == []
    assert got(find_leaks(table([(1, prose(1, 20))]), bench.limit(0))) == []
