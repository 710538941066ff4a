import re

from reelframe.llm.licenses import NOTICES, PHRASES, scan_licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(lowered)
    places = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def rows_of(df):
    return [(r.doc_id, (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in df.collect()]


def test_base_places(table, prose, odd):
    rows = odd + [(20, "Released UNDER the MIT-license. under the mit license"), (21, "apache license version 2 apache license, version 2.0"), (22, "cc by nc cc by nc cc-by-nd"),
                  (23, prose(1, 200) + " under the mit license " + prose(2, 50) + " CC BY-NC 4.0"), (24, "under the the mit license"), (25, "mit license"), (26, "apache licenÉse version 2")]
    got = rows_of(scan_licenses(table(rows)))
    key = lambda x: repr(x)
    assert sorted(got, key=key) == sorted(((i, base(t)) for i, t in rows), key=key)


def test_notices_by_diagonals(table, prose):
    words = NOTICES["mit"].split()
    edited = " ".join(words[:20] + ["really"] + words[20:35] + words[36:])
    far = " ".join(words[:12])
    rows = [(1, prose(3, 80) + " " + NOTICES["mit"] + " " + prose(4, 90)), (2, prose(5, 10) + " " + edited), (3, far), (4, NOTICES["bsd"].upper()), (5, prose(6, 300)),
            (6, " ".join(words[i] for i in range(len(words) - 1, -1, -1)))]
    got = {r.doc_id: r for r in scan_licenses(table(rows)).collect()}
    assert [got[i].labels for i in range(1, 7)] == ["mit", "mit", "", "bsd", "", ""]
    assert got[1].score == 1.0 and 0.8 <= got[2].score < 1.0 and 0 < got[3].score < 0.8 and got[5].score == 0.0
    assert got[1].spans[0].first == 80 and got[1].spans[0].last == 80 + len(WORD.findall(NOTICES["mit"].lower())) - 1
    assert all(0 <= r.score <= 1 for r in got.values())


def test_repeated_rows_and_empty_table(table):
    assert len(scan_licenses(table([(1, "under the mit license")] * 3)).filter("n_base = 1").collect()) == 3
    assert scan_licenses(table([])).collect() == []
