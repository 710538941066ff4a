"""Spelling variants: words one edit apart, found by common prefixes and suffixes of padded code-point matrices, and grouped under their common form."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelframe.session import staged

#: a word is a run of these; only A-Z are lower-cased. All are single bytes in Latin-1, so a word's bytes are its code points
LETTERS = bytes([*range(65, 91), *range(97, 123), *range(192, 256)])
PLAIN = bytes((c + 32 if 65 <= c <= 90 else c) if c in LETTERS else 32 for c in range(256))
#: words held in one counting table and rows compared in one go
HELD, ROWS, CELLS = 500_000, 200_000, 1 << 24


def runs(text: str) -> list[bytes]:
    return text.encode("latin-1", "replace").translate(PLAIN).split()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, drop: int | None = None) -> DataFrame:
    """(word, n) of all words of at least `least` code points; a task counts its own words before they are shuffled.

    With `drop`, a word whose number (crc32 of "<id>:<word>") is divisible by it loses the code point at that number modulo its length, the same in all
    places of a document. Null texts have no words, a null id is empty in the number."""

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for frame in frames:
            for name, text in zip(frame["name"], frame["body"]):
                salt = zlib.crc32(f"{name}:".encode())
                for word, n in Counter(runs(text)).items():
                    if len(word) < least:
                        continue
                    if drop:
                        number = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), salt)
                        if number % drop == 0:
                            at = number % len(word)
                            word = word[:at] + word[at + 1:]
                            if len(word) < least:
                                continue
                    total[word] += n
                if len(total) > HELD:
                    yield pd.DataFrame({"word": [w.decode("latin-1") for w in total], "n": list(total.values())})
                    total.clear()
        if total:
            yield pd.DataFrame({"word": [w.decode("latin-1") for w in total], "n": list(total.values())})

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    return rows.mapInPandas(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def keyed_words(words: DataFrame, pieces: int = 32, most: int = 8192) -> DataFrame:
    """Rows (key, m, i, part, cross, word, n): words that may be one edit apart share a key.

    Of a pair let m be the longer length. Cut the longer word into segments of two code points (m / `pieces` where that is more): what stands
    before and behind the segment with the edit is common to both. So every word is keyed, once as the longer and once as
    the shorter of a pair, by m, a segment's number and what surrounds it. Words of up to 2 x `pieces` code points that share a key differ in
    two code points, which bounds a key at some 8,000 words. Longer words have longer segments: keys with over `most` of them are dealt
    into parts of that size and every pair of parts has a key of its own (`cross`: only pairs between the parts count).
    """
    size = F.length("word")
    rows = words.select("word", "n", F.explode(F.array(size, size + 1)).alias("m"))
    rows = rows.withColumn("step", F.greatest(F.lit(2), F.ceil(F.col("m") / pieces).cast("int")))
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.ceil(F.col("m") / F.col("step")).cast("int") - 1)))
    behind = F.col("m") - F.least("m", F.col("step") * (F.col("i") + 1))
    key = F.xxhash64("m", "i", F.substr("word", F.lit(1), F.col("step") * F.col("i")), F.substr("word", size - behind + 1, behind))
    rows = rows.select(key.alias("key"), "m", "i", "word", "n")
    whole = rows.withColumn("part", F.lit(0)).withColumn("cross", F.lit(False))
    long = rows.filter(F.col("m") > 2 * pieces)
    hot = staged(long.groupBy("key").agg(F.count("*").alias("n_key")).filter(F.col("n_key") > most), "spelling-hot")
    if hot.isEmpty():
        return whole
    parts = long.join(hot, "key").withColumn("parts", F.ceil(F.col("n_key") / most).cast("int")).withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    dealt = parts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.withColumn("key", F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other"))).withColumn("cross", F.col("part") != F.col("other"))
    return whole.join(hot, "key", "left_anti").unionByName(dealt.select(whole.columns))


def matrices(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words, padded with 0 to m columns: from the front, and from the back."""
    place = np.arange(m)
    inside = place < sizes[:, None]
    front = np.where(inside, data[np.where(inside, starts[:, None] + place, 0)], 0)
    back = np.where(inside, data[np.where(inside, (starts + sizes - 1)[:, None] - place, 0)], 0)
    return front, back


def single_edits(front: np.ndarray, back: np.ndarray, sizes: np.ndarray, group: np.ndarray, i: np.ndarray, part: np.ndarray, cross: np.ndarray, m: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs one edit apart whose longer word has m code points; the rows of a group are neighbours.

    The block of rows is laid beside the block d rows further on, for every d within the largest group. Common prefix plus common suffix reach m - 1
    only for single edits. The prefix names the edit's segment, so a pair counts under one of its keys only.
    """
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    live, d = np.arange(len(group)), 0
    while True:
        d += 1
        live = live[live + d < len(group)]
        live = live[group[live] == group[live + d]]
        if not len(live):
            return np.concatenate(found_a), np.concatenate(found_b)
        for at in range(0, len(live), max(1, CELLS // m)):
            a = live[at:at + max(1, CELLS // m)]
            b = a + d
            ok = (np.maximum(sizes[a], sizes[b]) == m) & ((part[a] != part[b]) == cross[a])
            a, b = a[ok], b[ok]
            other = front[a] != front[b]
            head = np.where(other.any(1), other.argmax(1), m)
            other = back[a] != back[b]
            tail = np.where(other.any(1), other.argmax(1), m)
            near = (head + tail >= m - 1) & (head < m) & (head // step == i[a])
            found_a.append(a[near])
            found_b.append(b[near])


def best_neighbours(front: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """A row per word with a near one: how many it has here, and the most frequent of them (ties: smallest in code-point order)."""
    own, other = np.concatenate([a, b]), np.concatenate([b, a])
    text = np.ascontiguousarray(front).view(f"S{front.shape[1]}").ravel()
    rank = np.unique(text[other], return_inverse=True)[1]
    order = np.lexsort((rank, -n[other], own))
    own, other = own[order], other[order]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
    count = np.diff(np.r_[first, len(own)])
    words = lambda rows: pa.array(text[rows].tolist(), pa.binary())
    return pa.record_batch([words(own[first]), pa.array(count.astype(np.int64)), words(other[first]), pa.array(n[other[first]])], names=["own", "n_near", "best", "best_n"])


def compared(batches: Iterator[pa.RecordBatch], pieces: int) -> Iterator[pa.RecordBatch]:
    """Compare the words of each key. Batches are sorted by (m, key); a key may go on in the next batch."""

    def groups(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        cols = {c: table[c].to_numpy() for c in ("key", "m", "i", "part", "cross", "n")}
        words = table["word"].chunk(0) if table["word"].num_chunks else pa.array([], pa.binary())
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1].astype(np.int64)
        data = np.frombuffer(words.buffers()[2], np.uint8)
        group = np.cumsum(np.r_[0, (np.diff(cols["key"]) != 0) | (np.diff(cols["m"]) != 0) | (np.diff(cols["i"]) != 0)])
        at = 0
        while at < len(group):
            m = int(cols["m"][at])
            end = int(np.searchsorted(cols["m"], m, "right"))
            if end - at > max(1, CELLS // m):
                # as many whole keys as fit, at least one
                end = max(int(np.searchsorted(group, group[at + max(1, CELLS // m)], "left")), int(np.searchsorted(group, group[at], "right")))
            part = slice(at, end)
            at = end
            sizes = np.diff(offsets)[part]
            front, back = matrices(data, offsets[:-1][part], sizes, m)
            a, b = single_edits(front, back, sizes, group[part], cols["i"][part], cols["part"][part], cols["cross"][part], m, max(2, -(-m // pieces)))
            if len(a):
                yield best_neighbours(front, cols["n"][part], a, b)

    held: list[pa.Table] = []
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        if sum(t.num_rows for t in held) < ROWS:
            continue
        table = pa.concat_tables(held)
        key, m = table["key"].to_numpy(), table["m"].to_numpy()
        last = int(np.flatnonzero((key != key[-1]) | (m != m[-1]))[-1]) + 1 if len(np.flatnonzero((key != key[-1]) | (m != m[-1]))) else 0
        if last:
            yield from groups(table.slice(0, last))
        held = [table.slice(last)]
    if held:
        yield from groups(pa.concat_tables(held))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form) rows: the last word reached along forms. Every round doubles the way gone."""
    at = staged(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = at.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        gone = staged(at.join(on, at["root"] == on["_word"], "left").select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")), "spelling-roots")
        at = gone.select("word", "root")
        if gone.filter("moved").isEmpty():
            return at


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, seen: int = 2, ratio: int = 10, drop: int | None = None,
                    pieces: int = 32, most: int = 8192) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, with at least `least` code points and `seen` occurrences (n)
    over all texts; `drop` as in `word_counts`. Two words are near when one inserted, deleted or replaced code point makes them equal. A word's
    form is its near word with the largest n (ties: smallest in code-point order) if that is at least `ratio` times its own; its root is where forms lead
    in the end, itself without one. Null and empty texts have no words; equal rows are counted each; an empty table gives an empty result;
    other columns are not looked at; texts and words of any length are taken whole.
    """
    words = staged(word_counts(docs, id_col, text_col, least, drop).filter(F.col("n") >= seen), "spelling-words")
    keyed = keyed_words(words, pieces, most).withColumn("word", F.encode("word", "ISO-8859-1"))
    sorted_keys = keyed.repartition("key").sortWithinPartitions("m", "key", "i")
    near = sorted_keys.mapInArrow(lambda batches: compared(batches, pieces), "own binary, n_near long, best binary, best_n long")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word"))).alias("top")
    near = near.groupBy("own").agg(F.sum("n_near").alias("n_near"), best)
    near = near.select(F.decode("own", "ISO-8859-1").alias("own"), "n_near", F.decode("top.word", "ISO-8859-1").alias("best"), (-F.col("top.less")).alias("best_n"))
    wins = F.col("best_n") >= ratio * F.col("n")
    named = words.join(near, words["word"] == near["own"], "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(wins, F.col("best")).alias("form"), F.when(wins, F.col("best_n")).alias("form_n"))
    named = staged(named, "spelling-forms")
    last = roots(named.filter("form is not null").select("word", "form")).withColumnRenamed("word", "_word")
    return named.join(last, named["word"] == last["_word"], "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
