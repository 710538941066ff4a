"""Repeated passages removed by a run-length index: matches of a fixed length that also start in a document with a smaller id.

Documents travel in packed chunks. Equal strings of `span` bytes have equal least k-byte hashes (anchors), so only stretches whose anchor
occurs in several documents can hold a repeat; they are dealt by anchor to index tasks, those of a very frequent anchor by a longer one.
Each task builds run-compressed Burrows-Wheeler transforms of its distinct stretches with text samples at the run ends, streams the
matching statistics of every stretch backwards through them, and answers each full match with the smallest document that has it.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelframe.session import shared_dir

#: symbols sorted at once, at most
WIDE = 12
LAST = np.iinfo(np.int64).max
ODD = np.uint64(0x9E3779B97F4A7C15)


def packed(*parts) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(parts, 5))


def unpacked(blob: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(bytes(blob)))


def steps(rising: np.ndarray) -> np.ndarray:
    """Differences of a rising sequence, as planes of like bytes; `summed` undoes it."""
    return np.ascontiguousarray(np.diff(rising.astype(np.int64), prepend=0).astype(np.uint32).view(np.uint8).reshape(-1, 4).T)


def summed(planes: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32).ravel().astype(np.int64))


# --- documents in chunks -------------------------------------------------------------------------------------------------------------

def chunks(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """chunk, docs: packed (ids, which of them are null, byte lengths, bytes) of neighbouring rows with about `size` bytes together."""
    def gather(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, bodies, held = [], [], 0

        def row() -> pd.DataFrame:
            null = np.array([i is None for i in ids], bool)
            value = np.array([0 if i is None else i for i in ids], np.int64)
            return pd.DataFrame({"docs": [packed(value, null, np.array([len(b) for b in bodies], np.int64), b"".join(bodies))]})

        for frame in frames:
            for i, text in zip(frame["doc_id"].astype("Int64"), frame["body"]):
                ids.append(None if i is pd.NA else int(i))
                bodies.append(text.encode("utf-8", "replace"))
                held += len(bodies[-1]) + 64
                if held >= size:
                    yield row()
                    ids, bodies, held = [], [], 0
        if ids:
            yield row()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    return rows.mapInPandas(gather, "docs binary").withColumn("chunk", F.monotonically_increasing_id())


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """df written below the shared folder in hash buckets of key, so that joins on it leave df where it is."""
    spark = df.sparkSession
    name = f"suffix_chunks_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


# --- anchors -------------------------------------------------------------------------------------------------------------------------

def anchor_bytes(span: int) -> int:
    """Length of the strings that are hashed: long ones are seldom shared by chance, short ones make longer stretches."""
    return 24 if span >= 48 else 16 if span >= 24 else 8


def anchors(data: np.ndarray, span: int, width: int | None = None, step: int = 1 << 15) -> np.ndarray:
    """For each start the least hash of the strings of `width` bytes (anchor_bytes) inside the `span` bytes from there; starts run to the last one that fits. `step` at a time."""
    return np.concatenate([_anchors(data[i:i + step + span - 1], span, width or anchor_bytes(span)) for i in range(0, len(data) - span + 1, step)])


def _anchors(data: np.ndarray, span: int, width: int) -> np.ndarray:
    h = (data.astype(np.uint64) + np.uint64(1)) * ODD
    h ^= h >> np.uint64(29)
    have = 1
    while have < width:
        more = min(have, width - have)
        h = (h[:-more] * np.uint64(0xD1B54A32D192ED03 + 2 * more)) ^ (h[more:] + (h[more:] >> np.uint64(31)))
        have += more
    h *= ODD
    h ^= h >> np.uint64(32)
    wide, reach = span - width + 1, 1
    while 2 * reach <= wide:
        h = np.minimum(h[:-reach], h[reach:])
        reach *= 2
    return np.minimum(h[:-(wide - reach)], h[wide - reach:]) if reach < wide else h


@dataclass
class Stretches:
    """Runs of neighbouring starts in one document with one anchor."""

    start: np.ndarray
    count: np.ndarray
    doc: np.ndarray
    anchor: np.ndarray


def stretches(data: np.ndarray, sizes: np.ndarray, span: int, most: int = 4096) -> Stretches:
    none = np.zeros(0, np.int64)
    if not (sizes >= span).any():
        return Stretches(none, none, none, none.astype(np.uint64))
    a = anchors(data, span)
    ends = np.cumsum(sizes)
    fit = np.flatnonzero(sizes >= span)
    first, last = (ends - sizes)[fit], ends[fit] - span + 1  # starts of each document that has any
    cut = np.unique(np.concatenate((np.flatnonzero(a[1:] != a[:-1]) + 1, first, last)))
    start, stop = cut[:-1], cut[1:]
    home = np.searchsorted(first, start, "right") - 1
    inside = (home >= 0) & (start < last[np.maximum(home, 0)])
    start, stop, home = start[inside], stop[inside], home[inside]
    parts = -(-(stop - start) // most)
    begin = np.repeat(start, parts) + most * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    return Stretches(begin, np.minimum(np.repeat(stop, parts) - begin, most), fit[np.repeat(home, parts)], a[begin])


def bucket_of(anchor: np.ndarray, buckets: int) -> np.ndarray:
    return ((anchor >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def low(anchor: np.ndarray) -> np.ndarray:
    return (anchor & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def anchor_rows(buckets: int, span: int):
    """Each chunk's distinct anchors by bucket (as 32 bits: a false meeting only adds work), whether several of its documents have them, and how many bytes their stretches hold (as a power of two)."""
    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for chunk, blob in zip(frame["chunk"], frame["docs"]):
                _, _, sizes, body = unpacked(blob)
                s = stretches(np.frombuffer(body, np.uint8), sizes, span)
                home = bucket_of(s.anchor, buckets)
                mine = home.astype(np.uint64) << np.uint64(32) | low(s.anchor)
                order = np.argsort(mine, kind="stable")
                mine, doc, held = mine[order], s.doc[order], (s.count + span - 1)[order]
                first = np.flatnonzero(np.concatenate((np.ones(min(len(mine), 1), bool), mine[1:] != mine[:-1])))
                if not len(first):
                    continue
                several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
                weight = np.ceil(np.log2(np.add.reduceat(held, first))).astype(np.uint8)
                b, key = home[order][first], mine[first] & np.uint64(0xFFFFFFFF)
                cuts = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
                rows = [(int(b[i]), chunk, packed(steps(key[i:j]), np.packbits(several[i:j]), weight[i:j])) for i, j in zip(cuts, np.append(cuts[1:], len(b)))]
                yield pd.DataFrame(rows, columns=["bucket", "chunk", "keys"])

    return of


def shared_anchors(crowded: int):
    """Of each chunk's anchors in a bucket those that another document has too, and which of them are frequent: over `crowded` bytes in all chunks together."""
    def of(frame: pd.DataFrame) -> pd.DataFrame:
        parts = [unpacked(b) for b in frame["keys"]]
        each = [summed(k) for k, _, _ in parts]
        several = np.concatenate([np.unpackbits(b, count=len(k)) for k, (_, b, _) in zip(each, parts)])
        held = np.concatenate([np.exp2(w.astype(np.float64)) for _, _, w in parts])
        _, which, counts = np.unique(np.concatenate(each), return_inverse=True, return_counts=True)
        kept = ((counts > 1) | (np.bincount(which, several) > 0))[which]
        frequent = (np.bincount(which, held) > crowded)[which]
        ends = np.cumsum([len(k) for k in each])
        rows = [packed(steps(k[kept[j - len(k):j]]), np.packbits(frequent[j - len(k):j][kept[j - len(k):j]])) for k, j in zip(each, ends)]
        return pd.DataFrame({"chunk": frame["chunk"], "bucket": frame["bucket"], "keys": rows})

    return of


# --- stretches that may repeat -------------------------------------------------------------------------------------------------------

def longer(data: np.ndarray, s: Stretches, span: int) -> Stretches:
    """The stretches cut by anchors of nearly `span` bytes: what surrounds a frequent anchor tells its strings apart."""
    place = np.repeat(s.start, s.count) + np.arange(s.count.sum()) - np.repeat(np.cumsum(s.count) - s.count, s.count)
    home = np.repeat(np.arange(len(s.start)), s.count)
    anchor = anchors(data, span, span - 2)[place]
    first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (home[1:] != home[:-1]))))
    return Stretches(place[first], np.diff(np.append(first, len(place))), s.doc[home[first]], anchor[first])


def candidate_rows(buckets: int, span: int, index_buckets: int):
    """A chunk's occurrences (start, number of the content, starts of each content) in a bucket of their own below zero; its distinct contents by index bucket."""
    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for chunk, blob, shared in zip(frame["chunk"], frame["docs"], frame["shared"]):
                ids, null, sizes, body = unpacked(blob)
                data = np.frombuffer(body, np.uint8)
                s = stretches(data, sizes, span)
                known, often = [], []
                for r in shared:
                    planes, bits = unpacked(r["keys"])
                    known.append(np.uint64(r["bucket"]) << np.uint64(32) | summed(planes).astype(np.uint64))
                    often.append(np.unpackbits(bits, count=len(known[-1])).astype(bool))
                known, often = np.concatenate(known), np.concatenate(often)
                order = np.argsort(known)
                known, often = known[order], often[order]
                if not len(known):
                    continue
                mine = bucket_of(s.anchor, buckets).astype(np.uint64) << np.uint64(32) | low(s.anchor)
                at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
                keep = known[at] == mine

                def chosen(which: np.ndarray) -> Stretches:
                    return Stretches(s.start[which], s.count[which], s.doc[which], s.anchor[which])

                s, many = chosen(keep & ~often[at]), chosen(keep & often[at])
                if len(many.start):
                    many = longer(data, many, span)
                    s = Stretches(*(np.concatenate((getattr(s, k), getattr(many, k))) for k in ("start", "count", "doc", "anchor")))
                    s = chosen(np.argsort(s.start))
                number: dict[bytes, int] = {}
                which = np.fromiter((number.setdefault(body[i:j], len(number)) for i, j in zip(s.start.tolist(), (s.start + s.count + span - 1).tolist())), np.int32, len(s.start))
                if not len(which):
                    continue
                least = np.full(len(number), LAST)
                np.minimum.at(least, which, np.where(null, LAST, ids)[s.doc])
                _, rep = np.unique(which, return_index=True)
                n_starts = s.count[rep].astype(np.uint16)
                home = bucket_of(s.anchor[rep] * ODD, index_buckets)
                rows = [(chunk, -1 - chunk, packed(steps(s.start), np.diff(which, prepend=0), n_starts))]
                texts = list(number)
                by = np.argsort(home, kind="stable")
                cuts = np.flatnonzero(np.concatenate(([True], np.diff(home[by]) > 0)))
                for i, j in zip(cuts, np.append(cuts[1:], len(by))):
                    part = by[i:j]
                    rows.append((chunk, int(home[part[0]]), packed(steps(part), n_starts[part], least[part], b"".join([texts[x] for x in part]))))
                yield pd.DataFrame(rows, columns=["chunk", "bucket", "part"])

    return of


# --- the index -----------------------------------------------------------------------------------------------------------------------

class RunIndex:
    """Run-length BWT of texts over bytes, each ended by a symbol of its own, with the places of the rows at both ends of each run."""

    def __init__(self, texts: list[bytes], span: int):
        sizes = np.array([len(t) for t in texts], np.int64)
        joined = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
        self.begin = np.cumsum(sizes + 1) - sizes - 1
        ends, n = self.begin + sizes, len(joined)
        used = np.bincount(joined, minlength=256)
        used[0] -= len(texts)
        self.code = np.where(used > 0, np.cumsum(used > 0), 256)  # bytes in use are numbered from 1; 0 ends a text
        symbols = self.code[joined].astype(np.int16)
        symbols[ends] = 0
        self.symbols = symbols
        self.bits = max(1, int((used > 0).sum()).bit_length())
        self.wide = min(WIDE, span, 63 // self.bits)
        # the first symbols as one number; then rows still alike are sorted by what follows, twice as far each time
        number = np.repeat(np.arange(len(texts), dtype=np.int32), sizes + 1)
        self.rest = (np.repeat(ends, sizes + 1) - np.arange(n)).astype(np.int32)
        key, have = symbols.astype(np.int64), 1
        while have < self.wide:
            more = min(have, self.wide - have)
            later = np.zeros(n, np.int64)
            later[:max(n - have, 0)] = key[have:] >> self.bits * (have - more)
            key, have = key << self.bits * more | later, have + more
        self.key = key
        order = np.argsort(key)
        rank, new = np.empty(n, np.int32), np.concatenate(([True], np.diff(key[order]) != 0))
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), 0))  # place of the first row alike

        def refine(depth: int) -> None:
            alike = np.flatnonzero(~(new & np.append(new[1:], True)))
            rows = order[alike]
            k = rank[rows].astype(np.int64) * (n + 1) + np.where(rows + depth < n, rank[np.minimum(rows + depth, n - 1)] + 1, 0)
            by = np.argsort(k)
            rows, k = rows[by], k[by]
            order[alike], new[alike] = rows, np.concatenate((np.ones(min(len(k), 1), bool), np.diff(k) != 0))
            rank[rows] = np.maximum.accumulate(np.where(new[alike], alike, 0))

        self.ranks: dict[int, np.ndarray] = {self.wide: rank.copy()}
        depth = self.wide
        while depth < span or not new.all():
            refine(depth)
            depth *= 2
            if depth <= span:
                self.ranks[depth] = rank.copy()
        before = symbols[order - 1]  # of the first row's text the last symbol, an end
        starts = np.flatnonzero(np.concatenate(([True], before[1:] != before[:-1])))
        lengths = np.diff(np.append(starts, n))
        self.run_start, self.run_symbol = starts, before[starts].astype(np.int64)
        self.first_sample, self.last_sample = order[starts], order[starts + lengths - 1]  # places of the rows at both ends of each run
        by = np.argsort(self.run_symbol, kind="stable")
        through = np.concatenate(([0], np.cumsum(lengths[by])[:-1]))
        self.step = -starts
        self.step[by] += through  # how far a run's rows step: rows are in order of their first symbol
        self.length = lengths
        self.runs = len(starts)
        self.keyed = self.run_symbol[by] * self.runs + by
        self.by = by
        self.run_of = np.repeat(np.arange(self.runs, dtype=np.int32), lengths)
        near = np.flatnonzero(self.key[order[1:]] == self.key[order[:-1]])
        new = np.ones(n, bool)
        new[near + 1] = self.common(order[near], order[near + 1], span) < span
        block = np.flatnonzero(new)
        self.first_text = np.repeat(np.minimum.reduceat(number[order], block), np.diff(np.append(block, n)))  # for each row of a block of equal `span` symbols the first text

    def common(self, p: np.ndarray, q: np.ndarray, most: int) -> np.ndarray:
        """Symbols that the suffixes at p and q share, counted up to `most`."""
        out = np.zeros(len(p), np.int64)
        depths = sorted((d for d in self.ranks if d <= most), reverse=True)
        for depth in depths[:1] * (most // depths[0] if depths else 0) + depths[1:]:
            rank = self.ranks[depth]
            more = depth * ((rank[p] == rank[q]) & (self.rest[p] >= depth))
            out, p, q = out + more, p + more, q + more
        apart = self.key[p] ^ self.key[q]
        top = np.frexp((apart & ~(apart >> 1)).astype(np.float64))[1]  # bits up to the first that differs
        alike = (self.wide * self.bits - top) // self.bits
        return np.minimum(out + np.minimum(alike, np.minimum(self.rest[p], self.rest[q])), most)

    def matches(self, texts: list[bytes], span: int) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of every text, from its end to its start, capped at span: for each place of the joined texts the length of the match
        that starts there, and the first indexed text with it where the length is span (else -1)."""
        sizes = np.array([len(t) for t in texts], np.int64)
        query = self.code[np.frombuffer(b"".join(texts), np.uint8)]
        ends = np.cumsum(sizes)
        length_out, text_out = np.zeros(len(query), np.int64), np.full(len(query), -1)
        by_size = np.argsort(-sizes, kind="stable")
        sizes, ends = sizes[by_size], ends[by_size]
        row, length = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        place = np.full(len(texts), self.first_sample[0])
        for t in range(int(sizes.max(initial=0))):
            live = int(np.searchsorted(-sizes, -t, "left"))  # texts of more than t symbols come first
            at = ends[:live] - 1 - t
            c = query[at]
            r, p, m = row[:live], place[:live], length[:live]
            run = self.run_of[r]
            off = np.flatnonzero(self.run_symbol[run] != c)
            if len(off):
                # the nearest runs of the symbol above and below; the one whose suffix shares more goes on
                j = np.searchsorted(self.keyed, c[off] * self.runs + run[off])
                up, down = self.by[np.maximum(j - 1, 0)], self.by[np.minimum(j, self.runs - 1)]
                has_up = (j > 0) & (self.run_symbol[up] == c[off])
                has_down = (j < self.runs) & (self.run_symbol[down] == c[off])
                share_up = np.where(has_up, self.common(p[off], self.last_sample[up], min(t, span)), -1)  # no match is longer than what was read
                share_down = np.where(has_down, self.common(p[off], self.first_sample[down], min(t, span)), -1)
                higher = share_up >= share_down
                run[off] = np.where(higher, up, down)
                r[off] = np.where(higher, self.run_start[up] + self.length[up] - 1, self.run_start[down])
                p[off] = np.where(higher, self.last_sample[up], self.first_sample[down])
                m[off] = np.minimum(m[off], np.maximum(share_up, share_down))
            r += self.step[run]
            p -= 1
            np.minimum(m + 1, span, out=m)
            gone = off[~(has_up | has_down)] if len(off) else off  # a symbol that the index does not have
            r[gone], p[gone], m[gone] = 0, self.first_sample[0], 0
            length_out[at] = m
            full = np.flatnonzero(m == span)
            text_out[at[full]] = self.first_text[r[full]]
        return length_out, text_out


def least_orders(least: dict[bytes, int], span: int, at_once: int) -> tuple[dict[bytes, int], np.ndarray]:
    """Where each text begins among all texts' places, and for each place the least order of the string that starts there, read off indexes of about `at_once` bytes.

    Strings of different anchors are different, so texts meet only those of their own anchor, which go into one index.
    """
    texts = sorted(least, key=lambda t: (least[t], t))
    sizes = np.array([len(t) for t in texts], np.int64)
    piece = np.zeros(len(texts), np.int64)
    if sizes.sum() > at_once:
        joined = np.frombuffer(b"".join([t[:span] for t in texts]), np.uint8)
        anchor = anchors(joined, span)[::span]
        _, family = np.unique(anchor, return_inverse=True)
        through = np.cumsum(np.bincount(family, sizes))
        piece = (np.concatenate(([0], through[:-1])) // at_once).astype(np.int64)[family]
    out, begin, held = [], {}, 0
    for k in np.unique(piece).tolist():
        mine = [texts[i] for i in np.flatnonzero(piece == k)]
        _, found = RunIndex(mine, span).matches(mine, span)
        out.append(np.array([least[t] for t in mine], np.int64)[found])
        for t in mine:
            begin[t] = held
            held += len(t)
    return begin, np.concatenate(out)


def index_rows(span: int, at_once: int):
    """A bucket's contents against their index: for each chunk the numbers of its contents and the least document order of each of their `span`-byte strings, as runs. Occurrences go through."""
    def of(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        if key[0] < 0:
            return pd.DataFrame({"chunk": frame["chunk"], "found": False, "reply": frame["part"]})
        least: dict[bytes, int] = {}
        parts = []
        for blob in frame["part"]:
            numbers, count, order, text = unpacked(blob)
            ends = np.cumsum(count + np.int64(span - 1)).tolist()
            mine = [text[i:j] for i, j in zip([0, *ends[:-1]], ends)]
            parts.append((numbers, count.astype(np.int64), mine))
            for t, o in zip(mine, order.tolist()):
                if o < least.get(t, LAST + 1):
                    least[t] = o
        begin, orders = least_orders(least, span, at_once)
        replies = []
        for numbers, count, mine in parts:
            inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            out = orders[np.repeat(np.array([begin[t] for t in mine]), count) + inner]
            first = np.flatnonzero(np.concatenate(([True], out[1:] != out[:-1])))
            replies.append(packed(numbers, steps(first), out[first]))
        return pd.DataFrame({"chunk": frame["chunk"], "found": True, "reply": replies})

    return of


# --- removal -------------------------------------------------------------------------------------------------------------------------

REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start:long,end:long>>"


def removal_rows(span: int, bodies: bool):
    """Each document without the bytes of strings whose least order is below its own."""
    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for blob, replies in zip(frame["docs"], frame["replies"]):
                ids, null, sizes, body = unpacked(blob)
                data, ends = np.frombuffer(body, np.uint8), np.cumsum(sizes)
                gone = np.zeros(len(data), bool)
                if replies is not None:
                    start, which, count = next(unpacked(r["reply"]) for r in replies if not r["found"])
                    start, which, count = summed(start), np.cumsum(which), count.astype(np.int64)
                    doc = np.searchsorted(ends, start, "right")
                    begin = np.cumsum(count) - count
                    least = np.full(count.sum(), LAST)
                    for r in replies:
                        if r["found"]:
                            numbers, first, order = unpacked(r["reply"])
                            w = summed(numbers)
                            n = count[w]
                            place = np.repeat(begin[w], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                            least[place] = np.repeat(order, np.diff(np.append(summed(first), len(place))))
                    n = count[which]
                    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    own = np.where(null, LAST, ids)[np.repeat(doc, n)]
                    hit = (np.repeat(start, n) + inner)[least[np.repeat(begin[which], n) + inner] < own]
                    edge = np.bincount(hit, minlength=len(data) + 1) - np.bincount(hit + span, minlength=len(data) + 1)[:len(data) + 1]
                    gone = np.cumsum(edge[:len(data)]) > 0
                rows = []
                for i, (a, b) in enumerate(zip((ends - sizes).tolist(), ends.tolist())):
                    g = gone[a:b]
                    edges = np.flatnonzero(np.diff(np.concatenate(([False], g, [False])).astype(np.int8))).tolist()
                    kept = data[a:b][~g].tobytes() if edges else body[a:b]
                    rows.append((None if null[i] else int(ids[i]), b - a, b - a - len(kept), len(edges) // 2, hashlib.sha256(kept).hexdigest(), kept if bodies else None,
                                 [{"start": x, "end": y} for x, y in zip(edges[::2], edges[1::2])] if bodies else None))
                out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"])
                yield out.astype({"doc_id": "Int64"})

    return of


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 50, chunk_bytes: int = 4 << 20, crowded: int = 4 << 20, bodies: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (remaining bytes), spans (removed runs); the last two null without `bodies`.

    A byte goes if a `span`-byte string that covers it also starts in a document with a smaller id; strings lie within one document and are judged
    on the input. Null texts are empty. Texts shorter than span keep all bytes. Very long texts are a chunk of their own. Rows with one id are not
    smaller than each other, so they remove nothing from one another; null ids are larger than all others and equal among themselves. Other columns
    are not looked at. An empty table gives an empty one.

    Index tasks hold the distinct stretches of one bucket, in indexes of about `crowded` bytes. Stretches of an anchor with over `crowded` bytes in all
    chunks together are cut where an anchor of span - 2 bytes changes and dealt by that one: such an anchor has at most 3 * 65,536
    different strings, whatever the corpus, though each chunk sends its own copy of them.
    """
    # numbered partitions: rows are small and costly, so partitions are not to be joined for their size
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = bucketed(chunks(docs, id_col, text_col, chunk_bytes), "chunk", tasks)
    buckets = max(64, held.count())
    keys = held.mapInPandas(anchor_rows(buckets, span), "bucket long, chunk long, keys binary")
    common = keys.repartition(tasks, "bucket").groupBy("bucket").applyInPandas(shared_anchors(crowded), "chunk long, bucket long, keys binary")
    shared = common.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "keys")).alias("shared"))
    parts = held.join(shared.hint("shuffle_hash"), "chunk").mapInPandas(candidate_rows(buckets, span, 3 * buckets), "chunk long, bucket long, part binary")
    answers = parts.repartition(tasks, "bucket").groupBy("bucket").applyInPandas(index_rows(span, crowded), "chunk long, found boolean, reply binary")
    replies = answers.groupBy("chunk").agg(F.collect_list(F.struct("found", "reply")).alias("replies"))
    return held.join(replies.hint("shuffle_hash"), "chunk", "left").mapInPandas(removal_rows(span, bodies), REMOVED)
