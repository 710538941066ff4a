"""Masked pseudo-likelihood: a window network predicts every token from the tokens on both sides; the summed log-probabilities score documents."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, count, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelframe.llm.tokens import word_ids
from reelframe.session import staged

SIDE = 2
OFFSETS = [*range(-SIDE, 0), *range(1, SIDE + 1)]
HIDDEN = 16
#: places of a step; its arrays stay within the processor's caches
CHUNK = 2048
#: places scored at once, where the state stays as it is
SCORED = 4 * CHUNK
#: values of decisions near the root, which most tokens pass, are taken as one matrix product
TOP = 63
#: rows of a state that are averaged together
BLOCK = 1024


@dataclass
class Vocabulary:
    """Tokens 0 to len(counts) - 1: frequent words, pieces of all other words, and last the one for pieces that the corpus has none of."""

    words: dict[bytes, int]
    pieces: dict[int, int]
    counts: np.ndarray
    kinds: int  # pieces of the tokenizer, which share the last token's probability


class Tree:
    """Huffman tree over the counts: a token is reached by yes / no decisions at nodes 0 (root), 1, ... in the order of their counts."""

    def __init__(self, counts: np.ndarray):
        size = len(counts)
        leaves = np.argsort(counts, kind="stable").tolist()
        weight = counts.tolist() + [0] * (size - 1)
        parent, sign, odds = np.full(2 * size - 1, -1), np.zeros(2 * size - 1, np.int8), np.zeros(max(size - 1, 0), np.float32)
        a, b = 0, size  # next leaf and next inner node; both come in ascending order
        for new in range(size, 2 * size - 1):
            pair = []
            for _ in range(2):
                if a < size and (b >= new or weight[leaves[a]] <= weight[b]):
                    pair.append(leaves[a])
                    a += 1
                else:
                    pair.append(b)
                    b += 1
            left, right = pair
            weight[new] = weight[left] + weight[right]
            parent[left] = parent[right] = new
            sign[left], sign[right] = 1, -1
            odds[2 * size - 2 - new] = np.log(weight[left] / weight[right])
        self.odds, self.size = odds, size
        top = min(TOP, size - 1)
        self.top = np.zeros((size, top), np.int8)
        leaf, at, steps = np.arange(size), np.arange(size), []
        while len(leaf):
            more = parent[at] >= 0
            leaf, at = leaf[more], at[more]
            node = 2 * size - 2 - parent[at]
            high = node < top
            self.top[leaf[high], node[high]] = sign[at[high]]
            steps.append(np.stack((leaf[~high], node[~high], sign[at[~high]])))
            at = parent[at]
        self.slot, self.side = top_ways(self.top)
        deep = np.concatenate(steps, axis=1) if steps else np.zeros((3, 0), np.int64)
        deep = deep[:, np.argsort(deep[0], kind="stable")]
        self.node, self.sign = deep[1].astype(np.int32), deep[2].astype(np.int8)
        self.n = np.bincount(deep[0], minlength=size)
        self.start = np.cumsum(self.n) - self.n
        self.deepest = int(self.n.max(initial=0))

    def passed(self, seen: np.ndarray) -> np.ndarray:
        """How often each node was passed on the way to tokens seen so often."""
        out = np.bincount(self.node, np.repeat(seen, self.n), minlength=self.size - 1).astype(float)
        out[:self.top.shape[1]] += np.abs(self.top.astype(np.float32)).T @ seen
        return out


def top_ways(top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes above on the way to each token, and the decisions there, a column per token; shorter ways are filled up with a node after the last, where the decision is sure."""
    wide = max(int(np.abs(top).sum(1, dtype=np.int64).max(initial=0)), 1)
    slot, side = np.full((len(top), wide), top.shape[1], np.uint8), np.ones((len(top), wide), np.int8)
    token, node = np.nonzero(top)
    place = np.arange(len(token)) - np.searchsorted(token, token)
    slot[token, place], side[token, place] = node, top[token, node]
    return np.ascontiguousarray(slot.T), np.ascontiguousarray(side.T)


@dataclass
class Net:
    """A vector per token (one more for outside the text), a gain per place and number, and a vector per node of the tree, whose last number is its bias."""

    ctx: np.ndarray  # [tokens + 1, HIDDEN]
    gain: np.ndarray  # [2 SIDE + 1, HIDDEN], the last row is added
    node: np.ndarray  # [tokens - 1, HIDDEN]

    def arrays(self) -> list[np.ndarray]:
        return [self.ctx, self.gain, self.node]

    def rows(self) -> np.ndarray:
        """All numbers as one table, a row per token, place and node."""
        return np.concatenate(self.arrays())

    def of_rows(self, rows: np.ndarray) -> Net:
        a, b = len(self.ctx), len(self.ctx) + len(self.gain)
        return Net(rows[:a].copy(), rows[a:b].copy(), rows[b:].copy())


def new_net(tree: Tree, seed: int = 7) -> Net:
    """Small random vectors; the biases give the tokens' shares in the corpus."""
    rng = np.random.default_rng(seed)
    small = lambda n: (0.1 * rng.standard_normal((n, HIDDEN))).astype(np.float32)
    gain = np.concatenate((1 + small(2 * SIDE), np.zeros((1, HIDDEN), np.float32)))
    node = small(tree.size - 1)
    node[:, -1] = tree.odds
    return Net(small(tree.size + 1), gain, node)


def words_of(text: str) -> list[bytes]:
    """Lower-cased words in UTF-8; they end at ASCII white space."""
    return text.lower().encode("utf-8", "replace").split()


def runs(sizes: list[int], most: int) -> Iterator[slice]:
    """Runs of items of about `most` together; a larger item is a run of its own."""
    at, total = 0, 0
    for i, size in enumerate(sizes):
        if i > at and total + size > most:
            yield slice(at, i)
            at, total = i, 0
        total += size
    if sizes:
        yield slice(at, len(sizes))


def split_texts(texts: list[str | None], most: int = 1 << 20) -> Iterator[list[list[bytes]]]:
    """The words of each text, of some texts at a time."""
    for run in runs([len(t or "") for t in texts], most):
        yield [words_of(t or "") for t in texts[run]]


def numbered(split: list[list[bytes]], numbers: dict[bytes, int]) -> np.ndarray:
    return np.fromiter(map(numbers.__getitem__, chain.from_iterable(split)), np.int64, sum(map(len, split)))


def new_numbers(words: Iterable[bytes] = ()) -> dict[bytes, int]:
    """The words' places; every other word that is looked up gets the next number."""
    out = defaultdict(count().__next__)
    for word in words:
        out[word]
    return out


class Numbers:
    """The tokens of words; remembers about `room` words besides the frequent ones."""

    def __init__(self, vocabulary: Vocabulary, tokenizer: str, room: int = 500_000):
        self.frequent, self.room, self.cut = list(vocabulary.words), room, word_ids(tokenizer).of_words
        self.pieces = np.full(max(vocabulary.pieces, default=0) + 2, len(vocabulary.counts) - 1, "<i4")  # the last stands for all ids further on
        self.pieces[list(vocabulary.pieces)] = list(vocabulary.pieces.values())
        self.clear()

    def clear(self) -> None:
        """Forgets all but the frequent words."""
        self.words = new_numbers(self.frequent)
        self.tokens, self.start = np.arange(len(self.frequent), dtype="<i4"), np.arange(len(self.frequent) + 1)

    def learn(self) -> None:
        """Cuts the words that have a number but no tokens yet."""
        new = list(islice(reversed(self.words), len(self.words) + 1 - len(self.start)))[::-1]
        if new:
            ids, starts = self.cut(new)
            self.start = np.concatenate((self.start, self.start[-1] + np.append(starts[1:], len(ids))))
            self.tokens = np.concatenate((self.tokens, self.pieces.take(ids, mode="clip")))

    def of(self, texts: list[str | None]) -> list[bytes]:
        """The tokens of each text as little-endian 32-bit numbers."""
        out = []
        for split in split_texts(texts):
            number = numbered(split, self.words)
            self.learn()
            first = self.start.take(number)
            many = self.start.take(number + 1) - first
            ends = np.concatenate(([0], many.cumsum()))
            got = self.tokens.take(np.repeat(first - ends[:-1], many) + np.arange(ends[-1])).tobytes()
            cuts = (4 * ends[np.cumsum([0, *map(len, split)])]).tolist()
            out += [got[a:b] for a, b in zip(cuts, cuts[1:])]
            if len(self.words) > self.room + len(self.frequent):
                self.clear()
        return out


def padded(texts: list[bytes], mark: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts' tokens with SIDE marks around each, and how many each has."""
    gap = np.full(SIDE, mark, np.int32)
    parts = [gap]
    for t in texts:
        parts += [np.frombuffer(t, "<i4"), gap]
    return np.concatenate(parts), np.array([len(t) // 4 for t in texts], np.int64)


def yes(x: np.ndarray) -> np.ndarray:
    """Logistic function, in place. Values under -60, which would mean one in 1e26, are taken as -60."""
    np.maximum(x, -60, out=x)
    np.exp(np.negative(x, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


#: rows of one matrix product: too small for the linear algebra library to wake threads of its own, which take twice the processor time and save none
SLICE = 240


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b, in slices of a."""
    out = np.empty((len(a), b.shape[1]), np.float32)
    for i in range(0, len(a), SLICE):
        np.matmul(a[i:i + SLICE], b, out=out[i:i + SLICE])
    return out


def crossed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a.T @ b, summed over slices of rows."""
    return sum((a[i:i + SLICE].T @ b[i:i + SLICE] for i in range(0, len(a), SLICE)), np.zeros((a.shape[1], b.shape[1]), np.float32))


def above(net: Net, tree: Tree) -> np.ndarray:
    """Vectors of the nodes above, a column each, and last the one whose decision is sure."""
    top = tree.top.shape[1]
    out = np.zeros((HIDDEN, top + 1), np.float32)
    out[:, :top] = net.node[:top].T
    out[-1, top] = 100
    return out


class Pass:
    """The network at the tokens of places low to high of a padded stream: hidden values and the chance of each decision on the way to each token. Tokens come
    by falling number of decisions below the top, so that those with a further one are always the first."""

    def __init__(self, net: Net, tree: Tree, ids: np.ndarray, low: int, high: int):
        self.span = ids[low - SIDE:high + SIDE]
        self.given = net.ctx.take(self.span, axis=0)
        own = ids[low:high]
        at = np.flatnonzero(own != tree.size)
        deep = tree.n.take(own.take(at))
        self.at = at = at[np.argsort((tree.deepest - deep).astype(np.uint8), kind="stable")]
        self.target = own.take(at)
        n = high - low
        h = net.gain[0] * self.given[:n]
        h += net.gain[-1]
        for p, o in enumerate(OFFSETS[1:], 1):
            h += net.gain[p] * self.given[SIDE + o:SIDE + o + n]
        self.h = h.take(at, axis=0)
        np.tanh(self.h, out=self.h)
        self.h[:, -1] = 1
        top = tree.top.shape[1]
        values = product(self.h, above(net, tree))
        self.slot = tree.slot.take(self.target, axis=1).astype(np.int64)
        self.slot += np.arange(0, values.size, top + 1)
        self.side = tree.side.take(self.target, axis=1).T
        self.high = yes(values.take(self.slot) * self.side.T).T
        # how many tokens have a first, second, ... decision below the top
        ended = np.bincount(deep, minlength=1).cumsum()
        self.runs = (len(at) - ended[:-1]).tolist()
        first = tree.start.take(self.target)
        places = np.concatenate([first[:m] + k for k, m in enumerate(self.runs)] or [first[:0]])
        self.node, self.sign = tree.node.take(places), tree.sign.take(places)
        self.vectors = net.node.take(self.node, axis=0)
        self.hidden = np.concatenate([self.h[:m] for m in self.runs] or [self.h[:0]])
        self.low = np.einsum("ij,ij->i", self.vectors, self.hidden)
        self.low *= self.sign
        yes(self.low)

    def parts(self) -> Iterator[tuple[slice, int]]:
        """Of the first, second, ... decisions below the top: where they lie, and of how many tokens they are."""
        at = 0
        for m in self.runs:
            yield slice(at, at + m), m
            at += m


class Scorer:
    """log P(token | both sides) under a network that stays as it is: vectors times gains are taken from a table per place."""

    def __init__(self, net: Net, tree: Tree):
        self.net, self.tree, self.top = net, tree, above(net, tree)
        self.given = [net.ctx * g for g in net.gain[:-1]]
        self.given[0] += net.gain[-1]

    def of(self, ids: np.ndarray) -> np.ndarray:
        """Of every token of a padded stream, in its order, marks left out."""
        at = np.flatnonzero(ids != self.tree.size)
        return np.concatenate([np.zeros(0), *(self.part(ids, at[i:i + SCORED]) for i in range(0, len(at), SCORED))])

    def part(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        tree, target = self.tree, ids.take(at)
        h = self.given[0].take(ids.take(at + OFFSETS[0]), axis=0)
        for table, o in zip(self.given[1:], OFFSETS[1:]):
            h += table.take(ids.take(at + o), axis=0)
        np.tanh(h, out=h)
        h[:, -1] = 1
        values = product(h, self.top)
        slot = tree.slot.take(target, axis=1).astype(np.int64)
        slot += np.arange(0, values.size, values.shape[1])
        high = values.take(slot)
        high *= tree.side.take(target, axis=1)
        got = np.log(yes(high)).sum(0, dtype=np.float64)
        # below the top: one token's decisions after the other's
        n = tree.n.take(target)
        ends = n.cumsum()
        if ends[-1]:
            places = np.repeat(tree.start.take(target) - ends + n, n)
            places += np.arange(len(places))
            low = np.einsum("ij,ij->i", self.net.node.take(tree.node.take(places), axis=0), np.repeat(h, n, axis=0))
            low *= tree.sign.take(places)
            some = np.flatnonzero(n)
            got[some] += np.add.reduceat(np.log(yes(low)).astype(np.float64), (ends - n).take(some))
        return got


def token_scores(net: Net, tree: Tree, ids: np.ndarray) -> np.ndarray:
    """log P(token | both sides) of every token of a padded stream, in its order, marks left out."""
    return Scorer(net, tree).of(ids)


#: rows of so few keys or less are not summed side by side
FEW = 128


def summed(key: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys and the sums of their rows: keys by falling number of rows, so that those with a further row are always the first."""
    order = np.argsort(key.astype(np.uint16) if key.max() < 65536 else key, kind="stable")  # short numbers are sorted by digits
    ordered = key.take(order)
    firsts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    n = np.empty_like(firsts)
    np.subtract(firsts[1:], firsts[:-1], out=n[:-1])
    n[-1] = len(key) - firsts[-1]
    most = np.argsort((n.max() - n).astype(np.uint16), kind="stable") if n.max() < 65536 else np.argsort(-n, kind="stable")
    firsts, n = firsts.take(most), n.take(most)
    out = rows.take(order.take(firsts), axis=0)
    more = np.searchsorted(-n, -np.arange(1, n[0]), side="left")  # keys with more than 1, 2, ... rows
    done = int(np.count_nonzero(more >= FEW))
    for k, m in enumerate(more[:done].tolist(), 1):
        out[:m] += rows.take(order.take(firsts[:m] + k), axis=0)
    if done < len(more):
        n = n[:more[done]] - done - 1
        starts = np.cumsum(n) - n
        places = np.repeat(firsts[:len(n)] + done + 1 - starts, n) + np.arange(n.sum())
        out[:len(n)] += np.add.reduceat(rows.take(order.take(places), axis=0), starts, axis=0)
    return ordered.take(firsts), out


def put_rows(table: np.ndarray, place: np.ndarray, rows: np.ndarray) -> None:
    """table[place] = rows, each row as one item."""
    whole = f"V{rows.shape[1] * rows.itemsize}"
    table.view(whole).ravel()[place] = rows.view(whole).ravel()


class Trainer:
    """Adagrad on the negative log-likelihood, a step per CHUNK places."""

    def __init__(self, net: Net, tree: Tree, rate: float = 0.1):
        self.net, self.tree, self.rate = net, tree, rate
        self.past = [np.full_like(a, 1e-2) for a in net.arrays()]
        self.seen = np.zeros(tree.size + 1)

    def move(self, k: int, place, grad: np.ndarray) -> None:
        past, value = self.past[k], self.net.arrays()[k]
        if isinstance(place, slice):
            past[place] += grad * grad
            value[place] -= self.rate * grad / np.sqrt(past[place])
        else:
            got = grad * grad
            got += past.take(place, axis=0)
            put_rows(past, place, got)
            np.sqrt(got, out=got)
            grad *= -self.rate
            grad /= got
            grad += value.take(place, axis=0)
            put_rows(value, place, grad)

    def step(self, ids: np.ndarray, low: int, high: int) -> None:
        net, tree = self.net, self.tree
        p = Pass(net, tree, ids, low, high)
        n, top = len(p.at), tree.top.shape[1]
        if not n:
            return
        g = np.zeros((n, top + 1), np.float32)
        p.high -= 1
        p.high *= p.side
        p.high /= n
        g.reshape(-1)[p.slot.ravel()] = p.high.T.ravel()
        g = g[:, :top]
        moves = [(2, slice(0, top), crossed(g, p.h))]
        dh = product(g, net.node[:top])
        if len(p.node):
            e = (p.sign * (p.low - 1) / np.float32(n))[:, None]
            p.hidden *= e
            moves.append((2, *summed(p.node, p.hidden)))
            p.vectors *= e
            for part, m in p.parts():
                dh[:m] += p.vectors[part]
        dh *= 1 - p.h * p.h
        full = np.zeros((high - low, HIDDEN), np.float32)
        full[p.at] = dh
        gain, given = np.zeros_like(net.gain), np.zeros_like(p.given)
        gain[-1] = np.ones(n, np.float32) @ dh
        for k, o in enumerate(OFFSETS):
            side = slice(SIDE + o, SIDE + o + high - low)
            gain[k] = np.einsum("ij,ij->j", full, p.given[side])
            given[side] += net.gain[k] * full
        moves += [(1, slice(None), gain), (0, *summed(p.span, given))]
        for k, place, grad in moves:
            self.move(k, place, grad)

    def learn(self, ids: np.ndarray) -> None:
        self.seen += np.bincount(ids, minlength=len(self.seen))
        for low in range(SIDE, len(ids) - SIDE, CHUNK):
            self.step(ids, low, min(low + CHUNK, len(ids) - SIDE))

    def weights(self) -> np.ndarray:
        """How much was seen of what each row of the state is about."""
        return np.concatenate((self.seen, np.full(len(self.net.gain), self.seen[:-1].sum()), self.tree.passed(self.seen[:-1])))


def count_words(room: int = 400_000):
    """Counts of the words of a task's rows, given out whenever `room` different ones are held."""
    def of(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total = new_numbers(), np.zeros(0, np.int64)
        for frame in frames:
            for split in split_texts(frame["text"].to_pylist()):
                number = numbered(split, words)
                seen = np.bincount(number, minlength=len(words))
                seen[:len(total)] += total
                total = seen
                if len(words) >= room:
                    yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()), pa.array(total)], ["word", "n"])
                    words, total = new_numbers(), np.zeros(0, np.int64)
        if words:
            yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()), pa.array(total)], ["word", "n"])

    return of


def plain_texts(docs: DataFrame, text_col: str, *more) -> DataFrame:
    return docs.select(*more, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def corpus_vocabulary(docs: DataFrame, tokenizer: str, text_col: str = "text", entries: float = 300) -> Vocabulary:
    """Tokens and their counts, from every word of every text. The `entries` times fourth root of N most frequent of N words have tokens of their own
    (2.8e4 at 8e7 words, 6e5 at 1.6e13); all others are cut into the tokenizer's pieces. Those words and at most one count per piece come to the driver."""
    counts = staged(plain_texts(docs, text_col).mapInArrow(count_words(), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "pll-words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    top = counts.orderBy(F.desc("n"), "word").limit(int(np.ceil(entries * total ** 0.25))).collect()
    words = {bytes(r["word"]): i for i, r in enumerate(top)}
    held = docs.sparkSession.sparkContext.broadcast((words, tokenizer))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, of_words = held.value[0], word_ids(held.value[1]).of_words
        got = np.zeros(0, np.int64)
        for frame in frames:
            rare = np.array([word not in known for word in frame["word"]], bool)
            ids, starts = of_words(frame["word"][rare].tolist())
            times = np.repeat(frame["n"][rare].to_numpy(), np.diff(starts, append=len(ids)))
            more = np.zeros(max(len(got), int(ids.max(initial=0)) + 1), np.int64)
            more[:len(got)] = got
            np.add.at(more, ids, times)
            got = more
        yield pd.DataFrame({"piece": np.flatnonzero(got), "n": got[got > 0]})

    pieces = counts.mapInPandas(cut, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")).orderBy("piece").collect()
    numbers = {r["piece"]: len(words) + i for i, r in enumerate(pieces)}
    return Vocabulary(words, numbers, np.array([*(r["n"] for r in top), *(r["n"] for r in pieces), 1], float), tokenizer_size(tokenizer))


def tokenizer_size(tokenizer: str) -> int:
    import json

    return len(json.loads(tokenizer)["model"]["vocab"])


def tokens(docs: DataFrame, vocabulary: Vocabulary, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tokens (numbers of 32 bits, one after the other) of every row; written, since training and scoring read it."""
    held = docs.sparkSession.sparkContext.broadcast((vocabulary, tokenizer))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = Numbers(*held.value)
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64").array, "tokens": numbers.of(frame["text"].tolist())})

    rows = plain_texts(docs, text_col, F.col(id_col).cast("long").alias("doc_id"))
    return staged(rows.mapInPandas(cut, "doc_id long, tokens binary"), "pll-tokens")


def parts(texts: list[bytes], most: int = 64 * CHUNK) -> Iterator[list[bytes]]:
    """Runs of texts of about `most` tokens together; a longer text is a run of its own."""
    return (texts[run] for run in runs([len(t) // 4 for t in texts], most))


def train(rows: DataFrame, vocabulary: Vocabulary, fan_in: int = 32, rounds: int = 1) -> Net:
    """Every task trains on all tokens of its rows (of `tokens`) from the common state; then each row of the state is the mean over the tasks, weighted
    by how often a task saw its token or passed its node, so that what few tasks saw keeps its weight however many tasks there are.

    States are averaged in blocks of rows, `fan_in` tasks at a time; only the vocabulary and one state pass through the driver (128 bytes a token).
    """
    sc, tree = rows.sparkSession.sparkContext, Tree(vocabulary.counts)
    net = new_net(tree)
    for _ in range(rounds):
        held = sc.broadcast((tree, net))

        def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ways, start = held.value
            trainer = Trainer(Net(*(a.copy() for a in start.arrays())), ways)
            for frame in frames:
                for run in parts(frame["tokens"].tolist()):
                    trainer.learn(padded(run, ways.size)[0])
            weight, wide = trainer.weights().astype("<f4"), trainer.net.rows().astype("<f4")
            for i in range(0, len(wide), BLOCK):
                if weight[i:i + BLOCK].any():
                    yield pd.DataFrame({"block": [i // BLOCK], "weight": [weight[i:i + BLOCK].tobytes()], "state": [wide[i:i + BLOCK].tobytes()]})

        def mean(frame: pd.DataFrame) -> pd.DataFrame:
            weight = np.stack([np.frombuffer(w, "<f4") for w in frame["weight"]]).astype(float)
            state = np.stack([np.frombuffer(s, "<f4") for s in frame["state"]]).reshape(*weight.shape, -1)
            total = weight.sum(0)
            got = np.einsum("tr,trh->rh", weight / np.maximum(total, 1e-30), state)
            return pd.DataFrame({"block": frame["block"].iloc[:1], "weight": [total.astype("<f4").tobytes()], "state": [got.astype("<f4").tobytes()]})

        schema = "block int, weight binary, state binary"
        states = staged(rows.mapInPandas(learn, schema).withColumn("at", F.monotonically_increasing_id()), "pll-states")
        left = lambda: states.groupBy("block").count().agg(F.max("count")).first()[0] or 0
        most = left()
        while most > 1:
            grouped = states.withColumn("group", F.pmod(F.xxhash64("at"), F.lit(-(-most // fan_in))))
            states = staged(grouped.drop("at").groupBy("block", "group").applyInPandas(lambda frame: mean(frame), schema).withColumn("at", F.monotonically_increasing_id()), "pll-states")
            most = left()
        wide = net.rows()
        for r in states.select("block", "weight", "state").toLocalIterator():
            at = slice(r["block"] * BLOCK, (r["block"] + 1) * BLOCK)
            known = np.frombuffer(bytes(r["weight"]), "<f4") > 0
            wide[at][known] = np.frombuffer(bytes(r["state"]), "<f4").reshape(-1, HIDDEN)[known]
        net = net.of_rows(wide)
    return net


def score(rows: DataFrame, vocabulary: Vocabulary, net: Net) -> DataFrame:
    """One row per row of `tokens`: doc_id, n_tokens, pll (summed log-probability of every token given both sides), score (pll per token).

    Words are the lower-cased text's runs of other characters than ASCII white space; frequent ones are tokens, the others several. Pieces that the
    training texts have none of share one token's probability evenly. Null and empty texts have no tokens: pll 0, score null. Texts of any length are
    whole. Equal texts score the same up to rounding; null ids stay null; an empty table gives none; other columns are not looked at.
    """
    held = rows.sparkSession.sparkContext.broadcast((Tree(vocabulary.counts), net, np.log(vocabulary.kinds)))

    def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, state, even = held.value
        scorer = Scorer(state, tree)
        for frame in frames:
            at = 0
            for run in parts(frame["tokens"].tolist()):
                ids, n = padded(run, tree.size)
                got = scorer.of(ids) - even * (ids[ids != tree.size] == tree.size - 1)
                owner = np.repeat(np.arange(len(run)), n)
                yield pd.DataFrame({"doc_id": frame["doc_id"].iloc[at:at + len(run)].astype("Int64").array, "n_tokens": n, "pll": np.bincount(owner, got, minlength=len(run))})
                at += len(run)

    out = rows.mapInPandas(scored, "doc_id long, n_tokens long, pll double")
    return out.withColumn("score", F.when(F.col("n_tokens") > 0, F.col("pll") / F.col("n_tokens")))


def pseudo_likelihood(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", rounds: int = 1) -> DataFrame:
    """`score` of every row of docs under a network trained on all of them; `tokenizer` is the text of a byte-level BPE vocabulary file."""
    vocabulary = corpus_vocabulary(docs, tokenizer, text_col)
    rows = tokens(docs, vocabulary, tokenizer, id_col, text_col)
    return score(rows, vocabulary, train(rows, vocabulary, rounds=rounds))
