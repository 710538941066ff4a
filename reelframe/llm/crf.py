"""Document quality from a two-state linear-chain conditional random field over lines, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: characters looked at together; a longer line counts as several lines
PIECE = 1 << 21
LETTER, UPPER, DIGIT, SPACE, SYMBOL = 1, 2, 4, 8, 16
N_OWN = 22


@lru_cache(1)
def classes() -> np.ndarray:
    """Class bits of each character up to U+FFFE; the last entry is for all beyond."""
    out = np.full(1 << 16, SYMBOL, np.uint8)
    for i in range(0xFFFF):
        c = chr(i)
        if c.isspace():
            out[i] = SPACE
        elif c.isalpha():
            out[i] = LETTER | (UPPER if c.isupper() else 0)
        elif c.isdigit():
            out[i] = DIGIT
    return out


@lru_cache(1)
def powers() -> np.ndarray:
    return np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))


def pieces(line: str) -> Iterator[str]:
    """Parts of at most PIECE characters, cut after white space; only a word that is longer is cut itself. Parts of white space alone are left out."""
    at = 0
    while at < len(line):
        end = at + PIECE
        if end < len(line):
            while end > at and not line[end - 1].isspace():
                end -= 1
        end = end if end > at else at + PIECE
        piece, at = line[at:end], end
        if not piece.isspace():
            yield piece


def cut_lines(texts: list[str]) -> Iterator[tuple[list[str], list[int]]]:
    """Lines with more than white space and their documents' numbers, in pieces of about PIECE characters."""
    lines, owners, size = [], [], 0
    for i, text in enumerate(texts):
        for line in (text or "").split("\n"):
            if not line or line.isspace():
                continue
            for piece in pieces(line):
                lines.append(piece)
                owners.append(i)
                size += len(lines[-1]) + 1
                if size >= PIECE:
                    yield lines, owners
                    lines, owners, size = [], [], 0
    if lines:
        yield lines, owners


def line_features(lines: list[str], owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own features of each line, a hash of its words, its length."""
    a = np.frombuffer("\n".join(lines).encode("utf-32-le", "surrogatepass"), "<u4")
    kind = classes()[np.minimum(a, 0xFFFF)]
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes

    def per_line(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return sums[ends] - sums[starts]

    inside = kind != SPACE
    word_starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    word_of = np.cumsum(np.bincount(word_starts, minlength=len(a))) - 1
    place = np.minimum(np.arange(len(a)) - word_starts[np.maximum(word_of, 0)], 63)
    hashes = np.add.reduceat(np.where(inside, a.astype(np.uint64) * powers()[place], np.uint64(0)), word_starts)
    alnum = np.add.reduceat((kind & (LETTER | DIGIT) > 0).astype(np.int32), word_starts)
    line_of = np.searchsorted(ends, word_starts)
    n = len(lines)
    words = np.bincount(line_of, minlength=n)
    bare = np.bincount(line_of[alnum == 0], minlength=n)
    same = np.concatenate(([False], (hashes[1:] == hashes[:-1]) & (line_of[1:] == line_of[:-1])))
    again = np.bincount(line_of[same], minlength=n)
    first = np.unique(hashes * np.uint64(0x2545F4914F6CDD1D) + line_of.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03), return_index=True)[1]
    kinds = np.bincount(line_of[first], minlength=n)
    line_hash = np.add.reduceat(hashes * np.uint64(0x2545F4914F6CDD1D), np.searchsorted(line_of, np.arange(n)))

    w, size = np.maximum(words, 1), np.maximum(sizes, 1)
    letters, upper, digits, symbols = (per_line(kind & bit > 0) for bit in (LETTER, UPPER, DIGIT, SYMBOL))
    last = np.fromiter((x.rstrip()[-1:] in ".!?…:" for x in lines), bool, n)
    s, u, b, d, r = symbols / size, upper / np.maximum(letters, 1), bare / w, kinds / w, again / w
    few = words < 8  # shares of short lines say little
    x = np.stack([s, u, b, d, r, digits / size, np.log1p(sizes) / 10, last, per_line(inside) / w / 10, words < 3, s > 0.06, (s > 0.12) & ~few, s > 0.25, (u > 0.2) & ~few, u > 0.6,
                  b > 0.2, (d < 0.7) & ~few, d < 0.4, r > 0.15, r > 0.35, np.minimum(words, 50) / 50, few], axis=1)
    return x.astype(np.float32), line_hash, sizes


@dataclass
class Lines:
    """All lines of some documents in order: neighbour features, lengths, and each document's first line and number of lines."""

    x: np.ndarray
    sizes: np.ndarray
    first: np.ndarray
    count: np.ndarray


def lines_of(texts: list[str]) -> Lines:
    parts = [(np.array(owners), *line_features(lines, np.array(owners))) for lines, owners in cut_lines(texts)]
    if not parts:
        none = np.zeros(len(texts), np.int64)
        return Lines(np.zeros((0, 3 * N_OWN + 4), np.float32), np.zeros(0, np.int64), none, none)
    owner, own, hashes, sizes = (np.concatenate(x) for x in zip(*parts))
    count = np.bincount(owner, minlength=len(texts))
    key = hashes * np.uint64(0x9E3779B97F4A7C15) + owner.astype(np.uint64)
    _, at = np.unique(key, return_index=True)
    repeated = np.ones(len(owner), bool)
    repeated[at] = False
    edge = owner[1:] != owner[:-1]
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:] = np.where(edge[:, None], 0, own[:-1])
    after[:-1] = np.where(edge[:, None], 0, own[1:])
    has_before, has_after = np.concatenate(([False], ~edge)), np.concatenate((~edge, [False]))
    x = np.concatenate([own, before, after, np.stack([repeated, has_before, has_after, np.ones(len(owner))], axis=1)], axis=1).astype(np.float32)
    return Lines(x, sizes, np.cumsum(count) - count, count)


def chain(emission: np.ndarray, lines: Lines, step: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over every document: P(good) of each line, expected transitions [2, 2], log of the partition sum. emission: score of good over bad."""
    good, moves, total = np.zeros(len(emission)), np.zeros((2, 2)), 0.0
    sizes = np.ceil(np.log2(np.maximum(lines.count, 1))).astype(int)
    for group in np.unique(sizes[lines.count > 0]):
        docs = np.flatnonzero((sizes == group) & (lines.count > 0))
        for at in range(0, len(docs), max(1, (1 << 20) >> int(group))):
            part = docs[at:at + max(1, (1 << 20) >> int(group))]
            n, longest = lines.count[part], int(lines.count[part].max())
            rows = lines.first[part][:, None] + np.minimum(np.arange(longest), n[:, None] - 1)
            e, live = emission[rows], np.arange(longest) < n[:, None]
            grow = np.exp(step)
            ahead, scale = np.zeros((longest, len(part), 2)), np.zeros((longest, len(part)))
            bound = np.clip(e, -30, 30)
            local = np.stack([np.exp(-bound / 2), np.exp(bound / 2)], axis=2)
            now = local[:, 0] * np.exp([-start / 2, start / 2])
            for t in range(longest):
                if t:
                    now = np.where(live[:, t, None], ahead[t - 1] @ grow * local[:, t], ahead[t - 1])
                scale[t] = now.sum(1)
                ahead[t] = now / scale[t][:, None]
            total += float(np.log(np.where(live.T, scale, 1)).sum())
            back = np.ones((len(part), 2))
            for t in range(longest - 1, -1, -1):
                p = ahead[t] * back
                p /= p.sum(1, keepdims=True)
                good[rows[live[:, t], t]] = p[live[:, t], 1]
                if t:
                    pull = local[:, t] * back
                    pair = ahead[t - 1][:, :, None] * grow * pull[:, None, :]
                    moves += (pair / pair.sum((1, 2), keepdims=True))[live[:, t]].sum(0)
                    new = pull @ grow.T
                    back = np.where(live[:, t, None], new / new.sum(1, keepdims=True), back)
    return good, moves, total


@dataclass
class Model:
    weights: np.ndarray
    step: np.ndarray
    start: float
    slope: float = 1.0
    shift: float = 0.0
    prior: float = 0.5

    def line_marginals(self, lines: Lines) -> np.ndarray:
        return chain(lines.x @ self.weights, lines, self.step, self.start)[0]

    def raw(self, lines: Lines) -> np.ndarray:
        """Length-weighted mean marginal of each document; NaN for one without lines."""
        owner = np.repeat(np.arange(len(lines.count)), lines.count)
        size = np.bincount(owner, lines.sizes, minlength=len(lines.count))
        with np.errstate(invalid="ignore"):
            return np.bincount(owner, lines.sizes * self.line_marginals(lines), minlength=len(lines.count)) / size

    def score(self, texts: list[str]) -> np.ndarray:
        p = self.raw(lines_of(texts))
        p = 1 / (1 + np.exp(-(self.slope * logit(p) + self.shift)))
        return np.where(np.isnan(p), self.prior, p)


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit_lines(lines: Lines, y: np.ndarray, model: Model, rounds: int, decay: float = 1e-4, rate: float = 0.05) -> Model:
    """Conditional log-likelihood of the line labels by Adam; decay pulls the weights to zero."""
    inner = np.ones(len(y), bool)
    inner[lines.first[lines.count > 0]] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[at - 1], y[at]), 1)
    heads = y[lines.first[lines.count > 0]]
    theta = np.concatenate([model.weights, model.step.ravel(), [model.start]])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    k = len(model.weights)
    for t in range(1, rounds + 1):
        step = theta[k:k + 4].reshape(2, 2)
        p, moves, _ = chain(lines.x @ theta[:k], lines, step, theta[-1])
        g = np.concatenate([lines.x.T @ (y - p), (seen - moves).ravel(), [(heads - p[lines.first[lines.count > 0]]).sum()]]) / max(1, len(y)) - decay * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return Model(theta[:k], theta[k:k + 4].reshape(2, 2), float(theta[-1]))


def fit(texts: list[str], labels: np.ndarray, rounds: int = 120, turns: int = 2) -> Model:
    """Lines first bear their document's label. Then, `turns` times, lines of bad documents that the field holds to be good are taken as good, except
    the worst line of each, and the field is fitted again. Last, documents' mean marginals are turned to probabilities by a logistic fit."""
    lines = lines_of(texts)
    labels = np.asarray(labels, int)
    prior = (labels.sum() + 1) / (len(labels) + 2)
    model = Model(np.zeros(3 * N_OWN + 4), np.zeros((2, 2)), 0.0)
    owner = np.repeat(np.arange(len(texts)), lines.count)
    if len(owner):
        y = labels[owner]
        model = fit_lines(lines, y, model, rounds)
        for _ in range(turns):
            p = model.line_marginals(lines)
            worst = np.full(len(texts), np.inf)
            np.minimum.at(worst, owner, p)
            y = np.where(labels[owner] == 1, 1, (p > 0.8) & (p > worst[owner])).astype(int)
            model = fit_lines(lines, y, model, rounds // 2)
        z = logit(model.raw(lines))
        some = ~np.isnan(z)
        model.slope, model.shift = logistic(z[some], labels[some])
    model.prior = float(prior)
    return model


def logistic(z: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Newton steps for P(y) = 1 / (1 + exp(-(slope z + shift))), slightly drawn to zero; the slope is kept positive."""
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w, e = p * (1 - p), p - y
        g = np.array([(e * z).sum() + 0.1 * a, e.sum() + 0.1 * b])
        h = np.array([[(w * z * z).sum() + 0.1, (w * z).sum()], [(w * z).sum(), w.sum() + 0.1]])
        da, db = np.linalg.solve(h + 1e-6 * np.eye(2), g)
        size = max(1.0, abs(da), abs(db))
        a, b = a - da / size, b - db / size
    return max(float(a), 1e-3), float(b)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_docs: int = 3000, sample_chars: int = 20_000) -> Model:
    """Model fitted on at most `sample_docs` labelled documents that are not held out and have at most `sample_chars` characters, the first by a hash of
    their id. Null labels are passed over; of several labels for an id the smallest counts. Without labelled rows every document gets the prior."""
    marked = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    marked = marked.groupBy(F.col(id_col).alias("_id")).agg(F.min(F.col(label_col)).alias("_label"))
    marked = marked.orderBy(F.xxhash64("_id"), "_id").limit(2 * sample_docs)  # broadcast: bounded by the parameter
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")).filter(F.length("_text") <= sample_chars)
    rows = rows.join(F.broadcast(marked), "_id").orderBy(F.xxhash64("_id"), "_id", "_text").limit(sample_docs).collect()
    return fit([r["_text"] for r in rows], np.array([int(r["_label"] > 0) for r in rows], int))


def scorer(model: Model, batch: int = 256):
    @pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        texts = [t or "" for t in text]
        return pd.Series(np.concatenate([model.score(texts[i:i + batch]) for i in range(0, len(texts), batch)] or [np.zeros(0)]))

    return score


def quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1, higher: better), predicted (1 from 0.5 on).

    The score is the mean of the marginals of all lines of the whole text, each weighted by its length and seen with its neighbours, put through
    the fitted logistic curve. Texts without a line that has more than white space, null ones too, get the share of good documents in
    training. Rows with a null id are scored and not held out; equal texts get equal scores; other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("body"))
    rows = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scorer(model)("body").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
