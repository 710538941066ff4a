import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from reelframe.llm import pll
from reelframe.llm.queries import vocabulary_path
from reelframe.llm.tokens import word_ids


@pytest.fixture(scope="module")
def tokenizer():
    with open(vocabulary_path(), encoding="utf-8") as f:
        return f.read()


def small(size=300, seed=3):
    counts = np.random.default_rng(seed).integers(1, 50, size).astype(float)
    tree = pll.Tree(counts)
    return counts, tree, pll.new_net(tree, seed)


def test_tree_is_a_huffman_tree():
    counts, tree, _ = small(200)
    depth = np.abs(tree.top).sum(1) + tree.n
    assert abs((0.5 ** depth).sum() - 1) < 1e-9  # a full binary tree
    p = counts / counts.sum()
    entropy = -(p * np.log2(p)).sum()
    assert entropy <= (p * depth).sum() < entropy + 1
    assert (tree.passed(counts)[1:] <= tree.passed(counts)[:-1] + 1e-6).all() and tree.passed(counts)[0] == counts.sum()


def test_untrained_probabilities_are_the_shares():
    counts, tree, net = small()
    net.node[:, :-1] = 0
    ids = pll.padded([np.arange(300, dtype="<i4").tobytes()], 300)[0]
    assert np.allclose(np.exp(pll.token_scores(net, tree, ids)), counts / counts.sum(), rtol=1e-3)


@pytest.mark.parametrize("size", [1, 2, 40, 300])
def test_probabilities_sum_to_one(size):
    _, tree, net = small(size)
    total = 0.0
    for w in range(size):
        ids = np.array([size, size, 0, w, size - 1, size, size], np.int32)
        total += np.exp(pll.token_scores(net, tree, ids)[1])
    assert abs(total - 1) < 1e-4


def test_gradient_lowers_the_loss_like_finite_differences():
    _, tree, net = small()
    rng = np.random.default_rng(5)
    ids = pll.padded([rng.integers(0, 300, 40).astype("<i4").tobytes() for _ in range(2)], 300)[0]
    seen = {}

    class Watch(pll.Trainer):
        def move(self, k, place, grad):
            seen.setdefault(k, []).append((place, grad.copy()))

    Watch(net, tree).step(ids, pll.SIDE, len(ids) - pll.SIDE)
    loss = lambda: -pll.token_scores(net, tree, ids).mean()
    for k, a in enumerate(net.arrays()):
        full = np.zeros_like(a)
        for place, g in seen[k]:
            full[place] += g
        spot = np.unravel_index(np.argmax(np.abs(full)), a.shape)
        step, old = np.float32(2e-2), a[spot]
        a[spot] = old + step
        up = loss()
        a[spot] = old - step
        down = loss()
        a[spot] = old
        assert abs((up - down) / (2 * step) - full[spot]) < 0.05 * abs(full[spot]) + 1e-4, k


def test_chances_only_of_decisions_on_the_way():
    """A token's chances are as many as its own decisions, or those on the longest way above; not one for each node above."""
    _, tree, net = small()
    ids = pll.padded([np.random.default_rng(6).integers(0, 300, 500).astype("<i4").tobytes()], 300)[0]
    p = pll.Pass(net, tree, ids, pll.SIDE, len(ids) - pll.SIDE)
    assert p.high.shape == (500, np.abs(tree.top).sum(1).max()) and tree.top.shape[1] == pll.TOP
    assert len(p.low) == tree.n[ids[2:502]].sum() and np.array_equal(np.sort(p.target), np.sort(ids[2:502]))


@pytest.mark.parametrize("size, n", [(1, 900), (5, 2000), (400, 3000), (100_000, 500)])
def test_sums_by_key(size, n):
    """One key for all rows, some keys with many rows and many with few, keys beyond 16 bits."""
    rng = np.random.default_rng(8)
    key, rows = (size * rng.random(n) ** 4).astype(np.int32), rng.standard_normal((n, 16)).astype(np.float32)
    want = np.zeros((size, 16))
    np.add.at(want, key, rows)
    keys, got = pll.summed(key, rows)
    assert sorted(keys) == sorted(set(key.tolist())) and np.abs(got - want[keys]).max() < 1e-3


def by_hand(vocabulary, net, tokenizer, text):
    """pll of a text from the definition: walks from the root with a list of decisions per token, one token at a time."""
    heap = [(c, i) for i, c in enumerate(vocabulary.counts)]
    assert len(heap) > 2
    tree = pll.Tree(vocabulary.counts)
    ways = {t: [(n, int(s)) for n, s in enumerate(tree.top[t]) if s] + [(int(tree.node[i]), int(tree.sign[i])) for i in range(tree.start[t], tree.start[t] + tree.n[t])] for t in range(tree.size)}
    ids = []
    for word in text.lower().encode().split():
        ids += [vocabulary.words[word]] if word in vocabulary.words else [vocabulary.pieces.get(i, tree.size - 1) for i in word_ids(tokenizer).ids(" " + word.decode())]
    full, total = [tree.size] * 2 + ids + [tree.size] * 2, 0.0
    for i, t in enumerate(ids, 2):
        h = np.tanh(net.gain[4] + sum(net.gain[k] * net.ctx[full[i + o]] for k, o in enumerate((-2, -1, 1, 2))))
        h[-1] = 1  # a node's last number is its bias
        total += sum(-math.log1p(math.exp(-s * float(net.node[n] @ h))) for n, s in ways[t])
        total -= math.log(vocabulary.kinds) if t == tree.size - 1 else 0
    return len(ids), total


def test_whole_documents_score_as_by_hand(table, tokenizer, prose):
    texts = [prose(i, 300, 3000) for i in range(12)]
    docs = table(list(enumerate(texts)))
    known = pll.corpus_vocabulary(docs, tokenizer, entries=3)
    net = pll.train(pll.tokens(docs, known, tokenizer), known)
    asked = [(1, texts[0]), (2, f"{texts[1]} Zyxé 漢字"), (3, "one"), (None, texts[2]), (1, texts[3][:50])]
    got = pll.score(pll.tokens(table(asked), known, tokenizer), known, net).collect()
    want = [(i, *by_hand(known, net, tokenizer, t)) for i, t in asked]
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(i), n) for i, n, _ in want)
    assert np.allclose(sorted(r.pll for r in got), sorted(p for _, _, p in want), rtol=1e-4)
    assert known.words and known.pieces and (np.array([0]) < known.counts).all()


def test_learns_both_sides(table, tokenizer):
    """The middle word follows from its neighbours on both sides together, from neither alone."""
    rng = random.Random(1)
    left, right = ["aa", "bb", "cc"], ["xx", "yy", "zz"]
    middle = {(a, b): f"m{i}{j}" for i, a in enumerate(left) for j, b in enumerate(right)}

    def text(true):
        out = []
        for _ in range(60):
            a, b = rng.choice(left), rng.choice(right)
            out += [a, middle[a, b] if true else rng.choice(list(middle.values())), b]
        return " ".join(out)

    docs = table([(i, text(True)) for i in range(600)], parts=2)
    known = pll.corpus_vocabulary(docs, tokenizer)
    net = pll.train(pll.tokens(docs, known, tokenizer), known, rounds=6)
    got = {r.doc_id: r for r in pll.score(pll.tokens(table([(1, text(True)), (2, text(False)), (3, "q w e r t z u i")]), known, tokenizer), known, net).collect()}
    assert got[1].score > got[2].score + 0.3
    assert got[1].n_tokens == 180 and abs(got[1].pll - 180 * got[1].score) < 1e-6
    assert got[3].score < got[1].score


def test_odd_rows(table, odd, tokenizer):
    df = pll.pseudo_likelihood(table(odd), tokenizer)
    assert df.columns == ["doc_id", "n_tokens", "pll", "score"]
    rows = df.collect()
    assert len(rows) == len(odd)
    assert all((r.n_tokens, r.pll, r.score) == (0, 0.0, None) for r in rows if r.doc_id in (1, 2, 3))
    assert len({round(r.score, 4) for r in rows if r.n_tokens >= 60_000}) == 1
    assert pll.pseudo_likelihood(table([]), tokenizer).collect() == []


def test_counts_are_of_all_words_and_pieces(table, prose, tokenizer):
    texts = [prose(i, 500, 3000) for i in range(10)]
    known = pll.corpus_vocabulary(table(list(enumerate(texts))), tokenizer, entries=5)
    words = Counter(" ".join(texts).encode().split())
    assert len(known.words) == math.ceil(5 * 5000 ** 0.25) and all(known.counts[i] == words[w] for w, i in known.words.items())
    assert min(words[w] for w in known.words) >= max(n for w, n in words.items() if w not in known.words)
    pieces = Counter()
    for w, n in words.items():
        if w not in known.words:
            for i in word_ids(tokenizer).ids(" " + w.decode()):
                pieces[i] += n
    assert {i: known.counts[t] for i, t in known.pieces.items()} == pieces


def test_the_vocabulary_grows_with_the_corpus(table, prose, tokenizer):
    few, many = (pll.corpus_vocabulary(table([(i, prose(i, 500, 3000)) for i in range(n)]), tokenizer, entries=5) for n in (2, 32))
    assert len(many.words) >= 2 * len(few.words) - 2


def test_two_splits_agree(table, prose, tokenizer):
    """Tasks train on their own rows, so scores depend on the split: by under 5 % of a token's log-probability, and in like order."""
    rows = [(i, prose(i, 2000, 3000 if i % 2 else 30)) for i in range(60)]
    got = []
    for n in (1, 6):
        docs = table(rows, parts=n)
        got.append({r.doc_id: r.score for r in pll.pseudo_likelihood(docs, tokenizer).collect()})
    a, b = (np.array([g[i] for i in range(60)]) for g in got)
    assert np.abs(a - b).max() < 0.05 * np.abs(a).mean()


def test_words_forgotten_on_the_way_change_nothing(tokenizer, prose):
    """A task's table of words starts anew many times; tokens and counts are as with room for all, and words are cut together, not one by one."""
    texts = [f"{prose(i, 60, 3000)} Zyx\u00e9 \u6f22\u5b57 only{i}" * (i % 3) for i in range(40)] + [None, "", " \t", "a\x1cb\u0085c", "x" * (1 << 20), "one more"]
    words = Counter(w for t in texts for w in pll.words_of(t or ""))
    frequent = [w for w, _ in words.most_common(20)]
    ids = word_ids(tokenizer).ids
    seen = sorted({i for w in list(words)[:200] for i in ids(" " + w.decode())})
    known = pll.Vocabulary({w: i for i, w in enumerate(frequent)}, {p: 20 + i for i, p in enumerate(seen)}, np.ones(21 + len(seen)), 50_000)
    want = [b"".join(np.array([known.words[w]] if w in known.words else [known.pieces.get(i, 20 + len(seen)) for i in ids(" " + w.decode())], "<i4").tobytes() for w in pll.words_of(t or "")) for t in texts]
    for room in (0, 50, 10_000):
        numbers, cuts, of_words = pll.Numbers(known, tokenizer, room), [], word_ids(tokenizer).of_words
        numbers.cut = lambda new: (cuts.append(new), of_words(new))[1]
        assert [t for i in range(0, len(texts), 8) for t in numbers.of(texts[i:i + 8])] == want
        assert len(cuts) <= 9
        got = Counter()
        for part in pll.count_words(room)(pa.RecordBatch.from_pydict({"text": [t or "" for t in texts[i:i + 8]]}) for i in range(0, len(texts), 8)):
            got.update(dict(zip(part["word"].to_pylist(), part["n"].to_pylist())))
        assert got == words
