"""Plain versions of what had none: the language model's training and scores, and the order in which packing fills windows."""

import math
import random

import numpy as np
import pytest

from loomspark.llm import language_id, packing


def subwords_by_hand(text):
    data, out = text.lower().encode(), [0] * language_id.BUCKETS
    for n in language_id.ORDERS:
        for i in range(len(data) - n + 1):
            h = 0
            for k in range(n):
                h = (h * 263 + data[i + k] + k + 1) % 2**32
            out[(h * 2654435761 % 2**32) >> (32 - int(math.log2(language_id.BUCKETS)))] += 1
    return out


def test_subwords_by_hand():
    for text in ("", "a", "Ab", "Größe and more of it, 123", "x" * 50):
        assert language_id.subwords(text).tolist() == subwords_by_hand(text)


def loss_of(embed, soft, bias, x, y):
    total = 0.0
    for row, k in zip(x, y, strict=True):
        mean = [sum(row[b] * embed[b][w] for b in range(len(row))) for w in range(len(embed[0]))]
        z = [sum(mean[w] * soft[w][c] for w in range(len(mean))) + bias[c] for c in range(len(bias))]
        top = max(z)
        total += math.log(sum(math.exp(v - top) for v in z)) + top - z[k]
    return total / len(y)


def slope(f, a):
    """The gradient of f at the array a, by differences."""
    out = np.zeros_like(a)
    for i in np.ndindex(a.shape):
        held = a[i]
        a[i] = held + 1e-5
        up = f()
        a[i] = held - 1e-5
        out[i] = (up - f()) / 2e-5
        a[i] = held
    return out


def test_training_goes_down_the_slope_of_the_loss(monkeypatch):
    """Two steps of the training against steps along a gradient that is taken by differences."""
    for name, value in (("BUCKETS", 8), ("WIDTH", 3), ("EPOCHS", 2), ("BATCH", 100), ("RATE", 1.5)):
        monkeypatch.setattr(language_id, name, value)
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 5, (9, 8)) + np.eye(8, dtype=int)[np.arange(9) % 8]
    names = ["de", "en", "fr"] * 3
    rows = [(np.flatnonzero(c), c[np.flatnonzero(c)]) for c in counts]
    model = language_id.train(names, language_id.Shares(rows), np.zeros(9, bool))
    x, y = counts / counts.sum(axis=1, keepdims=True), [k % 3 for k in range(9)]
    embed = np.random.default_rng(7).normal(0, 1 / 3, (8, 3)).astype(np.float32).astype(float)
    soft, bias = np.zeros((3, 3)), np.zeros(3)
    f = lambda: loss_of(embed, soft, bias, x, y)
    for epoch in range(2):
        step = 1.5 * (1 - epoch / 2)
        down = [slope(f, a) for a in (embed, soft, bias)]
        embed -= step * down[0]
        soft -= 0.05 * step * down[1]
        bias -= 0.01 * step * down[2]
    assert np.allclose(model.weights, embed @ soft, atol=1e-5) and np.allclose(model.bias, bias, atol=1e-5)
    # The temperature is the one of the grid under which the documents are likeliest.
    logits = x @ (embed @ soft) + bias
    likely = lambda t: -sum(logits[i][k] / t - math.log(sum(math.exp(v / t) for v in logits[i])) for i, k in enumerate(y))
    grid = [2.0 ** (e / 4) for e in range(-16, 13)]
    assert model.temperature == min(grid, key=likely) and model.langs == ["de", "en", "fr"]


def test_scores_by_hand():
    rng = np.random.default_rng(2)
    model = language_id.Model(["a", "b", "c"], rng.normal(size=(language_id.BUCKETS, 3)).astype(np.float32), np.array([0.1, 0, -0.2], np.float32), 0.7, 0.4)
    texts = ["some words", "Größe", "?!", None, "x"]
    lang, score, rejected = model.predict(texts)
    for k, t in enumerate(texts):
        if t is None or not any(c.isalpha() for c in t):
            assert (lang[k], score[k], rejected[k]) == ("und", 0.0, True)
            continue
        counts = subwords_by_hand(t)
        z = [(sum(n / sum(counts) * float(model.weights[b][c]) for b, n in enumerate(counts)) + float(model.bias[c])) / 0.7 for c in range(3)]
        p = [math.exp(v) / sum(map(math.exp, z)) for v in z]
        assert lang[k] == "abc"[p.index(max(p))] and abs(score[k] - max(p)) < 1e-4 and rejected[k] == (max(p) < 0.4)


def packed_by_hand(lengths, rests, df, n_docs, window):
    """Windows by the rule alone: whole windows of long documents, then each seed with its neighbours by falling score."""
    out = [[(i, lo, window)] for i, n in enumerate(lengths) for lo in range(0, n - n % window, window)]
    live = [i for i, n in enumerate(lengths) if n % window]
    mean = sum(len(rests[i]) for i in live) / max(len(live), 1)
    idf = lambda t: max(0.0, math.log((n_docs - df[t] + 0.5) / (df[t] + 0.5)))

    def score(seed, k):
        doc, total = rests[k].tolist(), 0.0
        for t in sorted(set(rests[seed].tolist())):
            tf = doc.count(t)
            if tf and idf(t) > 0:
                total += idf(t) * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(doc) / mean))
        return total

    left, start = {i: lengths[i] % window for i in live}, {i: lengths[i] - lengths[i] % window for i in live}
    while any(left.values()):
        seed = next(i for i in live if left[i])
        near = sorted((i for i in live if left[i] and i != seed and score(seed, i) > 0), key=lambda i: -score(seed, i))
        rest = [i for i in live if left[i] and i != seed and i not in near]
        row, room = [], window
        for i in [seed, *near, *[i for i in rest if i > seed]]:
            n = min(room, left[i])
            if n:
                row.append((i, start[i], n))
                left[i], start[i], room = left[i] - n, start[i] + n, room - n
        out.append(row)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_windows_are_filled_in_the_order_of_the_rule(seed):
    rnd = random.Random(seed)
    window, vocabulary = rnd.choice([8, 16, 40]), 60
    docs = [np.array([rnd.choice([rnd.randrange(8), rnd.randrange(vocabulary)]) for _ in range(rnd.randrange(1, 2 * window + 5))]) for _ in range(40)]
    df = np.array([sum(t in d for d in docs) for t in range(vocabulary)])
    lengths, rests = [len(d) for d in docs], [d[len(d) - len(d) % window :] for d in docs]
    got = list(packing.pack_shard(lengths, rests, df, len(docs), window))
    assert got == packed_by_hand(lengths, rests, df, len(docs), window)
    assert sum(n for w in got for _, _, n in w) == sum(lengths) and all(sum(n for *_, n in w) == window for w in got[:-1])
