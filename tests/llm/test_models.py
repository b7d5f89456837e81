"""The trained models against plain loops."""

import math

import numpy as np
import pytest

from logsieve.llm import ftrl, gru, quality, toxicity

TEXTS = [
    b"good clean prose about rivers and hills", b"BUY NOW!!! click click click", b"", b"a", b"rivers and hills, again and again",
    b"click here now now now !!! 99", "Grüße aus dem Tal, Tal und Hügel".encode(), b"one two three four five six seven",
]
LABELS = [1, 0, 0, 1, 1, 0, 1, 1]


def plain_rows(module, binary):
    """Each text's feature values as a dict, counted one occurrence at a time."""
    out = []
    for text in TEXTS:
        ids, _, scale = module.features([text])
        row = {}
        for i in ids.tolist():
            row[i] = 1.0 if binary else row.get(i, 0.0) + float(scale[0])
        out.append(row)
    return out


def plain_weight(z, n, m):
    if abs(z) <= m.l1:
        return 0.0
    return -(z - math.copysign(m.l1, z)) / ((m.beta + math.sqrt(n)) / m.alpha + m.l2)


def plain_fit(rows, m):
    z, n = {}, {}
    for _ in range(m.epochs):
        for row, label in zip(rows, LABELS, strict=True):
            row = {**row, "bias": 1.0}
            w = {i: plain_weight(z.get(i, 0.0), n.get(i, 0.0), m) for i in row}
            p = 1 / (1 + math.exp(-sum(w[i] * x for i, x in row.items())))
            for i, x in row.items():
                g, old = (p - label) * x, n.get(i, 0.0)
                n[i] = old + g * g
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n[i]) - math.sqrt(old)) / m.alpha * w[i]
    return {i: w for i in z if (w := plain_weight(z[i], n[i], m))}


@pytest.mark.parametrize(("module", "l1"), [(quality, 0.05), (toxicity, 0.2)])
def test_ftrl_and_sparse_products(module, l1):
    binary = module.MODEL.binary
    model = ftrl.Ftrl(alpha=0.5, l1=l1, l2=0.01, epochs=3, binary=binary)
    rows = plain_rows(module, binary)
    wanted = plain_fit(rows, model)
    found = ftrl.fit_rows(ftrl.rows_of(module.features, TEXTS, binary), LABELS, model)
    bias = 1 << ftrl.BITS
    assert {i if i != bias else "bias" for i in np.flatnonzero(found).tolist()} == set(wanted)
    assert all(math.isclose(found[bias if i == "bias" else i], w, rel_tol=1e-4, abs_tol=1e-6) for i, w in wanted.items())
    scores = ftrl.score_texts(TEXTS, module.features, found, binary)
    for row, s in zip(rows, scores, strict=True):
        total = wanted.get("bias", 0.0) + sum(wanted.get(i, 0.0) * x for i, x in row.items())
        assert math.isclose(s, 1 / (1 + math.exp(-total)), rel_tol=1e-4)


def some_model(seed=3):
    random = np.random.default_rng(seed)
    flat = gru.start(random.integers(0, 50, gru.TOKENS).astype(float))
    return flat + random.normal(0, 0.05, gru.SIZE).astype(np.float32)


def plain_score(flat, ids):
    """One text, one unit at a time."""
    p = {k: v.astype(np.float64) for k, v in gru.views(flat).items()}
    H, h, last, total = gru.HIDDEN, np.zeros(gru.HIDDEN), 0, 0.0
    for token in ids.tolist():
        x = p["e"][last] @ p["wx"] + p["b"]
        new = np.zeros(H)
        for j in range(H):
            z = 1 / (1 + math.exp(-(x[j] + h @ p["u"][:, j])))
            r = 1 / (1 + math.exp(-(x[H + j] + h @ p["u"][:, H + j])))
            c = math.tanh(x[2 * H + j] + r * (h @ p["u"][:, 2 * H + j]))
            new[j] = (1 - z) * c + z * h[j]
        h = new
        classes = h @ p["wc"] + p["bc"]
        group = token // gru.WIDE if token < gru.HEAD else gru.GROUPS + token - gru.HEAD
        total += classes[group] - np.log(np.exp(classes).sum())
        if token < gru.HEAD:
            inner = h @ p["wo"][group] + p["bo"][group]
            total += inner[token % gru.WIDE] - np.log(np.exp(inner).sum())
        last = token
    return total


def test_scores_are_those_of_plain_loops():
    random, flat = np.random.default_rng(5), some_model()
    texts = [np.append(random.integers(1, gru.TOKENS, n), 0) for n in (0, 3, 40, 90)]
    assert np.allclose(gru.score(flat, texts, 2), [plain_score(flat, t) for t in texts], rtol=1e-4)


def test_probabilities_add_up():
    flat = some_model()
    h = np.random.default_rng(1).normal(0, 1, gru.HIDDEN).astype(np.float32)
    logs, _, _ = gru.output(gru.views(flat), np.tile(h, (gru.TOKENS, 1)), np.arange(gru.TOKENS), False)
    assert math.isclose(np.exp(logs.astype(np.float64)).sum(), 1, rel_tol=1e-4)


def test_gradients_are_finite_differences():
    """Within one window; steps are made from the squares that they leave."""
    random, flat = np.random.default_rng(6), some_model()
    texts = [np.append(random.integers(1, gru.TOKENS, n), 0) for n in (7, 15, 20, 25)]
    trainer = gru.Trainer(flat, np.full(gru.SIZE, 1e-2, dtype=np.float32), rate=1e-3, wide=4)
    trainer.learn(texts)
    gradient = -(trainer.flat - flat).astype(np.float64) * np.sqrt(trainer.sum) / 1e-3 * (4 * gru.WINDOW)
    names, at = {}, 0
    for name, shape in gru._SHAPES.items():
        names[name] = np.arange(at, at + int(np.prod(shape)))
        at += int(np.prod(shape))
    for name, places in names.items():
        for i in places[np.argsort(-abs(gradient[places]))[:4]]:
            up, down = flat.copy(), flat.copy()
            up[i] += 0.02
            down[i] -= 0.02
            slope = -sum(plain_score(up, t) - plain_score(down, t) for t in texts) / 0.04
            assert math.isclose(gradient[i], slope, rel_tol=0.05, abs_tol=0.02), name
