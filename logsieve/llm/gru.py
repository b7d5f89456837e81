"""A gated recurrent language model in numpy with a class-factored output.

Token ids: 0 is the end of a text, 1..HEAD-1 frequent words, HEAD.. the tail
classes (rarer words by their endings). A word's probability is
P(class | state) * P(word | class, state); inside a tail class the second factor
is not the model's. Head words lie in ``GROUPS`` classes of ``WIDE`` words.

Texts run side by side in lanes. A lane's state is carried from window to window
and set to zero where a text begins; gradients stop at a window's edge.
"""

from __future__ import annotations

import numpy as np

GROUPS, WIDE, TAILS = 32, 64, 32
HEAD = GROUPS * WIDE
TOKENS = HEAD + TAILS
CLASSES = GROUPS + TAILS
HIDDEN = 16
WINDOW = 32
_SHAPES = {
    "e": (TOKENS, HIDDEN), "wx": (HIDDEN, 3 * HIDDEN), "b": (3 * HIDDEN,), "u": (HIDDEN, 3 * HIDDEN),
    "wc": (HIDDEN, CLASSES), "bc": (CLASSES,), "wo": (GROUPS, HIDDEN, WIDE), "bo": (GROUPS, WIDE),
}
SIZE = sum(int(np.prod(s)) for s in _SHAPES.values())


def views(flat: np.ndarray) -> dict[str, np.ndarray]:
    """Named parameters as views of one flat array."""
    out, at = {}, 0
    for name, shape in _SHAPES.items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def start(counts: np.ndarray, seed: int = 7) -> np.ndarray:
    """Parameters before training: small weights, biases of the tokens' frequencies."""
    random = np.random.default_rng(seed)
    flat = random.normal(0, 0.1, SIZE).astype(np.float32)
    p = views(flat)
    p["e"][:] = random.normal(0, 0.5, p["e"].shape)
    p["wx"][:] = random.normal(0, 0.35, p["wx"].shape)
    p["u"][:] = random.normal(0, 0.25, p["u"].shape)
    p["b"][:] = 0
    smooth = counts.astype(np.float64) + 0.5
    head = smooth[:HEAD].reshape(GROUPS, WIDE)
    p["bo"][:] = np.log(head / head.sum(axis=1, keepdims=True))
    classes = np.concatenate([head.sum(axis=1), smooth[HEAD:]])
    p["bc"][:] = np.log(classes / classes.sum())
    p["wc"][:] *= 0.1
    p["wo"][:] *= 0.1
    return flat


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, -1, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def lanes_of(sizes: list[int], wide: int) -> list[list[int]]:
    """Texts dealt to at most ``wide`` lanes, longest first, each to the shortest lane; longest lane first."""
    import heapq

    heap = [(0, i) for i in range(min(wide, len(sizes)))]
    lanes: list[list[int]] = [[] for _ in heap]
    total = [0] * len(heap)
    for text in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        n, lane = heapq.heappop(heap)
        lanes[lane].append(text)
        total[lane] = n + sizes[text]
        heapq.heappush(heap, (total[lane], lane))
    return [lanes[i] for i in sorted(range(len(lanes)), key=lambda i: -total[i])]


class Windows:
    """Texts (id arrays, each ending in 0) as windows of (inputs, targets, resets, active lanes)."""

    def __init__(self, texts: list[np.ndarray], wide: int):
        lanes = lanes_of([len(t) for t in texts], wide)
        self.lanes, self.texts = lanes, texts
        self.long = [sum(len(texts[i]) for i in lane) for lane in lanes]
        steps = self.long[0] if lanes else 0
        self.targets = np.zeros((steps, len(lanes)), dtype=np.int16)
        self.resets = np.zeros((steps, len(lanes)), dtype=bool)
        for k, lane in enumerate(lanes):
            at = 0
            for i in lane:
                self.targets[at : at + len(texts[i]), k] = texts[i]
                self.resets[at, k] = True
                at += len(texts[i])
        self.inputs = np.zeros_like(self.targets)
        self.inputs[1:] = self.targets[:-1]
        self.inputs[self.resets] = 0
        ends = np.array(self.long)
        self.active = np.searchsorted(-ends, -np.arange(steps), side="left")  # lanes longer than each step

    def __iter__(self):
        for at in range(0, len(self.targets), WINDOW):
            yield at, min(at + WINDOW, len(self.targets))


def run_window(p, proj, w: Windows, at: int, to: int, h: np.ndarray, keep: bool):
    """States after each step, and what the backward pass needs.

    Arrays are laid out (hidden, lanes), so that each gate is a block of long rows.
    """
    H, steps, n0 = HIDDEN, to - at, int(w.active[at])
    states = np.zeros((steps, H, n0), dtype=np.float32)
    kept = []
    u_zr, u_n = p["u"][:, : 2 * H].T.copy(), p["u"][:, 2 * H :].T.copy()
    h = h[:, :n0]
    for t in range(steps):
        n = int(w.active[at + t])
        if n < h.shape[1]:
            h = np.ascontiguousarray(h[:, :n])
        reset = w.resets[at + t, :n]
        if reset.any():
            h = h.copy()
            h[:, reset] = 0
        x = proj.take(w.inputs[at + t, :n], axis=1)
        zr = u_zr @ h
        zr += x[: 2 * H]
        zr = _sigmoid(zr)
        z, r = zr[:H], zr[H:]
        hn = u_n @ h
        c = r * hn
        c += x[2 * H :]
        np.tanh(c, out=c)
        new = h - c
        new *= z
        new += c
        states[t, :, :n] = new
        if keep:
            kept.append((h, z, r, hn, c, reset))
        h = new
    return states, kept, h


_ONES = np.ones(max(CLASSES, WIDE), dtype=np.float32)


def _bound(scores: np.ndarray) -> None:
    """Bring scores into the range of exp: as a whole, or row by row where they spread too far."""
    high = scores.max(initial=0)
    if high - scores.min(initial=0) > 60:
        scores -= scores.max(axis=1, keepdims=True)
    elif high > 20:
        scores -= high


#: Each token's class.
_GROUP = np.concatenate([np.arange(HEAD) // WIDE, np.arange(TAILS) + GROUPS]).astype(np.int16)


def output(p, h: np.ndarray, y: np.ndarray, grad: bool):
    """log P of targets' class, and of head words within it; gradients on demand.

    h: rows of states; y: their token ids. Tail tokens have only the class's part.
    Rows are put in the order of their classes first, so that each class is a slice.
    """
    order = np.argsort(_GROUP[y], kind="stable")
    h, y = h[order], y[order]
    group = _GROUP[y]
    rows = np.arange(len(y))
    scores = h @ p["wc"]
    scores += p["bc"]
    _bound(scores)
    picked = scores[rows, group]
    np.exp(scores, out=scores)
    total = scores @ _ONES[:CLASSES]
    logs = picked - np.log(total)
    g = {}
    if grad:
        scores *= np.reciprocal(total)[:, None]
        scores[rows, group] -= 1
        g["wc"], g["bc"] = h.T @ scores, _ONES[:1].repeat(len(y)) @ scores
        dh = scores @ p["wc"].T
        g["wo"], g["bo"] = np.zeros_like(p["wo"]), np.zeros_like(p["bo"])
    cuts = np.searchsorted(group, np.arange(GROUPS + 1)).tolist()
    for k, (low, high) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if low == high:
            continue
        hk, local, r = h[low:high], y[low:high] - k * WIDE, rows[: high - low]
        inner = hk @ p["wo"][k]
        inner += p["bo"][k]
        _bound(inner)
        got = inner[r, local]
        np.exp(inner, out=inner)
        s = inner @ _ONES[:WIDE]
        logs[low:high] += got - np.log(s)
        if grad:
            inner *= np.reciprocal(s)[:, None]
            inner[r, local] -= 1
            g["wo"][k], g["bo"][k] = hk.T @ inner, inner.sum(axis=0)
            dh[low:high] += inner @ p["wo"][k].T
    back = np.empty_like(order)
    back[order] = rows
    return (logs[back], dh[back], g) if grad else (logs[back], None, None)


def score(flat: np.ndarray, texts: list[np.ndarray], wide: int = 512) -> np.ndarray:
    """Natural log-likelihood of each text (tail words up to their class)."""
    p, w = views(flat), Windows(texts, wide)
    proj = np.ascontiguousarray((p["e"] @ p["wx"] + p["b"]).T)
    logs = np.zeros(w.targets.shape, dtype=np.float32)
    h = np.zeros((HIDDEN, len(w.lanes)), dtype=np.float32)
    for at, to in w:
        states, _, h = run_window(p, proj, w, at, to, h, False)
        n = states.shape[2]
        live = np.arange(n)[None, :] < w.active[at:to, None]
        found, _, _ = output(p, states.transpose(0, 2, 1)[live], w.targets[at:to, :n][live].astype(np.int64), False)
        part = np.zeros(live.shape, dtype=np.float32)
        part[live] = found
        logs[at:to, :n] = part
    out = np.zeros(len(texts))
    for k, lane in enumerate(w.lanes):
        at = 0
        for i in lane:
            out[i] = logs[at : at + len(texts[i]), k].sum(dtype=np.float64)
            at += len(texts[i])
    return out


class Trainer:
    """Truncated backpropagation with per-coordinate (Adagrad) steps."""

    def __init__(self, flat: np.ndarray, before: np.ndarray | None = None, rate: float = 0.1, wide: int = 256):
        self.flat = flat.copy()
        self.p = views(self.flat)
        self.sum = np.full(SIZE, 1e-4, dtype=np.float32) if before is None else before.copy()
        self.s, self.rate, self.wide = views(self.sum), rate, wide
        self.tokens, self.loss = 0, 0.0

    def _step(self, name: str, g: np.ndarray, at=slice(None)) -> None:
        s = self.s[name]
        s[at] += g * g
        self.p[name][at] -= self.rate * g / np.sqrt(s[at])

    def learn(self, texts: list[np.ndarray]) -> None:
        p, w, H = self.p, Windows(texts, self.wide), HIDDEN
        h = np.zeros((H, len(w.lanes)), dtype=np.float32)
        # one scale for all windows: where few lanes are left, steps are small
        scale = np.float32(1 / (max(1, len(w.lanes)) * WINDOW))
        for at, to in w:
            proj = np.ascontiguousarray((p["e"] @ p["wx"] + p["b"]).T)
            states, kept, h = run_window(p, proj, w, at, to, h, True)
            n = states.shape[2]
            live = np.arange(n)[None, :] < w.active[at:to, None]
            rows = states.transpose(0, 2, 1)[live]
            logs, dh, g = output(p, rows, w.targets[at:to, :n][live].astype(np.int64), True)
            self.tokens += len(rows)
            self.loss -= float(logs.sum())
            later = np.zeros((to - at, n, H), dtype=np.float32)
            later[live] = dh
            later = np.ascontiguousarray(later.transpose(0, 2, 1))
            da = np.zeros((to - at, 3 * H, n), dtype=np.float32)
            du = np.zeros_like(p["u"])
            u_zr, u_n = p["u"][:, : 2 * H], p["u"][:, 2 * H :]
            back = np.zeros((H, n), dtype=np.float32)
            for t in range(to - at - 1, -1, -1):
                h0, z, r, hn, c, reset = kept[t]
                m = h0.shape[1]
                d = later[t, :, :m] + back[:, :m]
                a = np.empty((3 * H, m), dtype=np.float32)
                dc = d * z
                np.subtract(d, dc, out=dc)
                dc -= dc * c * c
                a[2 * H :] = dc
                dz = h0 - c
                dz *= d
                dr = dc * hn
                gates = z - z * z
                np.multiply(dz, gates, out=a[:H])
                gates = r - r * r
                np.multiply(dr, gates, out=a[H : 2 * H])
                dc *= r
                du[:, : 2 * H] += h0 @ a[: 2 * H].T
                du[:, 2 * H :] += h0 @ dc.T
                d *= z
                d += u_zr @ a[: 2 * H]
                d += u_n @ dc
                if reset.any():
                    d[:, reset] = 0
                da[t, :, :m] = a
                back[:, :m] = d
                if m < n:
                    back[:, m:] = 0
            da = da.transpose(0, 2, 1)
            flat_a, ids = da[live], w.inputs[at:to, :n][live]
            order = np.argsort(ids, kind="stable")
            seen, first = np.unique(ids[order], return_index=True)
            summed = np.add.reduceat(flat_a[order], first, axis=0)  # of each input token
            summed *= scale
            np.clip(summed, -1, 1, out=summed)
            of_e, of_wx = summed @ p["wx"].T, p["e"][seen].T @ summed
            self._step("wx", of_wx)
            self._step("b", summed.sum(axis=0))
            self._step("e", of_e, seen)
            self._step("u", np.clip(du * scale, -1, 1))
            for name in ("wc", "bc", "wo", "bo"):
                self._step(name, g[name] * scale)
