"""A character-level bidirectional LSTM with CRF transitions, in numpy: training, decoding, confidence.

It tags windows of character classes with O, or B and I of a kind. Gradients are exact: back-propagation
through both directions, and CRF marginals by forward-backward. Everything is seeded, so equal windows train
equal models.
"""

from __future__ import annotations

import string

import numpy as np

Weights = dict[str, np.ndarray]

EMBEDDING, HIDDEN = 12, 24
PAD, DIGIT, LOWER, UPPER, OTHER, CONTROL = range(6)
_MARKS = " " + string.punctuation
N_CLASSES = CONTROL + 1 + len(_MARKS)


def _classes() -> np.ndarray:
    table = np.full(257, OTHER, np.int64)
    table[:32] = CONTROL
    for chars, number in ((string.digits, DIGIT), (string.ascii_lowercase, LOWER), (string.ascii_uppercase, UPPER)):
        table[[ord(c) for c in chars]] = number
    for i, c in enumerate(_MARKS):
        table[ord(c)] = CONTROL + 1 + i
    return table


_TABLE = _classes()


def classes_of(text: str) -> np.ndarray:
    """The class of every code point."""
    return _TABLE[np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), 256)]


def _new(tags: int, draw: np.random.Generator) -> Weights:
    def normal(*shape):
        return (draw.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)

    w = {"embedding": 0.5 * draw.normal(size=(N_CLASSES, EMBEDDING)).astype(np.float32)}
    for side in ("f", "b"):
        w |= {f"{side}_in": normal(EMBEDDING, 4 * HIDDEN), f"{side}_rec": normal(HIDDEN, 4 * HIDDEN)}
        w[f"{side}_bias"] = np.zeros(4 * HIDDEN, np.float32)
        w[f"{side}_bias"][HIDDEN : 2 * HIDDEN] = 1  # forget gates start open
    w |= {"out": normal(2 * HIDDEN, tags), "out_bias": np.zeros(tags, np.float32)}
    return w | {"move": np.zeros((tags, tags), np.float32)}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lstm(w: Weights, side: str, x: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """x: (step, window, feature) -> hidden states, and what the way back needs."""
    steps, n, _ = x.shape
    ahead = x @ w[f"{side}_in"] + w[f"{side}_bias"]
    h = c = np.zeros((n, HIDDEN), np.float32)
    out, tape = np.empty((steps, n, HIDDEN), np.float32), []
    for t in range(steps):
        z = ahead[t] + h @ w[f"{side}_rec"]
        gates, new = _sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        before = (h, c)
        c = f * c + i * new
        flat = np.tanh(c)
        h = o * flat
        out[t] = h
        if keep:
            tape.append((i, f, o, new, flat, *before))
    return out, tape


def _lstm_back(w: Weights, side: str, x: np.ndarray, tape: list, d_out: np.ndarray, grads: Weights) -> np.ndarray:
    rec, d_z = w[f"{side}_rec"], np.empty((*x.shape[:2], 4 * HIDDEN), np.float32)
    d_h = d_c = np.zeros(d_out.shape[1:], np.float32)
    d_rec = np.zeros_like(rec)
    for t in range(len(x) - 1, -1, -1):
        i, f, o, new, flat, h, c = tape[t]
        d_h = d_h + d_out[t]
        d_c = d_c + d_h * o * (1 - flat**2)
        d = d_z[t]
        d[:, :HIDDEN] = d_c * new * i * (1 - i)
        d[:, HIDDEN : 2 * HIDDEN] = d_c * c * f * (1 - f)
        d[:, 2 * HIDDEN : 3 * HIDDEN] = d_h * flat * o * (1 - o)
        d[:, 3 * HIDDEN :] = d_c * i * (1 - new**2)
        d_rec += h.T @ d
        d_h, d_c = d @ rec.T, d_c * f
    grads[f"{side}_rec"] = d_rec
    grads[f"{side}_in"] = np.tensordot(x, d_z, ((0, 1), (0, 1)))
    grads[f"{side}_bias"] = d_z.sum(axis=(0, 1))
    return d_z @ w[f"{side}_in"].T


def _emissions(w: Weights, windows: np.ndarray, keep: bool = False):
    x = w["embedding"][windows.T]
    forth, tape_f = _lstm(w, "f", x, keep)
    back, tape_b = _lstm(w, "b", x[::-1], keep)
    hidden = np.concatenate([forth, back[::-1]], axis=2)
    return hidden @ w["out"] + w["out_bias"], (x, hidden, tape_f, tape_b)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def _alphas_betas(emissions: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    alpha, beta = np.empty_like(emissions), np.zeros_like(emissions)
    alpha[0] = emissions[0]
    for t in range(1, len(emissions)):
        alpha[t] = emissions[t] + _log_sum(alpha[t - 1][:, :, None] + move, 1)
    for t in range(len(emissions) - 2, -1, -1):
        beta[t] = _log_sum(move + (emissions[t + 1] + beta[t + 1])[:, None, :], 2)
    return alpha, beta


def loss_and_gradients(w: Weights, windows: np.ndarray, tags: np.ndarray) -> tuple[float, Weights]:
    """Mean negative log-likelihood of the tags (window, step), and its gradients."""
    emissions, (x, hidden, tape_f, tape_b) = _emissions(w, windows, True)
    gold, n, move = tags.T, len(windows), w["move"]
    alpha, beta = _alphas_betas(emissions, move)
    total = _log_sum(alpha[-1], 1)
    at = np.arange(n)
    path = sum(emissions[t][at, gold[t]] for t in range(len(gold)))
    path = path + sum(move[gold[t - 1], gold[t]] for t in range(1, len(gold)))
    d_e = np.exp(alpha + beta - total[:, None])
    d_move = np.zeros_like(move)
    for t in range(len(gold)):
        d_e[t][at, gold[t]] -= 1
        if t:
            pair = alpha[t - 1][:, :, None] + move + (emissions[t] + beta[t])[:, None, :] - total[:, None, None]
            d_move += np.exp(pair).sum(axis=0)
            np.subtract.at(d_move, (gold[t - 1], gold[t]), 1)
    d_e, d_move = d_e.astype(np.float32) / n, d_move / n
    grads = {"move": d_move, "out": np.tensordot(hidden, d_e, ((0, 1), (0, 1))), "out_bias": d_e.sum(axis=(0, 1))}
    d_hidden = d_e @ w["out"].T
    d_x = _lstm_back(w, "f", x, tape_f, d_hidden[:, :, :HIDDEN], grads)
    d_x = d_x + _lstm_back(w, "b", x[::-1], tape_b, d_hidden[::-1, :, HIDDEN:], grads)[::-1]
    grads["embedding"] = np.zeros_like(w["embedding"])
    np.add.at(grads["embedding"], windows.T, d_x)
    return float((total - path).mean()), grads


def train(windows: np.ndarray, tags: np.ndarray, n_tags: int, *, epochs: int = 8, batch: int = 64, rate: float = 0.01) -> Weights:
    """Adam over shuffled batches, the rate falling to zero."""
    draw = np.random.default_rng(7)
    w = _new(n_tags, draw)
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    steps, done = epochs * -(-len(windows) // batch), 0
    for _ in range(epochs):
        order = draw.permutation(len(windows))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            _, grads = loss_and_gradients(w, windows[rows], tags[rows])
            done += 1
            norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
            scale, now = min(1.0, 5 / (norm + 1e-9)), rate * (1 - (done - 1) / steps)
            for k, g in grads.items():
                g = g * scale
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                w[k] -= (now * first[k] / (1 - 0.9**done) / (np.sqrt(second[k] / (1 - 0.99**done)) + 1e-8)).astype(np.float32)
    return w


def decode(w: Weights, windows: np.ndarray, batch: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """The best path of each window (window, step), and the marginal probability of its tags."""
    paths, sure = [], []
    for at in range(0, len(windows), batch):
        emissions, _ = _emissions(w, windows[at : at + batch])
        steps, n, _ = emissions.shape
        best, came = emissions[0], []
        for t in range(1, steps):
            scores = best[:, :, None] + w["move"]
            came.append(scores.argmax(axis=1))
            best = scores.max(axis=1) + emissions[t]
        path = np.empty((steps, n), np.int64)
        path[-1] = best.argmax(axis=1)
        for t in range(steps - 2, -1, -1):
            path[t] = came[t][np.arange(n), path[t + 1]]
        alpha, beta = _alphas_betas(emissions, w["move"])
        total = _log_sum(alpha[-1], 1)
        marginal = np.exp(alpha + beta - total[:, None])
        paths.append(path.T)
        sure.append(np.take_along_axis(marginal, path[:, :, None], 2)[:, :, 0].T)
    return np.concatenate(paths), np.concatenate(sure)
