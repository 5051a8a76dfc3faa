"""A character-level bidirectional LSTM with CRF transitions, trained and run in numpy."""

from __future__ import annotations

import numpy as np

#: Code points below this have their own input, all others share one; 0 pads.
ALPHABET = 128


def encode(text: str) -> np.ndarray:
    return np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), ALPHABET).astype(np.int64) + 1


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Tagger:
    """Emissions from both directions' hidden states, transitions between tags; batches are (windows, characters)."""

    def __init__(self, tags: int, embed: int = 12, hidden: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        init = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.hidden = hidden
        self.p = {"e": init(ALPHABET + 2, embed) * 3, "out": init(2 * hidden, tags), "out_b": np.zeros(tags, np.float32), "trans": np.zeros((tags, tags), np.float32)}
        for d in "fb":
            self.p |= {f"w{d}": init(embed, 4 * hidden), f"u{d}": init(hidden, 4 * hidden), f"b{d}": np.zeros(4 * hidden, np.float32)}
            self.p[f"b{d}"][hidden:2 * hidden] = 1

    def _direction(self, d: str, x: np.ndarray, mask: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        n, length, _ = x.shape
        size = self.hidden
        inputs = x @ self.p[f"w{d}"] + self.p[f"b{d}"]
        h, c = np.zeros((n, size), np.float32), np.zeros((n, size), np.float32)
        out, tape = np.zeros((n, length, size), np.float32), []
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            z = inputs[:, t] + h @ self.p[f"u{d}"]
            gates, g = _sigmoid(z[:, : 3 * size]), np.tanh(z[:, 3 * size:])
            i, f, o = gates[:, :size], gates[:, size:2 * size], gates[:, 2 * size:]
            before, c = c, (f * c + i * g) * mask[:, t, None]
            tc = np.tanh(c)
            if keep:
                tape.append((t, h, before, i, f, o, g, tc))
            h = o * tc * mask[:, t, None]
            out[:, t] = h
        return out, tape

    def emissions(self, chars: np.ndarray) -> np.ndarray:
        x, mask = self.p["e"][chars], (chars > 0).astype(np.float32)
        both = np.concatenate([self._direction("f", x, mask, False)[0], self._direction("b", x, mask, False)[0]], 2)
        return both @ self.p["out"] + self.p["out_b"]

    def step(self, chars: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tag sequences, and its gradients."""
        p, n, length = self.p, *chars.shape
        x, mask = p["e"][chars], (chars > 0).astype(np.float32)
        forward, tape_f = self._direction("f", x, mask, True)
        backward, tape_b = self._direction("b", x, mask, True)
        both = np.concatenate([forward, backward], 2)
        em = both @ p["out"] + p["out_b"]
        loss, d_em, d_trans = self._crf(em, mask, tags)
        grads = {"trans": d_trans, "out": both.reshape(n * length, -1).T @ d_em.reshape(n * length, -1), "out_b": d_em.sum((0, 1))}
        d_both = d_em @ p["out"].T
        d_x = np.zeros_like(x)
        for d, tape, dh_out in (("f", tape_f, d_both[..., : self.hidden]), ("b", tape_b, d_both[..., self.hidden:])):
            dh, dc = np.zeros((n, self.hidden), np.float32), np.zeros((n, self.hidden), np.float32)
            dw, du, db = np.zeros_like(p[f"w{d}"]), np.zeros_like(p[f"u{d}"]), np.zeros_like(p[f"b{d}"])
            for t, h, before, i, f, o, g, tc in reversed(tape):
                dh = (dh + dh_out[:, t]) * mask[:, t, None]
                dc = (dc + dh * o * (1 - tc * tc)) * mask[:, t, None]
                dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
                dw += x[:, t].T @ dz
                du += h.T @ dz
                db += dz.sum(0)
                d_x[:, t] += dz @ p[f"w{d}"].T
                dh, dc = dz @ p[f"u{d}"].T, dc * f
            grads |= {f"w{d}": dw, f"u{d}": du, f"b{d}": db}
        grads["e"] = np.zeros_like(p["e"])
        np.add.at(grads["e"], chars, d_x)
        return loss, grads

    def _crf(self, em: np.ndarray, mask: np.ndarray, tags: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Forward and backward sums in probabilities, scaled at every character."""
        n, length, k = em.shape
        top = em.max(2)
        e, a = np.exp(em - top[..., None]), np.exp(self.p["trans"])
        alpha, beta, scale = np.empty_like(e), np.ones_like(e), np.ones((n, length), np.float32)
        live = mask > 0
        for t in range(length):
            new = (alpha[:, t - 1] @ a if t else 1) * e[:, t]
            scale[:, t] = np.where(live[:, t], new.sum(1), 1)
            alpha[:, t] = np.where(live[:, t, None], new / scale[:, t, None], alpha[:, t - 1] if t else 1 / k)
        for t in range(length - 2, -1, -1):
            new = (e[:, t + 1] * beta[:, t + 1] / scale[:, t + 1, None]) @ a.T
            beta[:, t] = np.where(live[:, t + 1, None], new, beta[:, t + 1])
        d_em = alpha * beta * mask[..., None]
        rows, places = np.arange(n)[:, None], np.arange(length)[None]
        total = (np.log(scale) + top * mask).sum() - (em[rows, places, tags] * mask).sum() - (self.p["trans"][tags[:, :-1], tags[:, 1:]] * mask[:, 1:]).sum()
        d_em[rows, places, tags] -= mask
        after = e * beta / scale[..., None] * mask[..., None]
        d_trans = a * np.einsum("nti,ntj->ij", alpha[:, :-1], after[:, 1:], optimize=True)
        np.add.at(d_trans, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), -mask[:, 1:].ravel())
        return float(total / n), (d_em / n).astype(np.float32), (d_trans / n).astype(np.float32)

    def fit(self, chars: np.ndarray, tags: np.ndarray, steps: int = 400, batch: int = 96, rate: float = 0.01, seed: int = 7) -> list[float]:
        rng = np.random.default_rng(seed)
        m, v, losses = {}, {}, []
        for i in range(1, steps + 1):
            own = rng.integers(0, len(chars), min(batch, len(chars)))
            loss, grads = self.step(chars[own], tags[own])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            pace = rate * min(1.0, 2 * (1 - i / (steps + 1)))
            for name, g in grads.items():
                g = g * min(1.0, 5.0 / (norm + 1e-9))
                m[name] = 0.9 * m.get(name, 0) + 0.1 * g
                v[name] = 0.99 * v.get(name, 0) + 0.01 * g * g
                self.p[name] = (self.p[name] - pace * (m[name] / (1 - 0.9**i)) / (np.sqrt(v[name] / (1 - 0.99**i)) + 1e-8)).astype(np.float32)
            losses.append(loss)
        return losses

    def decode(self, em: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tag sequence of every row of emissions, and each character's lead: its tag's emission over the best other one."""
        em, trans = em.copy(), self.p["trans"]
        n, length, k = em.shape
        best, back = em[:, 0], np.zeros((n, length, k), np.int8)
        for t in range(1, length):
            scores = best[:, :, None] + trans
            back[:, t] = scores.argmax(1)
            new = np.take_along_axis(scores, back[:, t][:, None], 1)[:, 0] + em[:, t]
            live = alive[:, t, None]
            best = np.where(live, new, best)
            back[:, t] = np.where(live, back[:, t], np.arange(k))
        tags = np.zeros((n, length), np.int64)
        tags[:, -1] = best.argmax(1)
        for t in range(length - 1, 0, -1):
            tags[:, t - 1] = back[np.arange(n), t, tags[:, t]]
        own = np.take_along_axis(em, tags[..., None], 2)[..., 0]
        np.put_along_axis(em, tags[..., None], -np.inf, 2)
        return tags, own - em.max(2)
