"""A gated recurrent language model over words in classes, in numpy: truncated backpropagation, and scoring.

A word is a slot: its class times `members` plus its place in the class. After each word the state gives the next one's
class by a softmax over classes, and the place by a softmax over the class's members; both depend on the state.
"""

from __future__ import annotations

import numpy as np

NONE = -1e9
#: Rows of scores at once, few enough to stay in a core's cache.
ROWS = 1024


def _exponentials(weights: np.ndarray, h: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray, np.ndarray | int]:
    """For each row of h the exponentials of its scores, their sum, and what was taken off the scores before: their largest,
    where one may be as large as single precision has no room for."""
    e, top = h @ weights.T, 0
    if not bound < 40:
        top = e.max(axis=1)
        e -= top[:, None]
    np.exp(e, out=e)
    return e, e @ np.ones(e.shape[1], e.dtype), top


def _rows(states: list[np.ndarray]) -> np.ndarray:
    """All states, each a row that ends in 1."""
    out, at = np.ones((sum(map(len, states)), states[0].shape[1] + 1), states[0].dtype), 0
    for h in states:
        out[at : at + len(h), :-1] = h
        at += len(h)
    return out


def _sums(columns: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """The sums of the columns that are of 0, of 1, and so on, to n."""
    out = np.zeros((len(columns), n), columns.dtype)
    for row, values in zip(out, columns, strict=True):
        np.add.at(row, of, values)
    return out


class Gru:
    NAMES = ("v", "m", "o", "b", "w", "c", "u")

    def __init__(self, classes: int, members: int, size: int = 32, seed: int = 7, kind=np.float32):
        rng = np.random.default_rng(seed)
        self.classes, self.members, self.size = classes, members, size
        self.p = {
            "v": rng.normal(0, 0.1, (classes * members, size)).astype(kind),  # a vector for each slot, going in and coming out
            "m": np.zeros((classes, members), kind),
            "o": rng.normal(0, 0.1, (size, classes)).astype(kind),
            "b": np.zeros(classes, kind),
            "w": rng.normal(0, size**-0.5, (size, 3 * size)).astype(kind),
            "c": rng.normal(0, 0.1, (classes + 1, 3 * size)).astype(kind),  # of the class before; the last row begins a text
            "u": rng.normal(0, size**-0.5, (size, 3 * size)).astype(kind),
        }

    def packed(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in self.NAMES])

    def unpack(self, values: np.ndarray) -> Gru:
        at = 0
        for k in self.NAMES:
            n = self.p[k].size
            self.p[k] = values[at : at + n].reshape(self.p[k].shape).astype(self.p[k].dtype)
            at += n
        return self

    def table(self) -> np.ndarray:
        """What each slot before brings to the gates; the last row begins a text."""
        x = np.empty((3 * self.size, self.classes * self.members + 1), self.p["v"].dtype)
        x[:, :-1] = self.p["w"].T @ self.p["v"].T
        x[:, :-1] += np.repeat(self.p["c"][:-1].T, self.members, axis=1)
        x[:, -1] = self.p["c"][-1]
        return x.T

    def inputs(self, before: np.ndarray) -> np.ndarray:
        """The table's rows for the slots before; -1 begins a text."""
        return self.table().T.take(before, axis=1, mode="wrap").T

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """New states, the gates (reset, update, candidate), and what the states bring to the candidate. All are laid out column
        by column, as x and h had best be, so that a gate's values lie side by side."""
        n, x, h = self.size, x.T, h.T
        b = self.p["u"].T @ h
        gates = x[: 2 * n] + b[: 2 * n]
        np.minimum(gates, 80, out=gates)
        np.exp(gates, out=gates)
        gates /= gates + 1
        r, z, b = gates[:n], gates[n:], b[2 * n :]
        c = r * b
        c += x[2 * n :]
        np.tanh(c, out=c)
        after = h - c
        after *= z
        after += c
        return after.T, r.T, z.T, c.T, b.T

    def _by_class(self, slots: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
        """An order in which slots of one class are side by side, and (class, its part of the order), of ROWS at most."""
        of = (slots // self.members).astype(np.int16 if self.classes < 1 << 15 else np.int32)  # short numbers sort in linear time
        order = np.argsort(of, kind="stable")
        edges = np.searchsorted(of[order], np.arange(self.classes + 1)).tolist()
        return order, [(c, slice(i, min(i + ROWS, b))) for c, (a, b) in enumerate(zip(edges, edges[1:])) for i in range(a, b, ROWS)]

    def _outputs(self) -> tuple[np.ndarray, float, np.ndarray, list[float], np.ndarray]:
        """Weights and bias side by side, of the classes and of each class's members; how large the scores of a class and of a
        member can be, as a state's values are within 1; and for each slot its own weights and its class's added up."""
        of = np.concatenate([self.p["o"], self.p["b"][None]]).T.copy()
        within = np.concatenate([self.p["v"].reshape(self.classes, self.members, self.size), self.p["m"][:, :, None]], axis=2)
        bounds = [np.abs(np.where(w > NONE / 2, w, 0)).sum(axis=-1).max(axis=-1) for w in (of, within)]
        return of, float(bounds[0]), within, bounds[1].tolist(), (within + of[:, None]).reshape(-1, self.size + 1)

    def log_probabilities(self, h: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """Natural logarithms for the slots after the states h."""
        return self._logs(_rows([h]), slots)

    def _logs(self, h: np.ndarray, slots: np.ndarray) -> np.ndarray:
        of, of_bound, within, bounds, both = self._outputs()
        order, parts = self._by_class(slots)
        h = h.take(order, axis=0, mode="clip")
        logs = np.einsum("ij,ij->i", h, both.take(slots[order], axis=0, mode="clip"))
        for i in range(0, len(slots), ROWS):
            _, total, top = _exponentials(of, h[i : i + ROWS], of_bound)
            logs[i : i + ROWS] -= np.log(total) + top
        for c, part in parts:
            _, total, top = _exponentials(within[c], h[part], bounds[c])
            logs[part] -= np.log(total) + top
        out = np.empty_like(logs)
        out[order] = logs
        return out

    def _gradients(self, trace: list[tuple], g: dict[str, np.ndarray]) -> float:
        """Adds the gradients of one window's mean loss, and returns it. trace: (slot before, begins, state before, gates,
        state, slot, what the state before brought to the candidate) for each step, laid out as in step()."""
        n, lanes, ends = self.size, len(trace[0][0]), self.classes * self.members
        targets = np.concatenate([t[7] for t in trace])
        order, parts = self._by_class(targets)
        targets = targets[order]
        h = _rows([t[6] for t in trace]).take(order, axis=0, mode="clip")
        of, of_bound, within, bounds, both = self._outputs()
        loss, scale = 0.0, h.dtype.type(1 / len(targets))

        def output(weights: np.ndarray, h: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
            """The gradients of the weights and of the states, by the exponentials. Their sums divide the states, which are fewer
            values."""
            nonlocal loss
            e, total, top = _exponentials(weights, h, bound)
            loss += float((np.log(total) + top).sum())
            share = (1 / total)[:, None]
            back = e @ weights[:, :n]
            back *= share
            return e.T @ (h * share), back

        # the chosen slots and their classes first: their scores' gradients are less by one
        own = both.take(targets, axis=0, mode="clip")
        loss -= float(np.vdot(own, h))
        d_states = np.negative(own[:, :n])
        d_within = -_sums(h.T, targets, ends).T.reshape(within.shape)
        d_of = d_within.sum(axis=1)
        for i in range(0, len(targets), ROWS):
            part = slice(i, i + ROWS)
            d, back = output(of, h[part], of_bound)
            d_of += d
            d_states[part] += back
        for c, part in parts:
            d, back = output(within[c], h[part], bounds[c])
            d_within[c] += d
            d_states[part] += back
        d_of *= scale
        d_within *= scale
        g["o"] += d_of[:, :n].T
        g["b"] += d_of[:, n]
        g["v"] += d_within[:, :, :n].reshape(-1, n)
        g["m"] += d_within[:, :, n]
        d_states *= scale
        places = np.empty_like(order)
        places[order] = np.arange(len(order))
        d_states = d_states.take(places, axis=0, mode="clip")

        dh = np.zeros((n, lanes), h.dtype)
        dx = np.empty((3 * n, len(trace), lanes), h.dtype)
        inner = np.empty((3 * n, lanes), h.dtype)
        for j in range(len(trace) - 1, -1, -1):
            begins = trace[j][1]
            old, r, z, c, b = (trace[j][i].T for i in (2, 3, 4, 5, 8))
            dh += np.ascontiguousarray(d_states[j * lanes : (j + 1) * lanes].T)
            kept = dh * z
            dh -= kept
            dr, dz, dc = inner[:n], inner[n : 2 * n], dx[2 * n :, j]
            np.multiply(c, c, out=dc)
            np.subtract(1, dc, out=dc)
            dc *= dh
            np.multiply(dc, r, out=inner[2 * n :])
            np.subtract(1, r, out=dr)
            dr *= b
            dr *= inner[2 * n :]
            np.subtract(old, c, out=dz)
            dz *= z
            dz *= dh
            dx[: 2 * n, j] = inner[: 2 * n]
            g["u"] += (inner @ old.T).T
            dh = self.p["u"] @ inner
            dh += kept
            if begins.any():
                dh[:, begins] = 0
        # what each slot before has brought is added up first
        before = np.concatenate([t[0] for t in trace])
        slots = _sums(dx.reshape(3 * n, -1), np.where(before < 0, ends, before), ends + 1)
        g["c"] += np.concatenate([slots[:, :-1].reshape(3 * n, self.classes, self.members).sum(axis=2), slots[:, -1:]], axis=1).T
        g["w"] += (slots[:, :-1] @ self.p["v"]).T
        g["v"] += (self.p["w"] @ slots[:, :-1]).T
        return loss / len(targets)

    def window(self, slots: np.ndarray, before: np.ndarray, begins: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
        """The states after a window of steps (rows are lanes), and its trace."""
        table = self.table().T
        trace = []
        for j in range(slots.shape[1]):
            if begins[:, j].any():
                h = np.where(begins[:, j], 0, h.T).astype(h.dtype).T
            after, r, z, c, b = self.step(table.take(before[:, j], axis=1, mode="wrap").T, h)
            trace.append((before[:, j], begins[:, j], h, r, z, c, after, slots[:, j], b))
            h = after
        return h, trace

    def train(self, sequences: list[np.ndarray], rate: float, lanes: int = 128, window: int = 16, every: int = 8, moments: dict | None = None) -> dict:
        """Adam over windows. The sequences are laid end to end in lanes; states are carried from window to window and
        begin anew with each sequence. Every window is learned from: its gradients stop at its start, and the mean of those
        of `every` windows, or of those left at the end, makes a step.
        Returns the optimiser's moments, for the next call."""
        moments = moments or {"t": 0, "1": {k: np.zeros_like(x) for k, x in self.p.items()}, "2": {k: np.zeros_like(x) for k, x in self.p.items()}}
        flat = np.concatenate(sequences) if sequences else np.zeros(0, np.int32)
        if not len(flat):
            return moments
        begins = np.zeros(len(flat), bool)
        begins[np.cumsum([0, *map(len, sequences[:-1])])] = True
        before = np.concatenate([[-1], flat[:-1]])
        before[begins] = -1
        lanes = max(1, min(lanes, len(flat) // (32 * window)))
        width = -(-len(flat) // lanes)
        # the last lane goes on with the first texts, so that none is left out
        more = np.arange(lanes * width) % len(flat)
        flat, begins, before = (x[more].reshape(lanes, width) for x in (flat, begins, before))
        h = np.zeros((lanes, self.size), self.p["u"].dtype)
        g, n = {name: np.zeros_like(x) for name, x in self.p.items()}, 0
        for at in range(0, width, window):
            here = slice(at, at + window)
            h, trace = self.window(flat[:, here], before[:, here], begins[:, here], h)
            self._gradients(trace, g)
            n += 1
            if n == every or at + window >= width:
                for x in g.values():
                    x *= 1 / n
                self._update(g, moments, rate)
                g, n = {name: np.zeros_like(x) for name, x in self.p.items()}, 0
        return moments

    def _update(self, g: dict[str, np.ndarray], moments: dict, rate: float) -> None:
        norm = np.sqrt(sum(float(np.vdot(x, x)) for x in g.values()))
        moments["t"] += 1
        t = moments["t"]
        pace = rate * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        for k, x in g.items():
            x *= min(1.0, 1.0 / max(norm, 1e-9))
            m, v = moments["1"][k], moments["2"][k]
            m *= 0.9
            m += 0.1 * x
            v *= 0.99
            x *= x
            v += 0.01 * x
            np.sqrt(v, out=x)
            x += 1e-8
            np.divide(m, x, out=x)
            x *= pace
            self.p[k] -= x

    def score(self, sequences: list[np.ndarray]) -> np.ndarray:
        """Natural log-probability of each whole sequence, ROWS of about one length side by side, states carried from window to
        window."""
        sizes = np.array([len(s) for s in sequences], np.int64)
        order = np.argsort(-sizes, kind="stable")
        begin = np.cumsum(sizes) - sizes
        flat = np.concatenate(sequences) if len(sequences) else np.zeros(0, np.int32)
        table, out = self.table().T, np.zeros(len(sequences))
        for i in range(0, len(order), ROWS):
            own = order[i : i + ROWS]
            out[own] = self._scored(flat, begin[own], sizes[own], table)
        return out

    def _scored(self, flat: np.ndarray, begin: np.ndarray, sizes: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Of the sequences that begin at these places of flat, the longest first."""
        total, h = np.zeros(len(sizes)), np.zeros((self.size, len(sizes)), self.p["u"].dtype).T
        at, longest = 0, int(sizes[0])
        while at < longest:
            states, targets, owners = [], [], []  # those still going on are the first
            alive = int(np.searchsorted(-sizes, -at, "left"))
            until = min(at + 32 * ROWS // max(alive, 1), longest)
            for j, alive in enumerate(np.searchsorted(-sizes, -np.arange(at, until), "left").tolist(), at):  # those of more than j
                place = begin[:alive] + j
                x = table.take(flat[place - 1], axis=1, mode="wrap") if j else np.repeat(table[:, -1:], alive, axis=1)
                h = self.step(x.T, h[:alive])[0]
                states.append(h)
                targets.append(flat[place])
                owners.append(alive)
            logs, done = self._logs(_rows(states), np.concatenate(targets)), 0
            for alive in owners:
                total[:alive] += logs[done : done + alive]
                done += alive
            at = until
        return total
