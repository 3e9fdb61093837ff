"""A one-layer causal self-attention model over subword ids, in numpy: training, and scoring in overlapping windows.

Subwords are told in two steps, P(class | context) by the network and
P(subword | class, group of the subword before) from corpus counts.  The COMMON
most frequent subwords are classes of their own; the others share classes with
subwords that follow the same groups, and a group holds subwords that are
followed alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CLASSES = 192
COMMON = 168
GROUPS = 64
#: Subwords with an embedding of their own; rarer ones share that of their class.
EMBEDDED = 2048
WIDTH = 24
#: A window's positions, and by how much windows move on; what a window shares with the one before is context only.
SPAN = 32
STEP = 24
BATCH = 512
#: Windows, and positions whose class scores, are worked on at once.
HIDDEN = 64
CACHED = 1536
#: Windows whose gradients are worked out at once.
TAUGHT = 64
#: Counts that a profile, and a group's share of a class, borrow from the whole corpus.
BORROWED = 5.0
UNSEEN = 0.01


def alike(counts: np.ndarray, weight: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """One of at most k clusters for each row of counts, by k-means on square roots of smoothed shares."""
    size = counts.sum(axis=1, keepdims=True)
    whole = counts.sum(axis=0) / max(counts.sum(), 1)
    x = np.sqrt((counts + BORROWED * whole) / (size + BORROWED)).astype(np.float32)
    weight = np.sqrt(weight)
    centre = [x[int(np.argmax(weight))]]
    far = ((x - centre[0]) ** 2).sum(axis=1) * weight
    while len(centre) < min(k, len(x)):
        at = int(np.argmax(far))
        centre.append(x[at])
        np.minimum(far, ((x - x[at]) ** 2).sum(axis=1) * weight, out=far)
    centre = np.array(centre)
    for _ in range(rounds):
        of = ((centre**2).sum(axis=1) - 2 * (x @ centre.T)).argmin(axis=1)
        total = np.bincount(of, weight, len(centre))
        for j in np.flatnonzero(total):
            mine = of == j
            centre[j] = weight[mine] @ x[mine] / total[j]
    return of


def group_ids(counts: np.ndarray, followed: np.ndarray) -> np.ndarray:
    """The group of each id.  followed: a row an id, how often ids of each bucket follow it.  Ids never seen are in group 0."""
    out = np.zeros(len(counts), np.int64)
    seen = np.flatnonzero(counts)
    if len(seen):
        out[seen] = alike(followed[seen], counts[seen], GROUPS)
    return out


class Classes:
    """Classes, embedding rows and within-class log10 probabilities by subword id.

    counts: how often each id occurs; group: of each id; after: a row an id, how
    often it follows each group.  Without the last two there is one group, and
    ids share classes with others about as frequent.
    """

    def __init__(self, counts: np.ndarray, group: np.ndarray | None = None, after: np.ndarray | None = None):
        n = counts.astype(np.float64) + UNSEEN
        rank = np.empty(len(n), np.int64)
        order = np.lexsort((np.arange(len(n)), -n))
        rank[order] = np.arange(len(n))
        rest = order[COMMON:]
        shared = CLASSES - COMMON
        self.of = np.empty(len(n), np.int64)
        self.of[order[:COMMON]] = np.arange(min(COMMON, len(n)))
        seen = rest[counts[rest] > 0]
        if after is None:
            cut = np.cumsum(n[rest]) - n[rest]
            self.of[rest] = COMMON + np.minimum(cut / max(n[rest].sum(), 1e-9) * shared, shared - 1).astype(np.int64)
        else:
            self.of[rest] = COMMON + rest % shared
            if len(seen):
                self.of[seen] = COMMON + alike(after[seen], n[seen], shared)
        self.group = np.zeros(len(n), np.int64) if group is None else group
        self.row = np.where(rank < EMBEDDED, rank, EMBEDDED + self.of)
        share = n / np.bincount(self.of, n, CLASSES)[self.of]
        if after is None:
            self.within = np.log10(share)[None].astype(np.float32)
        else:
            sums = np.zeros((CLASSES, after.shape[1]))
            np.add.at(sums, self.of, after)
            borrowed = 2 * BORROWED
            self.within = np.log10((after.T + borrowed * share) / (sums[self.of].T + borrowed)).astype(np.float32)

    def within_log10(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """log10 P(id | its class, group of the id before)."""
        return self.within[self.group[before], ids]


#: Larger exponents are cut to this, which float32 still holds.
MOST_EXPONENT = np.float32(60)


def _within(h: np.ndarray, c: np.ndarray) -> bool:
    """Whether by their lengths no product of a row of h and a column of c can exceed MOST_EXPONENT."""
    longest = (c**2).sum(axis=0).max(initial=0) * np.einsum("ij,ij->i", h, h).max(initial=0)
    return bool(longest <= MOST_EXPONENT**2)


def _exp(x: np.ndarray) -> np.ndarray:
    np.minimum(x, MOST_EXPONENT, out=x)
    return np.exp(x, out=x)


_PAST = np.subtract.outer(np.arange(SPAN), np.arange(SPAN))


class Attention:
    spread: dict[str, np.ndarray] | None = None

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        small = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.w = {
            "e": (0.3 * r.standard_normal((EMBEDDED + CLASSES, WIDTH))).astype(np.float32),
            "q": small(WIDTH, WIDTH), "k": small(WIDTH, WIDTH), "v": small(WIDTH, WIDTH), "o": small(WIDTH, WIDTH),
            "r": np.zeros(SPAN, np.float32), "c": small(WIDTH, CLASSES), "b": np.zeros(CLASSES, np.float32),
        }

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """By embedding row, as all that a position gives depends on its row alone: what asks of the rows themselves, and what is added when seen, with a one.

        Then the matrices that make them of rows, and the bias of attention.
        """
        w = self.w
        ask, tell = w["q"] @ w["k"].T / w["e"].dtype.type(np.sqrt(WIDTH)), w["v"] @ w["o"]
        told = np.ones((len(w["e"]), WIDTH + 1), w["e"].dtype)
        told[:, :WIDTH] = w["e"] @ tell
        bias = np.where(_PAST >= 0, w["r"][np.maximum(_PAST, 0)], w["r"].dtype.type(-1e9))
        return w["e"] @ ask, told, ask, tell, bias

    def forward(self, rows: np.ndarray, since: int = 0, tables: tuple[np.ndarray, ...] | None = None) -> tuple[np.ndarray, ...]:
        """rows: windows of SPAN embedding rows; a position sees itself and those before it.

        Of positions from since on: the rows that they see, what they ask, what is added when seen, weights before they are divided by their sum,
        that sum, what attention adds, and what classes are told from.
        """
        asks, told, _, _, bias = tables or self.tables()
        x, q, v = np.take(self.w["e"], rows, axis=0), np.take(asks, rows[:, since:], axis=0), np.take(told, rows, axis=0)
        a = np.matmul(q, x.transpose(0, 2, 1))
        a += bias[since:]
        _exp(a)
        y = np.matmul(a, v)
        total = np.maximum(y[..., WIDTH:], y.dtype.type(1e-30))
        y = y[..., :WIDTH] / total
        return x, q, v, a, total, y, x[:, since:] + y

    def hidden(self, rows: np.ndarray, since: int = 0, tables: tuple[np.ndarray, ...] | None = None) -> Iterator[np.ndarray]:
        """What forward gives last, HIDDEN windows at a time."""
        tables = tables or self.tables()
        for at in range(0, len(rows), HIDDEN):
            yield self.forward(rows[at : at + HIDDEN], since, tables)[-1]

    def class_log10(self, h: np.ndarray, target: np.ndarray) -> np.ndarray:
        """log10 P(class) at positions; h: (n, WIDTH).  Done in blocks that stay in a core's cache."""
        c, ones = np.concatenate([self.w["c"], self.w["b"][None]]), np.ones(CLASSES, np.float32)
        h = np.concatenate([h, np.ones((len(h), 1), h.dtype)], axis=1)
        within = _within(h, c)
        out = np.empty(len(h), np.float32)
        table = np.empty((min(CACHED, max(len(h), 1)), CLASSES), np.float32)
        for k in range(0, len(h), CACHED):
            part = h[k : k + CACHED]
            z = np.matmul(part, c, out=table[: len(part)])
            if not within:
                np.minimum(z, MOST_EXPONENT, out=z)
            picked = z[np.arange(len(z)), target[k : k + CACHED]]
            np.exp(z, out=z)
            out[k : k + CACHED] = picked - np.log(z @ ones)
        return out / np.float32(np.log(10))

    def gradients(self, rows: np.ndarray, target: np.ndarray, real: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy in nats over real positions, and its gradients.

        Where the first SPAN - STEP positions of a window are context only, they ask nothing.
        """
        w, n = self.w, max(int(real.sum()), 1)
        tables = self.tables()
        kind = w["e"].dtype
        late = ~real[:, : SPAN - STEP].any(axis=1)
        sums = {"ask": np.zeros((WIDTH, WIDTH), kind), "tell": np.zeros((WIDTH, WIDTH), kind), "past": np.zeros((SPAN, SPAN), kind), "c": np.zeros((WIDTH + 1, CLASSES), kind)}
        loss, order, dx = 0.0, [], []
        for since, mine in ((0, np.flatnonzero(~late)), (SPAN - STEP, np.flatnonzero(late))):
            for at in range(0, len(mine), TAUGHT):
                part = mine[at : at + TAUGHT]
                more, back = self._add_gradients(sums, tables, rows[part], target[part, since:], real[part, since:], since, n)
                loss += more
                order.append(rows[part].ravel())
                dx.append(back)
        g = {"c": sums["c"][:WIDTH], "b": sums["c"][WIDTH]}
        scale = kind.type(1 / np.sqrt(WIDTH))
        g["q"], g["k"] = sums["ask"] @ w["k"] * scale, sums["ask"].T @ w["q"] * scale
        g["v"], g["o"] = sums["tell"] @ w["o"].T, w["v"].T @ sums["tell"]
        g["r"] = np.bincount(np.maximum(_PAST, 0).ravel(), np.where(_PAST >= 0, sums["past"], 0).ravel(), SPAN).astype(np.float32)
        g["e"] = np.zeros_like(w["e"])
        if order:
            seen = np.concatenate(order).astype(np.uint16)
            order = np.argsort(seen, kind="stable")
            seen = seen[order]
            first = np.flatnonzero(np.concatenate([[True], seen[1:] != seen[:-1]]))
            g["e"][seen[first]] = np.add.reduceat(np.take(np.concatenate(dx), order, axis=0), first, axis=0)
        return loss / n, g

    def _add_gradients(self, sums: dict[str, np.ndarray], tables: tuple[np.ndarray, ...], rows: np.ndarray, target: np.ndarray, real: np.ndarray, since: int, n: int) -> tuple[float, np.ndarray]:
        """Adds to sums what positions from since on give, and returns their cross-entropy and the gradient of all positions' embedding rows."""
        _, _, ask, tell, _ = tables
        x, q, v, a, total, y, h = self.forward(rows, since, tables)
        kind = h.dtype
        flat = lambda z: z.reshape(-1, z.shape[-1])
        c = np.concatenate([self.w["c"], self.w["b"][None]])
        back_c = np.ones((CLASSES, WIDTH + 1), kind)
        back_c[:, :WIDTH] = self.w["c"].T
        own_c = self.w["c"].T / kind.type(n)
        told = np.flatnonzero(real)
        every = np.ones((len(told), WIDTH + 1), kind)
        every[:, :WIDTH] = np.take(flat(h), told, axis=0)
        within = _within(every, c)
        target = target.ravel()[told]
        dh, loss = np.zeros(flat(h).shape, kind), 0.0
        for at in range(0, len(every), CACHED):  # blocks that stay in a core's cache
            part, which = every[at : at + CACHED], target[at : at + CACHED]
            p = part @ c
            if not within:
                np.minimum(p, MOST_EXPONENT, out=p)
            np.exp(p, out=p)
            back = p @ back_c
            size = np.maximum(back[:, WIDTH], kind.type(1e-30))
            here = np.arange(len(p))
            one = p[here, which]
            loss -= float(np.log(np.maximum(one / size, kind.type(1e-30))).sum())
            p[here, which] = one - size  # p is divided by size at last
            share = (1 / (size * kind.type(n)))[:, None]
            sums["c"] += (part * share).T @ p
            back = back[:, :WIDTH] * share
            back -= np.take(own_c, which, axis=0)
            dh[told[at : at + CACHED]] = back
        dh = dh.reshape(h.shape)
        back = np.empty((*dh.shape[:2], WIDTH + 1), kind)
        np.divide(dh, total, out=back[..., :WIDTH])
        np.negative(np.einsum("ijk,ijk->ij", back[..., :WIDTH], y), out=back[..., WIDTH])
        dv = np.matmul(a.transpose(0, 2, 1), back[..., :WIDTH])
        a *= np.matmul(back, v.transpose(0, 2, 1))
        sums["past"][since:] += a.sum(axis=0)
        dq = np.matmul(a, x)
        dx = np.matmul(a.transpose(0, 2, 1), q)
        dx += (flat(dv) @ tell.T).reshape(dx.shape)
        dx[:, since:] += dh
        dx[:, since:] += (flat(dq) @ ask.T).reshape(dq.shape)
        sums["tell"] += flat(x).T @ flat(dv)
        sums["ask"] += flat(x[:, since:]).T @ flat(dq)
        return loss, flat(dx)

    def train(self, rows: np.ndarray, target: np.ndarray, real: np.ndarray, steps: int = 400, batch: int = 192, seed: int = 11) -> list[float]:
        """Adam with a falling rate on random batches; returns the losses.  What it divides steps by stays in spread."""
        r, losses = np.random.default_rng(seed), []
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        s = {k: np.zeros_like(v) for k, v in self.w.items()}
        for step in range(1, steps + 1):
            at = r.integers(0, len(rows), min(batch, len(rows)))
            loss, g = self.gradients(rows[at], target[at], real[at])
            losses.append(loss)
            rate = 0.02 * (1 - 0.95 * step / steps)
            for k in self.w:
                m[k] += 0.1 * (g[k] - m[k])
                s[k] += 0.01 * (g[k] ** 2 - s[k])
                self.w[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        self.spread = {k: np.sqrt(v / (1 - 0.99**steps)) + 1e-4 for k, v in s.items()} if steps else None
        return losses

    def go_on(self, rows: np.ndarray, target: np.ndarray, real: np.ndarray, rate: float, batch: int = 192) -> None:
        """One pass over windows, each batch a step divided by spread."""
        step = {k: (rate / v).astype(np.float32) for k, v in self.spread.items()}
        for at in range(0, len(rows), batch):
            part = slice(at, at + batch)
            _, g = self.gradients(rows[part], target[part], real[part])
            share = np.float32(min(1.0, len(rows[part]) / batch))
            for k in self.w:
                g[k] *= step[k]
                g[k] *= share
                self.w[k] -= g[k]

    def flat(self) -> np.ndarray:
        return np.concatenate([self.w[k].ravel() for k in sorted(self.w)])

    def set_flat(self, x: np.ndarray) -> None:
        at = 0
        for k in sorted(self.w):
            size = self.w[k].size
            self.w[k] = x[at : at + size].reshape(self.w[k].shape).astype(np.float32)
            at += size


def windows(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and first position of each window, for texts of size tokens; every token is scored by one window."""
    many = 1 + np.maximum(-(-(size - SPAN) // STEP), 0)
    text = np.repeat(np.arange(len(size)), many)
    return text, (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)) * STEP


def window_table(ids: np.ndarray, at: np.ndarray, end_id: int, some: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, targets and which targets count, of every window, with its text; or of some of the windows.

    ids: of all texts, each closed by end_id, which also stands before a text's first token; at: where texts start, with the end.
    """
    text, first = some or windows(np.diff(at))
    place = first[:, None] + np.arange(SPAN)
    size = np.diff(at)[text][:, None]
    real = place < size
    real[first > 0, : SPAN - STEP] = False
    where = at[text][:, None] + np.minimum(place, size - 1)
    before = np.where(place > 0, ids[np.maximum(where - 1, 0)], end_id)
    return before, ids[where], real, text


def score_texts(model: Attention, classes: Classes, ids: np.ndarray, at: np.ndarray, end_id: int) -> np.ndarray:
    """log10 probability of each text."""
    out = np.zeros(len(at) - 1)
    text, first = windows(np.diff(at))
    tables = model.tables()
    for since, mine in ((0, np.flatnonzero(first == 0)), (SPAN - STEP, np.flatnonzero(first))):  # context only is not asked for classes
        for a in range(0, len(mine), BATCH):
            some = mine[a : a + BATCH]
            before, target, real, of = window_table(ids, at, end_id, (text[some], first[some]))
            for k, h in zip(range(0, len(of), HIDDEN), model.hidden(classes.row[before], since, tables)):
                part = slice(k, k + HIDDEN)
                told, r = target[part, since:], real[part, since:]
                row, _ = np.nonzero(r)
                p = model.class_log10(h[r], classes.of[told[r]]) + classes.within_log10(before[part, since:][r], told[r])
                out += np.bincount(of[part][row], p, len(out))
    return out
