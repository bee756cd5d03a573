"""A small causal self-attention model in numpy, over subword ids.

The model predicts the next id from a window of ids. What two neighbours tell
comes from counts over the whole corpus: a smoothed table of P(next | previous)
for the commonest ids, all others sharing one entry that their own frequencies
split. What lies further back comes from attention: ids fall into classes, the
attention layer moves the table's class probabilities, and within a class the
table's proportions hold. So the model starts at the count model, sums to one by
construction, and only the small class layer needs a softmax.
"""

from __future__ import annotations

import numpy as np
from numpy.lib.stride_tricks import as_strided

F32 = np.float32
#: Commonest ids with an entry of their own (two less, which all others share), classes, width, window and
#: positions scored in each window: each has 16 to 31 ids before it.
ACTIVE, CLASSES, WIDTH, WINDOW, STRIDE = 2048, 64, 16, 32, 16
#: Windows whose gradients are worked out at a time.
CHUNK = 64
_DISTANCE = np.arange(WINDOW - STRIDE, WINDOW)[:, None] - np.arange(WINDOW)
_CAUSAL = _DISTANCE >= 0
_REACH = np.where(_CAUSAL, _DISTANCE, 0)


class Prior:
    """P(next | previous) from counts. ``end`` is the id that stands before and after each text and counts as a word.

    Entries are the commonest ids, then all other ids that begin words, then all other ids. Classes below
    ``CLASSES // 2`` hold the entries that begin words, so the model knows the probability that a word begins.
    """

    def __init__(self, vocabulary: int, begins: np.ndarray, unigrams: np.ndarray, pairs: np.ndarray, last: np.ndarray, first: np.ndarray):
        """``begins``: which ids begin words, the end among them; ``unigrams``: counts of ids. Over entries:
        ``pairs`` within words, ``last`` and ``first`` of words."""
        size = len(last)
        self.end, self.entry = vocabulary, entries_of(unigrams, begins, size)
        self.end_entry = int(self.entry[self.end])
        starts = np.zeros(size, bool)
        starts[self.entry[begins]] = True
        starts[size - 2], starts[size - 1] = True, False
        inner, start = np.where(starts, 0, pairs.sum(axis=0) + 0.1), np.where(starts, first + 0.1, 0)
        inner, start = inner / inner.sum(), start / start.sum()
        n_inner, n_last = pairs.sum(), last.sum()
        general = ((n_inner + 1) * inner + (n_last + 1) * start) / (n_inner + n_last + 2)
        kinds = (pairs > 0).sum(axis=1) + 1.0
        table = pairs + last[:, None] * start + kinds[:, None] * general
        table /= table.sum(axis=1, keepdims=True)
        table[self.end_entry] = 0.999 * start + 0.001 * general
        self.rest = np.zeros(vocabulary + 1, F32)
        for shared in (size - 2, size - 1):
            rare = np.flatnonzero(self.entry == shared)
            if len(rare):
                self.rest[rare] = np.log((unigrams[rare] + 0.5) / (unigrams[rare] + 0.5).sum())
        self.begins = begins
        self.classes = self._cluster(pairs, last, first, starts)
        by_class = np.zeros((size, CLASSES))
        for c in range(CLASSES):
            by_class[:, c] = table[:, self.classes == c].sum(axis=1)
        by_class = np.maximum(by_class, 1e-12)
        self.class_log = np.log(by_class).astype(F32)
        #: log P(next | its class, previous)
        self.within = (np.log(np.maximum(table, 1e-30)) - np.log(by_class)[:, self.classes]).astype(F32)

    @staticmethod
    def _cluster(pairs: np.ndarray, last: np.ndarray, first: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Classes of entries that follow and precede alike; ids that begin words apart from the others."""
        rng, size = np.random.default_rng(0), len(last)
        out = np.sqrt(pairs) / np.sqrt(pairs.sum(axis=1, keepdims=True) + 1)
        into = np.sqrt(pairs.T) / np.sqrt(pairs.sum(axis=0)[:, None] + 1)
        both = np.concatenate([out, into], axis=1)
        basis = both @ rng.normal(size=(both.shape[1], 40))
        for _ in range(3):
            basis = both @ (both.T @ np.linalg.qr(basis)[0])
        q = np.linalg.qr(basis)[0]
        u, s, _ = np.linalg.svd(q.T @ both, full_matrices=False)
        points = ((q @ u) * s)[:, :24]
        weight = np.sqrt(pairs.sum(axis=0) + first + last + 1)
        classes = np.zeros(size, np.int64)
        for part, low, high in ((np.flatnonzero(begins), 0, CLASSES // 2), (np.flatnonzero(~begins), CLASSES // 2, CLASSES)):
            if not len(part):
                continue
            x, w = points[part], weight[part]
            centres = x[rng.choice(len(x), min(high - low, len(x)), replace=False, p=w / w.sum())]
            for _ in range(25):
                label = ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)
                for j in range(len(centres)):
                    if (label == j).any():
                        centres[j] = np.average(x[label == j], axis=0, weights=w[label == j])
            classes[part] = low + label
        return classes


def entries_of(unigrams: np.ndarray, begins: np.ndarray, size: int) -> np.ndarray:
    """The entry of each id: the commonest ids, the end among them, have their own; two are shared by the others."""
    entry = np.where(begins, size - 2, size - 1).astype(np.int32)
    rank = unigrams.astype(float)
    rank[-1] = np.inf
    chosen = np.argsort(-rank, kind="stable")[: size - 2]
    entry[chosen] = np.arange(len(chosen))
    return entry


def initial(entries: int) -> dict[str, np.ndarray]:
    """Tables of queries, keys, values and residuals for each entry, the class layer and the biases of distances."""
    rng = np.random.default_rng(1)
    tables = {k: (rng.normal(size=(entries, WIDTH)) * 0.1).astype(F32) for k in "qkvr"}
    return tables | {"c": (rng.normal(size=(WIDTH, CLASSES)) * 0.1).astype(F32), "d": np.zeros(WINDOW, F32)}


def flatten(params: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([params[k].ravel() for k in "qkvrcd"])


def unflatten(flat: np.ndarray, entries: int) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, shape in [(k, (entries, WIDTH)) for k in "qkvr"] + [("c", (WIDTH, CLASSES)), ("d", (WINDOW,))]:
        n = int(np.prod(shape))
        out[k], at = flat[at : at + n].reshape(shape).astype(F32), at + n
    return out


#: The order of the parameters in a row of the table.
_ROW = "qkrv"


def _table(params: dict) -> np.ndarray:
    """Queries, keys, residuals and values of each entry, side by side, and a last row of zeros for places without an entry."""
    table = np.concatenate([params[k] for k in _ROW], axis=1)
    return np.concatenate([table, np.zeros_like(table[:1])])


def _scatter(index: np.ndarray, rows: np.ndarray, sums: np.ndarray, spare: dict) -> None:
    """Puts the sums of the rows with each index into ``sums``; those of its last row are left out."""
    order = np.argsort(index.astype(np.int16), kind="stable")
    index = index[order]
    first = np.flatnonzero(np.concatenate([[True], index[1:] != index[:-1]]))
    sums[:] = 0
    # Two neighbours at a time: a complex number's parts are added apart.
    pair = np.result_type(rows.dtype, np.complex64)
    dealt = np.take(rows.view(pair), order, axis=0, out=_room(spare, "dealt", (len(rows), rows.shape[1] // 2), pair), mode="clip")
    sums.view(pair)[index[first]] = np.add.reduceat(dealt, first, axis=0)
    sums[-1] = 0


def _room(spare: dict, name: str, shape: tuple, dtype) -> np.ndarray:
    """An array that calls with the same shape share."""
    if name not in spare or spare[name].shape != shape:
        spare[name] = np.empty(shape, dtype)
    return spare[name]


class _Known:
    """What a count model gives for entries and, in a last row, for places without one."""

    def __init__(self, prior: Prior):
        self.class_log = np.concatenate([prior.class_log, np.zeros((1, CLASSES), prior.class_log.dtype)])
        self.classes = np.append(prior.classes, 0)


def _looked_up(table: np.ndarray, spare: dict) -> np.ndarray:
    """The table with scaled queries and a column of ones, so that one product gives sums of values and of weights; its last row is zero."""
    out = _room(spare, "table", (len(table), 4 * WIDTH + 1), table.dtype)
    out[:, : 4 * WIDTH] = table
    out[:, :WIDTH] *= F32(1 / np.sqrt(WIDTH))
    out[:, 4 * WIDTH] = 1
    out[-1] = 0
    return out


def _backward(looked: np.ndarray, c: np.ndarray, d: np.ndarray, known: _Known, windows: np.ndarray, spots: np.ndarray, share: float, spare: dict, moved: np.ndarray):
    """Gradients of the class layer and of the biases, and the probabilities of the targets. ``moved`` gets those of the
    entries that are looked back at, one row of the table for each, before the queries' scale. Entries that are missing are
    the last of the rows. Each target counts ``share``."""
    size, n, kind = len(windows), len(spots), looked.dtype
    at = slice(None) if n == WINDOW else spots
    x, y = windows[:, :-1], windows[:, 1:][:, at].ravel()
    distance = spots[:, None] - np.arange(WINDOW)
    reach = np.maximum(distance, 0)
    rows = np.take(looked, x, axis=0, out=_room(spare, "rows", (size, WINDOW, 4 * WIDTH + 1), kind), mode="clip")
    own = rows[:, at]
    q, k, r, v = own[..., :WIDTH], rows[..., WIDTH : 2 * WIDTH], own[..., 2 * WIDTH : 3 * WIDTH], rows[..., 3 * WIDTH :]
    # Softmaxes aren't divided by their sums: what they are multiplied with is, as it is narrower.
    p = np.matmul(q, k.transpose(0, 2, 1), out=_room(spare, "p", (size, n, WINDOW), kind))
    p += np.where(distance >= 0, d[reach], F32(-1e9))
    np.exp(np.minimum(p, F32(60), out=p), out=p)
    o = np.matmul(p, v, out=_room(spare, "o", (size, n, WIDTH + 1), kind))
    part = 1 / np.maximum(o[..., WIDTH:], F32(1e-30))
    o = np.multiply(o[..., :WIDTH], part, out=_room(spare, "mean", (size, n, WIDTH), kind))
    h = np.add(r, o, out=_room(spare, "h", (size, n, WIDTH), kind)).reshape(-1, WIDTH)
    z = np.matmul(h, c, out=_room(spare, "z", (size * n, CLASSES), kind))
    z += np.take(known.class_log, x[:, at].ravel(), axis=0, out=_room(spare, "logs", (size * n, CLASSES), known.class_log.dtype), mode="clip")
    np.exp(np.minimum(z, F32(80), out=z), out=z)
    sums = z @ np.ones(CLASSES, kind)
    target = np.arange(0, z.size, CLASSES) + known.classes.take(y)
    right = z.ravel().take(target)
    z.ravel()[target] = right - sums
    weight = (F32(share) * (y < len(looked) - 1) / sums)[:, None]
    dh = (z @ c.T).reshape(size, n, WIDTH)
    dh *= weight.reshape(size, n, 1)
    g = _room(spare, "g", (size, n, WIDTH + 1), kind)
    np.multiply(dh, part, out=g[..., :WIDTH])
    np.negative(np.einsum("ijk,ijk->ij", g[..., :WIDTH], o), out=g[..., WIDTH])
    ds = np.matmul(g, v.transpose(0, 2, 1), out=_room(spare, "ds", (size, n, WINDOW), kind))
    ds *= p
    biases = np.bincount(reach.ravel(), ds.sum(axis=0).ravel(), minlength=WINDOW).astype(F32)
    if n < WINDOW:
        moved[:] = 0
    moved[:, at, :WIDTH] = np.matmul(ds, k)
    np.matmul(ds.transpose(0, 2, 1), q, out=moved[..., WIDTH : 2 * WIDTH])
    moved[:, at, 2 * WIDTH : 3 * WIDTH] = dh
    np.matmul(p.transpose(0, 2, 1), g[..., :WIDTH], out=moved[..., 3 * WIDTH :])
    h *= weight
    return h.T @ z, biases, right / sums


def gradients(params: dict, prior: Prior, windows: np.ndarray, spots: np.ndarray) -> tuple[float, dict, int]:
    """Summed loss of the class layer, its gradients and the number of targets, for windows of WINDOW + 1 entries (-1 is none).
    All entries but the last are what is looked back at; each one at ``spots`` predicts its next."""
    table = _table(params)
    windows = np.where(windows < 0, len(table) - 1, windows)
    moved, sums, use = np.empty((len(windows), WINDOW, table.shape[1]), table.dtype), np.empty_like(table), windows[:, 1:][:, spots].ravel() < len(table) - 1
    c, d, right = _backward(_looked_up(table, {}), params["c"], params["d"], _Known(prior), windows, spots, 1.0, {}, moved)
    _scatter(windows[:, :-1].ravel(), moved.reshape(-1, table.shape[1]), sums, {})
    sums[:, :WIDTH] *= F32(1 / np.sqrt(WIDTH))
    return -float(np.log(right[use]).sum()), {k: sums[:-1, i * WIDTH : (i + 1) * WIDTH] for i, k in enumerate(_ROW)} | {"c": c, "d": d}, int(use.sum())


class _Adam:
    """Adam over one array, in place, a part that stays in the cache at a time. Both moments are sums, not means."""

    def __init__(self, values: np.ndarray, part: int = 16_384):
        self.values, self.first, self.second = values, np.zeros_like(values), np.zeros_like(values)
        self.part, self.spare = part, np.empty(part, values.dtype)

    def step(self, grads: np.ndarray, step: int, pace: float) -> None:
        """Overwrites ``grads``."""
        root = np.sqrt(0.01 / (1 - 0.99**step))
        pace, least = F32(pace * 0.1 / (1 - 0.9**step) / root), F32(1e-8 / root)
        for low in range(0, len(grads), self.part):
            here = slice(low, low + self.part)
            g, first, second = grads[here], self.first[here], self.second[here]
            t = self.spare[: len(g)]
            first *= F32(0.9)
            first += g
            second *= F32(0.99)
            g *= g
            second += g
            np.sqrt(second, out=t)
            t += least
            np.divide(first, t, out=t)
            t *= pace
            self.values[here] -= t


def train(params: dict, prior: Prior, windows: np.ndarray, rate: float = 0.01, batch: int = 128, least: int = 160, seed: int = 0) -> dict:
    """Adam over the windows in a seeded order, once, or as often as makes ``least`` steps, with a rising and falling rate.
    Every place of a window that an entry follows is a target."""
    entries, spots, known = len(params["q"]), np.arange(WINDOW), _Known(prior)
    flat = np.concatenate([_table(params).ravel(), params["c"].ravel(), params["d"]])
    grads, cuts = np.empty_like(flat), np.cumsum([(entries + 1) * 4 * WIDTH, params["c"].size])
    (table, c, d), (sums, dc, dd) = np.split(flat, cuts), np.split(grads, cuts)
    table, sums, c, dc = table.reshape(entries + 1, -1), sums.reshape(entries + 1, -1), c.reshape(WIDTH, -1), dc.reshape(WIDTH, -1)
    adam, rng, spare = _Adam(flat), np.random.default_rng(seed), {}
    windows = np.where(windows < 0, np.int16(entries), windows)
    steps = max(-(-len(windows) // batch), least)
    order = np.concatenate([rng.permutation(len(windows)) for _ in range(-(-steps * batch // len(windows)))])
    for step in range(1, steps + 1):
        chosen = windows[order[(step - 1) * batch : step * batch]].astype(np.int64)
        moved = _room(spare, "moved", (len(chosen), WINDOW, 4 * WIDTH), F32)
        looked, share = _looked_up(table, spare), 1 / max(np.count_nonzero(chosen[:, 1:] < entries), 1)
        dc[:], dd[:] = 0, 0
        for low in range(0, len(chosen), CHUNK):
            at = slice(low, low + CHUNK)
            layer, biases, _ = _backward(looked, c, d, known, chosen[at], spots, share, spare, moved[at])
            dc += layer
            dd += biases
        _scatter(chosen[:, :-1].ravel(), moved.reshape(-1, 4 * WIDTH), sums, spare)
        sums[:, :WIDTH] *= F32(1 / np.sqrt(WIDTH))
        adam.step(grads, step, rate * min(1.0, step / 20) * max(0.1, 1 - step / (steps + 1)))
    return {k: table[:-1, i * WIDTH : (i + 1) * WIDTH].copy() for i, k in enumerate(_ROW)} | {"c": c.copy(), "d": d.copy()}


class Scorer:
    """Log-probabilities of whole texts, each id scored once, in batches of windows."""

    def __init__(self, prior: Prior, params: dict):
        self.prior = prior
        entries = len(params["q"])
        nothing = np.zeros((1, WIDTH), F32)
        self.q = np.concatenate([params["q"] * F32(1 / np.sqrt(WIDTH)), nothing])
        self.k = np.concatenate([params["k"], nothing])
        # A last column of ones makes the same product give the softmax's sum; the row of "none" is all zero.
        self.v = np.concatenate([np.concatenate([params["v"], np.ones((entries, 1), F32)], axis=1), np.zeros((1, WIDTH + 1), F32)])
        self.c, self.none = params["c"], entries
        # What the class layer gets from the entry itself, whatever lies further back.
        self.base = np.concatenate([prior.class_log + params["r"] @ params["c"], np.zeros((1, CLASSES), F32)])
        self.bias = np.where(_CAUSAL, params["d"][_REACH], F32(-1e9)).astype(F32)
        norm = lambda t: float(np.sqrt((t.astype(np.float64) ** 2).sum(axis=1)).max())
        reach = norm(self.q) * norm(self.k) + float(np.abs(params["d"]).max())
        self.safe = reach < 60 and (norm(params["r"]) + norm(params["v"])) * norm(self.c.T) < 50

    def logs(self, ids: np.ndarray, bounds: np.ndarray, chunk: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """Two natural logarithms for each id of texts (ids ``ids[bounds[i]:bounds[i + 1]]``) that add up to that of its
        probability: for ids that begin words, of the id among those, and that a word begins; for others, all and zero."""
        prior, n = self.prior, len(ids)
        if not n:
            return np.zeros(0), np.zeros(0)
        # Each text fills whole blocks of STRIDE places after one that holds nothing, so a window is two neighbouring blocks.
        lengths = np.diff(bounds)
        blocks = -(-lengths // STRIDE) + 1
        lead = np.cumsum(blocks) - blocks
        slot = np.arange(n) + np.repeat((lead + 1) * STRIDE - bounds[:-1], lengths)
        target = prior.entry[ids]
        before = np.concatenate([[prior.end_entry], target[:-1]])
        before[bounds[:-1][lengths > 0]] = prior.end_entry
        total = int(blocks.sum())
        x, y = np.full(total * STRIDE, self.none, np.int32), np.zeros(total * STRIDE, np.int32)
        x[slot], y[slot] = before, target
        own, turn = np.zeros(total * STRIDE), np.zeros(total * STRIDE)
        starting = CLASSES // 2
        sums = np.zeros((CLASSES, 2), F32)
        sums[:, 0], sums[:starting, 1] = 1, 1
        for at in range(1, total, chunk):
            here = slice(at * STRIDE, min(total, at + chunk) * STRIDE)
            both, mine = x[here.start - STRIDE : here.stop], x[here]
            windows = lambda table: as_strided(rows := table.take(both, axis=0), (len(mine) // STRIDE, WINDOW, rows.shape[1]), (STRIDE * rows.strides[0], *rows.strides), writeable=False)
            s = np.matmul(self.q.take(mine, axis=0).reshape(-1, STRIDE, WIDTH), windows(self.k).transpose(0, 2, 1))
            s += self.bias
            if not self.safe:
                s -= s.max(axis=2, keepdims=True)
            np.exp(s, out=s)
            o = np.matmul(s, windows(self.v)).reshape(-1, WIDTH + 1)
            z = (o[:, :WIDTH] / np.maximum(o[:, WIDTH:], F32(1e-30))) @ self.c
            z += self.base.take(mine, axis=0)
            if not self.safe:
                z -= z.max(axis=1, keepdims=True)
            kind = prior.classes[y[here]]
            chosen = z[np.arange(len(z)), kind] + prior.within[np.minimum(mine, self.none - 1), y[here]]
            np.exp(z, out=z)
            logs = np.log(z @ sums)
            word = kind < starting
            own[here] = chosen - np.where(word, logs[:, 1], logs[:, 0])
            turn[here] = np.where(word, logs[:, 1] - logs[:, 0], 0)
        return own[slot] + prior.rest[ids], turn[slot]

    def word_logs(self, ids: np.ndarray, bounds: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Natural logarithm of the probability of each word: its ids, and that the next word begins after them.
        ``words``: where words begin in ``ids``; the end of each text is its last word."""
        own, turn = self.logs(ids, bounds)
        out = np.add.reduceat(own, words)
        after = np.append(turn[words[1:]], 0.0)
        after[ids[words] == self.prior.end] = 0.0
        return out + after
