"""A causal self-attention model over subword ids, in numpy: forward, gradients, Adam. Whole tables run through :mod:`lm_graph`.

Ids are ranked by corpus frequency. A prediction is a class, by the corpus's
bigrams and what attention adds to their logits, times the id's share of its
class after the id before it, again by corpus bigrams. Frequent ids fall in
CLUSTERS classes by the company they keep, rarer ones in TAILS bands of rank. A
window holds SPAN inputs and scores the last STRIDE of them, so that every token
is scored once, with at least LEAD tokens before it where its text has them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

VOCAB, END = 50_257, 50_256
SPAN, STRIDE, WIDTH = 24, 18, 16
LEAD = SPAN - STRIDE
#: Input rows (the last SHARED are for all rarer ids), ids with bigrams of their own, classes of these, classes of the rest.
INPUTS, SHARED, HEAD, CLUSTERS, TAILS = 2048, 64, 2048, 56, 8
CLASSES = CLUSTERS + TAILS
PAD = INPUTS
#: Columns of the bigram counts: frequent ids, and the bands of the others.
COLUMNS = HEAD + TAILS
_F = np.float32


@dataclass
class Ids:
    """What corpus counts say of each id: rank, input row, column of the bigram counts, and its count."""

    rank: np.ndarray
    row: np.ndarray
    column: np.ndarray
    mass: np.ndarray


@dataclass
class Tables:
    """Class of each id, log share of a band for rarer ids, bigram logits of classes, and log shares of frequent ids after each row."""

    cls: np.ndarray
    share: np.ndarray
    pairs: np.ndarray
    inner: np.ndarray


def ids_of(counts: np.ndarray) -> Ids:
    """Rank ids by count, the end first."""
    counts = counts.astype(np.float64)
    rank = np.empty(VOCAB, np.int64)
    by = np.lexsort((np.arange(VOCAB), -counts))
    by = np.concatenate([[END], by[by != END]])
    rank[by] = np.arange(VOCAB)
    edges = np.unique(np.geomspace(HEAD, VOCAB, TAILS + 1).astype(np.int64))
    band = np.minimum(np.searchsorted(edges, rank, "right") - 1, TAILS - 1)
    row = np.where(rank < INPUTS - SHARED, rank, INPUTS - SHARED + rank % SHARED)
    return Ids(rank, row.astype(np.int32), np.where(rank < HEAD, rank, HEAD + band).astype(np.int32), counts + 0.1)


def clusters(company: np.ndarray, turns: int = 15, depth: int = 24) -> np.ndarray:
    """A cluster for each column of bigram counts: directions of their leading singular vectors, by k-means on the sphere."""
    norm = company / np.sqrt((company.sum(1, keepdims=True) + 1) * (company.sum(0, keepdims=True) + 1))
    values, vectors = np.linalg.eigh(norm.T @ norm)
    x = vectors[:, -depth:] * np.sqrt(np.maximum(values[-depth:], 0))
    x *= np.sign(x[np.abs(x).argmax(0), np.arange(depth)] + 0.5)  # a direction's sign is free
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    weight, centres = company.sum(0) + 1, x[:CLUSTERS].copy()
    for _ in range(turns):
        own = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x * weight[:, None])
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.maximum(length, 1e-9), centres)
    return (x @ centres.T).argmax(1)


def tables(ids: Ids, bigrams: np.ndarray) -> Tables:
    """From bigram counts (INPUTS, COLUMNS) to classes and logs; shares never seen after a row fall back to the corpus's."""
    bigrams = bigrams.astype(np.float64)
    group = np.concatenate([clusters(bigrams[:, :HEAD]), CLUSTERS + np.arange(TAILS)])
    cls = group[ids.column]
    by_class = lambda m: np.stack([m[:, group == k].sum(1) for k in range(CLASSES)], 1)
    pairs = by_class(bigrams)
    some = np.bincount(cls, minlength=CLASSES) > 0  # a class without ids gets next to nothing
    prior = np.where(some, pairs.sum(0) + 0.5, 1e-30)
    prior /= prior.sum()
    kinds = (pairs > 0).sum(1, keepdims=True) + 1
    logits = np.log((pairs + kinds * prior) / (pairs.sum(1, keepdims=True) + kinds))
    share = ids.mass / np.bincount(cls, ids.mass, CLASSES)[cls]
    own = np.empty(HEAD)
    own[ids.rank[ids.rank < HEAD]] = share[ids.rank < HEAD]
    seen = by_class((bigrams > 0).astype(np.float64))[:, group[:HEAD]] + 0.5
    inner = np.log((bigrams[:, :HEAD] + seen * own) / (pairs[:, group[:HEAD]] + seen))
    zero = np.zeros((INPUTS, 1))
    return Tables(cls.astype(np.int32), np.where(ids.rank < HEAD, 0, np.log(share)).astype(_F), np.vstack([logits, np.log(prior)]).astype(_F), np.vstack([np.hstack([inner, zero]), np.zeros(HEAD + 1)]).astype(_F))


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of texts laid end to end: inputs (n, SPAN) and targets (n, STRIDE) as places in :func:`padded`, and text of each window."""
    targets = lengths + 1
    many = -(-targets // STRIDE)
    base = (1 + np.cumsum(lengths + 2) - (lengths + 2)).astype(np.int32)  # place of each text's opening end
    text = np.repeat(np.arange(len(lengths)), many)
    first = ((np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)) * STRIDE).astype(np.int32)
    inside = first[:, None] + np.arange(-LEAD, STRIDE, dtype=np.int32)
    last, begin = targets[text][:, None].astype(np.int32), base[text][:, None]
    inputs = np.where((inside >= 0) & (inside < last), begin + inside, np.int32(0))
    aims = first[:, None] + np.arange(1, STRIDE + 1, dtype=np.int32)
    return inputs, np.where(aims <= last, begin + aims, np.int32(0)), text


def padded(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Ids of texts laid end to end, each as [end] + ids + [end]; place 0 is padding."""
    out = np.full(1 + len(ids) + 2 * len(lengths), END, np.int64)
    out[2 + np.arange(len(ids)) + np.repeat(2 * np.arange(len(lengths)), lengths)] = ids
    return out


#: What is trained; the tables stay as counted.
NAMES = ("embed", "place", "wq", "wkv", "wo", "out")


def start(seed: int = 3) -> dict[str, np.ndarray]:
    """Parameters before training: attention whose output adds nothing yet."""
    rng = np.random.default_rng(seed)
    p = {"embed": rng.normal(0, 0.3, (INPUTS + 1, WIDTH)), "place": rng.normal(0, 0.3, (SPAN, WIDTH)), "out": np.zeros((WIDTH, CLASSES))}
    p |= {k: rng.normal(0, WIDTH**-0.5, (WIDTH, n * WIDTH)) for k, n in (("wq", 1), ("wkv", 2), ("wo", 1))}
    return {k: p[k].astype(_F) for k in NAMES}


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].reshape(-1) for k in NAMES])


def _views(v: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in NAMES:
        out[k] = v[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def unflat(v: np.ndarray) -> dict[str, np.ndarray]:
    return _views(v.astype(_F), start())


_CAUSAL = (np.arange(SPAN)[None] <= np.arange(STRIDE)[:, None] + LEAD).astype(_F)


def attend(p: dict[str, np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Hidden state of the scored inputs (n * STRIDE, WIDTH) of windows of input rows, and what the gradients need.

    The causal mask is a factor after the exponential; padding has no key and no weight.
    """
    n, kind = len(rows), p["embed"].dtype
    x = p["embed"][rows]
    x += p["place"]
    kv = x.reshape(-1, WIDTH) @ p["wkv"]
    pad = rows == PAD
    kv[pad.reshape(-1)] = 0
    k = kv[:, :WIDTH].reshape(n, SPAN, WIDTH)
    v = np.empty((n, SPAN, WIDTH + 1), kind)
    v[:, :, :WIDTH] = kv[:, WIDTH:].reshape(n, SPAN, WIDTH)
    v[:, :, WIDTH] = ~pad
    xq = np.ascontiguousarray(x[:, LEAD:]).reshape(-1, WIDTH)
    q = xq @ (p["wq"] * kind.type(WIDTH**-0.5))
    a = q.reshape(n, STRIDE, WIDTH) @ k.transpose(0, 2, 1)
    np.clip(a, -60, 60, out=a)
    np.exp(a, out=a)
    a *= _CAUSAL
    c = (a @ v).reshape(-1, WIDTH + 1)
    scale = 1 / np.maximum(c[:, WIDTH:], kind.type(1e-30))
    c = c[:, :WIDTH] * scale
    h = c @ p["wo"]
    h += xq
    np.tanh(h, out=h)
    return h, (x, xq, q, k, v, a, c, scale)


def logits(p: dict[str, np.ndarray], pairs: np.ndarray, h: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Logits of the classes (n * STRIDE, CLASSES); bounded, see Adam, so that their exponentials need no maximum."""
    z = pairs[rows[:, LEAD:].reshape(-1)]
    z += h @ p["out"]
    return z


def log_classes(p: dict[str, np.ndarray], pairs: np.ndarray, rows: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """log P(class) of each target, (n, STRIDE)."""
    z = logits(p, pairs, attend(p, rows)[0], rows)
    aim = z[np.arange(len(z)), cls.reshape(-1)]
    np.exp(z, out=z)
    return (aim - np.log(z @ np.ones(CLASSES, z.dtype))).reshape(cls.shape)


def gradients(p: dict[str, np.ndarray], pairs: np.ndarray, rows: np.ndarray, cls: np.ndarray, valid: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean cross-entropy of the valid targets."""
    n, kind = len(rows), p["embed"].dtype
    h, (x, xq, q, k, v, a, c, scale) = attend(p, rows)
    z = logits(p, pairs, h, rows)
    np.exp(z, out=z)
    weight = (valid.reshape(-1) / max(1, int(valid.sum()))).astype(kind)
    z *= (weight / (z @ np.ones(CLASSES, kind)))[:, None]
    z[np.arange(len(z)), cls.reshape(-1)] -= weight
    g = {"out": h.T @ z}
    dh = z @ p["out"].T
    dh *= 1 - h * h
    g["wo"] = c.T @ dh
    dc = dh @ p["wo"].T
    a *= scale.reshape(n, STRIDE, 1)
    by = dc.reshape(n, STRIDE, WIDTH)
    dkv = np.empty((n, SPAN, 2 * WIDTH), kind)
    dkv[:, :, WIDTH:] = a.transpose(0, 2, 1) @ by
    ds = by @ v[:, :, :WIDTH].transpose(0, 2, 1)
    ds -= np.einsum("ij,ij->i", dc, c).reshape(n, STRIDE, 1)
    ds *= a
    dkv[:, :, :WIDTH] = ds.transpose(0, 2, 1) @ q.reshape(n, STRIDE, WIDTH)
    dq = (ds @ k).reshape(-1, WIDTH)
    dq *= kind.type(WIDTH**-0.5)
    g["wq"] = xq.T @ dq
    both = dkv.reshape(-1, 2 * WIDTH)
    both[(rows == PAD).reshape(-1)] = 0
    g["wkv"] = x.reshape(-1, WIDTH).T @ both
    dx = (both @ p["wkv"].T).reshape(n, SPAN, WIDTH)
    dh += dq @ p["wq"].T
    dx[:, LEAD:] += dh.reshape(n, STRIDE, WIDTH)
    g["place"] = dx.sum(0)
    g["embed"] = np.zeros_like(p["embed"])
    own = rows.reshape(-1).astype(np.uint16)
    order = np.argsort(own, kind="stable")
    own = own[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    g["embed"][own[first]] = np.add.reduceat(dx.reshape(-1, WIDTH)[order], first)
    g["embed"][PAD] = 0
    return g


class Adam:
    """Moves all parameters at once, as views of one vector; both moments are kept without the factors 0.1 and 0.01 of their sums."""

    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.all, self.rate, self.step = flat(p), rate, 0
        self.m, self.v, self.g = (np.zeros_like(self.all) for _ in range(3))
        self.p, self.into = _views(self.all, p), _views(self.g, p)

    def move(self, g: dict[str, np.ndarray]) -> None:
        self.step += 1
        for k, x in g.items():
            self.into[k][:] = x
        m, v, x = self.m, self.v, self.g
        m *= _F(0.9)
        m += x
        v *= _F(0.99)
        x *= x
        v += x
        unit = (0.01 / (1 - 0.99**self.step)) ** 0.5
        np.sqrt(v, out=x)
        x += _F(1e-8 / unit)
        np.divide(m, x, out=x)
        x *= _F(self.rate * 0.1 / (1 - 0.9**self.step) / unit)
        self.all -= x
        np.clip(self.p["out"], -2, 2, out=self.p["out"])  # what attention adds to a logit is at most 2 * WIDTH
