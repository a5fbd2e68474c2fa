"""A small causal self-attention model over subword ids, trained and scored in numpy.

The next subword is predicted in two steps: its class by the network, and the subword within its class by its
corpus count. The class's probability is mixed from the network's and from the counts of pairs over all learning texts:
which class follows each embedding row. The weight of the counts grows with what was seen of a row. The network looks
at the last subwords of the text: one attention head with a learned bias for each distance, then one hidden layer over
the attended vector and the current embedding. Scoring cuts a text into windows of ``STEP`` targets with ``CONTEXT`` more
subwords before them as keys, so each subword is scored once, with a full context, and all windows of many texts go
through masked attention together.

Beside the probability of a subword, scoring gives that of a word beginning at its place. A word is what lies between two
beginnings, so the two make a probability of whole words that sums to one and can be mixed with counts of words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

STEP, CONTEXT = 32, 16
KEYS = STEP + CONTEXT
DIMENSIONS, HIDDEN, CLASSES, ROWS = 16, 32, 128, 4096
#: Classes that hold a single frequent subword; the last class is the end of the text, the others share the rest.
SINGLES = 96
SMOOTH = 0.1
_NEVER = np.float32(-1e9)


@dataclass
class Vocabulary:
    """For each subword id, the end of text last: its row of the embeddings, its class and its log10 share there.

    ``begins`` has the share of each class that begins a word or ends the text.
    """

    row: np.ndarray
    kind: np.ndarray
    log_share: np.ndarray
    begins: np.ndarray

    @property
    def end(self) -> int:
        return len(self.row) - 1


def vocabulary(counts: np.ndarray, first: np.ndarray) -> Vocabulary:
    """Classes and embedding rows from corpus counts of all subwords; ``first`` marks those that begin a word.

    The last count is that of the end of text.
    """
    n = len(counts) - 1
    order = np.argsort(-counts[:n], kind="stable")
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.arange(n)
    # The first row is the start of a text; rare subwords share the last one.
    row = np.append(np.minimum(rank + 1, ROWS - 1), 0)
    kind = np.empty(n + 1, dtype=np.int64)
    mass = np.cumsum(counts[order[SINGLES:]] + SMOOTH)
    groups = CLASSES - 1 - SINGLES
    kind[order[:SINGLES]] = np.arange(min(SINGLES, n))
    kind[order[SINGLES:]] = SINGLES + np.minimum((mass / max(mass[-1] if len(mass) else 1, 1e-9) * groups).astype(np.int64), groups - 1)
    kind[n] = CLASSES - 1
    smoothed = counts + SMOOTH
    total = np.bincount(kind, weights=smoothed, minlength=CLASSES)
    begun = np.bincount(kind, weights=np.where(np.append(first, True), smoothed, 0), minlength=CLASSES)
    share = np.divide(begun, total, out=np.zeros(CLASSES), where=total > 0)
    return Vocabulary(row, kind, np.log10(smoothed / total[kind]).astype(np.float32), share.astype(np.float32))


@dataclass
class Network:
    embed: np.ndarray
    query: np.ndarray
    key: np.ndarray
    value: np.ndarray
    far: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.query, self.key, self.value, self.far, self.hidden, self.hidden_bias, self.out, self.out_bias]


def new_network(seed: int = 4) -> Network:
    r = np.random.default_rng(seed)
    d = DIMENSIONS
    draw = lambda *s, scale: r.normal(0, scale, s).astype(np.float32)
    zero = lambda *s: np.zeros(s, dtype=np.float32)
    return Network(draw(ROWS, d, scale=0.5), draw(d, d, scale=0.25), draw(d, d, scale=0.25), draw(d, d, scale=0.25), zero(KEYS), draw(2 * d, HIDDEN, scale=0.2), zero(HIDDEN), draw(HIDDEN, CLASSES, scale=0.2), zero(CLASSES))


#: How far back each key lies from each query, and which keys lie ahead of it.
_BACK = (CONTEXT + np.arange(STEP))[:, None] - np.arange(KEYS)[None, :]
_AHEAD = _BACK < 0


def attend(net: Network, rows: np.ndarray, there: np.ndarray):
    """Hidden layer and attention of windows: ``rows`` (n, KEYS) are embedding rows, ``there`` marks keys of the text."""
    x = net.embed[rows]
    # One product over all windows is faster than one for each.
    times = lambda t, by: (t.reshape(-1, t.shape[-1]) @ by).reshape(*t.shape[:-1], -1)
    now = np.ascontiguousarray(x[:, CONTEXT:])
    q, k, v = times(now, net.query), times(x, net.key), times(x, net.value)
    z = q @ k.transpose(0, 2, 1)
    z += np.where(_AHEAD, _NEVER, net.far[np.maximum(_BACK, 0)])
    z += np.where(there, np.float32(0), _NEVER)[:, None, :]
    longest = lambda t: float(np.sqrt(np.einsum("nij,nij->ni", t, t).max(initial=0)))
    if not longest(q) * longest(k) + float(np.abs(net.far).max()) < 60:
        # Where a value could overflow, or all could vanish, each target's largest is taken off.
        z -= z.max(axis=2, keepdims=True)
    np.exp(z, out=z)
    # A target that sees no key is of no text; it gets zeros.
    z *= 1 / np.maximum(z.sum(axis=2, keepdims=True), np.float32(1e-30))
    both = np.concatenate([z @ v, now], axis=2)
    h = times(both, net.hidden)
    h += net.hidden_bias
    np.maximum(h, 0, out=h)
    return x, q, k, v, z, both, h


def class_log_probabilities(net: Network, h: np.ndarray) -> np.ndarray:
    z = h @ net.out + net.out_bias
    z -= z.max(axis=-1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=-1, keepdims=True))


#: Numbers are added up as multiples of one in this many.
FIXED = float(1 << 24)


def flat(net: Network) -> np.ndarray:
    return np.concatenate([p.ravel() for p in net.parts()])


def from_flat(like: Network, numbers: np.ndarray) -> Network:
    """A network of the shapes of ``like`` from all its numbers in one row."""
    parts, at = [], 0
    for p in like.parts():
        parts.append(numbers[at : at + p.size].reshape(p.shape).astype(np.float32))
        at += p.size
    return Network(*parts)


def copy_of(net: Network) -> Network:
    return from_flat(net, flat(net))


def _keep_pages() -> None:
    """Once a large array has come and gone, freed memory up to its size is used again; else each step asks the system for its arrays' pages anew, a third of its time."""
    np.empty(24 << 20, dtype=np.uint8)


def train(rows: np.ndarray, there: np.ndarray, kinds: np.ndarray, aimed: np.ndarray, net: Network, epochs: int = 4, batch: int = 64, rate: float = 0.15, seed: int = 4, seen: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """Fit ``net`` in place by stochastic gradient steps, sized by past gradients, whose squares are returned to go on with.

    rows, there (n, KEYS): inputs; kinds, aimed (n, STEP): the class to predict, and whether there is one.
    """
    _keep_pages()
    seen = seen or [np.full_like(p, 1e-6) for p in net.parts()]
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for part in np.array_split(order.permutation(len(rows)), max(1, len(rows) // batch)):
            if not len(part):
                continue
            (met, embed), *grads = _gradients(net, rows[part], there[part], kinds[part], aimed[part])
            # Embeddings that the batch has none of stay as they are.
            squares = seen[0][met] + embed * embed
            seen[0][met] = squares
            net.embed[met] -= rate * embed / np.sqrt(squares)
            for p, g, s in zip(net.parts()[1:], grads, seen[1:], strict=True):
                s += g * g
                p -= rate * g / np.sqrt(s)
    return seen


def gradients(net: Network, rows: np.ndarray, there: np.ndarray, kinds: np.ndarray, aimed: np.ndarray) -> list[np.ndarray]:
    """Of the mean negative log probability of the aimed classes, in the order of ``Network.parts``."""
    (met, embed), *rest = _gradients(net, rows, there, kinds, aimed)
    whole = np.zeros_like(net.embed)
    whole[met] = embed
    return [whole, *rest]


def _gradients(net: Network, rows: np.ndarray, there: np.ndarray, kinds: np.ndarray, aimed: np.ndarray) -> list:
    """``gradients``; that of the embeddings as the rows that are met and theirs."""
    x, q, k, v, a, both, h = attend(net, rows, there)
    flat = lambda t: t.reshape(-1, t.shape[-1])
    hidden = flat(h)
    # Each target's row is the gradient of its logits but for one factor, which the narrower arrays take.
    d_out = hidden @ net.out
    d_out += net.out_bias
    if not d_out.max() < 60:
        d_out -= d_out.max(axis=1, keepdims=True)
    np.exp(d_out, out=d_out)
    whole = d_out.sum(axis=1)
    d_out[np.arange(kinds.size), kinds.ravel()] -= whole
    factor = ((aimed / max(aimed.sum(), 1)).ravel() / whole).astype(d_out.dtype)
    g_out, g_out_bias = (hidden * factor[:, None]).T @ d_out, factor @ d_out
    d_h = d_out @ net.out.T
    d_h *= (hidden > 0) * factor[:, None]
    g_hidden, g_hidden_bias = flat(both).T @ d_h, d_h.sum(axis=0)
    d_both = (d_h @ net.hidden.T).reshape(both.shape)
    d_att, d_now = d_both[..., :DIMENSIONS], d_both[..., DIMENSIONS:]
    d_a = d_att @ v.transpose(0, 2, 1)
    d_v = a.transpose(0, 2, 1) @ d_att
    d_z = a * (d_a - (d_a * a).sum(axis=2, keepdims=True))
    g_far = np.bincount(np.maximum(_BACK, 0).ravel(), weights=np.where(_AHEAD, 0, d_z.sum(axis=0)).ravel(), minlength=KEYS).astype(np.float32)
    d_q, d_k = d_z @ k, d_z.transpose(0, 2, 1) @ q
    now = flat(both)[:, DIMENSIONS:]
    g_query, g_key, g_value = now.T @ flat(d_q), flat(x).T @ flat(d_k), flat(x).T @ flat(d_v)
    d_x = flat(d_k) @ net.key.T
    d_x += flat(d_v) @ net.value.T
    d_x = d_x.reshape(x.shape)
    d_x[:, CONTEXT:] += (flat(d_q) @ net.query.T).reshape(d_now.shape)
    d_x[:, CONTEXT:] += d_now
    used = np.flatnonzero(there.ravel())
    # Numbers of 16 bits are sorted by their digits.
    met = rows.ravel()[used].astype(np.int16)
    order = np.argsort(met, kind="stable")
    used, met = used[order], met[order]
    first = np.flatnonzero(np.concatenate([[True], met[1:] != met[:-1]])) if len(met) else met
    g_embed = met[first], np.add.reduceat(flat(d_x)[used], first, axis=0) if len(met) else flat(d_x)[used]
    return [g_embed, g_query, g_key, g_value, g_far, g_hidden, g_hidden_bias, g_out, g_out_bias]


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts laid end to end: the position of each window's first target, and the bounds of its text."""
    counts = -(-lengths // STEP)
    ends = np.cumsum(lengths)
    text = np.repeat(np.arange(len(lengths)), counts)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    return (ends - lengths)[text] + nth * STEP, (ends - lengths)[text], ends[text]


def window_inputs(voc: Vocabulary, ids: np.ndarray, first: np.ndarray, begin: np.ndarray, end: np.ndarray):
    """Inputs and targets of windows over ``ids``, in which every text ends with the end id.

    The input at a position is the subword before it; before the first one stands the start of the text.
    """
    at = first[:, None] - CONTEXT + np.arange(KEYS)[None, :]
    there = (at >= begin[:, None]) & (at < end[:, None])
    before = np.clip(at - 1, 0, len(ids) - 1)
    rows = np.where(at > begin[:, None], voc.row[ids[before]], 0)
    rows[~there] = 0
    target = ids[np.minimum(at[:, CONTEXT:], len(ids) - 1)]
    return rows, there, target, there[:, CONTEXT:]


def pair_counts(voc: Vocabulary, ids: np.ndarray, lengths: np.ndarray, held: np.ndarray) -> np.ndarray:
    """How often each class follows each embedding row in the texts that are not ``held``; a text follows row 0."""
    ends = np.cumsum(lengths)
    before = np.concatenate([[0], voc.row[ids[:-1]]])[: len(ids)]
    before[(ends - lengths)[lengths > 0]] = 0
    cells = before * CLASSES + voc.kind[ids]
    return np.bincount(cells[np.repeat(~held, lengths)], minlength=ROWS * CLASSES).reshape(ROWS, CLASSES)


@dataclass
class Pairs:
    """The share of each class after each embedding row, and the weight of that share in the mixture."""

    share: np.ndarray
    weight: np.ndarray


#: Orders of magnitude of what was seen of an embedding row, none included.
LEVELS = 64


def levels(counts: np.ndarray) -> np.ndarray:
    seen = counts.sum(axis=1)
    return np.where(seen > 0, np.log2(np.maximum(seen, 1)).astype(np.int64) + 1, 0)


def _prior(counts: np.ndarray) -> np.ndarray:
    prior = counts.sum(axis=0) + SMOOTH
    return prior / prior.sum()


def pair_places(net: Network, counts: np.ndarray, rows: np.ndarray, there: np.ndarray, kinds: np.ndarray, aimed: np.ndarray, chunk: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """For each aimed target of windows of learning texts: the order of magnitude of the row before it, and its class's probability by the network and by the counts.

    Those windows are in the counts, so each target is judged by the counts without itself.
    """
    _keep_pages()
    prior, seen, level = _prior(counts), counts.sum(axis=1), levels(counts)
    alone = Pairs(np.zeros((ROWS, CLASSES), dtype=np.float32), np.zeros(ROWS, dtype=np.float32))
    scorer = Scorer(net, Vocabulary(*(np.zeros(0, dtype=np.int64) for _ in range(3)), np.zeros(CLASSES, dtype=np.float32)), alone)
    at, parts = [np.zeros(0, dtype=np.int64)], [np.zeros((2, 0))]
    for i in range(0, len(rows), chunk):
        s, aim = slice(i, i + chunk), aimed[i : i + chunk]
        own = scorer.probabilities(rows[s], there[s], kinds[s], aim)[0].astype(np.float64)
        kind, before = kinds[s][aim], rows[s, CONTEXT:][aim]
        parts.append(np.stack([own, (np.maximum(counts[before, kind] - 1, 0) + prior[kind]) / np.maximum(seen[before], 1)]))
        at.append(level[before])
    return np.concatenate(at), np.concatenate(parts, axis=1)


def pair_model(counts: np.ndarray, weight: np.ndarray) -> Pairs:
    """Of the counts and the weight that they have at each order of magnitude."""
    level, seen = levels(counts), counts.sum(axis=1)
    weight = np.where(level > 0, np.minimum(weight[level], 0.999), 0)
    return Pairs(((counts + _prior(counts)) / (seen + 1)[:, None]).astype(np.float32), weight.astype(np.float32))


class Scorer:
    """The network with its projections folded into one table for each use of an embedding row, and the pair counts."""

    def __init__(self, net: Network, voc: Vocabulary, pairs: Pairs):
        attended, now = net.hidden[:DIMENSIONS], net.hidden[DIMENSIONS:]
        self.voc = voc
        self.query, self.key = net.embed @ net.query, net.embed @ net.key
        # The last column adds up the weights of a target's keys.
        self.value = np.concatenate([net.embed @ net.value @ attended, np.ones((ROWS, 1), dtype=np.float32)], axis=1)
        self.now = net.embed @ now + net.hidden_bias
        self.bias = np.where(_AHEAD, _NEVER, net.far[np.maximum(_BACK, 0)])
        longest = lambda x: float(np.sqrt((x.astype(np.float64) ** 2).sum(axis=1).max()))
        self.largest = longest(self.query) * longest(self.key) + float(np.abs(net.far).max())
        self.out, self.out_bias = net.out, net.out_bias
        self.sums = np.stack([np.ones(CLASSES, dtype=np.float32), voc.begins], axis=1)
        self.share, self.weight = pairs.share.ravel(), pairs.weight
        self.begins = pairs.share @ voc.begins

    def probabilities(self, rows: np.ndarray, there: np.ndarray, kinds: np.ndarray, aimed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each aimed target, in order: the probability of its class, and that a word begins there."""
        now = rows[:, CONTEXT:]
        z = self.query[now] @ self.key[rows].transpose(0, 2, 1)
        z += self.bias
        z += np.where(there, np.float32(0), _NEVER)[:, None, :]
        if not self.largest < 60:
            # Where a value could overflow, or all could vanish, each target's largest is taken off.
            z -= z.max(axis=2, keepdims=True)
        np.exp(z, out=z)
        # A window's targets beyond the text's end see some key too, so no sum is 0.
        h = (z @ self.value[rows])[aimed]
        at = now[aimed]
        h = h[:, :-1] * (1 / h[:, -1:])
        h += self.now[at]
        np.maximum(h, 0, out=h)
        logits = h @ self.out
        logits += self.out_bias
        if not logits.max() < 60:
            logits -= logits.max(axis=1)[:, None]
        np.exp(logits, out=logits)
        kind = kinds[aimed]
        whole, begun = (logits @ self.sums).T
        scale = (1 - self.weight[at]) / whole
        own = logits[np.arange(len(logits)), kind] * scale + self.weight[at] * self.share[at * CLASSES + kind]
        return own, begun * scale + self.weight[at] * self.begins[at]


def log10_probabilities(scorer: Scorer, ids: np.ndarray, lengths: np.ndarray, chunk: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """For each subword of texts that lie end to end, each with the end id last: log10 of its probability, and of a word beginning there."""
    _keep_pages()
    first, begin, end = windows(lengths)
    voc = scorer.voc
    own, begins, done = np.empty(len(ids), dtype=np.float32), np.empty(len(ids), dtype=np.float32), 0
    for i in range(0, len(first), chunk):
        s = slice(i, i + chunk)
        rows, there, target, aimed = window_inputs(voc, ids, first[s], begin[s], end[s])
        # Windows follow each other, so their aimed targets are the subwords in order.
        p, b = scorer.probabilities(rows, there, voc.kind[target], aimed)
        own[done : done + len(p)], begins[done : done + len(p)] = p, b
        done += len(p)
    np.log10(np.maximum(own, 1e-30, out=own), out=own)
    np.log10(np.clip(begins, 1e-30, 1, out=begins), out=begins)
    own += voc.log_share[ids]
    return own, begins


def word_scores(own: np.ndarray, begins: np.ndarray, sizes: np.ndarray, is_end: np.ndarray) -> np.ndarray:
    """log10 of the probability of each word, given that one begins or the text ends; ``sizes`` are the words' subwords.

    A word ends where the next one or the end begins; an end of text has nothing after it.
    """
    first = np.cumsum(sizes) - sizes
    out = np.add.reduceat(own.astype(np.float64), first) - begins[first]
    out[:-1] += np.where(is_end[:-1], 0, begins[first[1:]])
    return out
