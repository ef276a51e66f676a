"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word enters as its own vector (vocabulary of the training sample), the mean
of the vectors of its character 4-grams, its smoothed log odds of standing in
toxic training texts, and the largest such odds of its first 3 to 8 bytes.  Two recurrent layers read each window of words, one in
either direction; attention pools their states into one logit.  Every
overlapping window of a text is scored, whole texts of any length; the
document's score is the calibrated largest logit.

Labels mark documents, not windows, so a toxic text trains with the windows
that hold its most telling words, a clean one with its most suspicious window
and random ones.  Training and gradients are numpy, on the driver, over a
sample of at most ``SAMPLE`` labelled rows of at most ``SAMPLE_CHARS``
characters, taken in the order of a hash of their ids.

Defined cases: null, empty and word-less texts are one window without words
and get the score of the network's bias; rows without a label or id teach
nothing; several labels of one id count as toxic if one is; a training sample
without both classes scores its share of toxic rows; null and repeated
``doc_id`` are rows of their own; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, give_back, importable, lean
from .textgrid import ALNUM, Grid, blocks, mix, ngrams

#: Labelled rows to train on: (clean, toxic), and the longest text among them.
SAMPLE, SAMPLE_CHARS = (2000, 1000), 10_000
#: Words of a window, and from one window to the next.
WINDOW, STRIDE = 16, 8
THRESHOLD = 0.3
VOCABULARY, CHAR_BITS = 5_000, 12
#: Lengths of the word beginnings that have odds of their own.
PREFIX = range(3, 9)
WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 8, 8, 8, 8
WORD_DROPOUT = 0.15
#: Windows that each of the two training phases shows the network, about.
VISITS = 70_000
#: Weight of a clean text in the calibration.
CLEAN_WEIGHT = 4
#: Decay of every parameter at each step.
DECAY = 2e-4


def char_grams(grid: Grid, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte 4-grams of words ``pick`` as 32-bit numbers, one for each byte,
    edges counted as blanks: flat, and the first of each word."""
    s, size = grid.starts[pick], grid.ends[pick] - grid.starts[pick]
    first = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else np.zeros(0, np.int64)
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    at, left = np.repeat(s, size) + place, np.repeat(size, size) - place
    d = np.concatenate([grid.data, np.full(2, 32, np.uint8)]).astype(np.uint32)
    code = np.where(place == 0, 32, d[at - 1]) << 8 | d[at]
    code = code << 8 | np.where(left > 1, d[at + 1], 32)
    return (code << 8 | np.where(left > 2, d[at + 2], 32)).astype(np.uint32), first


def prefixes(grid: Grid, pick: np.ndarray) -> np.ndarray:
    """Hashes of the first 3 ... 8 bytes of words ``pick`` (words x 6); 0 where
    a word is shorter."""
    s, size = grid.starts[pick], grid.ends[pick] - grid.starts[pick]
    out, h = np.zeros((len(pick), len(PREFIX)), np.uint64), np.zeros(len(pick), np.uint64)
    for n in range(1, PREFIX[-1] + 1):
        at = np.flatnonzero(size >= n)
        h[at] = mix(h[at] + grid.data[s[at] + n - 1] + np.uint64(n << 8))
        if n in PREFIX:
            out[at, n - PREFIX[0]] = h[at]
    return out


def _bucket(codes: np.ndarray) -> np.ndarray:
    return ((codes * np.uint32(2654435761)) >> np.uint32(32 - CHAR_BITS)).astype(np.int64)


def window_starts(counts: np.ndarray, window: int = WINDOW, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """(document, first word in it) of every window; each word is in one or
    two, a text without words has one."""
    n = np.maximum(1, -(-(counts - window) // stride) + 1)
    doc = np.repeat(np.arange(len(counts)), n)
    return doc, (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * stride


def window_words(grid: Grid, window: int = WINDOW, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Document of each window and its words (window x words, -1 for none)."""
    doc, start = window_starts(grid.counts, window, stride)
    at = (grid.bounds[doc] + start)[:, None] + np.arange(window)
    return doc, np.where(at < grid.bounds[doc + 1][:, None], at, -1)


def _scatter(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """n rows: the sums of the rows of ``values`` by their place."""
    out = np.zeros((n, values.shape[1]), np.float32)
    if len(at):
        order = np.argsort(at, kind="stable")
        at = at[order]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        out[at[first]] = np.add.reduceat(values[order], first, axis=0)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _index(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Index of each value in the sorted ``known``; len(known) where it isn't there."""
    n = len(known)
    if not n:
        return np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(known, values), n - 1)
    return np.where(known[at] == values, at, n)


class Network:
    """Parameters, scores and gradients."""

    def __init__(self, vocab: np.ndarray, odds: np.ndarray, begin: np.ndarray, begin_odds: np.ndarray, seed: int = 0):
        rng = np.random.default_rng(seed)
        dim = WORD_DIM + CHAR_DIM + 2

        def start(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(np.float32)
        # sorted hashes of words and of word beginnings; log odds, the last for unknown ones
        self.vocab, self.odds, self.begin, self.begin_odds = vocab, odds.astype(np.float32), begin, begin_odds.astype(np.float32)
        self.p = {"word": start(len(vocab) + 1, WORD_DIM, scale=0.1), "char": start(1 << CHAR_BITS, CHAR_DIM, scale=0.3),
                  "W": start(2, dim, 3 * HIDDEN, scale=dim ** -0.5), "U": start(2, HIDDEN, 3 * HIDDEN, scale=HIDDEN ** -0.5),
                  "b": np.zeros((2, 3 * HIDDEN), np.float32), "A": start(2 * HIDDEN, ATTENTION, scale=0.3), "a": np.zeros(ATTENTION, np.float32),
                  "v": start(ATTENTION, scale=0.3), "w": start(2 * HIDDEN, scale=0.3), "c": np.zeros(1, np.float32)}
        self.scale, self.shift = 1.0, 0.0

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary index of each word hash; unknown words have the last."""
        return _index(self.vocab, hashes)

    def word_odds(self, code: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Log odds of words and the largest of their beginnings (words x 2)."""
        known = self.begin_odds[_index(self.begin, begins.ravel())].reshape(begins.shape)
        return np.stack([self.odds[code], known.max(axis=1)], axis=1)

    def inputs(self, code: np.ndarray, grams: np.ndarray, first: np.ndarray, odds: np.ndarray) -> np.ndarray:
        """Input vectors of words."""
        size = np.diff(np.append(first, len(grams)))[:, None]
        chars = np.add.reduceat(self.p["char"][_bucket(grams)], first, axis=0) / size if len(first) else np.zeros((0, CHAR_DIM), np.float32)
        return np.concatenate([self.p["word"][code], chars, odds], axis=1).astype(np.float32)

    def forward(self, x: np.ndarray, words: np.ndarray, keep: bool = False):
        """Logits of windows; ``x`` are input vectors, ``words`` their rows
        (-1: none).  With ``keep`` also what the gradients need."""
        p, n, t = self.p, *words.shape
        mask = (words >= 0).astype(np.float32)
        gates = [np.concatenate([x @ p["W"][k] + p["b"][k], np.zeros((1, 3 * HIDDEN), np.float32)]) for k in (0, 1)]
        states = np.zeros((n, t, 2 * HIDDEN), np.float32)
        steps = ([], [])
        H = HIDDEN
        for k in (0, 1):
            h = np.zeros((n, H), np.float32)
            for i in range(t) if k == 0 else range(t - 1, -1, -1):
                g, u = gates[k][words[:, i]], h @ p["U"][k]
                zr = _sigmoid(g[:, :2 * H] + u[:, :2 * H])
                z, r = zr[:, :H], zr[:, H:]
                new = np.tanh(g[:, 2 * H:] + r * u[:, 2 * H:])
                m = mask[:, i:i + 1]
                if keep:
                    steps[k].append((i, h, z, r, new, u[:, 2 * H:]))
                h = ((1 - z) * new + z * h) * m
                states[:, i, k * H:(k + 1) * H] = h
        tanh = np.tanh(states @ p["A"] + p["a"])
        e = tanh @ p["v"]
        e = np.exp(e - e.max(axis=1, keepdims=True)) * mask
        alpha = e / np.maximum(e.sum(axis=1, keepdims=True), 1e-9)
        pooled = np.einsum("nt,nth->nh", alpha, states)
        logit = pooled @ p["w"] + p["c"][0]
        return (logit, (mask, states, steps, tanh, alpha, pooled)) if keep else logit

    def gradients(self, x, words, d_logit, kept) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the dense parameters, and of the input vectors."""
        p, H = self.p, HIDDEN
        mask, states, steps, tanh, alpha, pooled = kept
        g = {"w": pooled.T @ d_logit, "c": np.array([d_logit.sum()])}
        d_pool = d_logit[:, None] * p["w"]
        d_alpha = np.einsum("nh,nth->nt", d_pool, states)
        d_states = alpha[:, :, None] * d_pool[:, None, :]
        d_e = alpha * (d_alpha - (alpha * d_alpha).sum(axis=1, keepdims=True))
        g["v"] = np.einsum("nt,nta->a", d_e, tanh)
        d_pre = d_e[:, :, None] * p["v"] * (1 - tanh ** 2)
        g["A"], g["a"] = np.einsum("nth,nta->ha", states, d_pre), d_pre.sum(axis=(0, 1))
        d_states = d_states + d_pre @ p["A"].T
        g |= {"W": np.zeros_like(p["W"]), "U": np.zeros_like(p["U"]), "b": np.zeros_like(p["b"])}
        d_x = np.zeros_like(x)
        for k in (0, 1):
            d_h = np.zeros((len(words), H), np.float32)
            d_all = np.zeros((*words.shape, 3 * H), np.float32)
            for i, h, z, r, new, un in reversed(steps[k]):
                d_h = (d_h + d_states[:, i, k * H:(k + 1) * H]) * mask[:, i:i + 1]
                d_new = d_h * (1 - z) * (1 - new ** 2)
                d_z = d_h * (h - new) * z * (1 - z)
                d_r = d_new * un * r * (1 - r)
                d_g = np.concatenate([d_z, d_r, d_new], axis=1)
                d_u = np.concatenate([d_z, d_r, d_new * r], axis=1)
                d_all[:, i] = d_g
                g["U"][k] += h.T @ d_u
                d_h = d_h * z + d_u @ p["U"][k].T
            some = words.ravel() >= 0
            d_gate = _scatter(words.ravel()[some], d_all.reshape(-1, 3 * H)[some], len(x))
            g["W"][k], g["b"][k] = x.T @ d_gate, d_gate.sum(axis=0)
            d_x += d_gate @ p["W"][k].T
        return g, d_x

    def score(self, logit: np.ndarray) -> np.ndarray:
        return _sigmoid(self.scale * logit + self.shift)

    def documents(self, grid: Grid) -> np.ndarray:
        """The largest logit of each document of a block."""
        hashes = grid.hashes()
        uniq, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        code, (grams, cut) = self.codes(uniq), char_grams(grid, first)
        x = self.inputs(code, grams, cut, self.word_odds(code, prefixes(grid, first)))
        doc, words = window_words(grid)
        rows = np.where(words >= 0, inverse[np.maximum(words, 0)], -1) if len(inverse) else words
        logits = np.concatenate([self.forward(x, rows[i:i + 8192]) for i in range(0, len(rows), 8192)])
        out = np.full(grid.n_docs, -np.inf)
        np.maximum.at(out, doc, logits)
        return out


class _Sample:
    """Distinct words of a sample: vocabulary indices, 4-grams, odds."""

    def __init__(self, net: Network, code, grams, first, odds):
        self.net, self.code, self.grams, self.first, self.odds = net, code, grams, first, odds
        self.sizes = np.diff(np.append(first, len(grams)))

    def inputs(self, w: np.ndarray, c: np.ndarray, odds: np.ndarray):
        """Inputs of words ``w`` under vocabulary indices ``c``, their 4-grams and how many each has."""
        size = self.sizes[w]
        cut = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(w) else np.zeros(0, np.int64)
        mine = self.grams[np.repeat(self.first[w] - cut, size) + np.arange(int(size.sum()))]
        return self.net.inputs(c, mine, cut, odds), mine, size

    def logits(self, words: np.ndarray, n: int = 8192) -> np.ndarray:
        out = []
        for lo in range(0, len(words), n):
            ids, local = _local(words[lo:lo + n])
            out.append(self.net.forward(self.inputs(ids, self.code[ids], self.odds[ids])[0], local))
        return np.concatenate(out)


def _local(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words of windows, and the windows in terms of them (-1: none)."""
    ids, local = np.unique(words, return_inverse=True)
    local = local.reshape(words.shape)
    return (ids[1:], local - 1) if ids[0] < 0 else (ids, local)


def _texts_of(chunks, group: np.ndarray, n: int) -> np.ndarray:
    """How many texts of each of 4 groups hold each of n items, from chunks of distinct (text, item) pairs."""
    out = np.zeros((4, n), np.int32)
    for doc, item in chunks:
        g = group[doc]
        for k in range(4):
            out[k] += np.bincount(item[g == k], minlength=n).astype(np.int32)
    return out


def _odds(clean: np.ndarray, toxic: np.ndarray, n_clean: int, n_toxic: int) -> np.ndarray:
    """Log odds of standing in a toxic text, over their standard error; 0 for items of one text."""
    z = (np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))) / np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))
    return np.where(clean + toxic >= 2, z / 4, 0).astype(np.float32)


def distinct_texts(texts: list[str], labels: np.ndarray) -> np.ndarray:
    """Indices of the texts that are not for the most part copies: fewer than
    half of their 5-word runs stand in earlier texts of the same label.  Copies
    of one toxic text would make its harmless words look telling."""
    keep = []
    for side in (False, True):
        own = np.flatnonzero(labels == side)
        for _, _, grid in blocks(pa.array([texts[i] for i in own], pa.string()), ALNUM, True, 1 << 62):
            at, h = ngrams(grid.hashes(), grid.left(), 5)
            d = grid.doc[at]
            _, begin, inverse = np.unique(h, return_index=True, return_inverse=True)
            old = d[begin][inverse] < d
            n = np.bincount(d, minlength=grid.n_docs)
            keep.append(own[2 * np.bincount(d, weights=old, minlength=grid.n_docs) <= n])
    return np.sort(np.concatenate(keep)) if keep else np.zeros(0, np.int64)


def train(texts: list[str], labels: np.ndarray, toxic_share: float, seed: int = 0) -> Network:
    """A network fitted to labelled texts; ``toxic_share`` is the share of
    toxic rows among all labelled ones, for the calibration."""
    rng = np.random.default_rng(seed)
    fresh = distinct_texts(texts, labels.astype(bool))
    texts, labels = [texts[i] for i in fresh], labels[fresh]
    [(_, _, grid)] = blocks(pa.array(texts, pa.string()), ALNUM, True, 1 << 62)
    hashes, doc = grid.hashes(), grid.doc
    uniq, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    pairs = np.divmod(np.unique(doc * max(len(uniq), 1) + inverse), max(len(uniq), 1))
    toxic = labels.astype(bool)
    # a text's own label must not reach it through its words: each half learns with the odds of the other
    half = np.zeros(len(toxic), int)
    for side in (False, True):
        half[np.flatnonzero(toxic == side)] = rng.permutation(int((toxic == side).sum())) % 2
    group = 2 * half + toxic
    n = np.bincount(group, minlength=4)

    grams, cut = char_grams(grid, first)
    begins = prefixes(grid, first)
    begin, begin_code = np.unique(begins, return_inverse=True)
    begin_code = begin_code.reshape(begins.shape).astype(np.int32)

    def begin_pairs():
        for j in range(begins.shape[1]):
            has = begins[pairs[1], j] > 0
            yield np.divmod(np.unique(pairs[0][has] * len(begin) + begin_code[pairs[1][has], j]), len(begin))
    df, begin_df = _texts_of([pairs], group, len(uniq)), _texts_of(begin_pairs(), group, len(begin))

    def odds_of(df, *halves):
        c, t = (sum(df[2 * k + side] for k in halves) for side in (0, 1))
        return _odds(c, t, *(sum(int(n[2 * k + side]) for k in halves) for side in (0, 1)))
    odds, often = odds_of(df, 0, 1), begin_df.sum(axis=0) >= 2
    known = np.flatnonzero(df.sum(axis=0) >= 3)
    known = np.sort(known[np.lexsort((known, -np.abs(odds[known])))][:VOCABULARY])  # uniq is sorted, so is the vocabulary
    net = Network(uniq[known], np.append(odds[known], 0), begin[often], np.append(odds_of(begin_df, 0, 1)[often], 0), seed)
    code = net.codes(uniq)
    words_of = _Sample(net, code, grams, cut, net.word_odds(code, begins))
    other = []
    for k in (0, 1):
        o = np.where(code < len(net.vocab), odds_of(df, 1 - k), 0)
        other.append(np.stack([o, odds_of(begin_df, 1 - k)[begin_code].max(axis=1)], axis=1).astype(np.float32))
    del pairs, begins, begin_code, df, begin_df

    owner, words = window_words(grid)
    words = (np.where(words >= 0, inverse[np.maximum(words, 0)], -1) if len(inverse) else words).astype(np.int32)
    told = np.full(len(words), -9.0)
    for k in (0, 1):
        own = half[owner] == k
        told[own] = np.where(words[own] >= 0, other[k].max(axis=1)[words[own]], -9).max(axis=1)
    top = np.full(len(toxic), -9.0)
    np.maximum.at(top, owner, told)
    # a toxic text without a word more telling than those of clean texts teaches nothing
    bar = np.quantile(top[~toxic], 0.999)
    if not (top[toxic] > bar).any():
        bar = -9.5
    best = np.zeros(len(owner), bool)
    order = np.lexsort((rng.random(len(owner)), -told, owner))
    best[order[np.concatenate([[True], owner[order][1:] != owner[order][:-1]])]] = True
    use = np.flatnonzero(np.where(toxic[owner], told > bar, best | (rng.random(len(owner)) < 0.05)))

    moments, step = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}, 0
    for phase in (0, 1):
        if phase:  # add the windows of clean texts that still look toxic
            clean = np.flatnonzero(~toxic[owner])
            logit = words_of.logits(words[clean])
            use = np.union1d(use, clean[np.lexsort((clean, -logit))][:min(int((logit > -3).sum()), len(use))])
        y = toxic[owner[use]].astype(np.float32)
        weight = np.where(y > 0, 1.0, min(1.0, 4 * y.sum() / max((1 - y).sum(), 1))).astype(np.float32)
        batch = 256 if len(use) > 4000 else 64
        for _ in range(int(np.clip(VISITS // max(len(use), 1), 3, 30))):
            order = rng.permutation(len(use))
            for lo in range(0, len(order), batch):
                rows = order[lo:lo + batch]
                side = half[owner[use[rows]]]
                # a word is an input of its own in each half
                ids, local = _local(np.where(words[use[rows]] >= 0, words[use[rows]] * 2 + side[:, None], -1))
                w, k = ids // 2, ids % 2
                lost = rng.random(len(ids)) < WORD_DROPOUT
                c = np.where(lost, len(net.vocab), code[w])
                o = np.where(k[:, None] == 0, other[0][w], other[1][w])
                o[:, 0] = np.where(lost, 0, o[:, 0])
                x, mine, size = words_of.inputs(w, c, o)
                logit, kept = net.forward(x, local, keep=True)
                d = ((_sigmoid(logit) - y[rows]) * weight[rows] / len(rows)).astype(np.float32)
                g, d_x = net.gradients(x, local, d, kept)
                g["word"] = _scatter(c, d_x[:, :WORD_DIM], len(net.vocab) + 1)
                g["char"] = _scatter(_bucket(mine), np.repeat(d_x[:, WORD_DIM:-2] / size[:, None], size, axis=0), 1 << CHAR_BITS)
                step += 1
                for name, v in net.p.items():
                    m, s = moments[name]
                    m += 0.1 * (g[name] - m)
                    s += 0.001 * (g[name] ** 2 - s)
                    v -= 0.01 * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-7) + DECAY * v
    n = [int((~toxic).sum()), int(toxic.sum())]
    # calibration of the largest logit, each class weighted to its share; clean texts more, as longer
    # ones than the sample's have more windows and so more chances to look toxic
    top = net.documents(grid)
    share = min(max(toxic_share, 1e-3), 1 - 1e-3)
    weight = np.where(toxic, share / n[1], CLEAN_WEIGHT * (1 - share) / n[0])
    f = np.stack([top, np.ones_like(top)])

    def loss(ab):
        v = np.clip(ab @ f, -500, 500)
        return (weight * (np.logaddexp(0, v) - toxic * v)).sum() + 5e-6 * ((ab - [1, 0]) ** 2).sum()
    ab = np.array([1.0, 0.0])
    for _ in range(40):
        q = _sigmoid(ab @ f)
        step = np.linalg.solve((f * (weight * q * (1 - q))) @ f.T + 1e-5 * np.eye(2), f @ (weight * (q - toxic)) + 1e-5 * (ab - [1, 0]))
        while np.abs(step).max() > 1e-6 and loss(ab - step) > loss(ab):
            step = step / 2
        ab = ab - step
    net.scale, net.shift = (float(ab[0]), float(ab[1])) if ab[0] > 0 else (1.0, 0.0)
    return net


def sample(docs: DataFrame, labels: DataFrame, usable) -> tuple[list[str], np.ndarray, float]:
    """Texts and labels to train on, and the share of toxic rows among the
    labelled documents for which ``usable`` (a condition on doc_id) holds."""
    marked = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(usable)
              .groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic")))
    count = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64("doc_id")
    picked = [marked.where(F.col("toxic") == k).orderBy(order, "doc_id").limit(SAMPLE[k]) for k in (0, 1)]
    ids = F.broadcast(picked[0].unionByName(picked[1]))  # as many rows as SAMPLE says at most
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.length("text") <= SAMPLE_CHARS)
    rows = texts.join(ids, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).toArrow().sort_by("doc_id")
    total = sum(count.values())
    return rows["text"].to_pylist(), np.array(rows["toxic"].to_pylist(), int), count.get(1, 0) / total if total else 0.0


def learn(docs: DataFrame, labels: DataFrame, usable=None) -> Network | float:
    """A trained network, or the share of toxic rows if only one class is there."""
    texts, y, share = sample(docs, labels, F.lit(True) if usable is None else usable)
    if len(set(y.tolist())) < 2:
        return share
    net = train(texts, y, share)
    del texts
    give_back()  # the driver trains, and goes on
    return net


def _scored(net: Network | float):
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for b in batches:
            if isinstance(net, float):
                yield from batches_of({"doc_id": b.column("doc_id"), "score": np.full(b.num_rows, net)}, schema)
                continue
            for lo, hi, grid in blocks(b.column("text"), ALNUM, True):
                yield from batches_of({"doc_id": b.column("doc_id").slice(lo, hi - lo), "score": net.score(net.documents(grid)).astype(float)}, schema)
    return run


def toxicity(docs: DataFrame, net: Network | float) -> DataFrame:
    """doc_id, score, predicted per row of ``docs`` (doc_id, text)."""
    importable(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(lean(_scored(net)), "doc_id bigint, score double").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def clean(docs: DataFrame, net: Network | float) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, all columns as they are."""
    importable(docs.sparkSession)

    def run(batches):
        for b in batches:
            texts = b.column("text")
            if isinstance(net, float):
                if net < THRESHOLD:
                    yield b
                continue
            for lo, hi, grid in blocks(texts, ALNUM, True):
                yield b.slice(lo, hi - lo).filter(pa.array(net.score(net.documents(grid)) < THRESHOLD))
    return docs.mapInArrow(lean(run), docs.schema)
