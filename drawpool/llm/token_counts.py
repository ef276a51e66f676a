"""Token counts of texts under a unigram model, by one dynamic programme over
a trie of pre-tokens.

The distinct pre-tokens of a block of texts are sorted, so that their common
beginnings are the nodes of a trie; a node's forward score is the best sum of
piece scores over all segmentations of its prefix, computed once for all
pre-tokens that share it, level by level.  The token counts at the terminal
nodes are then summed for each document.

The pieces are those of a public vocabulary file, in order of rank; a piece
has the log-probability of Zipf's law at its rank, in whole units of 2**-20,
so that ties are exact: of equal scores the segmentation with fewer tokens
counts.  A character without a piece costs a token for each of its bytes.

Pre-tokens are runs of bytes other than white space, whatever their length,
and begin with the vocabulary's word mark.  The trie holds those of up to 64
bytes; longer ones, which hardly share a beginning, go through the same
recursion one after the other, over the whole run.

Defined cases: null, empty and blank texts have no token; a null or repeated
``doc_id`` is a row of its own; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, importable
from .textgrid import NONSPACE, Grid, _P, _spans, blocks, mix, powers

MARK = "▁".encode()
#: Bytes of the longest pre-token in the trie; longer ones are scored by ``long_counts``, with the same result.
LONGEST = 64
UNIT = 1 << 20
#: Rank at which a byte of a character without a piece is set.
FALLBACK_RANK = 1_000_000
_UNREACHED = -(1 << 60)
_LOADED: dict[str, "Vocabulary"] = {}


def zipf(rank: int) -> int:
    """Log-probability of the piece at ``rank``, in units of 1 / UNIT."""
    return -round(math.log(rank + 2.7) * UNIT) - 2 * UNIT


class Vocabulary:
    """Hashes and scores of the pieces, by their length in bytes."""

    def __init__(self, pieces: list[bytes]):
        by: dict[int, list[tuple[int, int]]] = {}
        for rank, piece in enumerate(pieces):
            data = np.frombuffer(piece, np.uint8).astype(np.uint64) + np.uint64(1)
            by.setdefault(len(piece), []).append((int(mix((data * powers(_P, len(piece))[0][:len(piece)]).sum(keepdims=True))[0]), zipf(rank)))
        self.by = {}
        for n, rows in sorted(by.items()):
            best: dict[int, int] = {}
            for h, s in rows:
                best[h] = max(s, best.get(h, s))
            keys = np.array(sorted(best), np.uint64)
            self.by[n] = keys, np.array([best[int(k)] for k in keys], np.int64)

    @classmethod
    def load(cls, path: str) -> "Vocabulary":
        """The ordinary pieces of a sentencepiece model file."""
        if path not in _LOADED:
            import sentencepiece
            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _LOADED[path] = cls([model.id_to_piece(i).encode() for i in range(model.get_piece_size())
                                 if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))])
        return _LOADED[path]

    def scores(self, n: int, hashes: np.ndarray) -> np.ndarray:
        """Score of each hash among the pieces of n bytes, or unreached."""
        keys, values = self.by[n]
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return np.where(keys[at] == hashes, values[at], _UNREACHED)


def forward_counts(words: np.ndarray, sizes: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """Token counts of distinct words: rows of a byte matrix, padded with 0."""
    n, width = words.shape
    if not n:
        return np.zeros(0, np.int64)
    order = np.argsort(np.ascontiguousarray(words).view(f"S{width}").ravel(), kind="stable")
    words, sizes = words[order], sizes[order]
    same = np.zeros((n, width), bool)
    same[1:] = words[1:] == words[:-1]
    shared = np.where(same.all(axis=1), width, (~same).argmax(axis=1))
    shared[1:] = np.minimum(shared[1:], np.minimum(sizes[1:], sizes[:-1]))
    shared[0] = 0
    up, down = powers(_P, width + 1)
    prefix = np.zeros((n, width + 1), np.uint64)
    np.cumsum((words.astype(np.uint64) + np.uint64(1)) * up[:width], axis=1, out=prefix[:, 1:])

    # the node of each word at each depth; scores and counts of nodes
    node = np.zeros((n, width + 1), np.int32)
    total = 1
    grown_s, grown_c = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
    fallback = zipf(FALLBACK_RANK)
    for d in range(1, width + 1):
        live = np.flatnonzero(sizes >= d)
        if not len(live):
            break
        fresh = shared[live] < d
        node[live, d] = total + np.cumsum(fresh) - 1
        at = live[fresh]
        best_s, best_c = np.full(len(at), _UNREACHED), np.zeros(len(at), np.int64)
        # only where a character ends
        ends = np.flatnonzero((sizes[at] == d) | ((words[at, min(d, width - 1)] & 0xC0) != 0x80))
        rows = at[ends]
        lead = np.zeros(len(rows), np.int64)  # bytes of the character that ends here
        for k in range(4, 0, -1):
            if k <= d:
                lead[(words[rows, d - k] & 0xC0) != 0x80] = k
        single = np.zeros(len(rows), bool)
        for k in sorted(vocab.by):
            if k > d:
                break
            piece = vocab.scores(k, mix((prefix[rows, d] - prefix[rows, d - k]) * down[d - k]))
            found = np.flatnonzero(piece > _UNREACHED)
            if not len(found):
                continue
            single[found] |= lead[found] == k
            before = node[rows[found], d - k]
            _better(best_s, best_c, ends[found], grown_s[before] + piece[found], grown_c[before] + 1)
        lone = np.flatnonzero(~single & (lead > 0))
        before = node[rows[lone], d - lead[lone]]
        _better(best_s, best_c, ends[lone], grown_s[before] + fallback * lead[lone], grown_c[before] + lead[lone])
        while total + len(at) > len(grown_s):
            grown_s, grown_c = np.concatenate([grown_s, np.zeros_like(grown_s)]), np.concatenate([grown_c, np.zeros_like(grown_c)])
        grown_s[total:total + len(at)], grown_c[total:total + len(at)] = best_s, best_c
        total += len(at)
    out = np.zeros(n, np.int64)
    out[order] = grown_c[node[np.arange(n), sizes]]
    return out


def _better(score: np.ndarray, count: np.ndarray, at: np.ndarray, s: np.ndarray, c: np.ndarray) -> None:
    """Take (s, c) at places ``at`` where it scores higher, or as high with fewer tokens."""
    take = (s > score[at]) | (s == score[at]) & (c < count[at])
    score[at[take]], count[at[take]] = s[take], c[take]


def long_counts(data: np.ndarray, bounds: np.ndarray, vocab: Vocabulary, chunk: int = 1 << 16) -> np.ndarray:
    """Token counts of the runs data[bounds[i]:bounds[i + 1]]: the same forward
    recursion over the whole run, which needs the states of as many bytes as
    the longest piece has.  ``chunk`` bytes are looked up at once."""
    out = np.zeros(len(bounds) - 1, np.int64)
    total, longest, fallback = len(data), max(vocab.by), zipf(FALLBACK_RANK)
    starts_here = np.zeros(total + 1, bool)
    starts_here[:-1] = (data & 0xC0) != 0x80
    starts_here[bounds] = True
    score, count, base = [0], [0], 0
    run, stop = 0, int(bounds[1])
    for lo in range(0, total, chunk):
        hi, a = min(lo + chunk, total), max(0, lo - longest)
        part = data[a:hi]
        up, down = powers(_P, len(part) + 1)
        prefix = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[:len(part)], out=prefix[1:])
        ends = lo + 1 + np.flatnonzero(starts_here[lo + 1:hi + 1])
        room = ends - bounds[np.searchsorted(bounds, ends) - 1]
        lead = np.zeros(len(ends), np.int64)  # bytes of the character that ends here
        for k in range(4, 0, -1):
            lead[(room >= k) & starts_here[np.maximum(ends - k, 0)]] = k
        single = np.zeros(len(ends), bool)
        steps = []
        for k in sorted(vocab.by):
            at = np.flatnonzero(room >= k)
            r = ends[at] - a
            value = vocab.scores(k, mix((prefix[r] - prefix[r - k]) * down[r - k]))
            found = value > _UNREACHED
            single[at[found]] |= lead[at[found]] == k
            steps.append((ends[at[found]], np.full(found.sum(), k), value[found], np.ones(found.sum(), np.int64)))
        lone = np.flatnonzero(~single & (lead > 0))
        steps.append((ends[lone], lead[lone], fallback * lead[lone], lead[lone]))
        end, size, value, tokens = (np.concatenate(x) for x in zip(*steps))
        order = np.argsort(end, kind="stable")
        score += [_UNREACHED] * (hi - lo)
        count += [0] * (hi - lo)
        for e, k, v, n in zip(*(x[order].tolist() for x in (end, size, value, tokens))):
            if e > stop:  # the next run begins with nothing
                out[run] = count[stop - base]
                score[stop - base] = count[stop - base] = 0
                run, stop = run + 1, int(bounds[run + 2])
            s, c, i = score[e - k - base] + v, count[e - k - base] + n, e - base
            if s > score[i] or s == score[i] and c < count[i]:
                score[i], count[i] = s, c
        base = max(0, hi - longest)
        score, count = score[-longest - 1:], count[-longest - 1:]
    out[run] = count[-1]
    return out


def count_tokens(grid: Grid, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Pre-tokens and tokens of each document of a block."""
    doc, starts, ends = grid.doc, grid.starts, grid.ends
    _, pick, inverse = np.unique(_spans(grid.data, starts, ends, _P), return_index=True, return_inverse=True)
    sizes, lead = ends[pick] - starts[pick], len(MARK)
    counts = np.zeros(len(pick), np.int64)
    # short and long pre-tokens apart, as each trie is as wide as its longest
    for low, high in ((0, 24), (24, LONGEST)):
        group = np.flatnonzero((sizes > low) & (sizes <= high))
        if len(group):
            total = sizes[group] + lead
            words = np.zeros((len(group), int(total.max())), np.uint8)
            col = np.arange(words.shape[1])[None, :] - lead
            inside = (col >= 0) & (col < sizes[group][:, None])
            words[inside] = grid.data[(starts[pick[group]][:, None] + col)[inside]]
            words[:, :lead] = np.frombuffer(MARK, np.uint8)
            counts[group] = forward_counts(words, total, vocab)
    runs = np.flatnonzero(sizes > LONGEST)
    if len(runs):
        mark = np.frombuffer(MARK, np.uint8)
        data = np.concatenate([x for i in pick[runs] for x in (mark, grid.data[starts[i]:ends[i]])])
        counts[runs] = long_counts(data, np.concatenate([[0], np.cumsum(sizes[runs] + lead)]), vocab)
    return np.bincount(doc, minlength=grid.n_docs), np.bincount(doc, weights=counts[inverse], minlength=grid.n_docs).astype(np.int64)


def _counted(path: str):
    schema = pa.schema([("doc_id", pa.int64()), ("n_pretokens", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches):
        vocab = Vocabulary.load(path)
        for b in batches:
            for lo, hi, grid in blocks(b.column("text"), NONSPACE, False, 1 << 21):
                words, tokens = count_tokens(grid, vocab)
                yield from batches_of({"doc_id": b.column("doc_id").slice(lo, hi - lo), "n_pretokens": words, "n_tokens": tokens}, schema)
    return run


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_pretokens, n_tokens per row of ``docs`` (doc_id, text);
    ``vocabulary`` is a file's path."""
    importable(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_counted(vocabulary), "doc_id bigint, n_pretokens bigint, n_tokens bigint")
