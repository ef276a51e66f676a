"""Fuzzy line deduplication: SimHash, pigeonhole blocks, edit similarity.

A line's normal form is its sequence of lower-cased words (ASCII letters and
digits, and all beyond ASCII); in scripts that put no spaces between words
(Chinese, Japanese, Thai, Lao, Burmese, Khmer) each character is a word.
Lines with one normal form of a word or more are one class.  Classes are
linked when the edit similarity of their words, 1 - distance / words of the
longer, is PERCENT or more and a SimHash finds them; that takes LEAST words.
Of each connected group the occurrence with the smallest (doc_id, line number)
stays; lines without any word always stay.

A class has TABLES independent SimHashes of 64 bits over its distinct words
(counted as often as they occur, a few frequent words would decide most bits,
and unlike lines would meet).  Each is
cut into blocks of BLOCK bits, and two classes meet where they have one block
of one table in common and differ in at most DISTANCE bits of that table; by
the pigeonhole principle any two classes that differ in fewer bits of a table
than it has blocks do.  The edit similarity then decides on whole lines.  At
the limit of 0.95 one bit in ten differs, more than a single table's blocks
guarantee, so there are several: README and tests give the recall against all
pairs by edit similarity.  Most classes that meet like this are still too far
apart, so what meets must pass a bound as well that no link fails: an edit
flips at most two of a line's PARITIES (of the number of its words in each of
64 cells) and changes its length by one word at most.

Block values are dealt in ranges of (value, class), so that a value that many
classes have is spread over tasks.  A task compares the members of a value
that lies in it alone, up to PART of them, and passes on those with a partner,
each with its first one; larger values, and those at a border of a task, go on
whole.  Each member is verified once with the smallest of its first partners,
and ``linking`` takes what that leaves: about one pair for each member of a
family.

Defined cases: null and empty texts have no lines; a null ``doc_id`` counts as
larger than any other; rows of a repeated ``doc_id`` are judged each by its
own text, equal rows alike; other columns are not read; an empty table gives
an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, bitmap, in_bitmap, lean, written
from .linking import link
from .textgrid import _Q, _R, _spans, ALNUM, Grid, blocks, mix

#: Least edit similarity, in per cent, and the words that a line needs for one edit.
PERCENT = 95
LEAST = -(-100 // (100 - PERCENT))
#: SimHashes of a class, bits of a block, bits of a table in which candidates may differ.
TABLES, BLOCK, DISTANCE = 6, 21, 10
BLOCKS = 64 // BLOCK
#: Parities of a class: cells of its words by so many hashes.
PARITIES = 3
LAST = (1 << 63) - 1
#: Members of one block value that a task compares pair by pair; more go on whole.
PART = 4096
#: Words that counters of 8 bits hold, in fours.
_RUN = 252


def characters(grid: Grid) -> Grid:
    """``grid`` with each character of a script without spaces as a word."""
    d = grid.data
    if not len(d) or d.max() < 0xE0:
        return grid
    then = np.append(d[1:], 0)
    three = (d >= 0xE3) & (d <= 0xE9)  # kana, Chinese characters
    three |= (d == 0xE0) & (then >= 0xB8) & (then <= 0xBB)  # Thai, Lao
    three |= (d == 0xE1) & ((then >= 0x80) & (then <= 0x82) | (then == 0x9E) | (then == 0x9F))  # Burmese, Khmer
    three |= (d == 0xEF) & (then >= 0xA4) & (then <= 0xAB)  # compatibility characters
    at3, at4 = np.flatnonzero(three), np.flatnonzero((d == 0xF0) & (then >= 0xA0) & (then <= 0xB3))
    if not len(at3) + len(at4):
        return grid
    starts = np.unique(np.concatenate([grid.starts, at3, at3 + 3, at4, at4 + 4]))
    run = np.searchsorted(grid.starts, starts, "right") - 1
    inside = (run >= 0) & (starts < grid.ends[run])
    starts, stop = starts[inside], grid.ends[run[inside]]
    grid.starts, grid.ends = starts, np.minimum(np.append(starts[1:], len(d)), stop)
    grid.bounds = np.searchsorted(starts, grid.offsets)
    return grid


class Lines:
    """The lines of a block of texts that have a word."""

    def __init__(self, grid: Grid):
        self.words = grid.hashes()
        newlines = np.flatnonzero(grid.data == 10)
        newline = np.cumsum(np.bincount(np.searchsorted(grid.starts, newlines), minlength=len(grid.starts) + 1))[:len(grid.starts)]  # before each word
        at = newline + grid.doc  # a text ends a line as well
        self.first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
        self.end = np.append(self.first[1:], len(at)) if len(at) else self.first
        self.doc = grid.doc[self.first]
        self.number = newline[self.first] - np.searchsorted(newlines, grid.offsets[:-1])[self.doc]
        self.node = np.stack([_spans(self.words, self.first, self.end, _Q), _spans(mix(self.words + _R), self.first, self.end, _R)], axis=1)


def simhash(words: np.ndarray, first: np.ndarray, end: np.ndarray, table: int) -> np.ndarray:
    """64 bits of each line words[first:end] (one word or more, in order): in
    which of them most of its words' hashes have a 1."""
    return simhashes(words, first, end, [table])[0]


def simhashes(words: np.ndarray, first: np.ndarray, end: np.ndarray, tables: Sequence[int]) -> np.ndarray:
    """The ``simhash`` of each line in each table."""
    out = np.zeros((len(tables), len(first)), np.uint64)
    seeds = mix(np.array(tables, np.uint64) + np.uint64(1))
    lo = 0
    while lo < len(first):  # the lines that begin in about 131,072 words
        hi = int(np.searchsorted(first, first[lo] + (1 << 17)))
        base, top, size = int(first[lo]), int(end[hi - 1]), end[lo:hi] - first[lo:hi]
        runs = -(-size // _RUN)
        line = np.cumsum(runs) - runs
        start = np.repeat(first[lo:hi] - base, runs) + (np.arange(int(runs.sum())) - np.repeat(line, runs)) * _RUN
        hashes = np.zeros((len(tables), top - base + 1), np.uint64)
        for row, seed in zip(hashes, seeds):
            row[:-1] = mix(words[base:top] ^ seed)
        counts = _counts(hashes, start, np.minimum(start + _RUN, np.repeat(end[lo:hi] - base, runs)))
        if len(line) < len(start):
            counts = _sums(counts, line, runs, int(size.max()).bit_length())
        more, same = out[:, lo:hi], ~np.uint64(0)
        for i in reversed(range(len(counts))):  # counts against half of the line, digit by digit
            half = -(size // 2 >> i & 1).astype(np.uint64)
            more |= same & counts[i] & ~half
            same = same & ~(counts[i] ^ half)
        lo = hi
    return out.view(np.int64)


def _counts(hashes: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """How many of hashes[table, start:stop], _RUN words at most, have each of the 64
    bits, as binary digits: the i-th digits of a run's 64 counts are the number [i, table,
    run].  Four words at a time are added to all runs; a table's last hash is 0 and fills them."""
    order = np.argsort(start - stop, kind="stable")  # long runs first: those with another four are the first few
    begin, stop = start[order], stop[order]
    fours = (stop - begin + 3) // 4
    digits = np.zeros((8, len(hashes), len(order)), np.uint64)
    for i in range(int(fours[0])):
        k = int(np.searchsorted(-fours, -i))
        at = begin[:k] + np.arange(4 * i, 4 * i + 4)[:, None]
        a, b, c, d = np.moveaxis(hashes.take(np.where(at < stop[:k], at, hashes.shape[1] - 1), axis=1), 1, 0)
        now = digits[:, :, :k]
        carry = _added(now[1], _added(now[0], a, b), _added(now[0], c, d))
        for digit in now[2:(4 * i + 4).bit_length()]:
            both = digit & carry
            digit ^= carry
            carry = both
    out = np.empty_like(digits)
    out[:, :, order] = digits
    return out


def _added(digit: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Adds two binary digits to ``digit``; what is to carry."""
    either = a ^ b
    carry = a & b | either & digit
    digit ^= either
    return carry


def _sums(counts: np.ndarray, line: np.ndarray, runs: np.ndarray, digits: int) -> np.ndarray:
    """The counts of lines of several runs, the first of which is ``line``."""
    out = np.zeros((max(digits, len(counts)), counts.shape[1], len(line)), np.uint64)
    for j in range(int(runs.max())):
        which = np.flatnonzero(runs > j)
        carry = np.zeros((counts.shape[1], len(which)), np.uint64)
        for i in range(len(out)):
            digit = out[i][:, which]
            carry = _added(digit, counts[i][:, line[which] + j] if i < len(counts) else np.uint64(0), carry)
            out[i][:, which] = digit
    return out


def distinct(words: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words (44 bits of their hashes) of each line, and where they begin and end."""
    values, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for lo in range(0, len(first), 1 << 20):  # 20 bits for the line
        f, n = first[lo:lo + (1 << 20)], (end - first)[lo:lo + (1 << 20)]
        owner = np.repeat(np.arange(len(f), dtype=np.uint64), n)
        key = np.sort((owner << np.uint64(44)) | (words[np.repeat(f - (np.cumsum(n) - n), n) + np.arange(len(owner))] >> np.uint64(20)))
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
        values.append(key & np.uint64((1 << 44) - 1))
        sizes.append(np.bincount((key >> np.uint64(44)).astype(np.int64), minlength=len(f)))
    cut = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)
    return np.concatenate(values), cut[:-1], cut[1:]


def parities(words: np.ndarray, first: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """For each line words[first:end], bits that tell which of 64 cells hold an
    odd number of its words; cells by PARITIES hashes."""
    cut = np.stack([first, end], axis=1).ravel()
    cell = np.append(mix(words + _Q), np.uint64(0))
    return [np.bitwise_xor.reduceat(np.uint64(1) << ((cell >> np.uint64(6 * k)) & np.uint64(63)), cut)[::2].view(np.int64) if len(first) else np.zeros(0, np.int64)
            for k in range(PARITIES)]


def _line_blocks(texts: pa.Array):
    """(first, end, lines) for runs of whole texts."""
    for lo, hi, grid in blocks(texts, ALNUM, True):
        yield lo, hi, Lines(characters(grid))


def _hashes(node: np.ndarray) -> dict[str, np.ndarray]:
    return {c: np.ascontiguousarray(node[:, i]).view(np.int64) for i, c in enumerate(_CLASS)}


#: The hash of a class.
_CLASS = ["h", "g"]
_SIMS = [f"s{t}" for t in range(TABLES)]
_CELLS = [f"c{k}" for k in range(PARITIES)]
#: What a class has besides its hash: SimHashes, parities, the number of its words.
_SKETCH = [*_SIMS, *_CELLS, "n"]


def _lines(batches):
    """All lines; with SimHashes, parities and length, where the line has LEAST words or more and is its block's first of them."""
    schema = pa.schema([("rk", pa.int64()), ("doc_id", pa.int64()), ("line", pa.int32()), ("h", pa.int64()), ("g", pa.int64()), *((s, pa.int64()) for s in _SKETCH)])
    for b in batches:
        ids, keys = b.column("doc_id").to_numpy(), b.column("rk").to_numpy()
        for lo, hi, x in _line_blocks(b.column("text")):
            at = np.flatnonzero(x.end - x.first >= LEAST)
            if len(at):
                at = at[np.sort(np.unique(x.node[at], axis=0, return_index=True)[1])]
            none = np.ones(len(x.first), bool)
            none[at] = False
            sketch, bag = {}, distinct(x.words, x.first[at], x.end[at])
            of_lines = [*simhashes(*bag, range(TABLES)), *parities(x.words, x.first[at], x.end[at]), x.end[at] - x.first[at]]
            for s, of_line in zip(_SKETCH, of_lines):
                value = np.zeros(len(x.first), np.int64)
                value[at] = of_line
                sketch[s] = pa.array(value, mask=none)
            yield from batches_of({"rk": keys[lo + x.doc], "doc_id": ids[lo + x.doc], "line": x.number.astype(np.int32), **_hashes(x.node), **sketch}, schema)


def _held(marks: np.ndarray):
    """Rows whose key the bitmap lets pass with their text, the others with its digest."""
    def run(batches):
        for b in batches:
            may = in_bitmap(marks, b.column("rk").to_numpy())
            n, sha = [], []
            for t, m in zip(b.column("text"), may.tolist()):
                raw = t.as_buffer()
                raw = b"" if raw is None else bytes(raw)
                n.append(raw.count(b"\n") + 1 if raw else 0)
                sha.append(None if m else hashlib.sha256(raw).hexdigest())
            text = pc.if_else(pa.array(may), b.column("text"), pa.scalar(None, b.column("text").type))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "rk": b.column("rk"), "n_lines": pa.array(n, pa.int64()), "sha": pa.array(sha, pa.string()), "text": text})
    return run


def partners(bucket: np.ndarray, sim: np.ndarray, cells: np.ndarray | None = None, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which members of sorted buckets go on (those with a partner in their
    bucket, and all of a bucket of more than PART), and the place of the first
    partner, where that comes before the member.  ``cells`` is a parity of
    each member and ``n`` its words."""
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    run = np.diff(np.append(first, len(bucket)))
    left = np.repeat(first + run, run) - np.arange(len(bucket)) - 1  # members after this one
    go, to = np.repeat(run > PART, run), np.arange(len(bucket))
    a, gap = np.flatnonzero(~go & (left > 0)), 1
    while len(a):
        near = a[np.bitwise_count(sim[a] ^ sim[a + gap]) <= DISTANCE]
        if cells is not None:
            x, y = n[near], n[near + gap]
            most = np.maximum(x, y) * (100 - PERCENT) // 100
            near = near[(np.abs(x - y) <= most) & (np.bitwise_count((cells[near] ^ cells[near + gap]).view(np.uint64)) <= 2 * most)]
        go[near] = True
        go[near + gap] = True
        to[near + gap] = near  # a larger gap, an earlier partner
        gap += 1
        a = a[left[a] >= gap]
    return go, to


def _partners(batches):
    """Rows of a partition sorted by bucket, less those of buckets that lie in it
    alone and have no partner there.  At most PART rows are kept back."""
    kept, border = None, None  # rows of the last bucket so far; a bucket that goes on whole
    for b in batches:
        if not b.num_rows:
            continue
        border = b.column("bucket")[0].as_py() if border is None else border
        part = pa.Table.from_batches([b] if kept is None else [kept, b]).combine_chunks().to_batches()[0]
        bucket, ids = part.column("bucket").to_numpy(), part.column("id").to_numpy()
        done = int(np.searchsorted(bucket, bucket[-1]))
        if len(bucket) - done > PART:
            border = int(bucket[-1])
        if bucket[-1] == border:
            done = len(bucket)
        kept = part.slice(done) if done < len(bucket) else None
        if done:
            order = np.lexsort((ids[:done], bucket[:done]))
            go, to = partners(bucket[:done], *(part.column(c).to_numpy()[order] for c in ("sim", "c0", "n") if c in part.schema.names))
            go |= bucket[:done] == border
            yield part.take(pa.array(order[go])).append_column("to", pa.array(ids[order[to[go]]]))
    if kept is not None:
        yield kept.append_column("to", kept.column("id"))


def _line_texts(rows: np.ndarray, marks: np.ndarray):
    """The lines whose class the bitmap ``marks`` lets pass, from the first word to the
    last, of the rows whose key the bitmap ``rows`` lets pass."""
    def run(batches):
        for b in batches:
            texts = b.column("text").filter(pa.array(in_bitmap(rows, b.column("rk").to_numpy())))
            for _, _, grid in blocks(texts, ALNUM, True):
                x = Lines(characters(grid))
                at = np.flatnonzero(in_bitmap(marks, _hashes(x.node)["h"]))
                if len(at):
                    at = at[np.unique(x.node[at], axis=0, return_index=True)[1]]
                    data = grid.data.tobytes()
                    texts = [data[a:e] for a, e in zip(grid.starts[x.first[at]].tolist(), grid.ends[x.end[at] - 1].tolist())]
                    yield pa.RecordBatch.from_pydict({**_hashes(x.node[at]), "words": pa.array(texts, pa.binary()).cast(pa.string())})
    return run


def _row_words(texts: pa.Array) -> list[np.ndarray]:
    """The words (as hashes) of each text."""
    out = []
    for _, _, grid in blocks(texts, ALNUM, True):
        grid = characters(grid)
        out += np.split(grid.hashes(), grid.bounds[1:-1])
    return out


def _rest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sequences without what they begin and end with alike."""
    n = min(len(a), len(b))
    diff = np.flatnonzero(a[:n] != b[:n])
    head = int(diff[0]) if len(diff) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    diff = np.flatnonzero(a[::-1][:n] != b[::-1][:n])
    tail = int(diff[0]) if len(diff) else n
    return a[:len(a) - tail], b[:len(b) - tail]


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance of two sequences, or ``most`` + 1 if it is larger:
    furthest-reaching ends of each diagonal, one more edit at a time."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    a, b = (x.tolist() for x in _rest(a, b))
    if not a or not b:
        return len(a) + len(b)
    goal, reach = len(b) - len(a), {}  # diagonal (place in b less place in a) -> furthest place in a
    for d in range(most + 1):
        now = {}
        for k in range(-d, d + 1):
            i = 0 if d == 0 else max(reach.get(k, -2) + 1, reach.get(k - 1, -2), reach.get(k + 1, -2) + 1)
            i = min(i, len(a), len(b) - k)
            if i < 0 or i + k < 0:
                continue
            while i < len(a) and i + k < len(b) and a[i] == b[i + k]:
                i += 1
            now[k] = i
        if now.get(goal, -1) >= len(a):
            return d
        reach = now
    return most + 1


def bag_distance(a: np.ndarray, b: np.ndarray) -> int:
    """A lower bound of the edit distance: words of the longer without one to meet."""
    _, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    n = int(at.max(initial=-1)) + 1
    return max(len(a), len(b)) - int(np.minimum(np.bincount(at[:len(a)], minlength=n), np.bincount(at[len(a):], minlength=n)).sum())


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the edit similarity is PERCENT or more."""
    most = max(len(a), len(b)) * (100 - PERCENT) // 100
    if abs(len(a) - len(b)) > most:
        return False
    a, b = _rest(a, b)
    return max(len(a), len(b)) <= most or bag_distance(a, b) <= most and edit_distance(a, b, most) <= most


def _verified(batches):
    for b in batches:
        mask = pa.array(list(map(alike, _row_words(b.column("x_words")), _row_words(b.column("y_words")))), pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column("x").filter(mask), b.column("y").filter(mask)], names=["x", "y"])


def _cut(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])
    for b in batches:
        removed, shas, texts = [], [], []
        for sha, text, gone in zip(b.column("sha").to_pylist(), b.column("text").to_pylist(), b.column("gone").to_pylist()):
            gone, kept = set(gone or ()), None
            if gone:
                kept = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
            removed.append(len(gone))
            shas.append(sha or hashlib.sha256(((text or "") if kept is None else kept).encode()).hexdigest())
            texts.append(kept)
        yield from batches_of({"doc_id": b.column("doc_id"), "n_lines": b.column("n_lines"), "n_removed": pa.array(removed, pa.int64()),
                               "kept_sha256": pa.array(shas, pa.string()), "kept_text": pa.array(texts, pa.string())}, schema)


def _verify(docs: DataFrame, members: DataFrame):
    wanted = written(members.select("id", *_CLASS, "rk").distinct(), "wanted")
    held = written(docs.mapInArrow(lean(_line_texts(bitmap(wanted, "rk"), bitmap(wanted, "h"))), "h bigint, g bigint, words string")
                   .join(wanted.select("id", *_CLASS), _CLASS).groupBy("id").agg(F.first("words").alias("words")), "words")

    def verify(pairs: DataFrame) -> DataFrame:
        x, y = (held.select(F.col("id").alias(c), F.col("words").alias(f"{c}_words")) for c in "xy")
        return pairs.join(y, "y").join(x, "x").select("x", "y", "x_words", "y_words").mapInArrow(lean(_verified), "x bigint, y bigint")
    return verify


def _near(a, b):
    """Whether two members meet in their table, and can be similar enough."""
    most = F.floor(F.greatest(a["n"], b["n"]) * (100 - PERCENT) / 100)
    met = (F.bit_count(a["sim"].bitwiseXOR(b["sim"])) <= DISTANCE) & (F.abs(a["n"] - b["n"]) <= most)
    for c in _CELLS:
        met &= F.bit_count(a[c].bitwiseXOR(b[c])) <= 2 * most
    return met


def _groups(docs: DataFrame, hashes: DataFrame) -> DataFrame:
    """(id, component) of the classes that links join."""
    at, sim = F.col("at"), F.when(F.col("at") < BLOCKS, F.col(_SIMS[0]))
    for t in range(1, TABLES):
        sim = sim.when(at < (t + 1) * BLOCKS, F.col(_SIMS[t]))
    block = F.call_function("shiftrightunsigned", sim, at % BLOCKS * BLOCK).bitwiseAND(F.lit((1 << BLOCK) - 1))
    dealt = (hashes.select("id", "c0", "n", *_SIMS, F.explode(F.array(*map(F.lit, range(TABLES * BLOCKS)))).alias("at"))
             .select((F.call_function("shiftleft", at.cast("bigint"), F.lit(BLOCK)) + block).alias("bucket"), "id", sim.alias("sim"), "c0", "n"))
    # tasks sort by one number, which is much cheaper than by two; the few members of a bucket are put in order in Python
    met = written(dealt.repartitionByRange("bucket", "id").sortWithinPartitions("bucket")
                  .mapInArrow(lean(_partners), "bucket bigint, id bigint, sim bigint, c0 bigint, n bigint, to bigint"), "met")
    members = written(met.join(hashes.select("id", *_CLASS, "rk", *_CELLS[1:]), "id"), "members")
    # one pair a member: of its first partners the smallest, else a family of n copies costs a pair for each block of each
    pairs = written(members.where("to < id").groupBy(F.col("id").alias("y")).agg(F.min("to").alias("x")).select("x", "y"), "pairs")
    return link(members.select("bucket", F.col("id").alias("node"), "sim", "n", *_CELLS), _verify(docs, members), _near, pairs=pairs).withColumnRenamed("node", "id")


def fuzzy_lines(docs: DataFrame, texts: bool = False) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 per row of ``docs`` (doc_id,
    text); with ``texts`` also kept_text, null where nothing was removed."""
    docs = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("rk", F.xxhash64("doc_id", "text"))  # a key of each row by its id and text
    lines = written(docs.mapInArrow(lean(_lines), "rk bigint, doc_id bigint, line int, h bigint, g bigint, " + ", ".join(f"{s} bigint" for s in _SKETCH)), "lines")
    place = F.col("doc_id").cast("decimal(20)") * F.lit(1 << 31).cast("decimal(10)") + F.col("line")  # first by doc_id, then by line
    classes = written(lines.groupBy(*_CLASS).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times"), *(F.min(c).alias(c) for c in ("rk", *_SKETCH)))
                      .withColumn("id", F.monotonically_increasing_id()), "classes")
    named = written(classes.select("id", *_CLASS, "first", "times").join(_groups(docs, classes.where("n IS NOT NULL")), "id", "left").where("times > 1 OR component IS NOT NULL")
                    .select(*_CLASS, "first", "times", F.coalesce("component", "id").alias("component")), "named")
    several = named.groupBy("component").agg(F.min("first").alias("stays"), F.sum("times").alias("times")).where("times > 1").drop("times")
    dup = written(named.join(several, "component").select(*_CLASS, "stays"), "repeated")
    gone = written(lines.join(dup, _CLASS).where(place != F.col("stays")).groupBy("rk", "doc_id").agg(F.collect_list("line").alias("gone")), "gone")

    held = docs.mapInArrow(_held(bitmap(gone, "rk")), "doc_id bigint, rk bigint, n_lines bigint, sha string, text string")
    out = held.join(gone, ["rk", "doc_id"], "left").select("doc_id", "n_lines", "sha", "text", "gone").mapInArrow(
        _cut, "doc_id bigint, n_lines bigint, n_removed bigint, kept_sha256 string, kept_text string")
    return out.select(F.when(F.col("doc_id") < LAST, F.col("doc_id")).alias("doc_id"), "n_lines", "n_removed", "kept_sha256", *(["kept_text"] if texts else []))
