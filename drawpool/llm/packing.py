"""Best-fit packing of token sequences, hierarchically over residuals.

Texts are tokenised whole (ids, then one end id) and cut into pieces of the
sequence length.  Tasks pack their pieces by best fit, longest first, and
emit nearly full bins; underfull bins go on as items: a tree of rounds deals
them into fewer groups and packs them again, until a round of one group is
done or a round has merged no two bins.  Groups have a bounded number of items, so
no task gathers what grows with the input.

Defined cases: a null or empty text is the end id alone; a null or repeated
``doc_id`` is a row of its own; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import os
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, lean, lists, written
from .textgrid import buffers

LENGTH = 2048
END_ID = 0
#: Bins with at most so many free places are emitted at once.
SLACK = 16
#: Items that are packed together in memory.
GROUP = 1 << 15
#: Units of text whose ids a worker keeps, and the longest of them.
CACHE, CACHED_BYTES = 250_000, 64
#: Bytes of text that are encoded together.
BLOCK = 2 << 20
_LOADED: dict[str, tuple] = {}
#: Kinds of bytes: letters, digits, other visible ASCII, white space, all else.
_L, _D, _P, _W, _O = range(5)
_KIND = np.array([_L if chr(c).isalpha() else _D if chr(c).isdigit() else _P if 0x20 < c < 0x7F else _W if c in b" \n\t\r" else _O for c in range(128)] + [_O] * 128, np.int8)
#: Units that are one word for the tokenizer.
_WORD = "^[a-zß-öø-ÿ]+$"


def _units(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``data`` in small letters without white space, where its units begin and
    end, and the ``ends`` of the texts in it.  The tokenizer folds case, drops
    white space, takes each digit by itself and never joins letters, digits and
    other visible ASCII characters, but for an apostrophe and the letters after
    it.  Next to any other character than the letters of Latin-1, which may
    change what stands before it, nothing is cut or folded."""
    kind = _KIND[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] & 0xDF) != 0x97]  # not the signs of multiplication and division
    kind[lead] = kind[lead + 1] = _L
    then = np.append(kind[1:], np.int8(_W))
    then[ends[(ends > 0) & (ends < len(data))] - 1] = _W
    fold = (kind == _L) & (then != _O)
    data = data + ((data - np.uint8(65) < 26) & fold).astype(np.uint8) * np.uint8(32)
    second = lead[fold[lead + 1] & (data[lead + 1] < 0x9F)] + 1
    data[second] += np.uint8(32)
    cut = np.zeros(len(data) + 1, bool)  # before which byte
    cut[1:] = (kind != then) & (kind != _O) & (then != _O) | (kind == _D) & (then == _D) | (kind == _W) | (then == _W)
    cut[1:][(data == 0x27) & (then == _L)] = False
    cut[ends] = True
    text = kind != _W
    gone = np.flatnonzero(~text)
    data = data[text]
    return data, np.append(np.flatnonzero(cut[:-1][text]), len(data)), ends - np.searchsorted(gone, ends)


class Units:
    """The ids of units, each encoded once and looked up afterwards."""

    def __init__(self, tok):
        self.tok = tok
        vocab = tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for v, i in vocab.items() if v.endswith("</w>")]] = True
        self.special = [t.content for t in tok.get_added_tokens_decoder().values()]
        self.clear()

    def __len__(self) -> int:
        return len(self.known)

    def clear(self) -> None:
        self.known, self.size, self.pool = pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def direct(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of ``texts``, and how many each has."""
        ids = [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *ids]), np.array([len(i) for i in ids], np.int64)

    def learn(self, new: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """``new`` in another order, its flat ids, and how many each has.
        Words are encoded as one text: each ends in a piece that ends a word."""
        plain = pc.match_substring_regex(new, _WORD)
        words, rest, ids, size = new.filter(plain), new.filter(pc.invert(plain)), [], []
        for lo in range(0, len(words), 4096):
            part = words.slice(lo, 4096)
            got, _ = self.direct([" ".join(part.to_pylist())])
            stop = np.flatnonzero(self.ends[got]) + 1
            n = np.diff(stop, prepend=0)
            if len(stop) != len(part):
                got, n = self.direct(part.to_pylist())
            ids.append(got)
            size.append(n)
        got, n = self.direct(rest.to_pylist())
        return pa.concat_arrays([words, rest]), np.concatenate([*ids, got]), np.concatenate([*size, n])

    def look_up(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids, and where in it each of the distinct ``units`` begins
        and how many it has."""
        if len(self) > CACHE:
            self.clear()
        at = pc.index_in(units, value_set=self.known)
        new, ids, size = self.learn(units.filter(at.is_null()))
        known, pool, sizes = pa.concat_arrays([self.known, new]), np.concatenate([self.pool, ids]), np.concatenate([self.size, size])
        place = at.fill_null(0).to_numpy().copy()
        if len(new):
            miss = np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False))
            place[miss] = len(self) + pc.index_in(units.take(pa.array(miss)), value_set=new).to_numpy()
        short = pc.binary_length(new).to_numpy() <= CACHED_BYTES  # the others hardly come again
        self.pool = np.concatenate([self.pool, ids[np.repeat(short, size)]])
        self.known, self.size = pa.concat_arrays([self.known, new.filter(pa.array(short))]), np.concatenate([self.size, size[short]])
        return pool, (np.cumsum(sizes) - sizes)[place], sizes[place]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, n + 1 bounds) of ``texts``; null counts as empty."""
        odd = np.zeros(len(texts), bool)
        for s in self.special:
            odd |= pc.match_substring(texts, s).fill_null(False).to_numpy(zero_copy_only=False)
        if odd.any():  # texts with special tokens are encoded as they are
            own, size = self.direct(texts.filter(pa.array(odd)).to_pylist())
            own = iter(np.split(own, np.cumsum(size)[:-1]))
            flat, bounds = self.encode(pc.if_else(pa.array(odd), "", texts))
            rows = [next(own) if o else flat[x:y] for o, x, y in zip(odd, bounds[:-1], bounds[1:])]
            return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        data, offsets = buffers(texts)
        data, cuts, ends = _units(data[offsets[0]:offsets[-1]], offsets - offsets[0])
        units = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data)).dictionary_encode()  # each is looked up once a block
        pool, start, size = self.look_up(units.dictionary)
        code = units.indices.to_numpy()
        count = size[code]
        sums = np.concatenate([[0], np.cumsum(count)])
        at = np.repeat(start[code] - sums[:-1], count)
        at += np.arange(sums[-1])
        return pool[at], sums[np.searchsorted(cuts, ends)]


def _encoder(path: str) -> Units:
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(path)
        _LOADED[path] = (tok, Units(tok))
    return _LOADED[path][1]


def encoder(path: str):
    """texts -> their ids as little-endian 32-bit bytes, through a bounded
    cache of the texts' units."""
    units = _encoder(path)

    def encode(texts: list[str]) -> list[bytes]:
        flat, bounds = units.encode(pa.array(texts, pa.string()))
        return [flat[x:y].tobytes() for x, y in zip(bounds[:-1], bounds[1:])]

    return encode


def _pieces(path: str, length: int, end_id: int):
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    end = array("I", [end_id]).tobytes()

    def run(batches):
        units = _encoder(path)
        for b in batches:
            size = np.cumsum(pc.binary_length(b.column("text")).fill_null(0).to_numpy())
            lo = 0
            while lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + BLOCK, "right")))
                flat, bounds = units.encode(b.column("text").slice(lo, hi - lo))
                out = []
                for d, x, y in zip(b.column("doc_id").slice(lo, hi - lo).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                    n = y - x + 1
                    for k, at in enumerate(range(0, n, length)):
                        last = at + length >= n
                        crc = zlib.crc32(flat[x + at:y if last else x + at + length])
                        out.append((d, k, at, n - at if last else length, zlib.crc32(end, crc) if last else crc))
                yield from batches_of(dict(zip(schema.names, (pa.array(c, f.type) for c, f in zip(zip(*out), schema)))), schema)
                lo = hi
        units.clear()  # the worker goes on to other stages
    return run


def pieces(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(lean(_pieces(path, length, end_id)), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit(sizes: np.ndarray, order: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item, taken in ``order``: each goes where the
    least room is left that holds it."""
    room: list[list[int]] = [[] for _ in range(length + 1)]
    filled = 0  # bit r: a bin has r free places
    bins, offsets, n = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), 0
    for i in order.tolist():
        s = int(sizes[i])
        fits = filled >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                filled ^= 1 << r
        else:
            r, b = length, n
            n += 1
        bins[i], offsets[i] = b, length - r
        r -= s
        if r > 0:
            room[r].append(b)
            filled |= 1 << r
    return bins, offsets


_MEMBERS = ("doc_id", "piece", "start", "length", "ids_crc32", "offset")
_TYPES = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
_BIN = "sequence_id bigint, size bigint, open boolean, " + ", ".join(f"{n} array<{'int' if t == pa.int32() else 'bigint'}>" for n, t in zip(_MEMBERS, _TYPES))


def _packer(length: int, turn: int, group: int, slack: int):
    schema = pa.schema([("sequence_id", pa.int64()), ("size", pa.int64()), ("open", pa.bool_()), *((n, pa.list_(t)) for n, t in zip(_MEMBERS, _TYPES))])

    def packed(table: pa.Table, done: int):
        """Bins of the items of ``table``, whose members are lists."""
        from pyspark import TaskContext

        sizes = table["size"].to_numpy()
        flat = {n: table[n].combine_chunks() for n in _MEMBERS}
        cuts = np.concatenate([[0], np.cumsum(np.diff(flat["doc_id"].offsets.to_numpy()))])
        flat = {n: a.flatten() for n, a in flat.items()}
        first = cuts[:-1]
        key = [flat[n].fill_null(-1).to_numpy(zero_copy_only=False)[first] for n in ("ids_crc32", "piece", "doc_id")]
        bins, base = best_fit(sizes, np.lexsort((*key, -sizes)), length)
        # members by bin and place
        owner = np.repeat(np.arange(len(sizes)), np.diff(cuts))
        place = flat["offset"].to_numpy() + base[owner]
        order = np.lexsort((place, bins[owner]))
        n = int(bins.max()) + 1
        bounds = np.searchsorted(bins[owner][order], np.arange(n + 1))
        total = np.bincount(bins, weights=sizes, minlength=n).astype(np.int64)
        take = pa.array(order)
        cols = {m: pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), flat[m].take(take)) for m in _MEMBERS if m != "offset"}
        cols["offset"] = lists(place[order], bounds)
        ctx = TaskContext.get()
        seq = (np.int64(turn) << 56) + (np.int64(ctx.partitionId() if ctx else 0) << 32) + done + np.arange(n)
        return n, batches_of({"sequence_id": seq, "size": total, "open": total < length - slack, **cols}, schema)

    def run(batches):
        held, rows, done = [], 0, 0
        for b in batches:
            if turn == 0:  # pieces: items of one member
                ones = np.arange(b.num_rows + 1)
                b = pa.RecordBatch.from_arrays([b.column("length"), *(pa.ListArray.from_arrays(pa.array(ones.astype(np.int32)), b.column(n)) for n in _MEMBERS[:-1]),
                                                lists(np.zeros(b.num_rows, np.int64), ones)], names=["size", *_MEMBERS])
            held.append(b.select(["size", *_MEMBERS]))
            rows += b.num_rows
            if rows >= group:
                n, out = packed(pa.Table.from_batches(held), done)
                yield from out
                held, rows, done = [], 0, done + n
        if rows:
            yield from packed(pa.Table.from_batches(held), done)[1]
    return run


def pack(parts: DataFrame, length: int = LENGTH, slack: int = SLACK, group: int = GROUP) -> DataFrame:
    """The rows of ``pieces`` with sequence_id and offset."""
    # narrow rows, dealt so that a task's first groups are as full as they may be
    dealt = parts.repartition(max(1, -(-parts.count() // group)), F.xxhash64("doc_id", "piece"))
    bins = written(dealt.mapInArrow(_packer(length, 0, group, slack), _BIN), "bins")
    done, turn = bins.where("NOT open"), 1
    n = bins.where("open").count()
    while n > 1:
        groups = -(-n // group)
        dealt = bins.where("open").repartition(groups, F.xxhash64("sequence_id", F.lit(turn)))
        bins = written(dealt.mapInArrow(_packer(length, turn, group, slack), _BIN), "bins")
        done, before, turn = done.unionByName(bins.where("NOT open")), n, turn + 1
        n = bins.where("open").count()
        if groups == 1 or n == before:  # one group is best fit itself; or nothing could be merged
            break
    done = done.unionByName(bins.where("open"))
    return done.select("sequence_id", F.explode(F.arrays_zip(*_MEMBERS)).alias("m")).select(*(f"m.{c}" for c in _MEMBERS[:-1]), "sequence_id", "m.offset")


def best_fit_packing(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every
    piece of ``docs`` (doc_id, text); ``tokenizer`` is a file's path."""
    return pack(written(pieces(docs, tokenizer, length, end_id), "pieces"), length)
