"""Token ids of whole texts as Parquet files that can be read in part.

``write`` deals the documents into shards by ascending ``doc_id``, encodes
each text once, in the task that writes it, and stores one row a document:

* ``ids``: a list column, dictionary encoded (about two bytes an id);
* ``shard``, ``doc_id``, ``at`` (ids before the document in its shard),
  ``n_tokens``: delta encoded.

Row groups and pages have a bounded size and the files carry page indexes, so
a reader of ``doc_id``, ``at`` and ``n_tokens`` never touches the ids, and a
range of documents or token positions touches only its own pages.  A second
small table holds, for each shard, how many ids come before it; the position
of a document in the whole stream is that number plus ``at``.

Defined cases: a null or empty text is the end id alone; rows without a
``doc_id`` come first; rows of one ``doc_id`` follow each other, by the hash
of their text; an empty table gives files without rows; other columns are not
read.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches_of, importable, lists, scratch

END_ID = 0
#: Bytes of text in a shard, and in a row group and a page of its files.
SHARD_BYTES, GROUP_BYTES, PAGE_BYTES = 64 << 20, 16 << 20, 64 << 10
#: Documents in a page of the narrow columns.
PAGE_ROWS = 512
#: Pieces of text whose ids a worker keeps, and the longest that it keeps.
CACHE, CACHED_CHARS = 500_000, 64
#: Bytes of text that are encoded together.
BLOCK = 3 << 20
NARROW = ("shard", "doc_id", "at", "n_tokens")
_LOADED: dict[str, "Encoder"] = {}


def _cuts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Byte positions at which a byte-level tokenizer always ends a piece,
    among them the ``ends`` of the texts: before a blank that follows other
    text, around the last line end before other text, and between a letter or
    digit and the punctuation after it.  What stands next to a cut is known
    not to be white space; where a character isn't known, nothing is cut."""
    n = len(data)
    one, two, three = (np.concatenate([np.zeros(k, np.uint8), data[:-k]]) if n > k else np.zeros(n, np.uint8) for k in (1, 2, 3))
    tail = (one >= 0x80) & (one < 0xC0)
    accented = tail & (two == 0xC3) & (one != 0x97) & (one != 0xB7)  # the letters from U+00C0 to U+00FF
    text_before = (one > 0x20) & (one < 0x80) | tail & ((two >= 0xC3) & (two < 0xE0) | (three >= 0xE4) & (three < 0xEE))
    here = np.concatenate([data, np.zeros(1, np.uint8)])
    text_here = (here > 0x20) & (here < 0x80) | (here >= 0xC3) & (here < 0xE0) | (here >= 0xE4)
    text_here[ends] = False
    line = np.flatnonzero((data == 0x0A) & text_here[1:])
    kind = _KIND[one]
    cut = np.zeros(n + 1, bool)
    cut[:n] = (data == 0x20) & text_before | ((kind == 1) | accented) & (_KIND[data] == 2)
    cut[line] = cut[line + 1] = cut[ends] = True
    return np.flatnonzero(cut).astype(np.int32)


#: Of each byte: 1 ASCII letter or digit, 2 other visible ASCII character.
_KIND = np.array([0 if not 0x20 < c < 0x7F else 1 if chr(c).isalnum() else 2 for c in range(256)], np.int8)


class Encoder:
    """Texts -> ids of a byte-level BPE file.  Each distinct piece between two
    cuts is encoded once and looked up afterwards."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        vocab = self.tok.get_vocab()  # a character of a piece stands for a byte
        self.bytes = np.zeros(max(vocab.values()) + 1, np.int64)
        self.bytes[list(vocab.values())] = [len(v) for v in vocab]
        self.dtype = np.uint16 if len(self.bytes) <= 1 << 16 else np.uint32
        self.clear()

    def clear(self) -> None:
        self.codes, self.n = {}, 0
        self.pool, self.start = np.empty(1 << 16, self.dtype), np.zeros(1 << 16, np.int64)  # unit i has pool[start[i]:start[i + 1]]

    def _direct(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, units: list[str]) -> None:
        """Units that begin with a blank and end with other text are encoded
        as one text, as there is a cut between any two of them."""
        joint, alone = [], []
        for u in units:
            (joint if u[0] == " " and not u[-1].isspace() and "|" not in u and ">" not in u else alone).append(u)
        ids, sizes = [], []
        for lo in range(0, len(joint), 4096):
            part = joint[lo:lo + 4096]
            got = np.array(self._direct(["".join(part)])[0], self.dtype)
            ends = np.cumsum([len(u) if u.isascii() else len(u.encode()) for u in part])
            sums = np.cumsum(self.bytes[got])
            at = np.searchsorted(sums, ends)
            assert len(sums) and sums[-1] == ends[-1] and (sums[at] == ends).all()
            ids.append(got)
            sizes.append(np.diff(at + 1, prepend=0))
        for got in self._direct(alone):
            ids.append(np.array(got, self.dtype))
            sizes.append(np.array([len(got)]))
        n, used, new = self.n, int(self.start[self.n]), np.concatenate(sizes)
        self.n += len(units)
        self.codes.update(zip(joint + alone, range(n, self.n)))
        self.start = _room(self.start, self.n + 1)
        self.start[n + 1:self.n + 1] = used + np.cumsum(new)
        self.pool = _room(self.pool, used + int(new.sum()))
        self.pool[used:used + int(new.sum())] = np.concatenate(ids)

    def _look_up(self, units: list[str]) -> np.ndarray:
        missing = [u for u in units if u not in self.codes]
        if missing:
            self._learn(missing)
        return np.fromiter(map(self.codes.__getitem__, units), np.int32, len(units))

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, n + 1 bounds) of the non-null ``texts``."""
        if len(self.codes) > CACHE or len(self.pool) > 16 * CACHE:
            self.clear()
        odd = np.zeros(len(texts), bool)  # texts with special tokens
        for s in self.special:
            odd |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        if odd.any():
            return self._with_special(texts, odd)
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
        ends = offsets - offsets[0]
        cuts = _cuts(data, ends)
        units = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(data)).dictionary_encode()
        values = units.dictionary.to_pylist()
        code = self._look_up(values)[units.indices.to_numpy()]
        start, count = self.start[code], self.start[code + 1] - self.start[code]
        sums = np.concatenate([[0], np.cumsum(count)])
        place = np.repeat((start - sums[:-1]).astype(np.int32), count)  # the pool is small
        place += np.arange(sums[-1], dtype=np.int32)
        flat = self.pool[place]
        for v in [v for v in values if len(v) > CACHED_CHARS]:  # they hardly come again
            del self.codes[v]
        return flat, sums[np.searchsorted(cuts, ends)]

    def _with_special(self, texts: pa.StringArray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts with special tokens are encoded as they are."""
        at = np.flatnonzero(odd)
        direct = dict(zip(at.tolist(), self._direct(texts.take(pa.array(at)).to_pylist())))
        flat, bounds = self.encode(pc.if_else(pa.array(odd), "", texts))
        rows = [np.array(direct[i], self.dtype) if odd[i] else flat[bounds[i]:bounds[i + 1]] for i in range(len(texts))]
        return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])


def _room(a: np.ndarray, n: int) -> np.ndarray:
    """``a`` with room for ``n`` entries."""
    return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])


def encoder(path: str) -> Encoder:
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def blocks(batch: pa.RecordBatch, column: str):
    """Slices of ``batch`` whose texts have about ``BLOCK`` bytes."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + BLOCK, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _encode(path: str, end_id: int):
    schema = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        from pyspark import TaskContext

        enc, at, shard = encoder(path), 0, TaskContext.get().partitionId()
        for batch in batches:
            for b in blocks(batch, "text"):
                flat, bounds = enc.encode(pc.fill_null(b.column("text").cast(pa.string()), ""))
                n = np.diff(bounds) + 1
                ends = np.concatenate([[0], np.cumsum(n)])
                ids = np.full(ends[-1], end_id, np.int32)
                ids[np.arange(len(flat)) + np.repeat(np.arange(len(n)), n - 1)] = flat
                yield from batches_of({"shard": np.full(len(n), shard, np.int32), "doc_id": b.column("doc_id"), "at": at + ends[:-1],
                                       "n_tokens": n.astype(np.int32), "ids": lists(ids, ends)}, schema, 1024)
                at += int(ends[-1])
            pa.default_memory_pool().release_unused()
    return run


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES, group_bytes: int = GROUP_BYTES,
          page_bytes: int = PAGE_BYTES, page_rows: int = PAGE_ROWS) -> None:
    """Write the ids of ``docs`` (doc_id, text) below ``path``: ``tokens`` and
    ``shards``.  A task that is run again writes the same rows: the order is
    total but for equal rows."""
    importable(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = ("doc_id", "h", "salt")  # the salt parts equal rows
    keyed = docs.withColumn("h", F.xxhash64("text")).withColumn("salt", F.monotonically_increasing_id())
    sorted_ = keyed.repartitionByRange(max(1, -(-size // shard_bytes)), *order).sortWithinPartitions(*order).select("doc_id", "text")
    rows = sorted_.mapInArrow(_encode(tokenizer, end_id), "shard int, doc_id bigint, at bigint, n_tokens int, ids array<int>")
    out = (rows.write.option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0").option("parquet.block.size", group_bytes)
           .option("parquet.page.size", page_bytes).option("parquet.page.row.count.limit", page_rows))
    for c in NARROW:
        out = out.option(f"parquet.enable.dictionary#{c}", "false")  # whole numbers without a dictionary are delta encoded
    out.option("parquet.enable.dictionary#ids.list.element", "true").parquet(f"{path}/tokens")
    per = read_metadata(docs.sparkSession, path).groupBy("shard").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_docs"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    per.select("shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("first"), "n_tokens", "n_docs").coalesce(1).write.parquet(f"{path}/shards")


_TOKENS = "shard int, doc_id bigint, at bigint, n_tokens int, ids array<int>"


def _tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_TOKENS).parquet(f"{path}/tokens")


def shards(spark: SparkSession, path: str) -> DataFrame:
    """shard, first (ids before it), n_tokens, n_docs."""
    return spark.read.schema("shard int, first bigint, n_tokens bigint, n_docs bigint").parquet(f"{path}/shards")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """shard, doc_id, at, n_tokens; the ids are not read."""
    return _tokens(spark, path).select(*NARROW)


def read_documents(spark: SparkSession, path: str, lo: int, hi: int) -> DataFrame:
    """Documents with lo <= doc_id <= hi: the bounds reach the page index."""
    return _tokens(spark, path).where(F.col("doc_id").between(lo, hi))


def read_span(spark: SparkSession, path: str, lo: int, hi: int) -> DataFrame:
    """doc_id, start, ids of the tokens lo <= position < hi of the whole
    stream, by document.  The shard table says which shards and places in
    them; documents elsewhere are not read."""
    hit = shards(spark, path).where((F.col("first") < hi) & (F.col("first") + F.col("n_tokens") > lo)).collect()  # the shards of one span
    if not hit:
        return spark.createDataFrame([], "doc_id bigint, start bigint, ids array<int>")
    rows = _tokens(spark, path)
    first = F.create_map(*(F.lit(x) for r in hit for x in (r["shard"], r["first"])))
    rows = rows.where(F.col("shard").between(min(r["shard"] for r in hit), max(r["shard"] for r in hit)))
    if len(hit) == 1:
        rows = rows.where(F.col("at") < hi - hit[0]["first"])
    rows = rows.withColumn("start", first[F.col("shard")] + F.col("at")).where((F.col("start") < hi) & (F.col("start") + F.col("n_tokens") > lo))
    skip = F.greatest(F.lit(lo) - F.col("start"), F.lit(0)).cast("int")
    stop = F.least(F.lit(hi) - F.col("start"), F.col("n_tokens")).cast("int")
    return rows.select("doc_id", (F.col("start") + skip).alias("start"), F.slice("ids", skip + 1, stop - skip).alias("ids"))


def _sums(batches):
    schema = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    for b in batches:
        ids = b.column("ids")
        cut = ids.offsets.to_numpy()
        flat = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<u4")
        crc = np.array([zlib.crc32(flat[x:y]) for x, y in zip(cut[:-1], cut[1:])], np.int64)
        yield from batches_of({"shard": b.column("shard"), "doc_id": b.column("doc_id"), "at": b.column("at"), "n_tokens": np.diff(cut).astype(np.int64), "ids_crc32": crc}, schema)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    importable(spark)
    rows = _tokens(spark, path).mapInArrow(_sums, "shard int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint")
    where = shards(spark, path).select("shard", "first")  # a row a shard: small, and Spark sees its size
    return rows.join(where, "shard").select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write ``docs`` to the shared folder and return ``checksums`` of the files."""
    path = scratch(docs.sparkSession, "token-files")
    write(docs, path, tokenizer, end_id)
    return checksums(docs.sparkSession, path)
