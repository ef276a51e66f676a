"""Near-duplicate groups by SuperMinHash, banding, verification and union.

Every shingle of a document draws one random permutation of the registers and
puts its j-th value, j plus a fraction, into the j-th register of that
permutation.  A document stops drawing as soon as all its registers hold less
than the next j, so a long text needs one value a shingle and a short one a
few more; the ranks of one shingle are correlated, which lowers the
variance of the signature.  Bands of registers are buckets; candidates of a
bucket are verified on the full shingle sets (``linking``).

256 registers make 51 bands of 5, so a pair at similarity 0.75 shares no band
with a probability of 1e-6.  Two members of a bucket are a candidate if three
tests allow the similarity: their set sizes; the parities of their shingles in
512 cells, which differ in no more cells than the sets differ in shingles (a
bound, so nothing is lost; it decides for short and middling texts); and 200
agreeing lowest bits of the 256 registers (224 are expected at 0.75, 200 lie 4.5
standard deviations below, 3e-6; it decides for long texts).  Equal sets are
one class from the start, by a 128-bit digest of the set.

Texts are verified in groups: one document and about 256 of those it meets, in
a stream that holds one set.  A text is filtered where it is read, by a bitmap
of the ids that any pair names, and goes to each group that compares it once.

Defined cases: null, empty and word-less texts have an empty set, are linked
with nothing and stay; fewer than 5 words are one shingle; rows of a repeated
``doc_id`` are one node, linked by each of their texts; a null ``doc_id`` is
never a component's id (its component is null if all of its class lack an
id, and it then stays); other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawpool.operators.membership import bitmap, may_be_in

from .common import batches_of, lean, lists, written
from .linking import components, link
from .textgrid import NONSPACE, Grid, blocks, mix, ngrams

SHINGLE, PERCENT = 5, 75
REGISTERS, BANDS, ROWS = 256, 51, 5
#: Agreeing low bits that a candidate needs.
AGREE = 200
#: Cells of the parities.
CELLS = 512
#: Partners of a document that one task compares with it, about.
PARTNERS = 256
#: Bytes of text whose signatures are made at once; each of their shingles takes a permutation of the registers.
SIGNED = 1 << 18
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(grid: Grid, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, flat, and n+1 bounds."""
    words, left, counts = grid.hashes(), grid.left(), grid.counts
    at, h = ngrams(words, left, size)
    few = np.flatnonzero((counts > 0) & (counts < size))
    whole = {}
    for n in np.unique(counts[few]):  # shorter texts: all their words as one
        d = few[counts[few] == n]
        mask = np.zeros(len(words), np.int64)
        mask[grid.bounds[d]] = n
        _, hs = ngrams(words, mask, int(n))
        whole.update(zip(d.tolist(), hs + np.uint64(n)))
    cut = np.searchsorted(at, grid.bounds)
    parts = [np.array([whole[d]], np.uint64) if d in whole else np.unique(h[cut[d]:cut[d + 1]]) for d in range(grid.n_docs)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def super_minhash(h: np.ndarray, bounds: np.ndarray, m: int) -> np.ndarray:
    """A signature of m registers per set; register values are j * 2**48 plus 48 random bits."""
    n = len(bounds) - 1
    sig = np.full(n * m, np.iinfo(np.uint64).max, np.uint64)
    sizes = np.diff(bounds)
    owner, elems = np.repeat(np.arange(n), sizes), h
    perm = None
    for j in range(m):
        draw = mix(elems + np.uint64(int(_STEP) * (j + 1) % (1 << 64)))
        k = j + ((draw >> np.uint64(48)) * np.uint64(m - j) >> np.uint64(16)).astype(np.int64)
        value = (np.uint64(j) << np.uint64(48)) | (mix(draw) >> np.uint64(16))
        if perm is None:
            register, first = k, k
        else:
            i = np.arange(len(elems))
            register = perm[i, k].astype(np.int64)
            perm[i, k] = perm[i, j]
        np.minimum.at(sig, owner * m + register, value)
        # a set whose registers all hold less than j + 1 is complete
        open_ = (sig.reshape(n, m).max(axis=1) >= np.uint64(j + 1) << np.uint64(48)) & (sizes > 0)
        if not open_.any():
            break
        go = open_[owner]
        if perm is None:
            perm = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (int(go.sum()), 1))
            perm[np.arange(len(perm)), first[go]] = 0
            owner, elems = owner[go], elems[go]
        elif not go.all():
            owner, elems, perm = owner[go], elems[go], perm[go]
    return sig.reshape(n, m)


def parities(h: np.ndarray, bounds: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """For each set, the parity of the number of its members in each cell, as 64-bit words."""
    n = len(bounds) - 1
    owner = np.repeat(np.arange(n), np.diff(bounds))
    counts = np.bincount(owner * cells + (mix(h) % np.uint64(cells)).astype(np.int64), minlength=n * cells)
    return np.packbits((counts & 1).astype(np.uint8).reshape(n, cells), axis=1).view(np.int64)


def _signatures(size: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()),
                        ("sketch", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        for b in batches:
            for lo, hi, grid in blocks(b.column("text"), NONSPACE, True, SIGNED):
                h, bounds = shingle_sets(grid, size)
                n = hi - lo
                full = super_minhash(h, bounds, REGISTERS)
                sig = full[:, :BANDS * ROWS].reshape(n, BANDS, ROWS)
                key = np.tile(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), (n, 1))
                for r in range(ROWS):
                    key = mix(key ^ sig[:, :, r])
                sketch = np.concatenate([np.packbits((full & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64), parities(h, bounds)], axis=1)
                sums = []
                for x in (mix(h + _STEP), mix(h ^ _STEP)):
                    c = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)])
                    sums.append((c[bounds[1:]] - c[bounds[:-1]]).view(np.int64))
                yield from batches_of({"doc_id": b.column("doc_id").slice(lo, n), "n_shingles": np.diff(bounds), "set_a": sums[0], "set_b": sums[1],
                                       "sketch": lists(np.ascontiguousarray(sketch).ravel(), np.arange(n + 1) * sketch.shape[1]),
                                       "bands": lists(key.view(np.int64).ravel(), np.arange(n + 1) * BANDS)}, schema)
    return run


def _verified(size: int, percent: int):
    schema = pa.schema([("x", pa.int64()), ("y", pa.int64())])

    def run(batches):
        """Rows come by group, a group's own texts (``head``) before those it meets."""
        here, heads = None, []
        for b in batches:
            x, y, head = b.column("x").to_pylist(), b.column("doc_id").to_pylist(), b.column("head").to_pylist()
            part = b.column("part").to_pylist()
            for lo, hi, grid in blocks(b.column("text"), NONSPACE, True):
                h, bounds = shingle_sets(grid, size)
                true = []
                for i in range(lo, hi):
                    if here != (x[i], part[i]):
                        here, heads = (x[i], part[i]), []
                    q = h[bounds[i - lo]:bounds[i - lo + 1]]
                    if head[i]:
                        heads.append(q.copy())
                        continue
                    for p in heads:
                        both = len(np.intersect1d(p, q, assume_unique=True))
                        if both > 0 and 100 * both >= percent * (len(p) + len(q) - both):
                            true.append(i)
                            break
                yield pa.RecordBatch.from_arrays([pa.array([c[i] for i in true], pa.int64()) for c in (x, y)], schema=schema)
    return run


def _groups(pairs: DataFrame) -> DataFrame:
    """The texts that each comparison needs: rows (doc_id, x, part, head).
    Every pair (x, y) asks for y's text once, and each part of x's partners,
    of about ``PARTNERS`` rows, for x's once."""
    sizes = written(pairs.groupBy("x").agg(F.ceil(F.count(F.lit(1)) / F.lit(PARTNERS)).alias("parts")), "sizes")
    dealt = pairs.join(sizes, "x").select("x", "y", F.pmod(F.xxhash64("y"), F.col("parts")).alias("part"))
    return written(dealt.select(F.col("y").alias("doc_id"), "x", "part", F.lit(False).alias("head"))
                   .unionByName(dealt.select(F.col("x").alias("doc_id"), "x", "part", F.lit(True).alias("head")).distinct()), "groups")


_BITS, _WORDS = REGISTERS // 64, (REGISTERS + CELLS) // 64


def _likely(percent: int):
    """Whether two members (their columns) can be similar enough, for ``link``."""
    def near(a, b):
        small, large = F.least(a["n"], b["n"]), F.greatest(a["n"], b["n"])
        differ = [F.bit_count(a[f"s{i}"].bitwiseXOR(b[f"s{i}"])) for i in range(_WORDS)]
        bits, cells = sum(differ[:_BITS], F.lit(0)), sum(differ[_BITS:], F.lit(0))
        # sets at this similarity differ in at most (100 - percent) / (100 + percent) of their sizes' sum
        return (100 * small >= percent * large) & ((100 + percent) * cells <= (100 - percent) * (a["n"] + b["n"])) & (bits <= REGISTERS - AGREE)
    return near


def near_dedup(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept per row of ``docs`` (doc_id,
    text).  ``percent`` is at least 75, for which the bands are laid out."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = written(docs.mapInArrow(lean(_signatures(size)), "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, sketch array<bigint>, bands array<bigint>"), "signatures")
    key = ["n_shingles", "set_a", "set_b"]
    some = signed.where("n_shingles > 0")
    classes = written(some.groupBy(*key).agg(F.min("doc_id").alias("node")), "classes")
    reps = written(some.join(classes.where("node IS NOT NULL"), key).where("doc_id = node").dropDuplicates(["node", *key]), "representatives")
    members = reps.select("node", F.explode("bands").alias("bucket"))
    shared = members.join(written(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket"), "buckets"), "bucket")
    # what the candidates' test needs goes with those that share a bucket
    carry = [F.col("n_shingles").alias("n"), *(F.col("sketch")[i].alias(f"s{i}") for i in range(_WORDS))]
    shared = written(shared.join(reps.select("node", *carry), "node"), "members")

    def verify(pairs: DataFrame) -> DataFrame:
        # texts are filtered where they are read; each goes once to the groups that compare it
        groups = _groups(pairs)
        ids = groups.select("doc_id").distinct()
        texts = docs.where(may_be_in(F.col("doc_id"), bitmap(ids, "doc_id"))).distinct().join(groups, "doc_id")
        dealt = texts.repartition("x", "part").sortWithinPartitions("x", "part", F.desc("head"))
        return dealt.select("x", "part", "head", "doc_id", "text").mapInArrow(lean(_verified(size, percent)), "x bigint, y bigint").distinct()

    comps = link(shared, verify, _likely(percent))
    # ids that come with several texts tie the classes of those texts together
    twice = some.groupBy("doc_id").agg(F.min(F.struct(*key)).alias("lo"), F.max(F.struct(*key)).alias("hi")).where("lo <> hi").select("doc_id")
    ties = written(some.join(twice, "doc_id").join(classes, key).where("doc_id <> node").select(F.col("doc_id").alias("x"), F.col("node").alias("y")), "ties")
    if not ties.isEmpty():
        comps = components(ties.unionByName(comps.select(F.col("node").alias("x"), F.col("component").alias("y"))))
    comps = written(comps, "components")
    placed = (signed.select("doc_id", *key).join(classes, key, "left").join(comps, "node", "left")
              .withColumn("component_id", F.when(F.col("n_shingles") > 0, F.coalesce("component", "node")).otherwise(F.col("doc_id"))))
    return placed.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
