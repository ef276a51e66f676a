"""Language identification as mixture inference.

Each language is a distribution over hashed byte trigrams of lower-cased words
(the edges of a word count as blanks), learned by counting the labelled
training rows.  A document is a mixture: expectation-maximisation estimates
its language proportions from the trigrams' likelihoods.  The set of its
languages is chosen among the nested sets of the largest proportions by
log-likelihood less a penalty for each further language; the prediction is the
language with the largest share in that set, the score is that share.

Counts of a task leave it as one row a language and trigram; the model that
reaches the driver has (languages x 32,768) counts, however many rows there
are.

Defined cases: null texts and texts without a letter are ``und`` with score 0;
rows without a language or id teach nothing; without any training row every
text is ``und``; a null ``doc_id`` is not held out; repeated rows are rows of
their own; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, importable
from .textgrid import buffers

BUCKETS = 1 << 15
#: Added to every count.
SMOOTH = 0.05
#: Log-likelihood that each further language must gain, times log(trigrams).
PENALTY = 3.0
FULL_ROUNDS, SET_ROUNDS = 8, 5
_BLOCK = 1 << 19

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, trigram bucket) of every letter byte."""
    offsets = offsets - offsets[0]
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    # one blank before each document and two at the end
    put = np.arange(len(data)) + np.repeat(np.arange(n), lengths) + 1
    x = np.full(len(data) + n + 2, 32, np.uint8)
    letter = _LETTER[data]
    folded = np.where((data >= 65) & (data < 91), data + 32, data)
    big = np.zeros(len(data), bool)  # capitals of Latin-1 in UTF-8
    big[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    folded = np.where(big, folded + 0x20, folded)
    x[put] = np.where(letter, folded, 32)
    at = put[letter]
    code = (x[at - 1].astype(np.uint32) << np.uint32(16)) | (x[at].astype(np.uint32) << np.uint32(8)) | x[at + 1]
    bucket = (code * np.uint32(2654435761)) >> np.uint32(17)
    return np.repeat(np.arange(n), lengths)[letter], bucket


def _parts(texts: pa.Array):
    data, offsets = buffers(texts)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + _BLOCK, "right")) - 1))
        yield lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1]
        lo = hi


def _count(batches):
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])
    total: dict[str, np.ndarray] = {}
    for b in batches:
        langs = np.array(b.column("lang").to_pylist(), object)
        for lo, hi, data, offsets in _parts(b.column("text")):
            doc, bucket = grams(data, offsets)
            names, code = np.unique(langs[lo:hi].astype(str), return_inverse=True)
            counts = np.bincount(code[doc] * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
            for name, c in zip(names.tolist(), counts):
                total[name] = total[name] + c if name in total else c
    for name, c in total.items():
        at = np.flatnonzero(c)
        yield from batches_of({"lang": pa.array([name] * len(at), pa.string()), "bucket": at.astype(np.int32), "n": c[at]}, schema)


def learn(train: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their trigram distributions (bucket x language) from
    ``train`` (text, lang)."""
    importable(train.sparkSession)
    rows = (train.where(F.col("lang").isNotNull()).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
            .mapInArrow(_count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow())
    langs = sorted(set(rows["lang"].to_pylist()))
    counts = np.full((BUCKETS, len(langs)), SMOOTH)
    code = {x: i for i, x in enumerate(langs)}
    np.add.at(counts, (rows["bucket"].to_numpy(), np.array([code[x] for x in rows["lang"].to_pylist()], np.int64)), rows["n"].to_numpy())
    return langs, counts / counts.sum(axis=0)


def infer(doc: np.ndarray, bucket: np.ndarray, n: int, model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(proportions n x languages, chosen set n x languages) of n documents."""
    size = model.shape[1]
    keys = np.sort((doc.astype(np.uint64) * np.uint64(BUCKETS) + bucket).astype(np.uint32 if n < 1 << 17 else np.uint64))
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(keys))).astype(float)
    owner, like = (keys[first] // BUCKETS).astype(np.int64), model[keys[first] % BUCKETS]
    cut = np.searchsorted(owner, np.arange(n))
    full = np.bincount(owner, minlength=n) > 0
    some = np.flatnonzero(full)

    def per_doc(values: np.ndarray) -> np.ndarray:
        out = np.zeros((n, *values.shape[1:]))
        if len(some):
            out[some] = np.add.reduceat(values, cut[some], axis=0)
        return out

    tokens = np.maximum(per_doc(count), 1)

    def em(share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        for _ in range(rounds):
            joint = like * share[owner]
            joint *= (count / joint.sum(axis=1))[:, None]
            share = per_doc(joint) / tokens[:, None]
        return share, per_doc(count * np.log((like * share[owner]).sum(axis=1)))

    share, _ = em(np.full((n, size), 1 / size), FULL_ROUNDS)
    single = per_doc(count[:, None] * np.log(like))
    order = np.argsort(-share, axis=1, kind="stable")
    best = np.zeros((n, size))
    best[np.arange(n), single.argmax(axis=1)] = 1
    score = single.max(axis=1)
    for k in range(2, size + 1):
        inside = np.zeros((n, size), bool)
        np.put_along_axis(inside, order[:, :k], True, axis=1)
        start = np.where(inside, share + 1e-9, 0)
        part, value = em(start / start.sum(axis=1, keepdims=True), SET_ROUNDS)
        value = value - PENALTY * (k - 1) * np.log(tokens + 1)
        better = full & (value > score)
        best[better], score[better] = part[better], value[better]
    return best, best > 0


def _predict(langs: list[str], model: np.ndarray):
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("languages", pa.list_(pa.string())), ("shares", pa.list_(pa.float64()))])
    names = np.array(langs, object)

    def run(batches):
        for b in batches:
            for lo, hi, data, offsets in _parts(b.column("text")):
                n = hi - lo
                doc, bucket = grams(data, offsets)
                has = np.bincount(doc, minlength=n) > 0
                plain = np.zeros(n, bool)
                plain[doc[data[_LETTER[data]] < 128]] = True
                for i in np.flatnonzero(has & ~plain):  # bytes above ASCII only: is one of them a letter?
                    has[i] = any(c.isalpha() for c in b.column("text")[lo + int(i)].as_py())
                has &= bool(langs)
                share, inside = infer(doc, bucket, n, model) if langs else (np.zeros((n, 1)), np.zeros((n, 1), bool))
                best = share.argmax(axis=1)
                share = np.minimum(share, 1.0)
                out = []
                for i, d in enumerate(b.column("doc_id").slice(lo, n).to_pylist()):
                    if has[i]:
                        own = np.flatnonzero(inside[i])
                        out.append((d, langs[best[i]], float(share[i, best[i]]), names[own].tolist(), share[i, own].tolist()))
                    else:
                        out.append((d, "und", 0.0, [], []))
                yield from batches_of(dict(zip(schema.names, (pa.array(c, f.type) for c, f in zip(zip(*out), schema)))), schema)
    return run


def held_out(doc_id, parts: int, part: int):
    """Whether crc32 of the id as text leaves ``part`` modulo ``parts``; a null id does not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def language_mixture(docs: DataFrame, langs: list[str], model: np.ndarray) -> DataFrame:
    """doc_id, lang_pred, score, languages, shares per row of ``docs`` (doc_id, text)."""
    importable(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_predict(langs, model), "doc_id bigint, lang_pred string, score double, languages array<string>, shares array<double>")
