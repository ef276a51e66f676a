import os
import random
import sys
import zlib
from array import array

import numpy as np

sys.path.insert(0, os.path.dirname(__file__))
from helpers import documents  # noqa: E402

from drawpool.llm import packing, queries  # noqa: E402

TEXTS = ["", None, "Hello, world! it's dogs' x's \"a\".", "é́ É Ⅷ² x².,; »a».", "a\tb c d\r\ne\x1cf", "<|endoftext|> <|EndOfText|> x<|startoftext|>.",
         "ﬁ İ ẞ ΣΑΣ. ΣΑΣ", "日本語。テスト", "...!? -- ###token = \"x\"###", "İstanbul. don't DON'T I'LL we're'", " \n \n", "🙂🙂. a🙂b,"]


def _ids(text):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(queries.tokenizer_path())
    return tok.encode(text or "", add_special_tokens=False).ids + [0]


def test_cached_encoder_equals_the_tokenizer():
    encode = packing.encoder(queries.tokenizer_path())
    rng = random.Random(2)
    bits = [c for t in TEXTS if t for c in t] + list("abcABC.,'!&# \n")
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(bits) for _ in range(60)) for _ in range(300)]
    for t, got in zip(texts, encode(texts)):
        assert np.frombuffer(got, np.uint32).tolist() == _ids(t)[:-1], t


def test_packing_round_trip(spark):
    rng = random.Random(4)
    texts = TEXTS + ["".join(rng.choice("abc d.") for _ in range(rng.randrange(1, 9000))) for _ in range(60)]
    docs = list(enumerate(texts)) + [(3, texts[3]), (None, "no id"), (3, texts[3])]
    rows = packing.best_fit_packing(documents(spark, docs), queries.tokenizer_path()).collect()
    for i, t in enumerate(texts):
        ids, mine = _ids(t), sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == i)
        want = [(k, at, len(ids[at:at + 2048]), zlib.crc32(array("I", ids[at:at + 2048]).tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
        assert mine == sorted(want * (3 if i == 3 else 1))
    _gapless(rows, 2048)
    total = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= max(-(-total // 2048) + 1, sum(r.length > 1024 for r in rows) + 1)


def _gapless(rows, length):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= length


def _parts(spark, sizes):
    return spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(sizes)], "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def test_tree_rounds_merge_underfull_bins(spark):
    sizes = [30] * 400 + [700] * 40 + [1400] * 40
    parts = _parts(spark, sizes).repartition(16)
    rows = packing.pack(parts, group=64).collect()  # several groups in each round
    assert sorted(r.doc_id for r in rows) == list(range(len(sizes)))
    _gapless(rows, 2048)
    # no sequence holds two of 1400, one of 1400 and one of 700, or three of 700: 60 at least
    assert len({r.sequence_id for r in rows}) <= 62


def test_items_that_cannot_share(spark):
    rows = packing.pack(_parts(spark, [1500] * 300), group=32).collect()
    assert len({r.sequence_id for r in rows}) == 300


def test_best_fit_takes_the_tightest_bin():
    sizes = np.array([6, 7, 3, 4])
    bins, offsets = packing.best_fit(sizes, np.array([0, 1, 2, 3]), 10)
    assert bins.tolist() == [0, 1, 1, 0] and offsets.tolist() == [0, 0, 7, 6]


def test_packing_empty_table(spark):
    assert packing.best_fit_packing(documents(spark, []), queries.tokenizer_path()).count() == 0


def test_worker_memory_is_bounded(monkeypatch):
    """Neither the cache of chunks nor the powers of the hashes grow with what a worker has seen."""
    from drawpool.llm import textgrid

    path = queries.tokenizer_path()
    encode = packing.encoder(path)
    for k in range(8):
        encode([" ".join(f"{k}x{i}" for i in range(60_000))])
    assert len(packing._LOADED[path][1]) <= 400_000
    packing._LOADED.clear()
    monkeypatch.setattr(textgrid, "_POWERS", {})
    at = np.arange(0, 3 << 20, 8)
    whole = textgrid._spans(np.arange(3 << 20) % 251, at, at + 8, textgrid._P)
    assert max(len(up) for up, _ in textgrid._POWERS.values()) < 1 << 19
    assert (whole == textgrid._spans(np.arange(3 << 20) % 251, at, at + 8, textgrid._P, seg=1 << 12)).all()


def test_words_are_encoded_once_whatever_their_case_and_neighbours():
    """Each distinct word is encoded once, not once for each case and each punctuation around it."""
    path = queries.tokenizer_path()
    packing._LOADED.clear()
    encode = packing.encoder(path)
    words = ["anderton", "éauxenen", "größe"]
    texts = [f"({w}) {w.title()}, {w.upper()}! \"{w}\"? 12{w}34 {w}'s\t{w}\n{w}%%%" for w in words[:2]] + ["größe. Größe, (größe)"]
    got = encode(texts)
    known = set(packing._LOADED[path][1].known.to_pylist())
    assert set(words) <= known
    assert not [u for u in known - set(words) if any(w in u.lower() for w in words)]
    for t, ids in zip(texts, got):
        assert np.frombuffer(ids, np.uint32).tolist() == _ids(t)[:-1], t


def test_a_task_leaves_no_cache_behind():
    import pyarrow as pa

    path = queries.tokenizer_path()
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["some words", None])], names=["doc_id", "text"])
    assert sum(b.num_rows for b in packing._pieces(path, 2048, 0)(iter([batch]))) == 2
    assert len(packing._LOADED[path][1]) == 0
