import glob
import os
import random
import sys
import zlib
from array import array

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
from helpers import documents  # noqa: E402

from drawpool.llm import queries, token_files  # noqa: E402

PATH = queries.tokenizer_path(queries.BYTE_TOKENIZER)
BITS = ["Hello,", "world!", "it's", "dogs'", '"a".', "é́", "Ⅷ²", "x².,;", "»a»", " ", "  ", "\n", "\n\n", " \n", "\t", "\r\n", " ", "　", " ", "<|endoftext|>",
        "<|", "日本語。", "...!?", "don't", "I'LL", "we're'", "🙂🙂.", "a", "1", "22", "\x1c", "\x85", "'", "s", "'s", "ÿ,", "×.", "ﬁ", "É!", "​", "é,", "Ω;"]


def _tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATH)


def _ids(tok, text):
    return tok.encode(text or "", add_special_tokens=False).ids + [0]


def test_encoder_equals_the_tokenizer():
    rng, tok, enc = random.Random(3), _tokenizer(), token_files.encoder(PATH)
    texts = ["".join(rng.choice(BITS) + (" " if rng.random() < .4 else "") for _ in range(rng.randrange(14))) for _ in range(8000)]
    texts += ["a" * 500 + " " + "b c" * 300, ""]
    for lo in range(0, len(texts), 1000):
        part = texts[lo:lo + 1000]
        flat, bounds = enc.encode(pa.array(part))
        for t, x, y in zip(part, bounds[:-1], bounds[1:]):
            assert flat[x:y].tolist() == _ids(tok, t)[:-1], t


ROWS = [(7, "one two"), (3, None), (None, "no id"), (None, "no id"), (-4, ""), (7, "one two"), (7, "another"), (9, "x " * 40_000), (11, "é\n\nb. <|endoftext|> c")]


def _want(rows):
    tok, out, at = _tokenizer(), [], 0
    for d, t in rows:
        ids = _ids(tok, t)
        out.append((d, at, len(ids), zlib.crc32(array("I", ids).tobytes())))
        at += len(ids)
    return out


def test_files_of_odd_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    token_files.write(documents(spark, ROWS).repartition(4), path, PATH, shard_bytes=20_000)
    got = sorted(map(tuple, token_files.checksums(spark, path).collect()), key=lambda r: r[1])
    ids = [r[0] for r in got]
    assert ids == sorted(ids, key=lambda d: (d is not None, d))  # ascending, rows without an id first
    by_id = {(r[0], r[2], r[3]) for r in got}
    assert by_id == {(d, n, c) for d, _, n, c in _want(ROWS)} and len(got) == len(ROWS)
    assert [r[1] for r in got] == [sum(r[2] for r in got[:i]) for i in range(len(got))]  # one stream without gaps
    assert token_files.shards(spark, path).count() > 1


def test_empty_table(spark):
    assert token_files.token_files(documents(spark, []), PATH).count() == 0


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    got = sorted(map(tuple, queries.op11_token_files(spark, sf).collect()))
    assert got == _want(rows)


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma,", "delta."]) for _ in range(rng.randrange(400)))) for i in range(3000)]
    path = str(tmp_path_factory.mktemp("store") / "t")
    token_files.write(documents(spark, rows), path, PATH, shard_bytes=1 << 20, group_bytes=1 << 18, page_bytes=8 << 10, page_rows=64)
    return path, rows


def test_encodings_row_groups_and_page_indexes(store):
    files = glob.glob(f"{store[0]}/tokens/*.parquet")
    assert len(files) > 2
    for f in files:
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            col = {meta.row_group(g).column(i).path_in_schema: meta.row_group(g).column(i) for i in range(meta.num_columns)}
            ids = next(c for p, c in col.items() if p.startswith("ids"))
            assert "RLE_DICTIONARY" in ids.encodings and "DELTA_BINARY_PACKED" in col["doc_id"].encodings and "DELTA_BINARY_PACKED" in col["at"].encodings
            assert all(c.has_offset_index and c.has_column_index for c in col.values())
            assert meta.row_group(g).total_byte_size < 2 << 20


def test_selective_reads(spark, store):
    path, rows = store
    tok, ids = _tokenizer(), []
    starts = []
    for _, t in rows:
        starts.append(len(ids))
        ids += _ids(tok, t)
    meta = token_files.read_metadata(spark, path)
    assert "ids" not in meta._jdf.queryExecution().executedPlan().toString()
    assert [r.n_tokens for r in meta.orderBy("doc_id").collect()] == [y - x for x, y in zip(starts, starts[1:] + [len(ids)])]
    part = token_files.read_documents(spark, path, 100, 104)
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,100), LessThanOrEqual(doc_id,104)]" in part._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id: r.ids for r in part.collect()} == {i: ids[starts[i]:starts[i + 1]] for i in range(100, 105)}
    for lo, hi in ((0, 1), (5000, 5900), (starts[700] - 3, starts[700] + 2), (len(ids) - 4, len(ids) + 9), (1000, 400_000), (len(ids), len(ids) + 1)):
        got = token_files.read_span(spark, path, lo, hi).where(F.size("ids") > 0).orderBy("start").collect()
        assert sum((r.ids for r in got), []) == ids[lo:hi] and (not got or got[0].start == lo)
