import os
import sys

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
from helpers import sql_rows  # noqa: E402

import corpus_pipeline  # noqa: E402
from drawpool.llm import language_mixture, oracle, queries, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_pipeline_against_sql_and_the_tokenizer(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    net = toxicity.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"), ~language_mixture.held_out(F.col("doc_id"), 4, 2))
    ok = [r.doc_id for r in toxicity.toxicity(docs, net).collect() if r.predicted == 0]
    table = docs.toPandas()
    table = table[table.doc_id.isin(ok)]
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet").toPandas()
    for sql, column, good in ((oracle.OP2, "kept", True), (oracle.OP5, "kept", True), (oracle.OP1, "contaminated", False)):
        cols, rows = sql_rows(sql, {"documents": table, "benchmark": benchmark})
        at, key = cols.index(column), cols.index("doc_id")
        rows = [eval(r) for r in rows]
        table = table[table.doc_id.isin([r[key] for r in rows if r[at] == good])]
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(queries.tokenizer_path())
    want = {d: len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for d, t in zip(table.doc_id, table.text)}
    got = {}
    rows = corpus_pipeline.run(spark, SF).collect()
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want and 0 < len(got) < 200
    assert len({r.sequence_id for r in rows}) <= 1.1 * sum(want.values()) / 2048 + 2


def test_stages_keep_columns_and_survive_odd_tables(spark):
    rows = [(1, "a plain text of six words", "en", None, 3, "x"), (1, "a plain text of six words", None, None, 3, "x"), (None, None, None, "s", None, "x"),
            (2, None, None, None, None, None), (3, "", "en", "s", 0, ""), (4, "a  plain text of six words", "en", "s", 3, "y"), (None, "another text", None, None, 1, "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string")
    for frame in (docs, docs.limit(0)):
        now = frame
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, SF)
            assert now.schema == frame.schema or now.dtypes == frame.dtypes
            now = spark.createDataFrame(now.collect(), frame.schema)
        ids = sorted(str(r.doc_id) for r in now.collect())
        assert ids == (["1", "2", "None"] if frame is docs else [])  # 3 and a null id equal 2: empty texts
        assert corpus_pipeline.STAGES[-1][1](spark, now, SF).count() == len(ids)


def test_entry_registers_everything(spark):
    import __spark_entry__ as e
    names = e.queries()
    assert names["pipeline"] is corpus_pipeline.run
    assert [n for n in range(1, 11) if sum(k.startswith(f"op{n}_") for k in names) != 1] == []
