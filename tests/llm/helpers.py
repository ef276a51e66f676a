"""Compare a query's rows with its DuckDB SQL, and build odd little tables."""

import duckdb


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted(map(repr, (tuple(r[c] for c in cols) for r in df.select(*cols).collect())))


def sql_rows(sql, tables):
    con = duckdb.connect()
    for name, source in tables.items():
        if isinstance(source, str):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{source}')")
        else:
            con.register(name, source)
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    cols = sorted(names)
    return cols, sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in rel.fetchall())


def documents(spark, rows, extra=True):
    """A documents table of (doc_id, text), with columns whose names clash
    with those that operators use inside."""
    schema = "doc_id bigint, text string" + (", n int, h string, digest string, rid string, doc string, kept int, score string" if extra else "")
    return spark.createDataFrame([tuple(r) + ((None,) * 7 if extra else ()) for r in rows], schema)
