"""drawpool: pool-based active learning as Spark DataFrame jobs.

Layout
------
sources/    table contracts, readers, test-table adaptors, history sinks
functions/  Column-level helpers: seeded hash, text templates, tokens, scores
operators/  DataFrame -> DataFrame operators: labels, sampling, NLI, ranking,
            evaluation, ledger upkeep
plans/      scorers (fit/score) and the round driver
streaming/  optional Structured Streaming feed into the annotation ledger
"""

__version__ = "0.1.0"
