"""What the tests of this folder share."""

from __future__ import annotations

import duckdb

TABLES = "documents embeddings pages benchmark labels conversations".split()
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def duck(folder: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return connection


def cells(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(str(row[i]) for i in order) for row in rows)


def documents(spark, texts, source="s"):
    """Rows of documents from texts, or from (id, text) pairs."""
    rows = [(*(t if isinstance(t, tuple) else (i, t)), "en", source, 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)
