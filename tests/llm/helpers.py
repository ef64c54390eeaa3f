"""Shared fixtures of the tests: small tables with awkward rows."""

from pyspark.sql import functions as F

DOC = "doc_id long, text string"
#: names that the operators use for results or inside
CLASHES = ["n_lines", "n_dropped", "n_words", "n_hit", "score", "features", "kept", "component_id", "n_links", "start", "length", "id", "key", "text_", "label"]


def docs(spark, rows):
    return spark.createDataFrame(rows, DOC)


def clashing(df):
    for c in CLASHES:
        if c not in df.columns:
            df = df.withColumn(c, F.lit("own"))
    return df


def duck(sf):
    import os

    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        p = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p if os.path.isfile(p) else p + '/*.parquet'}')")
    return con
