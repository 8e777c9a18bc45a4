"""Small tables with the cases that every operator must take."""

from __future__ import annotations

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "lorem ipsum dolor sit amet consectetur " * 20_000


def docs(spark, texts, clash=False):
    """texts: list of texts or (doc_id, text). clash: further columns with names that operators use or that differ in case only."""
    rows = [x if isinstance(x, tuple) else (i, x) for i, x in enumerate(texts)]
    df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)
    if clash:
        from pyspark.sql import functions as F

        df = df.select("*", *(F.lit(k).alias(n) for k, n in enumerate(("TEXT", "node", "text_key", "n_tokens", "held_out", "group", "key", "template", "start"))))
    return df


def ask(df, *columns):
    """Sorted rows of the named columns."""
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
