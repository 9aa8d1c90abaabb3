"""Histories: retention, recency, keywords, vectors, frequencies, message windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def retained(df: DataFrame, ts: str, most: int) -> DataFrame:
    """The newest ``most`` rows; ties at the cut-off stay. One bounded top-k and a comparison, no global window."""
    edge = df.where(F.col(ts).isNotNull()).select(ts).orderBy(F.desc(ts)).limit(most).agg(F.min(ts).alias("_edge"))
    return df.join(F.broadcast(edge), F.col(ts) >= F.col("_edge")).drop("_edge")


def occurrences(text: Column, word: str) -> Column:
    """How often the word occurs, without overlap, whatever the case."""
    low = F.lower(text)
    return ((F.length(low) - F.length(F.replace(low, F.lit(word.lower()), F.lit("")))) / len(word)).cast("long")


def keyword_hits(df: DataFrame, text: Column, words: list[str], n: int, tie: str) -> DataFrame:
    """The n rows with the most occurrences, with ``hits``."""
    hits = sum((F.coalesce(occurrences(text, w), F.lit(0)) for w in words), F.lit(0))
    return df.withColumn("hits", hits).where("hits > 0").orderBy(F.desc("hits"), tie).limit(n)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays of one length, in double precision."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def most_similar(df: DataFrame, id_col: str, vec_col: str, query: list[float], n: int) -> DataFrame:
    """(id, similarity) of the n vectors nearest to the query; others of its length only, no zero vectors."""
    q = F.lit([float(x) for x in query])
    v = F.col(vec_col)
    usable = df.where((F.size(v) == len(query)) & F.exists(v, lambda x: x != 0) & ~F.exists(v, F.isnan))
    return usable.select(id_col, F.round(cosine(v, q), 6).alias("similarity")).orderBy(F.desc("similarity"), id_col).limit(n)


def tail_within(df: DataFrame, conv: str, turn: str, tokens: str, system: Column, most: int, least: int) -> DataFrame:
    """A conversation's window: all system messages, and the newest others while the sum stays within ``most``, but ``least`` at any rate."""
    x = df.withColumn("_sys", system)
    total = F.sum(F.when(F.col("_sys"), F.col(tokens)).otherwise(0)).over(Window.partitionBy(conv))
    w = Window.partitionBy(conv, "_sys").orderBy(F.desc(turn))
    x = x.withColumns({"_total": total, "_run": F.sum(tokens).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_rn": F.row_number().over(w)})
    return x.where(F.col("_sys") | (F.col("_rn") <= least) | (F.col("_run") + F.col("_total") <= most)).drop("_sys", "_total", "_run", "_rn")


def compressed(df: DataFrame, conv: str, turn: str, system: Column, keep: int = 6, slack: int = 2) -> DataFrame:
    """(conv, turn, kind, n): system messages, one summary row for what is left out, and the last ``keep`` others; only if more than keep + slack."""
    x = df.withColumn("_sys", system)
    w = Window.partitionBy(conv, "_sys").orderBy(F.desc(turn))
    x = x.withColumns({"_rn": F.row_number().over(w), "_n": F.count("*").over(Window.partitionBy(conv, "_sys"))})
    long = F.col("_n") > keep + slack
    kind = F.when(F.col("_sys"), "system").when(~long | (F.col("_rn") <= keep), "kept").otherwise("omitted")
    x = x.select(conv, turn, kind.alias("kind"))
    rows = x.where("kind <> 'omitted'").select(conv, turn, "kind", F.lit(1).cast("long").alias("n"))
    summary = x.where("kind = 'omitted'").groupBy(conv).agg(F.max(turn).alias(turn), F.count("*").alias("n")).select(conv, turn, F.lit("summary").alias("kind"), "n")
    return rows.unionByName(summary)


def frequencies(df: DataFrame, kind: str, title: str, n: int, titles: int, seq: str) -> DataFrame:
    """(kind, n, title, title_n, title_rank): the n most frequent kinds with their most frequent titles; ties go to the first seen."""
    per = df.groupBy(kind, title).agg(F.count("*").alias("title_n"), F.min(seq).alias("_first"))
    totals = per.groupBy(kind).agg(F.sum("title_n").alias("n"), F.min("_first").alias("_seen"))
    top = totals.orderBy(F.desc("n"), "_seen").limit(n)
    w = Window.partitionBy(kind).orderBy(F.desc("title_n"), "_first")
    ranked = per.withColumn("title_rank", F.row_number().over(w)).where(F.col("title_rank") <= titles)
    return ranked.join(F.broadcast(top), kind).select(kind, "n", title, "title_n", "title_rank")
