"""Codes by vote of the nearest labelled vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlake.functions.scalars import dot

#: Neighbours, and the similarity that the nearest must have.
K, LEAST = 5, 0.8
#: Most examples that are broadcast and compared by native expressions; more are compared in blocks
#: of at most BLOCK_ROWS by matrix products, in BLOCKS blocks at least.
NATIVE_ROWS, BLOCK_ROWS, BLOCKS = 5_000, 100_000, 64
#: Similarities that a task holds at once.
_CELLS = 4_000_000


def vote(queries: DataFrame, examples: DataFrame, k: int = K, least: float = LEAST) -> DataFrame:
    """(id, code): the code with the largest sum of similarities among the k nearest examples; ties
    go to the nearer code; none if the nearest is less similar than least.

    queries (id, vector), examples (example, code, vector), unit vectors. Exact, for any number:
    the stated examples are compared with every query. Their number is counted first.
    """
    if examples.limit(NATIVE_ROWS + 1).count() > NATIVE_ROWS:
        return vote_all(queries, examples, k, least)
    pairs = queries.join(F.broadcast(examples.select("example", "code", F.col("vector").alias("v")))).select("id", "example", "code", dot(F.col("vector"), F.col("v")).alias("s"))
    return _voted(pairs, k, least)


def vote_all(queries: DataFrame, examples: DataFrame, k: int = K, least: float = LEAST, own: bool = True) -> DataFrame:
    """The same in blocks of queries and of examples, each block of the one with each of the other in
    a task; the k nearest of every block are merged. Nothing is collected. Unless own, a query's id
    is not among its examples."""
    n, m = examples.count(), queries.count()
    size = min(BLOCK_ROWS, max(1, -(-n // BLOCKS)))
    blocks, parts = max(1, -(-n // size)), max(1, -(-m // BLOCK_ROWS))
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    place = lambda c, count: F.pmod(F.xxhash64(c), F.lit(count)).cast("int")
    q = queries.select("id", "vector", place("id", parts).alias("part"), each(blocks).alias("block"))
    e = examples.select("example", "code", "vector", place("example", blocks).alias("block"), each(parts).alias("part"))

    def nearest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            b = b.sort_values("example", kind="stable")
            y, codes = np.stack(b["vector"].to_numpy()).astype(np.float64), b["code"].to_numpy()
            ids, names = a["id"].to_numpy(), b["example"].to_numpy()
            step = max(1, _CELLS // len(b))
            for i in range(0, len(a), step):
                x = np.stack(a["vector"].iloc[i : i + step].to_numpy()).astype(np.float64)
                s = np.round(x @ y.T, 12)  # equal vectors tie, wherever they stand in a block
                if not own:
                    s[ids[i : i + step, None] == names[None, :]] = -np.inf
                last = np.partition(s, -k, axis=1)[:, -k] if len(b) > k else np.full(len(s), -np.inf)
                for row, low, at in zip(s, last, ids[i : i + step], strict=True):
                    near = np.flatnonzero((row >= low) & (row > -np.inf))
                    near = near[np.argsort(-row[near], kind="stable")[:k]]
                    out.append((np.repeat(at, len(near)), names[near], codes[near], row[near]))
        return pd.DataFrame({c: np.concatenate(x) if out else [] for c, x in zip(("id", "example", "code", "s"), zip(*out, strict=True) if out else [[]] * 4, strict=True)})

    of = lambda df, c: df.schema[c].dataType.simpleString()
    schema = f"id {of(queries, 'id')}, example {of(examples, 'example')}, code {of(examples, 'code')}, s double"
    return _voted(q.groupBy("part", "block").cogroup(e.groupBy("part", "block")).applyInPandas(nearest, schema), k, least)


def _voted(pairs: DataFrame, k: int, least: float) -> DataFrame:
    order = Window.partitionBy("id").orderBy(F.desc("s"), "example")
    near = pairs.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    votes = near.groupBy("id", "code").agg(F.sum("s").alias("votes"), F.min("r").alias("nearest"), F.max("s").alias("top"))
    best = votes.groupBy("id").agg(F.min(F.struct((-F.round("votes", 9)).alias("v"), "nearest", "code")).alias("b"), F.max("top").alias("top"))
    return best.where(F.col("top") >= least).select("id", F.col("b.code").alias("code"))
