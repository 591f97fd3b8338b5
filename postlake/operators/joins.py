"""Join patterns. Every one keeps an equi key, so none becomes a nested loop over large tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a dictionary up to which it is broadcast; larger ones are joined by a shuffle.
SMALL_ROWS = 100_000


def sized(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows (counted up to that, no further)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _on(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k] == b[k] for k in keys])


def not_in(df: DataFrame, key: str, other: DataFrame, other_key: str) -> DataFrame:
    """SQL's NOT IN: as an anti join, but nothing passes if other has a null, and null keys pass
    only if other is empty."""
    stats = other.agg(F.count("*").alias("__n"), F.count_if(F.col(other_key).isNull()).alias("__null"))
    own = df.join(F.broadcast(stats))  # one row
    found = other.select(F.col(other_key).alias("__key")).distinct()
    kept = own.join(found, own[key] == found["__key"], "left_anti")
    return kept.where((F.col("__n") == 0) | ((F.col("__null") == 0) & F.col(key).isNotNull())).drop("__n", "__null")


#: Rows of a key that one block of pairs takes from each side, and pairs that a task compares.
BLOCK_ROWS, TASK_PAIRS = 4_000, 10_000_000


def blocks(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides of an equi join, and its keys, dealt so that a key of very many rows on both sides is joined by many tasks, block by block.

    Sizes are counted first; rows are told to blocks by their content, so a task that runs again deals them alike."""
    size = left.groupBy(*keys).count().withColumnRenamed("count", "n").join(right.groupBy(*keys).count().withColumnRenamed("count", "m"), keys)
    most, pairs = size.agg(F.coalesce(F.max(F.greatest("n", "m")), F.lit(0)), F.coalesce(F.sum(F.col("n").cast("double") * F.col("m")), F.lit(0.0))).collect()[0]  # one row
    tasks = int(pairs // TASK_PAIRS) + 1
    if tasks == 1:
        return left, right, keys
    n = most // BLOCK_ROWS + 1
    dealt = lambda df, own, other: df.withColumn(own, F.pmod(F.xxhash64(*df.columns), F.lit(n))).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn(other, F.col(other).cast("long"))
    on = [*keys, "__i", "__j"]
    return dealt(left, "__i", "__j").repartition(tasks, *on), dealt(right, "__j", "__i").repartition(tasks, *on), on


#: Pairs that a task of a dealt join gives.
DEALT_PAIRS = 2_000_000


def dealt_join(left: DataFrame, right: DataFrame, key: str, id_: str) -> tuple[DataFrame, int, list[str]]:
    """left joined with right by key over tasks of bounded output; the number of tasks, and the columns by which its rows are dealt.

    Pairs are counted first. A key that alone gives more is cut into pieces: its right rows are dealt by id_, its left rows go to each."""
    size = left.groupBy(key).agg(F.count("*").alias("n")).join(right.groupBy(key).agg(F.count("*").alias("m")), key).select(key, (F.col("n").cast("double") * F.col("m")).alias("pairs"))
    total, most = size.agg(F.coalesce(F.sum("pairs"), F.lit(0.0)), F.coalesce(F.max("pairs"), F.lit(0.0))).collect()[0]  # one row
    tasks = int(total // DEALT_PAIRS) + 1
    if most <= DEALT_PAIRS:
        return left.repartition(tasks, key).join(right.repartition(tasks, key), key), tasks, [key]
    hot = sized(size.where(F.col("pairs") > DEALT_PAIRS).select(key, F.ceil(F.col("pairs") / DEALT_PAIRS).alias("__pieces")))  # as many as tasks at most
    cut = lambda df, piece: df.join(hot, key, "left").withColumn("__piece", piece).drop("__pieces").repartition(tasks, key, "__piece")
    pieces = F.coalesce(F.col("__pieces"), F.lit(1))
    x, y = cut(left, F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1))), cut(right, F.pmod(F.xxhash64(id_), pieces))
    return x.join(y, [key, "__piece"]), tasks, [key, "__piece"]


def key_pairs(left: DataFrame, right: DataFrame, keys: list[str], id_: str, residual=None) -> DataFrame:
    """(a, b) with a < b of rows of left and right that agree in keys, one for each two rows; residual(left, right) filters further."""
    x, y, on = blocks(left, right, keys)
    out = x.alias("l").join(y.alias("r"), reduce(lambda p, q: p & q, [F.col(f"l.{k}") == F.col(f"r.{k}") for k in on]) & (F.col(f"l.{id_}") < F.col(f"r.{id_}")))
    if residual is not None:
        out = out.where(residual("l", "r"))
    return out.select(F.col(f"l.{id_}").alias("a"), F.col(f"r.{id_}").alias("b"))


def ordered_pairs(df: DataFrame, keys: list[str], id_: str, residual=None) -> DataFrame:
    """(a, b) with a < b, each once, of rows that agree in keys; residual(left, right) filters further.

    Two ids of one row each give a pair once, so pairs are shuffled, to be made distinct, only where an id has several rows."""
    own = df.where(reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in [*keys, id_]]))
    several = own.groupBy(id_).count().where("count > 1").select(id_)
    if several.isEmpty():
        return key_pairs(own, own, keys, id_, residual)
    one, more = own.join(several, id_, "left_anti").select(*df.columns), own.join(several, id_, "left_semi").select(*df.columns)
    again = key_pairs(more, own, keys, id_, residual).union(key_pairs(one, more, keys, id_, residual)).distinct()
    return key_pairs(one, one, keys, id_, residual).union(again)


def only_match(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) of keys that have exactly one value."""
    return df.groupBy(key).agg(F.count_distinct(value).alias("__n"), F.min(value).alias(value)).where("__n = 1").drop("__n")


def either_key(df: DataFrame, key: str, other: DataFrame, other_key: str) -> DataFrame:
    """Rows of df whose key, or key without leading zeros, is in other: two equi semi joins at once."""
    names = other.select(F.col(other_key).alias("__k")).where("__k IS NOT NULL").distinct()
    tagged = df.withColumn("__keys", F.array_distinct(F.array(F.col(key), F.ltrim(F.col(key), F.lit("0")))))
    hit = tagged.select(key, F.explode("__keys").alias("__k")).join(names, "__k", "left_semi").select(F.col(key).alias("__hit")).distinct()
    return df.join(hit, df[key] == hit["__hit"], "left_semi")


def first_by(df: DataFrame, keys: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """Of each key the columns of the first row in an order of ascending columns; combined before the shuffle."""
    top = F.min(F.struct(*[o.alias(f"__o{i}") for i, o in enumerate(order)], *columns)).alias("__top")
    return df.groupBy(*keys).agg(top).select(*keys, *[F.col(f"__top.{c}").alias(c) for c in columns])


def flagged(df: DataFrame, key: str, other: DataFrame, other_key: str, flag: str) -> DataFrame:
    """df with whether its key is in other (for EXISTS under OR or as a sort key)."""
    names = other.select(F.col(other_key).alias("__k"), F.lit(True).alias(flag)).where("__k IS NOT NULL").distinct()
    return df.join(names, df[key] == names["__k"], "left").drop("__k").withColumn(flag, F.coalesce(flag, F.lit(False)))


def matched_by_paths(paths: list[DataFrame]) -> DataFrame:
    """Union of paths of one schema, each pair once."""
    return reduce(lambda a, b: a.unionByName(b), paths).distinct()


def matched_by_key(paths: DataFrame, left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(c, k), each once: those of paths and those of left (c, key) and right (k, key) that have a common key.

    Pairs of a key are never shuffled: a pair is told at the first of several common keys, and paths leave out what the key gives."""
    few = lambda rows, id_, own: rows.where(F.col(key).isNotNull()).groupBy(id_).agg(F.collect_set(key).alias(own))  # noqa: E731  # an id's keys are few
    a, b = few(left, "c", "__a"), few(right, "k", "__b")
    x, y, on = blocks(a.withColumn(key, F.explode("__a")), b.withColumn(key, F.explode("__b")), [key])
    near = x.join(y, on).where(F.array_min(F.array_intersect("__a", "__b")) == F.col(key)).select("c", "k")
    p = paths.select("c", "k").distinct().alias("p")
    p = p.join(a.alias("a"), F.col("p.c").eqNullSafe(F.col("a.c")), "left").join(b.alias("b"), F.col("p.k").eqNullSafe(F.col("b.k")), "left")
    return near.union(p.where(~F.coalesce(F.arrays_overlap("__a", "__b"), F.lit(False))).select("p.c", "p.k"))


def counted(df: DataFrame, key: str, other: DataFrame, other_key: str, column: str) -> DataFrame:
    """df with the number of rows of other that have its key, 0 without any; other is counted before the join."""
    n = other.groupBy(F.col(other_key).alias("__k")).agg(F.count("*").alias(column))
    return df.join(n, df[key] == n["__k"], "left").drop("__k").withColumn(column, F.coalesce(column, F.lit(0)))


def with_parameters(df: DataFrame, **values: object) -> DataFrame:
    """df with the parameters of a query as columns, the same in every row."""
    return df.withColumns({name: F.lit(v) for name, v in values.items()})
