"""Target-distribution importance resampling.

Features are runs of words, hashed into buckets. Two tables of counts, of the corpus and of the target,
give a gain for each bucket, and the gains form an array that every task gets; a document's weight is
the sum of the array's entries over its features. Weight plus Gumbel noise, drawn by a hash of the
document's id, is its score, so that the highest scores are a sample without replacement in proportion
to exp(weight / 1000).

Scored rows are written once, then the cutoff is found by bisection of numbers: each job counts exactly
how many rows reach each of STEPS thresholds, which halves the interval of scores LEVELS times. If rows
tie at the cutoff, their ids are bisected in the same way, and rows of one id by their number in the
written table. The drawn rows are range-partitioned in order of rank, their places in their
partitions counted natively, and the sizes of the partitions before added. Undrawn rows are not
shuffled at all.

Edge cases: null texts have no features (weight 0) and are not eligible where least > 0; null ids are
hashed as the empty string and count as smaller than all others; repeated rows are documents of their own,
ranked one behind the other; without a benchmark all of the target's counts are 0; an empty table gives an
empty table. Ids must be integers, as ties are bisected by them. Other columns of docs pass.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.llm.common import arrow_schema, map_text, slices, stored, table

BUCKETS = 10_000
#: Shortest and longest run of words, seed of the noise, least words of an eligible document, per cent drawn.
RUNS = (1, 1)
SEED = "2024"
LEAST_WORDS = 20
PERCENT = 10
#: Halvings of a job, and the thresholds it counts for them.
LEVELS = 4
STEPS = 2**LEVELS - 1
#: Buckets of features that a Python worker remembers.
MEMORY = 500_000
#: Rows of a partition of drawn rows.
RANGE_ROWS = 1_000_000

#: A-Z become a-z; digits, a-z and all beyond ASCII stay; everything else parts words.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-case words (A-Z only) in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LETTERS).split()


def features(own: list[bytes], runs: tuple[int, int] = RUNS) -> Counter:
    """How often each run of words occurs, joined by one space."""
    out: Counter = Counter()
    for k in range(runs[0], runs[1] + 1):
        out.update(own if k == 1 else map(b" ".join, zip(*(own[i:] for i in range(k)), strict=False)))
    return out


class Buckets(dict):
    """Bucket by feature; remembers MEMORY features at most."""

    def __init__(self, n: int) -> None:
        super().__init__()
        self.n = n

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        made = self[feature] = zlib.crc32(feature) % self.n
        return made


def bucket_counts(texts: DataFrame, text: str = "text", runs: tuple[int, int] = RUNS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of all features of a table; at most one row a bucket leaves each task."""

    def run(batches):
        known, total = Buckets(buckets), np.zeros(buckets, np.int64)
        for b in batches:
            for i, j in slices(b.column(0)):
                all_of: Counter = Counter()
                for x in b.column(0).slice(i, j - i).to_pylist():
                    all_of.update(features(words(x), runs))
                if all_of:
                    at = np.fromiter((known[f] for f in all_of), np.int64, len(all_of))
                    np.add.at(total, at, np.fromiter(all_of.values(), np.int64, len(all_of)))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], schema=arrow_schema([("bucket", pa.int64()), ("n", pa.int64())]))

    made = texts.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
    return made.groupBy("bucket").agg(F.sum("n").alias("n"))


def _array(counts: DataFrame, buckets: int) -> list[int]:
    out = [0] * buckets
    for r in counts.collect():  # at most one row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: list[int], target: list[int]) -> list[int]:
    """What each bucket adds to a weight: thousandths of the logarithm of the ratio of its smoothed shares."""
    b, s_all, t_all = len(corpus), float(sum(corpus)), float(sum(target))
    return [math.floor(1000 * math.log((t + 1.0) * (s_all + b) / ((s + 1.0) * (t_all + b)))) for s, t in zip(corpus, target, strict=True)]


def _weigher(gain: list[int], runs: tuple[int, int]) -> Callable[[], Callable[[list], list]]:
    def make():
        of = np.array(gain, np.int64)
        known = Buckets(len(gain))

        def run(texts: list) -> list:
            n_words, n_features, weight = [], [], []
            for x in texts:
                own = words(x)
                each = features(own, runs)
                n_words.append(len(own))
                n_features.append(each.total())
                at = np.fromiter((known[f] for f in each), np.int64, len(each))
                weight.append(int(of[at] @ np.fromiter(each.values(), np.int64, len(each))))
            return [n_words, n_features, weight]

        return run

    return make


def noise(doc: Column, seed: str = SEED) -> Column:
    """Gumbel noise in thousandths, by the first 32 bits of a hash of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def weighted(docs: DataFrame, target: DataFrame, doc: str = "doc_id", text: str = "text", runs: tuple[int, int] = RUNS, buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """docs with n_words, n_features, weight and score; target has a column of the same name as text."""
    gain = gains(_array(bucket_counts(docs, text, runs, buckets), buckets), _array(bucket_counts(target, text, runs, buckets), buckets))
    made = map_text(docs, text, _weigher(gain, runs), [("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])
    return made.withColumn("score", F.col("weight") + noise(F.col(f"`{doc}`"), seed))


def kth(rows: DataFrame, value: str, k: int, low: int, high: int) -> tuple[int, int]:
    """(the k-th largest value, number of larger ones) of a written table's integer column that lies in low..high.

    Holds: k rows or more reach low, fewer than k reach end; every job counts for STEPS thresholds between."""
    end, larger = high + 1, 0
    while end - low > 1:
        at = sorted({low + (end - low) * i // (STEPS + 1) for i in range(1, STEPS + 1)} - {low})
        reach = rows.agg(*[F.count_if(F.col(value) >= F.lit(t).cast("long")).alias(f"c{i}") for i, t in enumerate(at)]).collect()[0]  # one row
        for t, n in zip(at, reach, strict=True):
            if n >= k:
                low = t
            else:
                end, larger = t, n
                break
    return low, larger


def _span(rows: DataFrame, value: str) -> tuple[int, int, int]:
    r = rows.agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high")).collect()[0]  # one row
    return r["n"], r["low"], r["high"]


def draw(scored: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS, doc: str = "doc_id") -> DataFrame:
    """scored (of weighted) with rank: 1, 2, 3... for the drawn rows by falling score, ties to smaller ids; null for the others."""
    if "__row" in scored.columns:
        raise ValueError("__row is a name of this operator's own")
    named = scored.withColumn("__id", F.coalesce(F.col(f"`{doc}`").cast("long"), F.lit(-(2**63))))
    # larger keys rank first, so ids and numbers of rows are turned; ~x doesn't overflow
    rows = stored(named.withColumn("__row", F.bitwise_not(F.monotonically_increasing_id())).withColumn("__id", F.bitwise_not("__id")))
    eligible = rows.where(F.col("n_words") >= least)
    total, low, high = _span(eligible, "score")
    k = total * percent // 100
    if k == 0:
        return rows.drop("__id", "__row").withColumn("rank", F.lit(None).cast("long"))
    # the condition of the drawn rows is score > s, or score = s and id > i, or score = s and id = i and row >= r
    keys, at, tied = ("score", "__id", "__row"), [], eligible
    need = k
    for i, key in enumerate(keys):
        if i:
            n, low, high = _span(tied, key)
            if n == need:  # all that tie are drawn
                break
        value, larger = kth(tied, key, need, low, high)
        at.append(value)
        need -= larger
        tied = tied.where(F.col(key) == value)
    drawn = F.lit(True) if len(at) < len(keys) else F.col(keys[-1]) >= at[-1]
    for key, value in reversed(list(zip(keys[: len(at)], at, strict=True))[: len(keys) - 1]):
        drawn = (F.col(key) > value) | ((F.col(key) == value) & drawn)
    drawn = drawn & (F.col("n_words") >= least)
    n = max(k // RANGE_ROWS + 1, int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col(x).desc() for x in keys]
    ranged = rows.where(drawn).repartitionByRange(n, *order).sortWithinPartitions(*order)
    # the place in a partition is in the 33 low bits of this number, the partition in the others
    ranged = stored(ranged.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    sizes = sorted((r["part"], r["n"]) for r in ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # one row a partition
    before, sums = 0, []
    for p, size in sizes:
        sums.append((p, before))
        before += size
    offsets = F.broadcast(scored.sparkSession.createDataFrame(sums, "__part long, __before long"))  # one row a partition
    ranks = ranged.join(offsets, part == F.col("__part")).withColumn("rank", F.col("__before") + F.col("__at").bitwiseAND(2**33 - 1) + 1)
    undrawn = rows.where(~drawn | drawn.isNull()).withColumn("rank", F.lit(None).cast("long"))
    return ranks.select(*undrawn.columns).unionByName(undrawn).drop("__id", "__row")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = weighted(docs, table(spark, sf_dir, "benchmark").select("text")).drop("text")
    return draw(scored).select("doc_id", "n_features", "weight", "score", "rank")


SQL = rf"""
WITH polynomial AS MATERIALIZED (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, _: xor(c >> 1, (c & 1) * 3988292384)) ORDER BY i) AS t
  FROM range(256) AS r(i)
), words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, 0 AS target, row_number() OVER () AS n FROM documents
  UNION ALL
  SELECT NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), 1, 0 FROM benchmark
), each AS MATERIALIZED (
  SELECT f, n, target, count(*) AS c FROM (SELECT unnest(w) AS f, n, target FROM words) GROUP BY ALL
), buckets AS MATERIALIZED (
  SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, octet_length(encode(f)) + 1), lambda i: ('0x' || substr(hex(encode(f)), 2 * i - 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % {BUCKETS} AS bucket
  FROM (SELECT DISTINCT f FROM each), polynomial
), totals AS (
  SELECT coalesce(sum(c) FILTER (target = 0), 0)::DOUBLE AS s_all, coalesce(sum(c) FILTER (target = 1), 0)::DOUBLE AS t_all FROM each
), gain AS MATERIALIZED (
  SELECT bucket, floor(1000 * ln((t + 1) * (s_all + {BUCKETS}) / ((s + 1) * (t_all + {BUCKETS}))))::BIGINT AS g
  FROM (SELECT bucket, coalesce(sum(c) FILTER (target = 0), 0)::DOUBLE AS s, coalesce(sum(c) FILTER (target = 1), 0)::DOUBLE AS t FROM each JOIN buckets USING (f) GROUP BY bucket), totals
), weights AS (
  SELECT n, sum(c * g)::BIGINT AS weight FROM each JOIN buckets USING (f) JOIN gain USING (bucket) WHERE target = 0 GROUP BY n
), scored AS (
  SELECT doc_id, n, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM words LEFT JOIN weights USING (n) WHERE target = 0
), ranked AS (
  SELECT n, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, n) AS r, count(*) OVER () * {PERCENT} // 100 AS k FROM scored WHERE n_features >= {LEAST_WORDS}
)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= k THEN r END AS rank FROM scored LEFT JOIN ranked USING (n)
"""
