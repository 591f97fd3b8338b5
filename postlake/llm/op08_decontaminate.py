"""Benchmark decontamination with a broadcast hash set of normalised n-grams; DataFrame code only.

Words are runs of ASCII digits and letters (A-Z lower-cased) and of any other characters beyond
ASCII. A window is WINDOW consecutive words of a benchmark item; a shorter item with words is one
window. The hashes of all windows are shipped to the executors with the plan as a hash set; every
window of every document is looked up in it, and what is found is verified by joining on the
words themselves. Only windows that hit leave their row, so texts are never shuffled.

Up to MAX_SET distinct windows, which are counted first, the hashes are literals of the plan and each
window is tested in its row. More are broadcast as a table of hashes, in blocks of MAX_HASHES: every
block scans the documents once, and what doesn't hit is dropped before any shuffle. The words (and
ids of items) are joined to hits only, by broadcast if both are within MAX_SET. All ways give the same result.

Edge cases: a null text has no words (0 words, no hits); a null item has no windows. Rows that
repeat both id and text count as one document. An empty benchmark hits nothing. Items whose ids
repeat count once.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.llm.common import stored, table

#: Words of a window.
WINDOW = 10
#: Most distinct windows (about 100 bytes each in an executor) that are broadcast.
MAX_SET = 100_000
#: Most hashes of windows in a broadcast table (8 bytes each, some 100 MB in an executor).
MAX_HASHES = 4_000_000
#: Fixed value of the contract: what separates words, after A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def words_sql(column: str) -> str:
    """SQL of the array of normalised words of a column: A-Z to a-z, letters beyond ASCII as they are;
    empty for null."""
    text = f"coalesce({column}, '')"
    other = text
    for c in string.ascii_uppercase:
        other = f"replace({other}, '{c}', '{c.lower()}')"
    return f"array_remove(split(CASE WHEN length({text}) = octet_length({text}) THEN lower({text}) ELSE {other} END, {quoted(BETWEEN)}), '')"


def words(column: str) -> Column:
    return F.expr(words_sql(f"`{column}`"))


def windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(n, key, items): distinct windows, their number of words, the ids (as strings) of the items that have them."""
    w = benchmark.select(F.col(item).cast("string").alias("item"), words(text).alias("w")).where(F.size("w") > 0)
    w = w.withColumn("n", F.least(F.size("w"), F.lit(window)))
    w = w.select("item", "n", F.explode(F.expr("transform(sequence(1, size(w) - n + 1), i -> array_join(slice(w, i, n), ' '))")).alias("key"))
    return w.groupBy("n", "key").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _found(w: str, sizes: list[int], hashes: dict[int, list[int]]) -> Column:
    """Array of (i, n, key) of the windows of the array column w that are in the hash sets."""
    parts = []
    for n in sizes:
        at = f"CASE WHEN size({w}) >= {n} THEN filter(sequence(1, size({w}) - {n} + 1), i -> xxhash64(slice({w}, i, {n})) IN ({', '.join(f'{h}L' for h in hashes[n])})) ELSE array() END"
        parts.append(f"transform({at}, i -> named_struct('i', i, 'n', {n}, 'key', array_join(slice({w}, i, {n}), ' ')))")
    return F.expr(f"concat({', '.join(parts)})" if parts else "cast(array() as array<struct<i:int,n:int,key:string>>)")


def _sets(win: DataFrame, max_set: int) -> tuple[list[int], dict[int, list[int]] | None, bool]:
    """Sizes of the windows, their hashes by size if there are max_set at most, and whether the ids of
    their items are that few, too."""
    count = {r["n"]: (r["count"], r["ids"]) for r in win.groupBy("n").agg(F.count("*").alias("count"), F.sum(F.size("items")).alias("ids")).collect()}
    sizes = sorted(count)
    small = sum(ids for _, ids in count.values()) <= max_set
    if sum(n for n, _ in count.values()) > max_set:
        return sizes, None, False
    hashes: dict[int, list[int]] = {n: [] for n in sizes}
    for r in win.select("n", _hash("key").alias("h")).collect():  # max_set rows at most
        hashes[r["n"]].append(r["h"])
    return sizes, hashes, small


def _hash(key: str) -> Column:
    return F.xxhash64(F.split(key, " "))


def _hits(d: DataFrame, win: DataFrame, sizes: list[int], max_hashes: int) -> DataFrame:
    """d (with the words w, and what names a row) by window that is in the benchmark: i, n, key and items
    instead of w. The hashes of the benchmark's windows are broadcast, in as many blocks as it takes."""
    win = stored(win)
    own = [c for c in d.columns if c != "w"]
    looks = [f"transform(CASE WHEN size(w) >= {n} THEN sequence(1, size(w) - {n} + 1) ELSE array() END, i -> named_struct('i', i, 'n', {n}, 'h', xxhash64(slice(w, i, {n})), 'key', array_join(slice(w, i, {n}), ' ')))" for n in sizes]
    rows = d.select(*own, F.explode(F.expr(f"concat({', '.join(looks)})")).alias("f")).select(*own, "f.*")
    hashes = stored(win.select(_hash("key").alias("wh")).distinct())
    blocks = -(-hashes.count() // max_hashes)
    out = None
    for b in range(blocks):
        part = rows.join(F.broadcast(hashes.where(F.pmod("wh", F.lit(blocks)) == b)), F.col("h") == F.col("wh"), "left_semi").drop("h")
        out = part if out is None else out.union(part)
    own_win = win.select(F.col("n").alias("wn"), F.col("key").alias("wk"), "items")
    return out.join(own_win, (F.col("n") == F.col("wn")) & (F.col("key") == F.col("wk"))).drop("wn")


def scan(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, max_set: int = MAX_SET, max_hashes: int = MAX_HASHES) -> DataFrame:
    """One row per distinct (id, text): doc, text_hash, n_words, n_hit, n_items, items, contaminated."""
    win = windows(benchmark, item, item_text, window)
    sizes, hashes, small = _sets(win, max_set)
    d = docs.select(F.col(doc).alias("doc"), F.xxhash64(text).alias("text_hash"), words(text).alias("w"))
    if small or not sizes:
        d = d.select("doc", "text_hash", F.size("w").cast("long").alias("n_words"), _found("w", sizes, hashes or {}).alias("found"))
        d = d.select("doc", "text_hash", "n_words", F.explode_outer("found").alias("f")).select("doc", "text_hash", "n_words", "f.i", "f.n", "f.key")
        own = win.select(F.col("n").alias("wn"), F.col("key").alias("wk"), "items")
        hit = d.join(F.broadcast(own), (F.col("n") == F.col("wn")) & (F.col("key") == F.col("wk")), "left")
    else:
        rows = d.select("doc", "text_hash", F.size("w").cast("long").alias("n_words"))
        none = [F.lit(None).cast(t).alias(c) for c, t in (("i", "int"), ("n", "int"), ("wk", "string"), ("items", "array<string>"))]
        hit = _hits(d, win, sizes, max_hashes)
        hit = hit.select("doc", "text_hash", F.lit(None).cast("long").alias("n_words"), "i", "n", "wk", "items").unionByName(rows.select("*", *none))
    per = hit.groupBy("doc", "text_hash").agg(
        F.max("n_words").alias("n_words"),
        F.collect_set(F.when(F.col("wk").isNotNull(), F.struct("i", "n"))).alias("at"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    at = F.array_distinct(F.flatten(F.transform("at", lambda h: F.sequence(h["i"], h["i"] + h["n"] - 1))))
    return per.select(F.col("doc").alias(doc), "text_hash", "n_words", F.size(at).cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", (F.size("at") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, max_set: int = MAX_SET, max_hashes: int = MAX_HASHES) -> DataFrame:
    """The rows of docs without any benchmark window, all columns as they are."""
    win = windows(benchmark, item, item_text, window)
    sizes, hashes, _ = _sets(win, max_set)
    if not sizes:
        return docs
    if hashes is not None:
        keys: dict[int, list[str]] = {n: [] for n in sizes}
        for r in win.select("n", "key").collect():  # max_set rows at most
            keys[r["n"]].append(r["key"])
        # the words are bound as a variable, so that a filter, wherever it moves, makes them once a row
        looks = [f"exists(filter(CASE WHEN size(w) >= {n} THEN sequence(1, size(w) - {n} + 1) ELSE array() END, i -> xxhash64(slice(w, i, {n})) IN ({', '.join(f'{h}L' for h in hashes[n])})), i -> array_join(slice(w, i, {n}), ' ') IN ({', '.join(quoted(k) for k in keys[n])}))" for n in sizes]
        return docs.where(F.expr(f"NOT exists(array({words_sql(f'`{text}`')}), w -> {' OR '.join(looks)})"))
    d = docs.select(F.md5(text).alias("m"), words(text).alias("w"))
    bad = _hits(d, win, sizes, max_hashes).select("m").distinct()
    return docs.join(bad, F.md5(docs[text]) == bad["m"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


SQL = rf"""
WITH item AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (
    SELECT item, w, least(len(w), {WINDOW}) AS n, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM item WHERE len(w) > 0)
), doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), spot AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM (
    SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
), hit AS (
  SELECT s.doc_id, s.i, s.n, x.item FROM spot s JOIN win x ON s.n = x.n AND s.k = x.k
), pos AS (
  SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
