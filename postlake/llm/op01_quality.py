"""Quality rules from a suffix array over the words of each text.

A suffix array with its LCP array is built for a slice of documents at once (prefix doubling on
groups that are still tied). The deepest LCP interval of a suffix has the value max(LCP before,
LCP after); its span is the longest repeated substring that starts there, and every maximal
repeat of the text is the span of some suffix. The union of the spans of at least MIN_REPEAT
words is the covered part. A text is kept if the covered part and the longest repeat are within
their limits, and the base rules hold.

Edge cases: null and empty texts have no words, so they fail the base rule of 50 words and are not
kept. Words compare as bytes, case and all. Repeated rows give repeated results. Documents with
one hot source or one very long text need nothing special: no shuffle happens, and the work for
a text of n words is O(n log n) in one task.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.llm.common import map_text, table

#: Repeats of fewer words don't count as covered.
MIN_REPEAT = 8
#: Largest part of the words, in hundredths, that repeats may cover.
MAX_COVERED = 45
#: Longest repeat, in words, that a text may hold.
MAX_REPEAT = 100
#: Fixed values of the contract: white space between words, symbols, base rules.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
BASE_WORDS = 50
BASE_REPEAT = 50
BASE_WINDOW = 3

FIELDS = [
    ("n_words", pa.int64()),
    ("word_chars", pa.int64()),
    ("n_symbols", pa.int64()),
    ("n_dup_lines", pa.int64()),
    ("n_repeat_words", pa.int64()),
    ("n_covered", pa.int64()),
    ("longest_repeat", pa.int64()),
    ("base_failed", pa.bool_()),
    ("kept", pa.bool_()),
]


def repeat_lengths(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each word position the length of the longest substring that starts there and occurs
    again in the same document; words: ids, doc: non-decreasing document numbers.

    The suffix array is sorted by prefix doubling; of each round only the suffixes whose prefix
    is still shared are sorted again. The ranks of every round stay, and the LCP of neighbours is
    read from them, largest power first.
    """
    n = len(words)
    best = np.zeros(n, np.int64)
    if not n:
        return best
    last = np.searchsorted(doc, doc, side="right")  # end of each position's document
    key = doc.astype(np.int64) * (int(words.max()) + 1) + words
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)

    def regroup(positions: np.ndarray, keys: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Rank of positions sorted by keys: index in the suffix array of the first equal one."""
        first = np.empty(len(keys), bool)
        first[:1] = True
        np.not_equal(keys[1:], keys[:-1], out=first[1:])
        rank[positions] = starts[first][np.cumsum(first) - 1]
        return first

    first = regroup(order, key[order], np.arange(n))
    suffixes = order
    levels = [rank.copy()]
    k = 1
    slots = np.arange(n)
    active = ~(first & np.append(first[1:], True))
    while active.any():
        slots = slots[active]
        positions = suffixes[slots]
        after = positions + k
        inside = after < last[positions]
        second = np.where(inside, rank[np.minimum(after, n - 1)] + 1, 0)
        # a suffix that ends here is equal to no other; its own position keeps it apart
        second = np.where(inside, second + n, last[positions] - positions - k)
        keys = rank[positions] * np.int64(3 * n + 2) + second
        by = np.argsort(keys, kind="stable")
        suffixes[slots] = positions[by]
        keys = keys[by]
        first = regroup(positions[by], keys, slots)
        k *= 2
        active = ~(first & np.append(first[1:], True))
        levels.append(rank.copy())
    a, b = suffixes[:-1].copy(), suffixes[1:].copy()
    lcp = np.zeros(n + 1, np.int64)
    live = np.flatnonzero(levels[0][a] == levels[0][b])
    x, y, got = a[live], b[live], np.zeros(len(live), np.int64)
    for i in range(len(levels) - 1, -1, -1):
        step = 1 << i
        ok = (x < last[a[live]]) & (y < last[b[live]])
        same = ok & (levels[i][np.minimum(x, n - 1)] == levels[i][np.minimum(y, n - 1)])
        got[same] += step
        x[same] += step
        y[same] += step
    lcp[live + 1] = got
    best[suffixes] = np.maximum(lcp[:-1], lcp[1:])
    return best


def covered(lengths: np.ndarray, least: int) -> np.ndarray:
    """Which positions lie in the span of a repeat of at least so many words."""
    n = len(lengths)
    at = np.flatnonzero(lengths >= least)
    edge = np.bincount(at, minlength=n + 1) - np.bincount(at + lengths[at], minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def measure(texts: list) -> list:
    """The columns of FIELDS for a list of texts."""
    split = [(x or "").encode("utf-8", "surrogatepass").split() for x in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    ids = defaultdict(count().__next__)
    flat = np.fromiter((ids[w] for words in split for w in words), np.int64, int(sizes.sum()))
    doc = np.repeat(np.arange(len(texts)), sizes)
    lengths = repeat_lengths(flat, doc)
    sums = lambda x: np.bincount(doc, x, minlength=len(texts)).astype(np.int64)
    repeated, inside = sums(covered(lengths, BASE_WINDOW)), sums(covered(lengths, MIN_REPEAT))
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, doc, lengths)
    chars, symbols, dups = [], [], []
    for x in texts:
        x = x or ""
        chars.append(len(x) - sum(map(x.count, SPACES)))
        symbols.append(sum(map(x.count, SYMBOLS)))
        lines = Counter(x.split("\n"))
        dups.append(sum(v - 1 for line, v in lines.items() if v > 1 and line.strip(SPACES)))
    failed = (sizes < BASE_WORDS) | (100 * repeated > BASE_REPEAT * sizes)
    kept = ~failed & (100 * inside <= MAX_COVERED * sizes) & (longest <= MAX_REPEAT)
    return [sizes, chars, symbols, dups, repeated, inside, longest, failed, kept]


def quality_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns of FIELDS; a column of docs of such a name is replaced."""
    return map_text(docs, text, lambda: measure, FIELDS)


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that pass, with their own columns alone."""
    names = [n for n, _ in FIELDS]
    clash = {c: f"__own_{c}" for c in docs.columns if c in names}
    out = quality_rules(docs.withColumnsRenamed(clash), text).where("kept").drop(*names)
    return out.withColumnsRenamed({v: k for k, v in clash.items()}).select(*[f"`{c}`" for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs).select("doc_id", *[n for n, _ in FIELDS if n != "longest_repeat"], (F.col("longest_repeat") > MAX_REPEAT).alias("over_longest"))


SQL = rf"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), spot AS (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words
), windows AS (
  SELECT doc_id, i,
    CASE WHEN i + 2 <= len(w) THEN hash(w[i:i + 2]) END AS w3,
    CASE WHEN i + {MIN_REPEAT - 1} <= len(w) THEN hash(w[i:i + {MIN_REPEAT - 1}]) END AS wm,
    CASE WHEN i + {MAX_REPEAT} <= len(w) THEN hash(w[i:i + {MAX_REPEAT}]) END AS wl
  FROM spot
), seen AS (
  SELECT doc_id, i,
    w3 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, w3) > 1 AS r3,
    wm IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, wm) > 1 AS rm,
    wl IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, wl) > 1 AS rl
  FROM windows
), spread AS (
  SELECT doc_id,
    max(r3::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS 2 PRECEDING) AS c3,
    max(rm::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS {MIN_REPEAT - 1} PRECEDING) AS cm,
    rl::INT AS rl
  FROM seen
), sums AS (
  SELECT doc_id, sum(c3)::BIGINT AS n_repeat_words, sum(cm)::BIGINT AS n_covered, max(rl) > 0 AS over_longest
  FROM spread GROUP BY doc_id
), dup AS (
  SELECT doc_id, sum(n - 1)::BIGINT AS n_dup_lines FROM (
    SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line) GROUP BY doc_id
), base AS (
  SELECT d.doc_id, len(w.w)::BIGINT AS n_words,
    length(regexp_replace(coalesce(d.text, ''), '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(coalesce(d.text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(u.n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(s.n_repeat_words, 0)::BIGINT AS n_repeat_words,
    coalesce(s.n_covered, 0)::BIGINT AS n_covered, coalesce(s.over_longest, false) AS over_longest
  FROM documents d JOIN words w USING (doc_id) LEFT JOIN sums s USING (doc_id) LEFT JOIN dup u USING (doc_id)
)
SELECT *, n_words < {BASE_WORDS} OR 100 * n_repeat_words > {BASE_REPEAT} * n_words AS base_failed,
  NOT (n_words < {BASE_WORDS} OR 100 * n_repeat_words > {BASE_REPEAT} * n_words)
    AND 100 * n_covered <= {MAX_COVERED} * n_words AND NOT over_longest AS kept
FROM base
"""
