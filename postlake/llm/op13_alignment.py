"""Alignment of two tokenizers by merge-path partitioning.

Every text is encoded by two tokenizers, A and B, whose tokens have the same bytes altogether. The
places where tokens end form two sorted lists, A's and B's, those of all texts of a batch one behind
the other. Binary searches on diagonals of the merge of both lists find where the merge stands after
so many ends, so it falls into independent pieces of PIECE ends each, whatever texts they belong to: a
text of millions of tokens is many pieces, and many short texts are one. A piece merges its ends by
itself and emits one link for each distinct end: the A token and the B token that meet there overlap,
and every overlap of two tokens has its own last byte. Where an A end and a B end are equal, all
tokens up to there form a group. If such a pair falls on both sides of a border, the right piece reports
it, and stitching drops its second link and cuts the group in the left piece.

Pair counts: a pass stores each document's distinct links with their numbers. The documents of a
pair are counted (partial counts first), and the most frequent HEAD pairs are sent to all tasks, where
documents sum them up without a shuffle; no other pair can be hot. The other pairs of documents are
joined with their counts by key, and their sums added.

Tokens by segment: a single space between a character that isn't a space and one that isn't white
space always begins a token of both vocabularies, which is checked when they are loaded, so the texts'
segments are encoded by the library once and remembered, MEMORY of them and LONGEST characters each at
most. Segments only save encoding: groups and links come from the pieces.

Edge cases: null and empty texts, and those whose bytes A or B don't give back (U+2581 in a text), have
zeros and an empty digest. Repeated rows count as documents of their own, null ids too. An empty table
gives an empty table. Other columns of docs pass; those named like results are replaced.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlake.llm.common import arrow_schema, claim, droppable, give_back, map_text, stored, table
from postlake.llm.op02_tokens import load, vocabulary_path
from postlake.llm.op04_bpe import byte_letters

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Ends of tokens (of A and B together) in a piece of the merge.
PIECE = 65_536
#: Pairs whose counts every task gets (some 13 MB).
HEAD = 500_000
#: Segments remembered in a Python worker, and the characters of the longest.
MEMORY = 300_000
LONGEST = 64
#: Bits of an id in a pair's key.
BITS = 24
SPACE_MARK = "▁"

FIELDS = [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))]


# merge path


def crossings(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """For each diagonal d how many of the first d of the merge of sorted a and b are a's (a first in ties), by binary search."""
    low, high = np.maximum(0, diagonals - len(b)), np.minimum(diagonals, len(a))
    while (open_ := low < high).any():
        mid = (low + high) // 2
        # a[mid] is among the first d, unless b's d - 1 - mid-th comes before it
        take = open_ & (a[np.minimum(mid, len(a) - 1)] <= b[np.clip(diagonals - 1 - mid, 0, len(b) - 1)])
        low = np.where(take, mid + 1, low)
        high = np.where(open_ & ~take, mid, high)
    return low


class Piece(NamedTuple):
    """Links of a piece: numbers of A and B tokens, whether a group ends there; tied: the first end, a B end, equals the last one of the piece before."""

    a: np.ndarray
    b: np.ndarray
    cut: np.ndarray
    tied: bool


def piece(a: np.ndarray, b: np.ndarray, first_a: int, first_b: int, before: int) -> Piece:
    """The piece of A ends a and B ends b, the first of which have these numbers; before: the last end of the piece before."""
    ends = np.concatenate([a, b])
    order = np.argsort(ends, kind="stable")  # A first in ties
    ends, of_a = ends[order], order < len(a)
    tied = bool(len(ends)) and ends[0] == before and not of_a[0]
    double = np.concatenate([[tied], ends[1:] == ends[:-1]]) if len(ends) else np.zeros(0, bool)
    # the token that ends here or next: ends of its side before this place, less the A end of a tie
    at_a = first_a + np.cumsum(of_a) - of_a
    at_b = first_b + np.cumsum(~of_a) - ~of_a
    cut = np.append(double[1:], False)[~double]
    return Piece(at_a[~double], at_b[~double], cut, tied)


def merged(a: np.ndarray, b: np.ndarray, size: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(A token, B token, whether a group ends there) of all links, from the pieces of the merge of both lists of ends."""
    total = len(a) + len(b)
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    at = np.append(np.arange(0, total, size), total)
    i = crossings(a, b, at)
    j = at - i
    made: list[Piece] = []
    for k in range(len(at) - 1):
        before = max(a[i[k] - 1] if i[k] else -1, b[j[k] - 1] if j[k] else -1)
        made.append(piece(a[i[k] : i[k + 1]], b[j[k] : j[k + 1]], i[k], j[k], before))
    for left, right in zip(made, made[1:], strict=False):  # stitch
        if right.tied:
            left.cut[-1] = True
    return np.concatenate([p.a for p in made]), np.concatenate([p.b for p in made]), np.concatenate([p.cut for p in made])


# tokens


def piece_bytes(piece: str) -> bytes:
    """Bytes of a sentencepiece piece."""
    if re.fullmatch("<0x[0-9A-F]{2}>", piece):
        return bytes([int(piece[3:5], 16)])
    return piece.replace(SPACE_MARK, " ").encode()


class Pair:
    """Both tokenizers, and what is remembered of segments."""

    def __init__(self, a: str, b: str) -> None:
        import sentencepiece

        self.a = load(a)
        self.a.encode_special_tokens = True  # their strings in texts are plain text
        with open(a, encoding="utf-8") as f:
            spec = json.load(f)
        if (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError(f"{a}: only byte-level vocabularies without normaliser or prefix are known here")
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        letters = byte_letters()
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for s, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in s) if all(c in letters for c in s) else s.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [piece_bytes(p) for p in pieces]
        if any(re.search(f"[^{SPACE_MARK}]{SPACE_MARK}", p) for p in pieces) or self.b.encode("a  b", out_type=str)[:2] != [f"{SPACE_MARK}a", SPACE_MARK]:
            raise ValueError(f"{b}: tokens across words, or spaces that are dropped, are not known here")
        self.a_size = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        # decimal ids with what may follow them: in A a comma or the bar, in B a comma or the semicolon
        self.names = np.array([f"{i}{c}" for c in ",|" for i in range(len(self.a_bytes))] + [f"{i}{c}" for c in ",;" for i in range(len(self.b_bytes))], dtype=object)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.of_a, self.of_b = _Lists(), _Lists()
        self.right = bytearray()

    def learn(self, segments: list[str]) -> None:
        """Encode segments, each of which begins with a space, and number them on."""
        for at in range(0, len(segments), 2000):
            some = segments[at : at + 2000]
            for s, e, ids in zip(some, self.a.encode_batch(some, add_special_tokens=False), self.b.encode([x[1:] for x in some], num_threads=1), strict=True):
                raw = s.encode("utf-8", "surrogatepass")
                self.of_a.append(e.ids)
                self.of_b.append(ids)
                self.known[s] = len(self.right)
                self.right.append(b"".join([self.a_bytes[i] for i in e.ids]) == raw and b"".join([self.b_bytes[i] for i in ids]) == raw)

    def numbers(self, texts: list[list[str]]) -> np.ndarray:
        """Numbers of the segments of all texts."""
        if len(self.right) > MEMORY or len(self.of_a.ids) > MEMORY * LONGEST:
            self.forget()
        known = self.known
        new = list(dict.fromkeys(s for own in texts for s in own if s not in known))
        self.learn(new)
        out = np.fromiter((known[s] for own in texts for s in own), np.int64, sum(map(len, texts)))
        for s in new:
            if len(s) > LONGEST:
                del known[s]
        return out


class _Lists:
    """Lists of ids one behind the other."""

    def __init__(self) -> None:
        self.ids, self.ends = array("i"), array("q", [0])

    def append(self, ids: list[int]) -> None:
        self.ids.extend(ids)
        self.ends.append(len(self.ids))

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of these lists one behind the other, how many each has)."""
        if not len(numbers):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ends, ids = np.frombuffer(self.ends, np.int64), np.frombuffer(self.ids, np.intc)
        begin = ends[numbers]
        size = ends[numbers + 1] - begin
        return ids[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - begin, size)].astype(np.int64), size


def segments(text: str) -> list[str]:
    """A space and the text, cut before each space that has no space before and no white space behind it."""
    cut = re.split(r"(?<! ) (?=\S)", " " + text)
    first = cut[0]
    return ([first] if first else []) + [" " + x for x in cut[1:]]


_PAIRS: dict[tuple[str, str], Pair] = {}
droppable(_PAIRS.clear)


def _pair(a: str, b: str) -> Pair:
    if (a, b) not in _PAIRS:
        _PAIRS[a, b] = Pair(a, b)
    return _PAIRS[a, b]


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the ranges of values that end at these places."""
    total = np.append(0, np.cumsum(values))
    return np.diff(np.append(0, total[ends]))


def aligner(a: str, b: str, size: int = PIECE) -> Callable[[], Callable[[list], list]]:
    def make():
        pair = _pair(a, b)

        def run(texts: list) -> list:
            n = len(texts)
            own = [segments(x) if x else [] for x in texts]
            number = pair.numbers(own)
            ends = np.cumsum(np.array([len(x) for x in own], np.int64))
            wrong = _sums(1 - np.frombuffer(bytes(pair.right), np.uint8).astype(np.int64)[number], ends) > 0
            if wrong.any():  # these texts have no tokens
                counts = np.diff(np.append(0, ends))
                number = number[~np.repeat(wrong, counts)]
                ends = np.cumsum(np.where(wrong, 0, counts))
            ids_a, many_a = pair.of_a.take(number)
            ids_b, many_b = pair.of_b.take(number)
            n_a, n_b = _sums(many_a, ends), _sums(many_b, ends)
            link_a, link_b, cut = merged(np.cumsum(pair.a_size[ids_a]), np.cumsum(pair.b_size[ids_b]), size)
            # the text of each token, link and group; texts end with a group
            text_of_a = np.repeat(np.arange(n), n_a)
            link_text = text_of_a[link_a]
            n_links = np.bincount(link_text, minlength=n)
            n_groups = np.bincount(link_text[cut], minlength=n)
            return [n_a, n_b, n_groups, n_links, _digests(pair, ids_a, ids_b, link_a, link_b, cut, n_a, n_b), *_distinct(link_text, ids_a[link_a], ids_b[link_b], n)]

        return run

    return make


def _digests(pair: Pair, ids_a, ids_b, link_a, link_b, cut, n_a, n_b) -> list[str]:
    """SHA-256 of each text's groups."""
    last_a, last_b = link_a[cut], link_b[cut]  # last tokens of the groups
    group_a = np.repeat(np.arange(len(last_a)), np.diff(np.append(-1, last_a)))
    group_b = np.repeat(np.arange(len(last_b)), np.diff(np.append(-1, last_b)))
    which = np.empty(len(ids_a) + len(ids_b), np.int64)
    # an A token stands behind the B tokens of earlier groups, a B token behind the A tokens up to its own
    bar, semicolon = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    bar[last_a], semicolon[last_b] = 1, 1
    which[np.arange(len(ids_a)) + np.append(0, last_b + 1)[group_a]] = ids_a + bar * len(pair.a_bytes)
    which[np.arange(len(ids_b)) + (last_a + 1)[group_b]] = 2 * len(pair.a_bytes) + ids_b + semicolon * len(pair.b_bytes)
    out, at = [], 0
    for k in (n_a + n_b).tolist():
        out.append(hashlib.sha256("".join(pair.names[which[at : at + k]].tolist())[:-1].encode()).hexdigest() if k else "")
        at += k
    return out


def _distinct(text: np.ndarray, a: np.ndarray, b: np.ndarray, n: int) -> tuple[list, list]:
    """Distinct pair keys of each text, and how often each is linked there."""
    key = (a << BITS) | b
    order = np.lexsort((key, text)) if len(key) else np.zeros(0, np.int64)
    key, text = key[order], text[order]
    first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (text[1:] != text[:-1]))) if len(key) else order
    times = np.diff(np.append(first, len(key))).astype(np.int32)
    ends = np.cumsum(np.bincount(text[first], minlength=n))
    key = key[first]
    cut = lambda x: np.split(x, ends[:-1]) if n else []
    return cut(key), cut(times)


def aligned(docs: DataFrame, text: str = "text", a: str | None = None, b: str | None = None, size: int = PIECE) -> DataFrame:
    """docs with n_a, n_b, n_groups, n_links, groups_sha256 and the distinct links: pairs (A id << BITS | B id) and times."""
    return map_text(docs, text, aligner(a or vocabulary_path(A), b or vocabulary_path(B), size), FIELDS)


def groups(docs: DataFrame, text: str = "text", a: str | None = None, b: str | None = None) -> DataFrame:
    """docs with groups: the array of groups as texts `a1,a2|b1`, in order (null without tokens)."""
    pa_, pb_ = a or vocabulary_path(A), b or vocabulary_path(B)

    def make():
        pair = _pair(pa_, pb_)

        def run(texts: list) -> list:
            out = []
            for x in texts:
                number = pair.numbers([segments(x)]) if x else np.zeros(0, np.int64)
                if not x or not all(pair.right[i] for i in number):
                    out.append(None)
                    continue
                ids_a, ids_b = pair.of_a.take(number)[0], pair.of_b.take(number)[0]
                link_a, link_b, cut = merged(np.cumsum(pair.a_size[ids_a]), np.cumsum(pair.b_size[ids_b]))
                begin_a = begin_b = 0
                own = []
                for i, j in zip((link_a[cut] + 1).tolist(), (link_b[cut] + 1).tolist(), strict=True):
                    own.append(f"{','.join(map(str, ids_a[begin_a:i].tolist()))}|{','.join(map(str, ids_b[begin_b:j].tolist()))}")
                    begin_a, begin_b = i, j
                out.append(";".join(own))
            return [out]

        return run

    return map_text(docs, text, make, [("__groups", pa.string())]).withColumn("groups", F.split("__groups", ";")).drop("__groups")


# counts over the corpus


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best) of rows with pairs: the documents of each pair, and whether no pair of its A id has more."""
    n = stored(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")))
    a = F.shiftright("pair", BITS)
    most = n.groupBy(a.alias("__a")).agg(F.max("n").alias("__most"))  # one row an id of A
    return n.join(most, a == F.col("__a")).select("pair", "n", (F.col("n") == F.col("__most")).alias("best"))


def _summed(rows: DataFrame, head: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """rows with n_best and count_sum, sums over the links whose pairs are in head; pairs and times keep the other links."""
    sent = rows.sparkSession.sparkContext.broadcast(head)  # HEAD pairs at most
    passed = [c for c in rows.columns if c not in ("pairs", "times")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__)
        key, n, best = sent.value
        for b in batches:
            pairs, times = b.column("pairs").flatten().to_numpy(), b.column("times").flatten().to_numpy()
            ends = np.cumsum(np.diff(b.column("pairs").offsets.to_numpy()), dtype=np.int64)
            at = np.searchsorted(key, pairs)
            at[at == len(key)] = 0
            here = key[at] == pairs if len(key) else np.zeros(len(pairs), bool)
            count, top = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
            count[here] = n[at[here]] * times[here]
            top[here] = best[at[here]] * times[here]
            left = np.append(0, np.cumsum(_sums(~here, ends))).astype(np.int32)
            rest = [pa.ListArray.from_arrays(pa.array(left), pa.array(x[~here])) for x in (pairs, times)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in passed), pa.array(_sums(top, ends)), pa.array(_sums(count, ends)), *rest], names=[*passed, "n_best", "count_sum", "pairs", "times"])
            give_back()

    own = T.StructType([*(rows.schema[c] for c in passed), T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType()), T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.IntegerType()))])
    return rows.select(*[f"`{c}`" for c in passed], "pairs", "times").mapInArrow(run, own)


def scored(rows: DataFrame, head: int = HEAD) -> DataFrame:
    """rows (written, of aligned, with numbers __row) with n_best and count_sum instead of pairs and times."""
    counts = stored(pair_counts(rows))
    first = counts.orderBy(F.col("n").desc(), "pair").limit(head).toArrow()  # head rows
    order = np.argsort(first.column("pair").to_numpy())
    out = _summed(rows, tuple(first.column(c).to_numpy()[order] for c in ("pair", "n", "best")))
    if counts.count() == first.num_rows:
        return out.drop("pairs", "times")
    out = stored(out)
    rest = counts.join(F.broadcast(rows.sparkSession.createDataFrame(first.select(["pair"]))), "pair", "left_anti")  # head rows
    links = out.select("__row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("__row", F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"))
    more = links.join(rest, "pair").groupBy("__row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("__best"), F.sum(F.col("n") * F.col("times")).alias("__sum"))
    both = out.drop("pairs", "times").join(more, "__row", "left")
    for name, add in (("n_best", "__best"), ("count_sum", "__sum")):
        both = both.withColumn(name, F.col(name) + F.coalesce(add, F.lit(0)))
    return both.drop("__best", "__sum")


def alignment(docs: DataFrame, text: str = "text", a: str | None = None, b: str | None = None, size: int = PIECE, head: int = HEAD) -> DataFrame:
    """docs without text, with n_a, n_b, n_groups, n_links, groups_sha256, n_best and count_sum."""
    rows = stored(aligned(docs.drop("n_best", "count_sum"), text, a, b, size).drop(text).withColumn("__row", F.monotonically_increasing_id()))
    return scored(rows, head).drop("__row")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = alignment(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
