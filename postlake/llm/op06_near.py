"""Near-duplicate classes by ProbMinHash signatures, banding and verification.

The weights of a text are the counts of its shingles of SHINGLE words (lower-cased, between white
space; a shorter text with words is one shingle). Every shingle starts a Poisson process whose
rate is its weight; each arrival falls on one of REGISTERS registers, and a register keeps the
shingle that arrived first. Shingles whose next arrival comes after the last register has been
filled stop early. Two texts agree in a register with their probability Jaccard similarity.

Signatures are cut into bands of ROWS registers. In each bucket of a band every text is verified
against the bucket's most central one, that which meets the most texts over all bands (a star,
not all pairs). Where the links so far leave a bucket in several components, its texts are
compared across components by a prefix filter: in a common order, rare shingles first, texts that
reach the threshold share a shingle before which neither has too much weight. So nothing is lost
by the stars, and few pairs are verified in vain. Links are texts whose exact probability Jaccard
similarity is THRESHOLD or more; a class is a connected component. A pair at the threshold shares
no band with probability 6e-5.

Equal texts are one node from the start (128-bit digest) and need no verification. Counts and
extremes are combined before every shuffle; rows of hot digests, buckets and classes are not shuffled
by them (see hot_join). Texts are shuffled only if their digest is in a bitmap of the wanted ones, whose
size follows their number up to a bound. Nothing else is collected but counts.

Edge cases: a null text is alone in its class; texts without words are linked to equal texts only. A null id
gets the class of its text, whose name is the smallest id there (null if there is none). Rows
are neither merged nor dropped: there is one row for each row of the input.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlake.llm.common import give_back, map_text, slices, stored, table
from postlake.llm.components import components

#: Words of a shingle, least similarity of a link.
SHINGLE = 5
THRESHOLD = 0.8
#: What sums of floats may lack, here and in the bounds; ratios of plain sets of up to 2e8 shingles
#: differ from the threshold by more.
ROUNDING = 1e-9
#: Bands of ROWS registers; a band's key is a hash of them.
BANDS = 32
ROWS = 6
REGISTERS = BANDS * ROWS

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
FIELDS = [("digest", pa.binary()), ("bands", pa.list_(pa.int64()))]
#: A key with more than one HOT-th of all rows is hot; so there are HOT of them at most.
HOT = 2000
#: The bitmap of wanted digests that each task gets has BITS_EACH bits for each, rounded up to a power of
#: two, of 2 ** FEWEST_BITS to 2 ** MOST_BITS bits (16 MB). Beyond some 10 ** 8 wanted digests it is full,
#: and all texts are shuffled; a cluster with the memory for it may raise MOST_BITS (32: 512 MB).
BITS_EACH, FEWEST_BITS, MOST_BITS = 8, 16, 27
#: Slots of the table of shingle frequencies that each task gets (8 MB).
SLOTS = 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x + _M1
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def shingles(texts: list, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash of 48 bits, weight) of the distinct shingles of each of up to 65,536 texts,
    sorted by document and hash."""
    import xxhash

    split = [(x or "").lower().split() for x in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    n = int(sizes.sum())
    ids = defaultdict(count().__next__)
    flat = np.fromiter((ids[w] for words in split for w in words), np.int64, n)
    word = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in ids), np.uint64, len(ids))[flat]
    doc = np.repeat(np.arange(len(texts), dtype=np.uint64), sizes)
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(n)  # words from here to the end
    value = np.zeros(n, np.uint64)
    for k in range(min(size, n)):
        inside = left[: n - k] > k
        value[: n - k] += np.where(inside, word[k:] * np.uint64(pow(int(_M1), k, 1 << 64)), np.uint64(0))
    keep = (left >= size) | (left == np.repeat(sizes, sizes))
    key = np.sort((doc[keep] << np.uint64(48)) | (mix(value[keep]) >> np.uint64(16)))
    where = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    key = key[where]
    return (key >> np.uint64(48)).astype(np.int64), key & np.uint64((1 << 48) - 1), np.diff(np.append(where, int(keep.sum())))


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """(n, registers) signature of each document; 0 throughout for a document without elements.

    All elements of all documents move through their processes together, one arrival each round.
    """
    time = np.full(n * registers, np.inf)
    held = np.zeros(n * registers, np.uint64)
    at, x = np.arange(len(doc)), np.zeros(len(doc))
    state = mix(element)
    limit = np.full(n, np.inf)
    while len(at):
        state = mix(state)
        x = x - np.log(((state >> np.uint64(11)).astype(np.float64) + 0.5) / 9007199254740992.0) / weight[at]
        ok = x < limit[doc[at]]
        at, x, state = at[ok], x[ok], state[ok]
        slot = doc[at] * registers + ((state * _M2 >> np.uint64(32)) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(time, slot, x)
        won = time[slot] == x
        held[slot[won]] = element[at[won]]
        touched = np.unique(doc[at])
        limit[touched] = time.reshape(n, registers)[touched].max(axis=1)
        ok = x < limit[doc[at]]
        at, x, state = at[ok], x[ok], state[ok]
    return held.reshape(n, registers)


def sketch(texts: list, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> list:
    doc, element, weight = shingles(texts, size)
    n = len(texts)
    sig = signatures(doc, element, weight, n, bands * rows).reshape(n, bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _M3, (n, bands)).copy()
    for r in range(rows):
        key = mix(key ^ sig[:, :, r])
    keys = key.view(np.int64)
    digests = _digest(texts)[0]
    some = np.bincount(doc, minlength=n) > 0
    return [digests, [k if t else [] for k, t in zip(keys, some, strict=True)]]


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard of two weighted sets (sorted elements, weights); two empty sets: 0.

    J = sum over common d of 1 / sum over all e of max(a_e / a_d, b_e / b_d). With e sorted by
    a_e / b_e the inner sum is a prefix and a suffix sum.
    """
    (ea, wa), (eb, wb) = a, b
    both, ia, ib = np.intersect1d(ea, eb, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    va, vb = wa[ia].astype(float), wb[ib].astype(float)
    only_a, only_b = float(wa.sum() - va.sum()), float(wb.sum() - vb.sum())
    ratio = va / vb
    order = np.argsort(ratio, kind="stable")
    va, vb, ratio = va[order], vb[order], ratio[order]
    upto = np.cumsum(vb)  # those of a smaller or equal ratio count by b
    above = va.sum() - np.cumsum(va) + only_a
    edge = np.searchsorted(ratio, ratio, side="right") - 1
    return float(np.sum(1.0 / (above[edge] / va + (upto[edge] + only_b) / vb)))


def _verified(pairs: DataFrame, texts: DataFrame, size: int, threshold: float) -> DataFrame:
    """The pairs (a, b) of digests whose texts are similar; texts has digest and text once each."""
    t = lambda k: texts.select(F.col("digest").alias(f"{k}_"), F.col("text").alias(f"text_{k}"))
    both = pairs.join(t("a"), F.col("a") == F.col("a_")).join(t("b"), F.col("b") == F.col("b_")).select("a", "b", "text_a", "text_b")

    def run(batches):
        last: tuple = (None, None)
        for batch in batches:
            for at, end in slices(batch.column("text_b")):
                part = batch.slice(at, end - at)
                ok = []
                for x, y in zip(part.column("text_a"), part.column("text_b"), strict=True):
                    x, y = x.as_py(), y.as_py()
                    if x != last[0]:
                        last = (x, shingles([x], size)[1:])
                    ok.append(similarity(last[1], shingles([y], size)[1:]) >= threshold - ROUNDING)
                yield part.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))
            give_back()

    return both.mapInArrow(run, T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())]))


def _digest(texts: list) -> list:
    import xxhash

    return [[None if x is None else xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in texts]]


def _bits(n: int) -> int:
    """The power of two of the bits of a bitmap of n digests."""
    return min(max((max(n, 1) * BITS_EACH - 1).bit_length(), FEWEST_BITS), MOST_BITS)


def _bitmap(digests: DataFrame) -> np.ndarray:
    """A bitmap with the bits of the column digest (a written table) set, of a size by their number."""
    bits = _bits(digests.count())
    bit = F.shiftrightunsigned(F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long"), 32 - bits)
    words = digests.select(F.shiftright(bit, 5).alias("w"), (bit % 32).cast("int").alias("b")).groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("v"))
    out = np.zeros(1 << (bits - 5), np.uint32)
    for r in words.groupBy(F.shiftright("w", 10).alias("block")).agg(F.collect_list(F.struct("w", "v")).alias("words")).toLocalIterator():  # 1024 words at most
        for w, v in r["words"]:
            out[w] = v
    return out


def _marked(docs: DataFrame, text: str, bits: np.ndarray, inside: bool, digest: str = "__digest") -> DataFrame:
    """Rows of docs, with their digest, whose digest is in the bitmap (or is not)."""
    own = map_text(docs, text, lambda: lambda x: _looked_up(x, bits), [(digest, pa.binary()), ("__in", pa.bool_())])
    return own.where(F.col("__in") if inside else ~F.col("__in")).drop("__in")


def _looked_up(texts: list, bits: np.ndarray) -> list:
    digests = _digest(texts)[0]
    shift = 32 - (len(bits) * 32 - 1).bit_length()
    at = [0 if d is None else int.from_bytes(d[:4], "big") >> shift for d in digests]
    return [digests, [d is not None and bool(bits[k >> 5] >> np.uint32(k & 31) & 1) for d, k in zip(digests, at, strict=True)]]


def _texts(source: DataFrame, need: DataFrame) -> DataFrame:
    """(digest, text) of the needed digests (a written table), once each."""
    own = _marked(source.select("text").where("text IS NOT NULL"), "text", _bitmap(need), True, "own")
    return stored(own.join(need, own["own"] == need["digest"], "left_semi").groupBy("own").agg(F.first("text").alias("text")).withColumnRenamed("own", "digest"))


def hot_join(rows: DataFrame, key: str, table: DataFrame, total: int, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with a written table that has one row a key, and n, the rows of the key.

    Rows of hot keys, those with more than total / HOT of total rows, stay where they are: what the
    table says of these HOT keys at most is broadcast, and the keys themselves are literals of the plan that
    keep their rows out of the shuffle. The others are shuffled, and null keys match nothing.
    """
    more = [c for c in table.columns if c not in (key, "n")]
    named = table.select(F.col(key).alias("__key"), *more, "n")
    hot = F.broadcast(named.where(F.col("n") * HOT > total).drop("n"))
    here = rows.join(hot, rows[key] == hot["__key"], "inner").drop("__key")
    few = [r["__key"] for r in named.where(F.col("n") * HOT > total).select("__key").collect()]  # HOT at most
    rest = rows.where(F.col(key).isNotNull() & ~F.col(key).isin(few)) if few else rows.where(F.col(key).isNotNull())
    other = named.where(F.col("n") * HOT <= total).drop("n")
    out = here.unionByName(rest.join(other, rest[key] == other["__key"], how).drop("__key"))
    if how == "left":
        out = out.unionByName(rows.where(F.col(key).isNull()), allowMissingColumns=True)
    return out


def _links(source: DataFrame, pairs: DataFrame, size: int, threshold: float) -> DataFrame:
    """Verified pairs, written to the shared folder."""
    need = stored(pairs.select(F.explode(F.array("a", "b")).alias("digest")).distinct())
    return stored(_verified(pairs, _texts(source, need), size, threshold))


def _parts(batches):
    """Batches in parts of a bounded size of their column text."""
    for batch in batches:
        for i, j in slices(batch.column("text")):
            yield batch.slice(i, j - i)
        give_back()


def _frequencies(texts: DataFrame, size: int) -> np.ndarray:
    """How often shingles occur, counted in 2 ** SLOTS slots by hash; of that size whatever the texts."""

    def run(batches):
        for part in _parts(batches):
            slot, n = np.unique(shingles(part.column("text").to_pylist(), size)[1] >> np.uint64(48 - SLOTS), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int64)), pa.array(n.astype(np.int64))], names=["slot", "n"])

    out = np.zeros(1 << SLOTS, np.int64)
    for r in texts.mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["slot"]] = r["n"]
    return out


def _prefixes(texts: DataFrame, often: np.ndarray, size: int, threshold: float) -> DataFrame:
    """(digest, key, o, w, p): the rarest shingles of each text, o the weight of those before. Two
    texts that reach the threshold share one; the order is the same for all texts."""

    def run(batches):
        for part in _parts(batches):
            d, e, w = shingles(part.column("text").to_pylist(), size)
            order = np.lexsort((e, often[(e >> np.uint64(48 - SLOTS)).astype(np.int64)], d))
            d, e, w = d[order], e[order], w[order]
            n = part.num_rows
            total = np.bincount(d, w, minlength=n).astype(np.int64)
            plain = total == np.bincount(d, minlength=n)
            before = np.cumsum(w) - w
            before -= (np.cumsum(total) - total)[d]
            keep = before <= (1 - threshold + ROUNDING) * total[d]
            d = d[keep]
            yield pa.RecordBatch.from_arrays([part.column("digest").take(pa.array(d)), pa.array(e[keep].astype(np.int64)), pa.array(before[keep]), pa.array(total[d]), pa.array(plain[d])], names=["digest", "key", "o", "w", "p"])

    return texts.mapInArrow(run, "digest binary, key long, o long, w long, p boolean")


def _bound(a: str, b: str) -> str:
    """SQL of an upper bound of the similarity of two texts, of their weights {}w, the weights {}o
    that they don't share, and whether all their weights are 1 ({}p). With shares x and y of weight
    not shared the probability Jaccard is at most (1 - x)(1 - y) / (1 - xy), as a b / (b + y a) is
    concave; for plain sets the overlap is at most the rest of either."""
    o = f"least({a}w - {a}o, {b}w - {b}o)"
    x, y = f"({a}o / {a}w)", f"({b}o / {b}w)"
    return f"CASE WHEN {a}p AND {b}p THEN {o} / ({a}w + {b}w - {o}) WHEN {x} = 1 OR {y} = 1 THEN 0 ELSE (1 - {x}) * (1 - {y}) / (1 - {x} * {y}) END"


def _across(source: DataFrame, shared: DataFrame, label: DataFrame, size: int, threshold: float) -> DataFrame:
    """Pairs (a, b) of texts that meet others of another component in a bucket, of different
    components themselves, that may reach the threshold: they share one of their rarest shingles,
    and what comes before it in either leaves enough."""
    named = stored(shared.join(label, shared["digest"] == label["node"], "left").select("key", "digest", F.coalesce("label", "digest").alias("label")))
    mixed = named.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("n")).where("x < y").select("key", "n")
    open_ = stored(hot_join(named, "key", stored(mixed), named.count()).select("digest", "label").distinct())
    if open_.isEmpty():
        return open_.select(F.col("digest").alias("a"), F.col("digest").alias("b"))
    texts = _texts(source, stored(open_.select("digest").distinct()))
    rows = stored(_prefixes(texts, _frequencies(texts, size), size, threshold).join(open_, "digest"))
    # without those that no text which has the shingle could match
    best = rows.groupBy("key").agg(F.min("label").alias("l1"), F.max("label").alias("l2"), F.min("w").alias("low_w"), F.min(F.expr("o / w")).alias("low_x"), F.min("p").alias("all_p"))
    at_best = "CASE WHEN all_p THEN (w - o) / (w + greatest(low_w, w - o) - (w - o)) WHEN o = w THEN 0 ELSE (1 - o / w) * (1 - low_x) / (1 - o / w * low_x) END"
    rows = stored(rows.join(best.where("l1 < l2"), "key").where(F.expr(at_best) >= threshold - ROUNDING).select("key", "digest", "label", "o", "w", "p"))
    top = rows.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "label")).alias("top"))
    minor = rows.join(top, "key").where("label <> top.label").select("key", *[F.col(c).alias(f"m{c}") for c in ("digest", "label", "o", "w", "p")])
    pairs = rows.join(minor, (rows["key"] == minor["key"]) & (F.col("label") != F.col("mlabel")) & (F.expr(_bound("", "m")) >= threshold - ROUNDING))
    return pairs.select(F.least("digest", "mdigest").alias("a"), F.greatest("digest", "mdigest").alias("b")).distinct()


def classes(docs: DataFrame, doc: str = "doc_id", text: str = "text", size: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc, digest, class_id, first) for every row of docs: class_id is the smallest doc of the
    class, first marks its row (each of them, if it is repeated)."""
    source = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    sketches = stored(map_text(source, "text", lambda: lambda x: sketch(x, size, bands, rows), FIELDS).drop("text"))
    total = sketches.count()
    nodes = stored(sketches.where("digest IS NOT NULL").groupBy("digest").agg(F.first("bands").alias("bands"), F.count("*").alias("n")))
    band = nodes.select("digest", F.explode("bands").alias("key"))
    buckets = stored(band.groupBy("key").agg(F.count("*").alias("n"), F.count("*").alias("count")).where("n > 1"))
    shared = stored(hot_join(band, "key", buckets, total * bands))
    central = shared.groupBy("digest").agg(F.sum("count").alias("met")).withColumnRenamed("digest", "d")
    ranked = stored(shared.join(central, shared["digest"] == central["d"]).select("key", F.struct("met", "digest").alias("rank")))
    tops = stored(ranked.groupBy("key").agg(F.max("rank").alias("top"), F.count("*").alias("n")))
    star = hot_join(ranked, "key", tops, total * bands).where("rank <> top")
    star = stored(star.select(F.least("rank.digest", "top.digest").alias("a"), F.greatest("rank.digest", "top.digest").alias("b")).distinct())
    links = _links(source, star, size, threshold)
    label = stored(components(links))
    rest = _across(source, shared.select("key", "digest"), label, size, threshold)
    rest = stored(rest.join(star, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        more = _links(source, rest, size, threshold)
        if not more.isEmpty():
            label = stored(components(links.union(more)))
    labels = stored(nodes.select("digest", "n").join(label, nodes["digest"] == label["node"], "left").select("digest", "n", F.coalesce("label", "digest").alias("label")))
    one = stored(hot_join(sketches.select("doc", "digest"), "digest", labels, total, "left"))
    firsts = one.where("label IS NOT NULL").groupBy("label").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "digest")).alias("top"), F.count("*").alias("n"))
    named = hot_join(one, "label", stored(firsts), total, "left")
    alone = F.col("label").isNull()
    first = alone | (F.col("doc").eqNullSafe(F.col("top.doc")) & (F.col("digest") == F.col("top.digest")))
    return named.select("doc", "digest", F.when(alone, F.col("doc")).otherwise(F.col("top.doc")).alias("class_id"), first.alias("first"))


def one_each(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of docs for each class: that of the smallest id. A row that repeats both id and
    text stays once. Rows with null text are classes of their own and all stay.

    Rows whose digest is not in a bitmap of the doubtful ones pass where they are; only the
    others are shuffled to the list of the first rows.
    """
    found = stored(classes(docs, doc, text).where("digest IS NOT NULL").groupBy("doc", "digest").agg(F.min("first").alias("first"), F.count("*").alias("n")))
    bits = _bitmap(stored(found.where("NOT first OR n > 1").select("digest")))
    keep = found.where("first").select("doc", "digest")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    doubtful = _marked(docs, text, bits, True).dropDuplicates([doc, "__digest"])
    kept = doubtful.join(keep, doubtful[doc].eqNullSafe(keep["doc"]) & (doubtful["__digest"] == keep["digest"]), "left_semi")
    return _marked(docs, text, bits, False).select(*columns).unionByName(kept.select(*columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("doc").alias("doc_id"), "class_id")
