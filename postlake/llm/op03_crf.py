"""Quality scores from a linear-chain conditional random field over the lines of a text.

Every line that has a word is good (1) or bad (0). The field scores a line by its own features,
those of its neighbours, and the label of the line before. Only documents are labelled, so the labels
of lines are latent: a document's label holds for most of its lines, not for all. First a model of
single lines (own features only) is fitted to the labels of their documents, both weighing the same; a line that it finds
bad in a good document, or good in a bad one, by a margin, changes sides, but a bad
document keeps its worst line. The field is then trained on these labels by maximum likelihood, with a
gradient from forward-backward. A document's aggregate is the mean of the marginal of "good" over its
lines, weighted by their lengths; its score is a logistic function of the aggregate, fitted to the
documents' labels, as a bad document may have many good lines.

Training takes at most MAX_DOCUMENTS labelled documents, those with the smallest hash of the id,
each with all its lines, as long as they have MAX_LINES lines each on average (one with more lines than are
left is passed over); the bounds hold for training only, every text is scored whole.
Labels of documents whose crc32 of the id modulo FOLDS is 0 are never read. Language, source and
ids are no features.

Edge cases: null counts as empty; a text without words is scored as one empty line. Without any
labelled document all scores are 0.5. Repeated labels of one id: the largest counts. Of several texts
of a labelled id that of the smallest features is trained on. Rows with a null id count as held out.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlake.llm.common import map_text, stored, table
from postlake.llm.op06_near import mix

FOLDS = 5
CUT = 0.3
#: Bounds of the training sample: documents, and lines of one on average.
MAX_DOCUMENTS = 4000
MAX_LINES = 60
#: Steps and rate of the optimiser (Adam), and the weight of the squared norm.
STEPS, RATE, RIDGE = 200, 0.4, 1e-5
#: A line changes sides in a good document below the first of these, in a bad one above the second.
SURELY_BAD, SURELY_GOOD = 0.3, 0.7

OWN = ("bias", "length", "symbols", "marks", "capitals", "digits", "bars", "word_length", "few_words", "repeated_words", "repeated_line", "same_word")
#: Features that are also taken from the line before and the line after (0 beyond the edge).
NEAR = ("symbols", "marks", "capitals", "bars", "repeated_words", "repeated_line")
SIZE = len(OWN) + 2 * len(NEAR) + 2

_CLASS = np.zeros((5, 256), bool)
for _i, _set in enumerate((b"#*$%&<>~^@_=+", b"!?", bytes(range(65, 91)), b"0123456789", b"|")):
    _CLASS[_i, list(_set)] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def features(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of SIZE features, document of each row, bytes of each line) of the lines with words, in order."""
    coded = [(x or "").encode("utf-8", "surrogatepass") for x in texts]
    data = np.frombuffer(b"\n".join(coded) + b"\n", np.uint8)
    breaks = np.flatnonzero(data == 10)
    starts = np.append(0, breaks[:-1] + 1)
    sizes = np.array([len(c) + 1 for c in coded], np.int64)
    of = np.searchsorted(np.cumsum(sizes), starts, side="right")
    space = _SPACE[data]
    begin = np.flatnonzero(~space & np.append(True, space[:-1]))
    line = np.searchsorted(starts, begin, side="right") - 1
    words = np.bincount(line, minlength=len(starts))
    per = lambda mask: np.add.reduceat(mask.astype(np.int64), starts)
    symbols, marks, capitals, digits, bars = (per(c[data]) for c in _CLASS)
    solid = per(~space)
    ids = defaultdict(count().__next__)
    flat = np.fromiter((ids[w] for c in coded for w in c.split()), np.int64, len(begin)).astype(np.uint64)
    doc = of[line].astype(np.uint64)
    # words that start a run of three which occurs again in the document
    again = np.zeros(len(flat), bool)
    if len(flat) > 2:
        key = mix(mix(mix(flat[:-2] + np.uint64(1)) ^ flat[1:-1]) ^ flat[2:])
        key = (doc[:-2] << np.uint64(48)) | (key >> np.uint64(16))
        within = np.flatnonzero(doc[:-2] == doc[2:])
        _, where, n = np.unique(key[within], return_inverse=True, return_counts=True)
        again[within] = n[where] > 1
    repeated = np.bincount(line, again, minlength=len(starts))
    whole: dict = {}
    lines = b"\n".join(coded).split(b"\n")
    first = np.fromiter((whole.setdefault((d, x), i) == i for i, (d, x) in enumerate(zip(of.tolist(), lines, strict=True))), bool, len(lines))
    w = np.maximum(words, 1)
    length = np.maximum(solid, 1)
    table_ = {
        "bias": np.ones(len(starts)),
        "length": np.log1p(solid) / 5,
        "symbols": np.minimum(symbols / w, 2),
        "marks": np.minimum(marks / w, 2),
        "capitals": capitals / length,
        "digits": digits / length,
        "bars": np.minimum(bars / w, 2),
        "word_length": np.minimum(length / w, 20) / 10,
        "few_words": (words < 4).astype(float),
        "repeated_words": repeated / w,
        "repeated_line": (~first).astype(float),
        "same_word": np.bincount(line, np.append(False, (flat[1:] == flat[:-1]) & (line[1:] == line[:-1])) if len(flat) else None, minlength=len(starts)) / w,
    }
    keep = words > 0
    empty = np.setdiff1d(np.arange(len(texts)), of[keep])
    keep[np.searchsorted(of, empty)] = True  # one line for a text without words
    of = of[keep]
    own = {k: v[keep] for k, v in table_.items()}
    before, after = np.append(False, of[1:] == of[:-1]), np.append(of[1:] == of[:-1], False)
    columns = [own[k] for k in OWN]
    columns += [np.where(before, np.roll(own[k], 1), 0) for k in NEAR] + [np.where(after, np.roll(own[k], -1), 0) for k in NEAR]
    columns += [(~before).astype(float), (~after).astype(float)]
    return np.stack(columns, axis=1), of, solid[keep] + 1


def marginals(x: np.ndarray, of: np.ndarray, weights: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(probability of label 1 of each line, expected counts of label pairs, sum of log partition sums).

    Documents advance together, one line a step, the longest first, so that those still going are
    always the first ones.
    """
    n = np.bincount(of)
    n = n[n > 0]
    order = np.argsort(-n, kind="stable")
    start = (np.cumsum(n) - n)[order]
    n = n[order]
    going = np.searchsorted(-n, -np.arange(n[0]), side="left") if len(n) else np.zeros(0, int)
    score = np.zeros((len(x), 2))
    score[:, 1] = x @ weights
    alpha, beta = np.zeros_like(score), np.zeros_like(score)
    for t, k in enumerate(going):
        at = start[:k] + t
        alpha[at] = score[at]
        if t:
            last = alpha[at - 1]
            alpha[at] += np.logaddexp(last[:, :1] + pairs[0], last[:, 1:] + pairs[1])
    for t in range(len(going) - 2, -1, -1):
        at = start[: going[t + 1]] + t
        more = score[at + 1] + beta[at + 1]
        beta[at] = np.logaddexp(more[:, :1] + pairs[:, 0], more[:, 1:] + pairs[:, 1])
    end = start + n - 1
    z = np.logaddexp(alpha[end, 0], alpha[end, 1])
    by = np.argsort(start)
    norm = np.repeat(z[by], n[by])
    good = 1 / (1 + np.exp(np.clip(alpha[:, 0] + beta[:, 0] - alpha[:, 1] - beta[:, 1], -500, 500)))
    inner = np.ones(len(x), bool)
    inner[start] = False
    at = np.flatnonzero(inner)
    joint = np.exp(alpha[at - 1][:, :, None] + pairs[None] + (score[at] + beta[at])[:, None, :] - norm[at][:, None, None])
    return good, joint.sum(axis=0), float(z.sum())


class Model(NamedTuple):
    """Weights of the features, scores of label pairs, slope and intercept of the score."""

    weights: np.ndarray
    pairs: np.ndarray
    slope: float
    intercept: float


def _ascend(gradient: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Where a concave function, less the ridge, is largest (Adam from 0)."""
    theta, mean, var = np.zeros(size), np.zeros(size), np.zeros(size)
    for step in range(1, STEPS + 1):
        grad = gradient(theta) - RIDGE * theta
        mean = 0.9 * mean + 0.1 * grad
        var = 0.99 * var + 0.01 * grad**2
        theta = theta + RATE * (mean / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.99**step)) + 1e-8)
    return theta


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def line_labels(x: np.ndarray, of: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Labels of lines from those of their documents (one for each line)."""
    own = x[:, : len(OWN)]
    share = np.bincount(label, minlength=2)
    even = len(label) / (2 * np.maximum(share, 1))[label]  # both labels weigh the same
    weights = _ascend(lambda theta: own.T @ (even * (label - _logistic(own @ theta))) / len(own), own.shape[1])
    good = _logistic(own @ weights)
    out = label.copy()
    out[(label == 1) & (good < SURELY_BAD)] = 0
    worst = np.zeros(len(of), bool)
    order = np.lexsort((good, of))
    worst[order[np.append(True, of[order][1:] != of[order][:-1])]] = True
    out[(label == 0) & (good > SURELY_GOOD) & ~worst] = 1
    return out


def aggregate(x: np.ndarray, of: np.ndarray, length: np.ndarray, weights: np.ndarray, pairs: np.ndarray, n: int) -> np.ndarray:
    """Length-weighted mean marginal of each of n documents."""
    good, _, _ = marginals(x, of, weights, pairs)
    return np.bincount(of, good * length, minlength=n) / np.bincount(of, length, minlength=n)


def train(x: np.ndarray, of: np.ndarray, length: np.ndarray, label: np.ndarray) -> Model:
    """The model of documents' labels (one for each line; documents are numbered from 0)."""
    if not len(x):
        return Model(np.zeros(x.shape[1]), np.zeros((2, 2)), 0.0, 0.0)
    lines = line_labels(x, of, label)
    inner = np.append(False, of[1:] == of[:-1])
    seen = np.zeros((2, 2))
    np.add.at(seen, (lines[np.flatnonzero(inner) - 1], lines[inner]), 1)
    docs = int(of[-1]) + 1

    def gradient(theta: np.ndarray) -> np.ndarray:
        good, expected, _ = marginals(x, of, theta[:-4], theta[-4:].reshape(2, 2))
        return np.append(x.T @ (lines - good), (seen - expected).ravel()) / docs

    theta = _ascend(gradient, x.shape[1] + 4)
    weights, pairs = theta[:-4], theta[-4:].reshape(2, 2)
    seen_as = np.stack([aggregate(x, of, length, weights, pairs, docs), np.ones(docs)], axis=1)
    truth = np.zeros(docs)
    truth[of] = label
    slope, intercept = _ascend(lambda t: seen_as.T @ (truth - _logistic(seen_as @ t)) / docs, 2)
    return Model(weights, pairs, max(float(slope), 0.0), float(intercept))


def scores(texts: list, model: Model) -> np.ndarray:
    """Score of each text."""
    x, of, length = features(texts)
    return _logistic(model.slope * aggregate(x, of, length, model.weights, model.pairs, len(texts)) + model.intercept)


def line_marginals(text: str, model: Model) -> np.ndarray:
    """Probability of "good" of each line with words."""
    x, of, _ = features([text])
    return marginals(x, of, model.weights, model.pairs)[0]


def held_out(doc: str = "doc_id"):
    """Whether a row is held out of training."""
    return F.coalesce(F.crc32(F.col(doc).cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", label: str = "quality", most: int = MAX_DOCUMENTS) -> Model:
    """The model, from a bounded sample of labelled documents; features are made on the executors."""
    chosen = labels.where(~held_out(doc) & F.col(label).isNotNull()).groupBy(doc).agg(F.max(label).alias("label"))
    chosen = chosen.orderBy(F.xxhash64(doc), doc).limit(most).withColumnRenamed(doc, "of")
    own = docs.select(doc, text).join(F.broadcast(chosen), F.col(doc) == F.col("of")).select("of", "label", text)

    def make():
        def run(texts: list) -> list:
            x, of, length = features(texts)
            rows = np.column_stack([x, length])
            return [[part.tobytes() for part in np.split(rows, np.searchsorted(of, np.arange(1, len(texts))))]]

        return run

    width = 8 * (SIZE + 1)
    rows = stored(map_text(own, text, make, [("x", pa.binary())]).groupBy("of").agg(F.min(F.struct("label", "x")).alias("r")).select("of", "r.*", F.xxhash64("of").alias("order"), (F.octet_length("r.x") / width).cast("long").alias("lines")))
    # documents by hash, as long as their lines fit; one that doesn't is passed over, not those behind it
    fits, lines = [], 0
    for r in rows.select("of", "order", "lines").orderBy("order", "of").collect():  # most rows
        if lines + r["lines"] <= most * MAX_LINES:
            fits.append((r["of"],))
            lines += r["lines"]
    chosen = rows.sparkSession.createDataFrame(fits, T.StructType([T.StructField("fit", rows.schema["of"].dataType)]))
    kept = [(r["of"], int(r["label"]), np.frombuffer(r["x"]).reshape(-1, SIZE + 1)) for r in rows.join(F.broadcast(chosen), F.col("of") == F.col("fit")).select("of", "label", "x").toLocalIterator()]
    kept.sort(key=lambda r: r[0])
    parts = [part for _, _, part in kept]
    x = np.concatenate(parts) if parts else np.zeros((0, SIZE + 1))
    n = [len(p) for p in parts]
    return train(x[:, :-1], np.repeat(np.arange(len(parts)), n), x[:, -1], np.repeat([k for _, k, _ in kept], n).astype(np.int64))


def score(docs: DataFrame, model: Model, text: str = "text", cut: float = CUT) -> DataFrame:
    """docs with score and predicted."""
    own = map_text(docs, text, lambda: lambda x: [scores(x, model)], [("score", pa.float64())])
    return own.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
