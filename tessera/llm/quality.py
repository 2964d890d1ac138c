"""Quality scores by positive-unlabelled learning.

Trusted positives are training documents labelled of good quality; a sample of all training documents,
their labels unseen, is the unlabelled web text. With class prior p, the risk of a scorer on positives P and unlabelled U is
p * E_P[loss(g, +)] + max(0, E_U[loss(g, -)] - p * E_P[loss(g, -)]): the second part, the negatives' risk,
can't be negative, so it is held at 0 (the non-negative unbiased risk). Mini-batches step down that risk;
when the bracket falls below 0 the step goes up on it instead, which stops the model from overfitting
the positives. Loss is the logistic loss; the scorer is linear over the features below.

The prior is estimated from positives and unlabelled texts alone: a scorer that tells positives from unlabelled texts is fitted on
one half of each; on the other half, the share of unlabelled texts above a cut is at least the prior times that of positives, so the
least ratio of both shares over all cuts, the cut chosen by its upper confidence bound, is the estimate (best bin estimation).
Labels other than good are not looked at.

Features of a whole text: how often each kind of character occurs and doubles, and ratios (words to bytes,
marks, upper case, repeated lines, doubled words, the most frequent word, repeated word pairs, words
to distinct words). Labels, lang, source and doc_id are never features.

The fit uses a bounded sample: the SAMPLE_POSITIVE labelled good and SAMPLE_UNLABELLED documents of
the smallest hashed doc_id, whole texts of any length, whose features are computed in tasks. Rows of crc32(doc_id as text) mod 3 = 1 are held out and never looked at.

Defined results: null and empty texts get the score of a text without features; if the fold has no
positive, every score is one half; a null doc_id is not held out and not learned from; several labels of one
doc_id count as good if any is; a row comes out for each document row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.kernel import Tokens, chunked, small_batches
from tessera.llm.langid import held_out

_U = np.uint64
SAMPLE_POSITIVE = 3000
SAMPLE_UNLABELLED = 6000
EPOCHS, BATCH, RATE, DECAY = 40, 256, 0.02, 3e-3


def _kinds() -> np.ndarray:
    """The kind of each byte: lower, upper, digit, space, line end, beyond ASCII, and each mark its own."""
    out = np.zeros(256, dtype=np.int64)
    marks = 6
    for b in range(256):
        c = chr(b)
        if b >= 0x80:
            out[b] = 5
        elif c.islower():
            out[b] = 0
        elif c.isupper():
            out[b] = 1
        elif c.isdigit():
            out[b] = 2
        elif c == "\n":
            out[b] = 4
        elif c.isspace() or b < 0x20:
            out[b] = 3
        else:
            out[b] = marks
            marks += 1
    return out


_KIND = _kinds()
_N_KINDS = int(_KIND.max()) + 1
#: Kinds whose plain frequency tells languages rather than quality: beyond ASCII counts as lower case.
_FOLD = np.where(np.arange(_N_KINDS) == 5, 0, np.arange(_N_KINDS))


def _features(text: str, data: np.ndarray, words: np.ndarray) -> np.ndarray:
    kinds = _FOLD[_KIND[data]]
    n = max(len(kinds), 1)
    one = np.bincount(kinds, minlength=_N_KINDS) / n
    same = np.zeros(_N_KINDS)
    if len(data) > 1:
        same = np.bincount(kinds[1:][data[1:] == data[:-1]], minlength=_N_KINDS) / n
    lines = [x for x in text.split("\n") if x]
    letters = one[0] + one[1]
    _, times = np.unique(words, return_counts=True)
    m = max(len(words), 1)
    pairs = np.unique(words[:-1] * _U(31) + words[1:]) if len(words) > 1 else words
    ratios = [
        m / n * 5,
        1 - letters - one[2] - one[3] - one[4],
        one[1] / max(letters, 1e-9),
        1 - len(set(lines)) / max(len(lines), 1),
        (words[1:] == words[:-1]).mean() if len(words) > 1 else 0.0,
        times.max() / m if len(words) > 5 else 0.0,
        1 - len(pairs) / max(len(words) - 1, 1) if len(words) > 1 else 0.0,
        np.log(max(m, 1)) - np.log(max(len(times), 1)),
        float(len(words) < 5),
    ]
    return np.concatenate([np.sqrt(one), np.sqrt(same), np.array(ratios), np.sqrt(np.maximum(ratios, 0))])


def features(texts: list[str]) -> np.ndarray:
    """A row of features for each whole text."""
    tokens = Tokens(texts)
    return np.stack([_features(t, np.frombuffer(t.encode("utf-8", "surrogatepass"), dtype=np.uint8), tokens.of(i)) for i, t in enumerate(texts)])


N_FEATURES = 2 * _N_KINDS + 18


class Model:
    def __init__(self, weights: np.ndarray, bias: float, centre: np.ndarray, scale: np.ndarray, prior: float):
        self.weights, self.bias, self.centre, self.scale, self.prior = weights, bias, centre, scale, prior

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -CLIP, CLIP) @ self.weights + self.bias

    def score(self, texts: list[str]) -> np.ndarray:
        return _sigmoid(self.raw(features(texts)))


CLIP = 6.0



def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def risk(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float]:
    """The positives' part and the negatives' unbiased part of the risk of weights w, logistic loss."""
    gp, gu = p @ w, u @ w
    # loss(g, -) = log(1 + e**g), loss(g, +) = log(1 + e**-g)
    return prior * np.logaddexp(0, -gp).mean(), np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()


def descent(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> np.ndarray:
    """The gradient to follow: of the whole risk while the negatives' part is not negative, else up on that part alone."""
    sp, su = _sigmoid(p @ w), _sigmoid(u @ w)
    to_negative = su @ u / len(u) - prior * (sp @ p) / len(p)
    return to_negative - prior * ((1 - sp) @ p) / len(p) if risk(w, p, u, prior)[1] >= 0 else -to_negative


def _apart(w: np.ndarray, p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gradient of telling positives from unlabelled texts, both of equal weight."""
    return (_sigmoid(u @ w) @ u / len(u) - (1 - _sigmoid(p @ w)) @ p / len(p)) / 2


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 7, against: bool = False) -> Model:
    """Minimise the non-negative unbiased risk; the sign of the score is the class. With `against`, tell positives from
    unlabelled texts instead, as estimate_prior() needs.

    Features are centred and scaled by the positives, so what good texts never show stands out.
    """
    rng = np.random.default_rng(seed)
    centre, scale = positive.mean(axis=0), positive.std(axis=0) + 0.03
    norm = lambda x: np.concatenate([np.clip((x - centre) / scale, -CLIP, CLIP), np.ones((len(x), 1))], axis=1)
    xp, xu = norm(positive), norm(unlabelled)
    w = np.zeros(xp.shape[1])
    w[-1] = np.log(prior / (1 - prior))
    keep = np.append(np.ones(len(w) - 1), 0)  # the bias does not decay
    first, second, step, tail = np.zeros_like(w), np.zeros_like(w), 0, []
    batches = max(1, -(-len(xu) // BATCH))
    for epoch in range(EPOCHS):
        order_u, order_p = rng.permutation(len(xu)), rng.permutation(len(xp))
        for b in range(batches):
            u = xu[order_u[b::batches]]
            p = xp[order_p[b::batches]] if len(xp) >= 8 * batches else xp
            grad = (descent(w, p, u, prior) if not against else _apart(w, p, u)) + DECAY * keep * w
            step += 1
            first = 0.9 * first + 0.1 * grad
            second = 0.999 * second + 0.001 * grad**2
            w = w - RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        if epoch >= EPOCHS // 2:
            tail.append(w)
    w = np.mean(tail, axis=0)
    return Model(w[:-1], float(w[-1]), centre, scale, prior)


def constant(prior: float) -> Model:
    return Model(np.zeros(N_FEATURES), float(np.log(prior / (1 - prior))), np.zeros(N_FEATURES), np.ones(N_FEATURES), prior)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, confidence: float = 0.1) -> float:
    """The share of positives among the unlabelled, by best bin estimation on halves that the scorer has not seen."""
    ranked = fit(positive[::2], unlabelled[::2], 0.5, against=True)
    p, u = np.sort(ranked.raw(positive[1::2])), np.sort(ranked.raw(unlabelled[1::2]))
    if not len(p) or not len(u):
        return 0.5
    cuts = np.unique(p)
    above_p = (len(p) - np.searchsorted(p, cuts, "left")) / len(p)
    above_u = (len(u) - np.searchsorted(u, cuts, "left")) / len(u)
    slack = np.sqrt(np.log(4 / confidence) / 2)
    bound = (above_u + slack / np.sqrt(len(u)) + slack / np.sqrt(len(p))) / above_p
    k = int(np.argmin(bound))
    return float(np.clip(above_u[k] / above_p[k], 0.01, 0.99))


_FEATURED = "key long, tie long, good int, x array<double>"


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from the training fold of documents and labels; what reaches the driver is bounded: features of the sample."""
    fold = F.crc32(F.col("doc_id").cast("string")) % 3 != 1
    key = F.xxhash64("doc_id")
    good = labels.where(fold & (F.col("quality") == 1)).select("doc_id").distinct()
    positives = good.orderBy(key).limit(SAMPLE_POSITIVE).select("doc_id", F.lit(1).alias("good"))
    n = docs.where(fold).select("doc_id").count()
    limit = min(2**63 - 1, 2**64 * min(n, 2 * SAMPLE_UNLABELLED + 100) // max(n, 1) - 2**63)
    # positives are at most SAMPLE_POSITIVE ids
    rows = docs.where(fold).select("doc_id", "text").join(F.broadcast(positives), "doc_id", "left").where((F.col("good") == 1) | (key <= limit))
    rows = rows.select(key.alias("key"), F.xxhash64("text").alias("tie"), F.coalesce("good", F.lit(0)).alias("good"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            for begin, texts in chunked(batch.column(3).to_pylist()):
                x = features(texts)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * N_FEATURES), pa.array(x.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(begin, len(texts)) for i in range(3)), lists], ["key", "tie", "good", "x"])

    featured = rows.mapInArrow(run, _FEATURED)
    first = lambda rows, n: [r.x for r in rows.orderBy("key", "tie").limit(n).select("x").collect()]
    trusted, others = first(featured.where("good = 1"), SAMPLE_POSITIVE), first(featured.where(F.col("key") <= limit), SAMPLE_UNLABELLED)
    if not trusted or not others:
        return constant(0.5)
    p, u = np.array(trusted), np.array(others)
    return fit(p, u, estimate_prior(p, u))


SCORED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            parts = [shared.value.score(texts) for _, texts in chunked(batch.column(2).to_pylist())]
            s = np.concatenate(parts) if parts else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], SCORED.names)

    return rows.mapInArrow(run, SCORED)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
