import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import quality as q

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")


@pytest.fixture(scope="module")
def model(tables):
    return q.train(*tables)


def test_risk_is_learned_from_positives_and_unlabelled_only():
    rng = np.random.default_rng(0)
    pos, neg = rng.normal(1, 1, (3000, 5)), rng.normal(-1, 1, (3000, 5))
    wide = lambda x: x
    unlabelled = np.concatenate([pos[1000:2400], neg[:600]])
    m = q.fit(wide(pos[:1000]), wide(unlabelled), 0.7)
    side = lambda x: (m.raw(wide(x)) > 0).mean()
    assert side(pos[2400:]) > 0.9 and side(neg[600:]) < 0.15


def test_held_out(spark, tables, model):
    docs, labels = tables
    got = q.score(docs, model).join(labels, "doc_id").where("held_out").toPandas()
    assert len(got) > 100 and (got.predicted == got.quality).mean() > 0.93
    good, bad = got[got.quality == 1].score, got[got.quality == 0].score
    auc = np.mean([(good > b).mean() + (good == b).mean() / 2 for b in bad])
    assert auc > 0.95


def test_held_out_labels_and_other_columns_do_not_matter(tables, model):
    docs, labels = tables
    fold = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    other = q.train(docs.withColumn("lang", F.lit("x")).withColumn("source", F.lit("y")), labels.withColumn("quality", F.when(fold, 1 - F.col("quality")).otherwise(F.col("quality"))))
    assert np.array_equal(other.weights, model.weights)


def test_edges(spark, tables, model):
    docs, labels = tables
    rows = [(1, None), (1, None), (2, ""), (None, "the and of"), (3, "!!! " * 100_000)]
    table = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "9 AS score", "true AS held_out", "0 AS quality")
    got = q.score(table, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert q.score(table.limit(0), model).count() == 0
    assert q.train(docs, labels.where("quality = 7")).prior == 0.5
    assert not q.train(docs.limit(0), labels).weights.any()


def test_gradient_is_that_of_the_plain_risk():
    """Against differences of the risk written out example by example."""
    from math import exp, log1p

    rng = np.random.default_rng(3)
    plus, minus = (lambda g: log1p(exp(-g))), (lambda g: log1p(exp(g)))
    seen = set()
    for prior in (0.2, 0.6, 0.9):
        p, u = rng.normal(1, 1, (15, 4)), rng.normal(-0.5, 1, (25, 4))
        for scale in (0.1, 2.0):
            w = rng.normal(0, scale, 4)
            parts = lambda w: (prior * sum(plus(x @ w) for x in p) / 15, sum(minus(x @ w) for x in u) / 25 - prior * sum(minus(x @ w) for x in p) / 15)  # noqa: B023, E731
            assert np.allclose(q.risk(w, p, u, prior), parts(w))
            below = parts(w)[1] < 0
            seen.add(below)
            aim = (lambda w: -parts(w)[1]) if below else (lambda w: sum(parts(w)))  # noqa: B023
            plain = [(aim(w + 1e-6 * e) - aim(w - 1e-6 * e)) / 2e-6 for e in np.eye(4)]
            assert np.allclose(q.descent(w, p, u, prior), plain, atol=1e-5)
    assert seen == {True, False}


@pytest.mark.parametrize("share", [0.3, 0.5, 0.8])
def test_prior_from_positives_and_unlabelled(share):
    rng = np.random.default_rng(1)
    draw = lambda n, at: rng.normal(at, 1, (n, 6))
    n = int(4000 * share)
    unlabelled = np.concatenate([draw(n, 1), draw(4000 - n, -1)])
    assert abs(q.estimate_prior(draw(2000, 1), unlabelled[rng.permutation(4000)]) - share) < 0.08


def test_labelled_negatives_and_long_texts(tables, model):
    docs, labels = tables
    other = q.train(docs, labels.where("quality = 1"))
    assert np.array_equal(other.weights, model.weights) and other.prior == model.prior
    assert abs(model.prior - labels.agg(F.avg("quality")).first()[0]) < 0.1
    long = docs.withColumn("text", F.repeat("text", 12))
    assert q.train(long, labels).weights.any()
