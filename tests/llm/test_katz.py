import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import katz as k

DATA = "/root/testdata/sf0.001"
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BEGIN, END, UNKNOWN = "<s>", "</s>", "<unk>"


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP)), END]


def discount(counts):
    n = Counter(counts)
    for top in range(k.K, 0, -1):
        if not all(n[r] for r in range(1, top + 2)):
            continue
        a = (top + 1) * n[top + 1] / n[1]
        if a >= 1:
            continue
        d = {r: ((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) for r in range(1, top + 1)}
        if all(0 < x < 1 for x in d.values()):
            return d
    return {}


class Plain:
    """The model by the book, in dictionaries."""

    def __init__(self, texts, order):
        self.order, self.after = order, [defaultdict(Counter) for _ in range(order)]
        for t in texts:
            seq = [BEGIN, *tokens(t)]
            for i in range(1, len(seq)):
                for n in range(min(order, i + 1)):
                    self.after[n][tuple(seq[i - n : i])][seq[i]] += 1
        self.d = [discount([c for own in level.values() for c in own.values()]) for level in self.after]

    def _seen(self, ctx):
        own, d = self.after[len(ctx)].get(ctx, {}), self.d[len(ctx)]
        total = sum(own.values()) + (bool(own) and not any(c in d for c in own.values()))
        return {w: d.get(c, 1) * c / total for w, c in own.items()}

    def p(self, ctx, w):
        seen = self._seen(ctx)
        if w in seen:
            return seen[w]
        left = 1 - sum(seen.values())
        if not ctx:
            return left
        if not seen:
            return self.p(ctx[1:], w)
        return left / (1 - sum(self.p(ctx[1:], x) for x in seen)) * self.p(ctx[1:], w)

    def score(self, text):
        seq = [BEGIN, *tokens(text)]
        return sum(math.log10(self.p(tuple(seq[max(0, i - self.order + 1) : i]), seq[i])) for i in range(1, len(seq)))


def made(n, seed, words=40):
    r = random.Random(seed)
    names = [f"w{i}" for i in range(words)] + ["É", "Ab", "aB", "x\x0by", "-"]
    return [(i, " ".join(r.choice(names[: r.choice((3, 8, len(names)))]) for _ in range(r.choice((0, 1, 5, 60))))) for i in range(n)]


def compare(spark, rows, order, **sizes):
    """rows: (doc_id, text, held)"""
    table = spark.createDataFrame(rows, "doc_id long, text string, held boolean").selectExpr("*", "1 AS block", "'x' AS kind", "2 AS score").repartition(3)
    got = sorted(k.score(table, F.col("held"), order, **sizes).collect(), key=str)
    train = [t for _, t, held in rows if not held]
    model = Plain(train, order)
    times = Counter(w for t in train for w in tokens(t))
    n = sum(times.values())
    want = []
    for i, t, held in rows:
        ws = tokens(t)
        want.append((i, held, len(ws), sum(w in times for w in ws), n, sum(math.log10((times[w] + 0.1) / (n + 0.1 * (len(times) + 1))) for w in ws), model.score(t)))
    want.sort(key=str)
    key = lambda r: (str(r[0]), r[1], r[2], round(r[6], 6))
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert tuple(a)[:5] == b[:5]
        assert np.allclose(a[5:], b[5:], rtol=1e-9, atol=1e-9)
    return model


@pytest.mark.parametrize("order", [1, 2, 3, 4])
@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, order, small):
    rows = [(i, t, i % 4 == 0) for i, t in made(160, order)]
    rows += [(1000, None, False), (1001, "", True), (None, "w1 w2 w3", False), (None, "w1 w2 w3", False), (7, "w1 w2 zz w3", True), (7, "w1 w2 zz w3", True), (1002, "w1 w2 " * 5000, True)]
    rows += [(2000 + i, "all alone here", False) for i in range(9)]  # contexts whose counts are all large
    rows += [(3000, "all alone there", True), (3001, "all w1 here", True)]
    compare(spark, rows, order, **({"block_bytes": 300, "part_entries": 400} if small else {}))


def test_probabilities_sum_to_one():
    texts = [t for _, t in made(150, 9)] + ["all alone here"] * 9
    for order in (1, 2, 3):
        m = Plain(texts, order)
        words = [*m.after[0][()], UNKNOWN]
        contexts = {c for level in m.after for c in level} | {("never",), ("w1", "never")}
        for ctx in sorted(c for c in contexts if len(c) < order)[:60]:
            assert abs(sum(m.p(ctx, w) for w in words) - 1) < 1e-9


def test_no_valid_discount_and_no_training(spark):
    compare(spark, [(1, "a a a a a a a", False), (2, "a b", True)], 3)
    compare(spark, [(1, "a b", True), (2, None, True)], 2)
    assert k.score(spark.createDataFrame([], "doc_id long, text string"), F.lit(True)).collect() == []
    assert k.discounts([]) == [] and k.discounts([5, 0, 3]) == [] and all(0 < d < 1 for d in k.discounts([100, 30, 12]))


def test_query_scores_held_out_texts_better_than_the_base(spark):
    got = k.op13_katz(spark, DATA).toPandas()
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert len(got) == docs.count() and got.doc_id.is_unique
    fold = docs.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 10 == 0).alias("held")).toPandas().set_index("doc_id").held
    assert (got.set_index("doc_id").held_out == fold).all() and 0 < fold.sum() < len(fold)
    out = got[got.held_out]
    assert (got.score <= 0).all() and np.isfinite(got.score).all() and out.score.sum() > out.base_score.sum()


def test_a_block_takes_a_small_multiple_of_its_tokens(spark, monkeypatch, tmp_path):
    """Memory of the steps that hold a whole block: 62 bytes a token of these texts before, now 36."""

    def measured(make, name):
        def made(*args):
            run = make(*args)

            def traced(left, right):
                import tracemalloc

                tracemalloc.start()
                try:
                    return run(left, right)
                finally:
                    (tmp_path / name).write_text(str(tracemalloc.get_traced_memory()[1]))
                    tracemalloc.stop()

            return traced

        return made

    monkeypatch.setattr(k, "_asker", measured(k._asker, "asker"))
    monkeypatch.setattr(k, "_scorer", measured(k._scorer, "scorer"))
    r = random.Random(4)
    rows = [(i, " ".join(f"w{int(r.paretovariate(0.7)) % 20000}" for _ in range(2000)), i % 10 == 0) for i in range(200)]
    got = k.score(spark.createDataFrame(rows, "doc_id long, text string, held boolean").coalesce(1), F.col("held")).collect()
    tokens_ = sum(x.n_tokens for x in got)
    peaks = {name: int((tmp_path / name).read_text()) / tokens_ for name in ("asker", "scorer")}
    assert len(got) == 200 and tokens_ == 400_200 and max(peaks.values()) < 48, peaks
