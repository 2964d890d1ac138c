import hashlib
import math
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from tessera.llm import codes as c

DATA = "/root/testdata/sf0.001"
COLUMNS = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def plain(rows, rounds=4):
    """Rows of (vec_id, vector, label) in Python integers."""
    rows = [(i, [math.floor(1024 * x) for x in v], lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(rows[0][1]) // 4
    cut = lambda v: [tuple(v[p * w : p * w + w]) for p in range(4)]
    books = [[cut(v)[p] for _, v, _ in rows[:256]] for p in range(4)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(4):
            of = defaultdict(list)
            for _, v, _ in rows:
                of[near(cut(v)[p], books[p])[1]].append(cut(v)[p])
            books[p] = [tuple(sum(x) // len(of[k]) for x in zip(*of[k])) if k in of else e for k, e in enumerate(books[p])]
    out, sums = [], defaultdict(int)
    for i, v, lab in rows:
        best = [near(cut(v)[p], books[p]) for p in range(4)]
        out.append((i, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), lab))
        sums[lab] += out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, code, e, sums[lab], digest) for i, code, e, lab in out), key=str)


def test_against_brute_force(spark):
    r = random.Random(3)
    rows = [(k if k % 50 else None, [r.choice((r.gauss(0, 1), r.choice((0.0, 0.5, -0.25)))) for _ in range(8)], r.choice((None, 1, 2))) for k in range(320)]
    rows += [(5, rows[5][1], 1), (5, rows[5][1], 1), (5, rows[6][1], None), (400, None, 1), (401, [], 1), (402, [1.0] * 7 + [None], 2), (403, [float("nan")] * 8, 2), (404, [float("inf")] * 8, 2), (405, [1e5] * 8, 7)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "'x' AS code", "1 AS error", "2 AS vector", "3 AS _salt").repartition(7)
    want = plain(rows)
    assert got(c.encode(table)) == want
    old, c.BROADCAST_LABELS = c.BROADCAST_LABELS, 0
    try:
        assert got(c.encode(table)) == want
    finally:
        c.BROADCAST_LABELS = old


def test_few_rows_and_odd_lengths(spark):
    rows = [(1, [0.5] * 5, 1), (2, [0.1, 0.2, 0.3, 0.4], 1), (3, [0.1, 0.2, 0.3, 0.4], 2), (4, [1.0] * 8, 2)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    out = c.encode(table).orderBy("vec_id").collect()
    assert [(x.vec_id, x.code, x.error) for x in out] == [(2, "00000000", 0), (3, "00000000", 0)]
    assert c.encode(table.limit(0)).collect() == []


def test_components_of_any_size(spark):
    rows = [(k, [x] * 4, None) for k, x in enumerate((1e300, -1e300, 3e38, 0.0))]
    out = c.encode(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert len(out) == 4 and all(x.error >= 0 for x in out)


@pytest.mark.parametrize("size", [1, 2000, 10**7])
def test_nearest_is_exact(size):
    rng = np.random.default_rng(size)
    block, books = rng.integers(-size, size + 1, (4, 3, 700)), rng.integers(-size, size + 1, (4, 50, 3))
    codes, best = c.nearest(block, books)
    for p in range(4):
        d = ((block[p].T[:, None, :] - books[p][None]) ** 2).sum(axis=2)
        assert (codes[p] == d.argmin(axis=1)).all() and (best[p] == d.min(axis=1)).all()


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    cursor = con.execute(c.OP12_SQL)
    assert [d[0] for d in cursor.description] == COLUMNS
    assert got(c.op12_codes(spark, DATA)) == sorted(cursor.fetchall(), key=str)
