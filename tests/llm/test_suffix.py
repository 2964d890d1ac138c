import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tessera.llm import suffix as sx


def brute(texts, length):
    seen = Counter()
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] += 1
    out = []
    for t in texts:
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))
        kept = bytes(np.frombuffer(t, dtype=np.uint8)[~gone])
        out.append((len(t), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(rng, unit, n):
    alphabet = ["a", "b", "é", "\n"] if unit < 100 else [f"{w} " for w in ("the", "of", "étude", "and", "for", "x")]
    word = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    shared = [word(rng.randint(unit // 2, unit * 3)) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = [word(rng.randint(0, unit * 2)) for _ in range(3)]
        for _ in range(rng.choice([0, 1, 1, 2])):
            s = shared[rng.randrange(6)]
            if rng.random() < 0.5 and s:
                k = rng.randrange(len(s))
                s = s[:k] + "Q" + s[k + 1 :]
            parts.insert(rng.randrange(4) % (len(parts) + 1), s)
        texts.append("".join(parts))
    texts += [texts[0], texts[1] + "z", "ab" * unit * 3, "c" * unit * 2, "", "short"]
    return texts


@pytest.mark.parametrize(("length", "gram", "seed"), [(200, 50, 1), (200, 50, 2), (24, 6, 3), (24, 10, 4), (9, 2, 5)])
def test_matches_brute_force(spark, length, gram, seed):
    rng = random.Random(seed)
    texts = corpus(rng, length, 60)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").selectExpr("*", "1 AS d", "2 AS k", "3 AS spans")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sx.remove_repeats(docs, length=length, gram=gram).collect()}
    want = brute([t.encode() for t in texts], length)
    assert [got[k] for k in range(len(texts))] == want
    assert sum(w[1] for w in want) > 0


def test_without_broadcasts(spark, monkeypatch):
    """Beyond BROADCAST_IDS all joins with ids shuffle."""
    from tessera.llm import common

    monkeypatch.setattr(common, "BROADCAST_IDS", 0)
    monkeypatch.setattr(sx, "REPS_ROWS", 0)
    texts = corpus(random.Random(6), 24, 50)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sx.remove_repeats(docs, length=24, gram=6).collect()}
    assert [got[k] for k in range(len(texts))] == brute([t.encode() for t in texts], 24)


@pytest.mark.parametrize("period", [1, 2, 7, 60, 150, 151, 260])
def test_periodic_texts(spark, period):
    unit = "".join(random.Random(period).choice("abcdefgh ") for _ in range(period))
    texts = [unit * (3000 // period), "xyz" + (unit * (900 // period + 1))[5:], unit[::-1] + unit + "q", (unit * 3)[:210], (unit * 4)[3:700]]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sx.remove_repeats(docs).collect()}
    assert [got[k] for k in range(len(texts))] == brute([t.encode() for t in texts], 200)


def test_very_long_periodic_texts(spark):
    texts = [" " * 2_000_000, "=-" * 500_000, " " * 300 + "end"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(tuple(r) for r in sx.remove_repeats(docs, with_kept=False).select("doc_id", "n_removed", "n_spans").collect()) == [(0, 2_000_000, 1), (1, 1_000_000, 1), (2, 300, 1)]


def test_ranks_are_places_in_sorted_order(spark):
    from tessera.llm.common import Scratch

    rows = spark.createDataFrame([(r, i, bytearray(p)) for r in range(3) for i in range(2) for p in (b"b", b"a", b"ab")], "rank long, i int, part binary").repartition(5)
    ranked = sx._ranked(rows, Scratch(spark), "rank", "i", "part").orderBy("new_rank").collect()
    keys = [(r["rank"], r.i, bytes(r.part)) for r in ranked]
    assert keys == sorted(keys) and len({r.new_rank for r in ranked}) == len(keys) == 18


def test_anchors_tile_all_windows():
    rng = np.random.default_rng(0)
    for n in (0, 199, 200, 201, 350, 351, 5000):
        data = rng.integers(97, 99, n).astype(np.uint8)
        _, at, _, first, last = sx.anchors([data.tobytes()])
        covered = [p for a, b in zip(first, last, strict=True) for p in range(a, b + 1)]
        assert covered == list(range(max(0, n - 199)))
        assert all(a <= x <= a + 150 and b <= x <= b + 150 for x, a, b in zip(at, first, last, strict=True))


def test_anchors_do_not_depend_on_the_chunk():
    rng = random.Random(4)
    parts = [bytes(rng.choice(b"abc ") for _ in range(rng.choice([0, 10, 199, 200, 900]))) for _ in range(30)]
    text, *rest = sx.anchors(parts)
    for i, part in enumerate(parts):
        for together, alone in zip(rest, sx.anchors([part])[1:], strict=True):
            assert np.array_equal(together[text == i], alone)


def test_repeated_rows_nulls_and_empty_tables(spark):
    text = "".join(random.Random(9).choice("abcdef ") for _ in range(500))
    rows = [(1, text), (1, text), (2, "x" + text), (None, text[:300]), (None, None), (3, None), (4, "é" * 100), (4, "y" * 120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in sx.remove_repeats(docs, with_kept=False).collect())
    assert got == sorted([("1", 500, 500)] * 2 + [("2", 501, 500), ("None", 300, 300), ("None", 0, 0), ("3", 0, 0), ("4", 200, 0), ("4", 120, 0)])
    assert sx.remove_repeats(docs.limit(0)).count() == 0
