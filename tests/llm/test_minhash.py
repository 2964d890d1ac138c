import random
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import minhash as mh


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    for ratio in (0.2, 0.5, 0.8, 0.95):
        elements = rng.integers(0, 2**63, 400).astype(np.uint64)
        a = rng.integers(1, 6, 400) * rng.choice([0.5, 1.0, 1.7], 400)
        b = np.where(rng.random(400) < ratio, a, a * rng.random(400))
        sig = mh.dart_signatures(np.concatenate([elements, elements]), np.concatenate([a, b]), np.repeat([0, 1], 400), 2, k=4096)
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert abs((sig[0] == sig[1]).mean() - want) < 0.04
        assert (sig != 0).all()


def test_signature_does_not_depend_on_the_chunk():
    rng = np.random.default_rng(2)
    e, w = rng.integers(0, 2**63, 900).astype(np.uint64), np.ones(900)
    owner = np.repeat([0, 1, 3], 300)
    sig = mh.dart_signatures(e, w, owner, 4)
    for s, part in ((0, slice(0, 300)), (1, slice(300, 600)), (3, slice(600, 900))):
        assert (mh.dart_signatures(e[part], w[part], np.zeros(300, np.int64), 1)[0] == sig[s]).all()
    assert (sig[2] == 0).all()


def brute_classes(docs):
    """Union of all pairs of equal words or weighted Jaccard of five-word runs of at least 0.8."""
    sets = {}
    for d, t in docs:
        w = re.findall(r"\w+", (t or "").lower())
        sets[d] = Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b]:
                low, high = (sets[a] & sets[b]).total(), (sets[a] | sets[b]).total()
                if low / high >= 0.8 and root(a) != root(b):
                    parent[max(root(a), root(b))] = min(root(a), root(b))
    return {d: root(d) for d in ids}


@pytest.mark.parametrize("seed", [3, 4])
def test_classes_match_brute_force(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    docs, n = [], 0
    shared = [rng.choice(vocabulary) for _ in range(60)]
    for g in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(20, 200))]
        if g % 3 == 0:
            base = base[:50] + shared  # a passage many documents share
        for _ in range(rng.choice([1, 1, 2, 12])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            docs.append((n, " ".join(words) if n % 4 else " ".join(words).upper() + "!"))
            n += 1
    docs += [(n, None), (n + 1, ""), (n + 2, "..."), (n + 3, "a b"), (n + 4, "A, b."), (n + 5, "a b c")]
    rng.shuffle(docs)
    table = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS copy_id", "'x' AS a")
    got = {r.doc_id: r.class_id for r in mh.find_near_duplicates(table).classes.collect()}
    assert got == brute_classes(docs)
    kept = mh.drop_near_duplicates(table)
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for c in got.values()})


def test_links_outside_the_star_are_found(spark):
    """A template whose copies are too far from the least one and from each other, but for planted pairs."""
    rng = random.Random(8)
    base = [f"t{i}" for i in range(240)]
    docs, n = [], 0

    def changed(words, k):
        out = list(words)
        for i in rng.sample(range(len(out)), k):
            out[i] = f"c{rng.randrange(10**9)}"
        return out

    for g in range(70):
        own = changed(base, 9)
        docs.append((n, " ".join(own)))
        n += 1
        if g % 7 == 0:
            docs.append((n, " ".join(changed(own, 2))))
            n += 1
    rng.shuffle(docs)
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in mh.find_near_duplicates(table).classes.collect()}
    assert got == brute_classes(docs)
    assert len(set(got.values())) < len(got)


def test_repeated_rows_and_nulls(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text), (1, text), (2, text.upper()), (None, text), (None, text), (3, None), (3, None), (4, "solo text")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.class_id)) for r in mh.find_near_duplicates(table).classes.collect())
    assert got == sorted([("1", "1"), ("1", "1"), ("2", "1"), ("None", "None"), ("None", "None"), ("3", "3"), ("3", "3"), ("4", "4")])
    assert sorted(str(r.doc_id) for r in mh.drop_near_duplicates(table).collect()) == sorted(["1", "None", "None", "3", "3", "4"])
    assert mh.find_near_duplicates(table.limit(0)).classes.count() == 0
    assert mh.drop_near_duplicates(table.limit(0)).count() == 0


def test_one_id_with_different_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    near = b.replace("b39", "other")
    rows = [(1, a), (1, b), (1, b), (2, near), (3, c), (3, c + " more"), (4, a), (4, None), (4, None), (5, "...")]
    table = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_words", "2 AS copy_a", "'x' AS _words", "3 AS class_id")
    result = mh.find_near_duplicates(table)
    assert sorted((r.doc_id, r.class_id) for r in result.classes.collect()) == [(1, 1), (1, 1), (1, 1), (2, 1), (3, 3), (3, 3), (4, 1), (4, 4), (4, 4), (5, 5)]
    assert sorted((r.a, r.b) for r in result.links.collect()) == [(1, 2), (3, 3)]
    kept = mh.drop_near_duplicates(table)
    assert kept.columns == table.columns
    got = sorted((r.doc_id, r.text or "") for r in kept.collect())
    # texts of one id and class are told apart by their words: one of each class stays
    assert [g for g in got if g[0] > 1] in ([(3, c), (4, ""), (4, ""), (5, "...")], [(3, c + " more"), (4, ""), (4, ""), (5, "...")])
    assert [g for g in got if g[0] == 1] == [(1, a), (1, b)]


def test_hot_leaders_and_large_buckets(spark, monkeypatch):
    """With tiny limits, a hub's pairs are dealt out and all buckets go to the exact search; the classes are the same."""
    from tessera.llm import common

    monkeypatch.setattr(mh, "FOLLOWERS", 3)
    monkeypatch.setattr(mh, "BUCKET", 2)
    monkeypatch.setattr(mh, "BROADCAST_IDS", 0)
    monkeypatch.setattr(common, "BROADCAST_IDS", 0)
    rng = random.Random(12)
    base = [f"t{i}" for i in range(200)]
    docs = []
    for n in range(60):
        words = list(base)
        for i in rng.sample(range(200), rng.choice([0, 1, 2, 9])):
            words[i] = f"c{rng.randrange(10**9)}"
        docs.append((n, " ".join(words)))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in mh.find_near_duplicates(table).classes.collect()} == brute_classes(docs)


def test_components(spark):
    from tessera.llm.common import Scratch, connected_components

    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7), (200, 100)] + [(500, k) for k in range(501, 560)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90, 200: 90, **{k: 500 for k in range(500, 560)}}
