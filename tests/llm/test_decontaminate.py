import random
import re

import numpy as np
import pytest

from tessera.llm import decontaminate as dc

WORDS = [f"w{i}" for i in range(3000)]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def brute_pairs(docs, items):
    """Every diagonal of every pair: contaminated if some stretch of 13 words or the item has 80 % equal words."""
    out = set()
    for d, text in docs:
        w = re.findall(r"[a-z0-9]+", (text or "").lower())
        for k, item in items:
            v = re.findall(r"[a-z0-9]+", (item or "").lower())
            if len(v) < 4:
                continue
            need = min(13, len(v))
            for dg in range(-len(v), len(w)):
                a, b = max(0, -dg), min(len(v), len(w) - dg)
                eq = [v[i] == w[i + dg] for i in range(a, b)]
                for s in range(len(eq)):
                    for e in range(s + need, len(eq) + 1):
                        if eq[s] and eq[e - 1] and sum(eq[s:e]) >= 0.8 * (e - s) - 1e-9:
                            out.add((d, k))
                if sum(eq) >= 0.8 * len(v) and eq:
                    out.add((d, k))
    return out


def test_longest_stretch():
    rng = np.random.default_rng(0)
    for _ in range(500):
        eq = rng.random(rng.integers(0, 30)) < rng.choice([0.3, 0.6, 0.8])
        best = 0
        for a in range(len(eq)):
            for b in range(a + 1, len(eq) + 1):
                if eq[a] and eq[b - 1] and eq[a:b].sum() >= 0.8 * (b - a) - 1e-9:
                    best = max(best, b - a)
        a, b = dc.longest_stretch(eq, 0.8)
        assert b - a == best, (eq, a, b, best)


@pytest.mark.parametrize("block_words", [1_000_000, 60])
def test_pairs_match_brute_force(spark, block_words):
    rng = random.Random(5)
    items = [(i, sentence(rng, rng.randint(14, 40))) for i in range(12)] + [(50, None), (51, "too short"), (52, "")]
    docs = []
    for d in range(80):
        words = sentence(rng, rng.randint(0, 80)).split()
        if d % 2:
            item = items[rng.randrange(12)][1].split()
            rate = rng.choice([0, 0.1, 0.15, 0.5])
            item = [rng.choice(WORDS) if rng.random() < rate else w for w in item]
            at = rng.randint(0, len(words))
            words[at:at] = item
        docs.append((d, " ".join(words).upper() if d % 3 else " ".join(words)))
    docs += [(900, None), (901, ""), (None, docs[1][1]), (1, docs[1][1])]
    table = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id", "'x' AS lang")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "2 AS doc_id")
    got = [(r.doc_id, r.item_id) for r in dc.find_contamination(table, bench, block_words=block_words).collect()]
    want = brute_pairs(docs, items)
    assert set(got) == want and len(want) > 15
    assert len(got) == len([1 for d, t in docs for k in {p[1] for p in want if p[0] == d}])
    kept = dc.drop_contaminated(table, bench, block_words=block_words)
    assert kept.columns == table.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, _ in docs if d not in {p[0] for p in want})


def test_dropped_word_is_bridged(spark):
    rng = random.Random(1)
    item = sentence(rng, 16).split()
    docs = spark.createDataFrame([(1, " ".join(item[:8] + item[9:])), (2, " ".join(item[:8] + ["zz"] + item[8:])), (3, " ".join(item[:7]))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    assert sorted(r.doc_id for r in dc.find_contamination(docs, bench).collect()) == [1, 2]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert dc.find_contamination(docs, bench).count() == 0
    assert dc.drop_contaminated(docs, bench).count() == 1
    assert dc.find_contamination(docs.limit(0), spark.createDataFrame([(1, "a b c d")], "item_id long, text string")).count() == 0


def test_some_mask_fits_between_all_substitutions_of_short_items():
    import itertools

    masks = [dc._offsets(m) for m in dc.MASKS + dc.SHORT_MASKS]
    for n in range(dc.LEAST, 22):
        for gone in itertools.combinations(range(n), n // 5):
            usable = masks if n <= dc.SHORT else masks[: len(dc.MASKS)]
            assert any(not set(gone) & {at + o for o in m} for m in usable for at in range(n - m[-1])), (n, gone)


def test_short_items_match_brute_force():
    rng = random.Random(8)
    for n in range(1, 16):
        item = sentence(rng, n)
        index = dc.Index([(n, item)])
        v = item.split()
        docs = []
        for k in range(n):  # one substitution at every place
            w = list(v)
            w[k] = "other"
            docs += [" ".join(w), "left " + " ".join(w) + " right"]
        docs += [item, "left " + item + " right", sentence(rng, 30), "", v[0]]
        for text in docs:
            words = dc.Tokens([text]).of(0)
            got = list(index.overlaps(words, 0.8, 13, index.diagonals(words)))
            want = text.split() == v if n < 4 else bool(brute_pairs([(0, text)], [(n, item)]))
            assert bool(got) == want, (n, text)


def test_repeated_words_do_not_square():
    import time

    rng = random.Random(2)
    item = " ".join(["same"] * 2000)
    almost = " ".join("same" if k % 11 else "other" for k in range(2000))
    mixed = " ".join(rng.choice(["same", "other"]) for _ in range(3000))
    index = dc.Index([(1, item), (2, almost), (3, sentence(rng, 30))])
    begin = time.process_time()
    for text, want in ((" ".join(["same"] * 2000), {1, 2}), (" ".join(["same"] * 20_000), {1, 2}), (almost, {1, 2}), (mixed, None), (sentence(rng, 5000), set())):
        words = dc.Tokens([text]).of(0)
        found = {index.ids[r[0]] for r in index.overlaps(words, 0.8, 13, index.diagonals(words))}
        assert want is None or found == want
    assert time.process_time() - begin < 30


def test_differences():
    rng = np.random.default_rng(1)
    for n in (1, 5, 300, 900):
        a, b = np.unique(rng.integers(0, 3 * n, n)), np.unique(rng.integers(0, 2 * n, n))
        assert np.array_equal(dc.differences(a, b), np.unique(a[:, None] - b[None, :]))
