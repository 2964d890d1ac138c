import hashlib
import random

import pytest
from tokenizers import Tokenizer

from tessera.llm import bpe

PATH = bpe.default_tokenizer()


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(PATH)


def texts():
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "\t", "the", "The", "'s", "'LL", "é", "ß", "日本", "😀", "́", " ", "123", "½", "...", "<|endoftext|>", "<|end", "_", "a" * 30, "‍", "ñ", " ", "\x00", "don't"]
    out = ["", " ", "<|endoftext|>", " <|endoftext|> ", "x" * 5000, "ab" * 3000, "hello world", "!" * 999]
    return out + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(600)]


@pytest.mark.parametrize("lexicon", [[], ["the", " the", "The", "é", "日本", "...", "\n", "don", "a" * 30]])
def test_ids_match_the_library(library, vocabulary, lexicon, tmp_path):
    bpe.Lexicon.build({w.encode(): vocabulary.merged(w.encode()) for w in lexicon}).save(str(tmp_path / "l"))
    encoder = bpe.Encoder(vocabulary, bpe.Lexicon.open(str(tmp_path / "l")))
    sample = texts()
    for text, (ids, joined) in zip(sample, encoder.encode(sample), strict=True):
        assert joined == ",".join(map(str, ids))
        want = library.encode(text, add_special_tokens=False).ids
        assert ids == want, text
        assert vocabulary.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_plain_pattern_is_equal_where_it_is_used(vocabulary):
    rng = random.Random(1)
    every = [chr(c) for c in range(0x250)]
    for _ in range(20_000):
        text = "".join(rng.choice(every) for _ in range(8))
        if not vocabulary.odd.search(text):
            assert vocabulary.plain.findall(text) == vocabulary.pattern.findall(text)
    assert all(not vocabulary.odd.search(c) for c in "aé ß_ñ1.")


def test_lexicon_is_minimal_and_complete(tmp_path):
    words = {w.encode(): [k, k + 1][: k % 3] for k, w in enumerate(["stop", "stops", "top", "tops", "step", "steps", "a", "ab", "abc", "été", "s"])}
    lexicon = bpe.Lexicon.build(words)
    lexicon.save(str(tmp_path / "l"))
    lexicon = bpe.Lexicon.open(str(tmp_path / "l"))
    every = [*words, b"", b"st", b"stopsx", b"x", b"\xff"]
    found = lexicon.find(every)
    for w, n in zip(every, found.tolist(), strict=True):
        assert (n >= 0) == (w in words)
        if w in words:
            assert lexicon.ids_of(n) == words[w]
    suffixes = {tuple(sorted(w[k:] for w in words if w.startswith(p) and (k := len(p)) is not None)) for p in {w[:k] for w in words for k in range(len(w) + 1)}}
    assert len(lexicon.final) == len(suffixes)  # one state for each set of continuations


def test_long_merges_agree(vocabulary):
    rng = random.Random(0)
    for _ in range(200):
        word = bytes(rng.choice(b" thesaunr") for _ in range(rng.randint(1, 60)))
        slow = [vocabulary.byte_id[b] for b in word]
        while True:
            ranked = [(vocabulary.rank[a << 32 | b], k) for k, (a, b) in enumerate(zip(slow, slow[1:], strict=False)) if a << 32 | b in vocabulary.rank]
            if not ranked:
                break
            _, k = min(ranked)
            slow[k : k + 2] = [vocabulary.product[vocabulary.rank[slow[k] << 32 | slow[k + 1]]]]
        assert vocabulary.merged(word) == slow == vocabulary._merged_long([vocabulary.byte_id[b] for b in word])


def test_rows(spark, library):
    rows = [(k % 50, t) for k, t in enumerate(texts()[:120])] + [(7, None), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_tokens", "2 AS ids")
    out = bpe.encode(docs, PATH)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect())
    want = []
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((str(d), len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want)
    assert sorted(r.text for r in bpe.decode(out, PATH).collect()) == sorted(t or "" for _, t in rows)
    assert bpe.encode(docs.limit(0), PATH).count() == 0
