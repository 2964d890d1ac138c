"""Byte-level BPE encoding and decoding with a minimal acyclic transducer lexicon.

A text is split into pre-tokens by the tokenizer's pattern. The pre-tokens of frequent words, counted over
all documents, are compiled with their ids into one minimal acyclic automaton: words share prefixes and,
by merging equal states, suffixes. Each transition carries the number of words that sort before the
ones behind it, so the sum along a path is the word's number and leads to its ids (the transducer's
output). The automaton is four flat arrays in one file that every worker of a machine memory-maps.
All distinct pre-tokens of a chunk walk it together, a byte a step. A pre-token outside the lexicon is
merged exactly: the adjacent pair of the lowest rank, leftmost first, until no pair has a rank.

The lexicon only decides what is looked up and what is merged; ids are the same with any lexicon.

Special tokens of the tokenizer file are recognised in texts, as the library does. Decoding joins the
ids' bytes; bytes that are no UTF-8 become U+FFFD.

Defined results: null and empty texts have no ids and decode to an empty text; a row comes out for each
that goes in; an empty table has an empty lexicon; only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import Scratch
from tessera.llm.kernel import chunked, small_batches

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same pattern for the standard library's faster engine; equal where no character is in ODD: numbers that are no decimal
#: digits, separators of information, and all beyond Latin.
PLAIN_PATTERN = r""" ?[A-Za-zªµºÀ-ÖØ-öø-ɏ]++| ?[0-9]++|'(?:[stmd]|re|ve|ll)| ?(?:[^\s\w]|_)++|\s+(?!\S)|\s+"""
ODD = "[^\t\n\r\x20-\x7e\xa0-\xac\xae-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]"
LEXICON_WORDS = 65_536
#: A longer word is not kept in the lexicon.
LONG_WORD = 64
#: Characters of texts that are encoded together.
ENCODE_CHUNK = 1 << 19
#: Pre-tokens an encoder keeps from chunk to chunk.
KNOWN = 100_000
#: Distinct words a task counts before it hands the counts on.
COUNT_WORDS = 200_000
#: A pre-token of more symbols is merged with a heap, in n log n.
HEAP_FROM = 200


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, by rule: printable
    Latin-1 stands for itself, the other bytes for U+0100 and up, in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in printable}
    for k, b in enumerate(b for b in range(256) if b not in set(printable)):
        out[chr(256 + k)] = b
    return out


class Vocabulary:
    """A byte-level BPE tokenizer file: token bytes, merge ranks and special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], byte_alphabet()
        if spec["pre_tokenizer"]["type"] != "ByteLevel" or model.get("ignore_merges") or spec.get("normalizer"):
            raise ValueError(f"{path} is not a plain byte-level BPE")
        specials = [t for t in spec["added_tokens"]]
        self.special = {t["content"]: t["id"] for t in specials}
        size = max([*model["vocab"].values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, i in model["vocab"].items():
            self.bytes[i] = token.encode() if token in self.special else bytes(alphabet[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.byte_id = [model["vocab"][c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])]
        self.rank: dict[int, int] = {}  # by both ids in one number
        self.product: list[int] = []  # by rank
        vocab = model["vocab"]
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[a] << 32 | vocab[b]] = rank
            self.product.append(vocab[a + b])
        self.prefix_space = bool(spec["pre_tokenizer"].get("add_prefix_space"))
        self.pattern, self.plain, self.odd = regex.compile(PATTERN), re.compile(PLAIN_PATTERN), re.compile(ODD)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def pieces(self, text: str) -> Iterator[tuple[str, bool]]:
        """Stretches of ordinary text and special tokens."""
        if self.split_special is None or not any(s in text for s in self.special):
            if text:
                yield text, False
            return
        for k, part in enumerate(self.split_special.split(text)):
            if part:
                yield part, k % 2 == 1

    def words(self, text: str) -> list[str]:
        """The pre-tokens of ordinary text."""
        if self.prefix_space and text and not text[0].isspace():
            text = " " + text
        return self.pattern.findall(text) if self.odd.search(text) else self.plain.findall(text)

    def merged(self, word: bytes) -> list[int]:
        """Exact ids of one pre-token."""
        ids = [self.byte_id[b] for b in word]
        if len(ids) >= HEAP_FROM:
            return self._merged_long(ids)
        get, none = self.rank.get, len(self.product)
        ranks = [get(a << 32 | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks and (best := min(ranks)) < none:
            at = ranks.index(best)
            new = self.product[best]
            ids[at : at + 2] = [new]
            del ranks[at]
            if at < len(ranks):
                ranks[at] = get(new << 32 | ids[at + 1], none)
            if at:
                ranks[at - 1] = get(ids[at - 1] << 32 | new, none)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        import heapq

        n = len(ids)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        heap = []

        def push(a: int) -> None:
            b = right[a]
            if b < n and (rank := self.rank.get(ids[a] << 32 | ids[b])) is not None:
                heapq.heappush(heap, (rank, a, ids[a], ids[b], self.product[rank]))

        for a in range(n - 1):
            push(a)
        while heap:
            _, a, x, y, new = heapq.heappop(heap)
            b = right[a] if alive[a] else n
            if b >= n or ids[a] != x or ids[b] != y:
                continue
            ids[a], alive[b], right[a] = new, False, right[b]
            if right[b] < n:
                left[right[b]] = a
            push(a)
            if left[a] >= 0:
                push(left[a])
        return [i for i, live in zip(ids, alive, strict=True) if live]

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


class Lexicon:
    """A minimal acyclic automaton from words (bytes) to ids, in flat arrays.

    Transitions are sorted by state * 256 + byte. `key` holds that number, `to` the next state, `skip`
    the number of words that sort before those behind the transition; `final` marks states that end a word.
    """

    def __init__(self, key: np.ndarray, to: np.ndarray, skip: np.ndarray, final: np.ndarray, start: np.ndarray, ids: np.ndarray):
        self.key, self.to, self.skip, self.final, self.start, self.ids = key, to, skip, final, start, ids

    @classmethod
    def build(cls, words: dict[bytes, list[int]]) -> Lexicon:
        order = sorted(w for w in words if w)
        register: dict[tuple, int] = {}
        states: list[tuple[bool, tuple]] = []  # final, ((byte, state), ...)
        counts: list[int] = []

        def freeze(final: bool, edges: list[tuple[int, int]]) -> int:
            made = (final, tuple(edges))
            if made not in register:
                register[made] = len(states)
                states.append(made)
                counts.append(final + sum(counts[s] for _, s in edges))
            return register[made]

        open_nodes: list[list] = [[False, []]]  # along the last word: final, finished edges
        path: list[int] = []
        for w in order:
            common = 0
            while common < min(len(path), len(w)) and path[common] == w[common]:
                common += 1
            while len(path) > common:
                final, edges = open_nodes.pop()
                open_nodes[-1][1].append((path.pop(), freeze(final, edges)))
            for b in w[common:]:
                path.append(b)
                open_nodes.append([False, []])
            open_nodes[-1][0] = True
        while path:
            final, edges = open_nodes.pop()
            open_nodes[-1][1].append((path.pop(), freeze(final, edges)))
        root = freeze(*open_nodes.pop())
        # the root gets number 0
        number = {root: 0}
        for s in range(len(states)):
            if s != root:
                number[s] = len(number)
        rows = []
        final_flags = np.zeros(len(states), dtype=np.uint8)
        for s, (final, edges) in enumerate(states):
            final_flags[number[s]] = final
            before = int(final)
            for byte, t in edges:
                rows.append((number[s] * 256 + byte, number[t], before))
                before += counts[t]
        rows.sort()
        table = np.array(rows, dtype=np.int64).reshape(-1, 3)
        lengths = np.array([len(words[w]) for w in order], dtype=np.int64)
        ids = np.array([i for w in order for i in words[w]], dtype=np.int32)
        return cls(
            table[:, 0].astype(np.uint32), table[:, 1].astype(np.uint32), table[:, 2].astype(np.uint32), final_flags, np.concatenate(([0], np.cumsum(lengths))).astype(np.uint32), ids
        )

    def dump(self) -> bytes:
        parts = [self.key, self.to, self.skip, self.final, self.start, self.ids]
        head = np.array([len(p) for p in parts], dtype=np.int64).tobytes()
        return head + b"".join(p.tobytes() + b"\0" * (-p.nbytes % 8) for p in parts)

    def save(self, path: str) -> None:
        with open(path, "wb") as f:
            f.write(self.dump())

    @classmethod
    def open(cls, path: str) -> Lexicon:
        raw = np.memmap(path, dtype=np.uint8, mode="r")
        lengths = raw[:48].view(np.int64)
        at, parts = 48, []
        for n, kind in zip(lengths, (np.uint32, np.uint32, np.uint32, np.uint8, np.uint32, np.int32), strict=True):
            size = int(n) * np.dtype(kind).itemsize
            parts.append(raw[at : at + size].view(kind))
            at += size + (-size % 8)
        return cls(*parts)

    def find(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, or -1; all words walk together."""
        out = np.full(len(words), -1, dtype=np.int64)
        if not len(self.key) or not words:
            return out
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        begin = np.cumsum(lengths) - lengths
        live, state, total, step = np.flatnonzero(lengths > 0), np.zeros(int((lengths > 0).sum()), dtype=np.int64), None, 0
        total = np.zeros(len(live), dtype=np.int64)
        while len(live):
            want = (state * 256 + data[begin[live] + step]).astype(np.uint32)
            at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            ok = self.key[at] == want
            live, at, total = live[ok], at[ok], total[ok]
            state, total, step = self.to[at].astype(np.int64), total + self.skip[at], step + 1
            done = lengths[live] == step
            ends = done & (self.final[state] == 1)
            out[live[ends]] = total[ends]
            live, state, total = live[~done], state[~done], total[~done]
        return out

    def ids_of(self, number: int) -> list[int]:
        return self.ids[self.start[number] : self.start[number + 1]].tolist()

    def __len__(self) -> int:
        return len(self.start) - 1


class Merges:
    """The vocabulary's merges and token bytes as flat arrays, and exact merging of many words at once."""

    NONE = np.int32(2**31 - 1)

    def __init__(self, vocabulary: Vocabulary):
        keys = np.fromiter(vocabulary.rank.keys(), np.uint64, len(vocabulary.rank))
        ranks = np.fromiter(vocabulary.rank.values(), np.int32, len(keys))
        order = np.argsort(keys)
        self.key, self.rank = np.append(keys[order], _LAST), np.append(ranks[order], self.NONE)
        self.product = np.array([*vocabulary.product, 0], dtype=np.int32)
        self.byte_id = np.array(vocabulary.byte_id, dtype=np.int32)
        first = np.repeat(self.byte_id, 256), np.tile(self.byte_id, 256)
        self.of_bytes = self._ranks(*first)  # by two bytes
        self.token_start = np.concatenate(([0], np.cumsum([len(b) for b in vocabulary.bytes])))
        self.token_bytes = np.frombuffer(b"".join(vocabulary.bytes), dtype=np.uint8)
        self.token_size = np.diff(self.token_start)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        want = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        at = np.searchsorted(self.key, want)
        return np.where(self.key[at] == want, self.rank[at], self.NONE)

    def merge(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, ids a word) of words that stand one after another in data, none of them empty. In each round
        every word merges its pair of the lowest rank, of equal ones the leftmost; finished words leave."""
        symbols = self.byte_id[data]
        pair = np.full(len(data), self.NONE, dtype=np.int32)
        pair[:-1] = self.of_bytes[data[:-1].astype(np.int32) << 8 | data[1:]]
        ends = np.cumsum(lengths)
        pair[ends - 1] = self.NONE
        word, start, size = np.arange(len(lengths)), ends - lengths, lengths.astype(np.int64)
        count = np.zeros(len(lengths), dtype=np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(word):
            # rank and place in one number: the least one is the leftmost pair of the lowest rank
            least = np.minimum.reduceat(pair.astype(np.int64) << 32 | np.arange(len(pair)), start)
            rank, at = least >> 32, least & 0xFFFFFFFF
            more = rank != self.NONE
            if not more.all():
                gone = np.repeat(~more, size)
                count[word[~more]] = size[~more]
                done.append((np.repeat(word[~more], size[~more]), symbols[gone]))
                moved = np.cumsum(gone) - gone
                at = (at - moved[at])[more]
                symbols, pair, word, size, rank = symbols[~gone], pair[~gone], word[more], size[more], rank[more]
                start = np.cumsum(size) - size
                if not len(word):
                    break
            symbols[at] = self.product[rank]
            keep = np.ones(len(symbols), dtype=bool)
            keep[at + 1] = False
            last = at + 1 == start + size - 1  # the merged pair ends its word
            symbols, pair = symbols[keep], pair[keep]
            shift = np.arange(len(word))
            at, start, size = at - shift, start - shift, size - 1
            pair[at[last]] = self.NONE
            right = at[~last]
            pair[right] = self._ranks(symbols[right], symbols[right + 1])
            left = at[at > start] - 1
            pair[left] = self._ranks(symbols[left], symbols[left + 1])
        owner, ids = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.empty(0, np.int64), np.empty(0, np.int32))
        return ids[np.argsort(owner, kind="stable")], count

    def bytes_of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, and how many each has."""
        size = self.token_size[ids]
        return self.token_bytes[_slices(self.token_start[ids], size)], size


_LAST = np.uint64(2**64 - 1)


def _slices(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of all slices, one after another."""
    out = np.arange(int(size.sum()))
    out += np.repeat(start - np.cumsum(size) + size, size)
    return out


class Encoded:
    """A chunk's ids in one array, how many each text has, and their decimal forms joined by commas."""

    __slots__ = ("ids", "count", "joined")

    def __init__(self, ids: np.ndarray, count: np.ndarray, joined: list[str]):
        self.ids, self.count, self.joined = ids, count, joined


class Encoder:
    """Encodes chunks of texts. The distinct new pre-tokens of a chunk walk the lexicon together, and those outside it are
    merged together. What is known is kept for the next chunks, up to KNOWN pre-tokens; then it is forgotten, as it can be
    found again."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon):
        self.vocabulary, self.lexicon, self.merges = vocabulary, lexicon, Merges(vocabulary)
        self._decimal = list(map(str, range(len(vocabulary.bytes))))
        self._forget()

    def _forget(self) -> None:
        """Only the special tokens are known; their numbers come first."""
        special = list(self.vocabulary.special.values())
        self._special = dict(zip(self.vocabulary.special, range(len(special)), strict=True))
        self._known: dict[str, int] = {}
        self._joined = list(map(str, special))
        self._ids, self._size = [np.array(special, dtype=np.int32)], [np.ones(len(special), dtype=np.int64)]

    def _learn(self, words: list[str]) -> None:
        """Give each new word a number; its ids and their decimal form stand under it."""
        v = self.vocabulary
        data = [w.encode("utf-8", "replace") for w in words]
        number = self.lexicon.find(data)
        starts = self.lexicon.start.astype(np.int64)
        size = np.zeros(len(words), dtype=np.int64)
        held = np.flatnonzero(number >= 0)
        size[held] = starts[number[held] + 1] - starts[number[held]]
        lengths = np.fromiter(map(len, data), np.int64, len(data))
        short = np.flatnonzero((number < 0) & (lengths < HEAP_FROM))
        long = np.flatnonzero((number < 0) & (lengths >= HEAP_FROM))
        merged, size[short] = self.merges.merge(np.frombuffer(b"".join([data[i] for i in short]), dtype=np.uint8), lengths[short])
        others = [v.merged(data[i]) for i in long]
        size[long] = [len(x) for x in others]
        begin = np.cumsum(size) - size
        ids = np.empty(int(size.sum()), dtype=np.int32)
        ids[_slices(begin[held], size[held])] = self.lexicon.ids[_slices(starts[number[held]], size[held])]
        ids[_slices(begin[short], size[short])] = merged
        for i, x in zip(long, others, strict=True):
            ids[begin[i] : begin[i] + size[i]] = x
        written = list(map(self._decimal.__getitem__, ids.tolist()))
        self._known.update(zip(words, range(len(self._joined), len(self._joined) + len(words)), strict=True))
        self._joined += [",".join(written[a:b]) for a, b in zip(begin.tolist(), (begin + size).tolist(), strict=True)]
        self._ids.append(ids)
        self._size.append(size)

    def encode_chunk(self, texts: list[str]) -> Encoded:
        v = self.vocabulary
        if len(self._known) > KNOWN:
            self._forget()
        split = [[(self._special[p], None) if special else (None, v.words(p)) for p, special in v.pieces(t)] for t in texts]
        new: set[str] = set()
        for parts in split:
            for _, words in parts:
                if words:
                    new.update(words)
        new.difference_update(self._known)
        if new:
            self._learn(list(new))
        known, codes, joined, n_words = self._known, [], [], []
        for parts in split:
            own: list[int] = []
            for special, words in parts:
                if special is not None:
                    own.append(special)
                else:
                    own += map(known.__getitem__, words)
            joined.append(",".join(map(self._joined.__getitem__, own)))
            codes.append(np.array(own, dtype=np.int64))
            n_words.append(len(own))
        if len(self._ids) > 1:
            self._ids, self._size = [np.concatenate(self._ids)], [np.concatenate(self._size)]
        size = self._size[0]
        every = np.concatenate(codes) if codes else np.empty(0, np.int64)
        counts = size[every]
        ids = self._ids[0][_slices((np.cumsum(size) - size)[every], counts)]
        ends = np.concatenate(([0], np.cumsum(counts)))[np.cumsum([0, *n_words])]
        return Encoded(ids, np.diff(ends), joined)

    def encode(self, texts: list[str]) -> list[tuple[list[int], str]]:
        """The ids of each text, and their decimal form joined by commas."""
        found = self.encode_chunk(texts)
        ends = np.cumsum(found.count).tolist()
        return [(found.ids[a:b].tolist(), j) for a, b, j in zip([0, *ends], ends, found.joined, strict=False)]

    def decode_chunk(self, ids: np.ndarray, count: np.ndarray) -> list[str]:
        """The text of each run of ids."""
        data, size = self.merges.bytes_of(ids)
        ends = np.concatenate(([0], np.cumsum(size)))[np.cumsum([0, *count])].tolist()
        whole = data.tobytes()
        return [whole[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:], strict=False)]


def frequent_words(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", n: int = LEXICON_WORDS) -> list[str]:
    """The pre-tokens of the about n most frequent words of all documents, words standing between white space.

    Each task hands on a count for each of its distinct words; the least count that leaves at most n words is read off a
    histogram, so no more than n words reach the driver, whatever the number of tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
        for batch in small_batches(batches):
            for t in batch.column(0).to_pylist():
                counts.update((t or "").split())
            if len(counts) > COUNT_WORDS:
                yield out()
                counts.clear()
        yield out()

    scratch = Scratch(docs.sparkSession)
    counted = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "word string, n long").where(F.octet_length("word") <= LONG_WORD)
    words = scratch.save(counted.groupBy("word").agg(F.sum("n").alias("n")).where("n > 1"), "words")
    # counts on a scale of ten steps an octave
    step = F.floor(F.log2("n") * 10).cast("int")
    histogram = sorted(((r.step, r["count"]) for r in words.groupBy(step.alias("step")).count().collect()), reverse=True)
    total, least = 0, None
    for s, count in histogram:
        if total + count > n:
            break
        total, least = total + count, s
    found = [] if least is None else [r.word for r in words.where(step >= least).select("word").collect()]
    scratch.drop("words")
    pieces = {p for w in found for p in (*vocabulary.words(" " + w), *vocabulary.words(w))}
    return sorted(pieces)


def compile_lexicon(spark: SparkSession, vocabulary: Vocabulary, words: list[str]) -> str:
    """Compile words with their ids, write the file to the shared folder and let every machine fetch it; returns its name there."""
    data = Lexicon.build({(b := w.encode()): vocabulary.merged(b) for w in words}).dump()
    name = "lexicon-" + hashlib.sha256(data).hexdigest()[:24]
    served = _served.setdefault(spark.sparkContext.applicationId, set())
    if name not in served:
        spark.sparkContext.addFile(Scratch(spark).write_bytes(data, name))
        served.add(name)
    return name


_served: dict[str, set[str]] = {}


@lru_cache(maxsize=1)
def _encoder(tokenizer: str, lexicon: str) -> Encoder:
    """A worker's encoder, kept for the tasks to come."""
    return Encoder(Vocabulary(tokenizer), Lexicon.open(SparkFiles.get(lexicon)))


ENCODED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
    ]
)


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the text decoded from them, and the ids."""
    spark = docs.sparkSession
    vocabulary = Vocabulary(tokenizer)
    name = compile_lexicon(spark, vocabulary, frequent_words(docs, vocabulary, text_col, lexicon_words))
    schema = ENCODED if with_ids else T.StructType(ENCODED.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer, name)
        for batch in small_batches(batches):
            n, digest, decoded, every = [], [], [], []
            for _, texts in chunked(batch.column(1).to_pylist(), ENCODE_CHUNK):
                found = encoder.encode_chunk(texts)
                n += found.count.tolist()
                digest += [hashlib.sha256(j.encode()).hexdigest() for j in found.joined]
                decoded += [hashlib.sha256(t.encode()).hexdigest() for t in encoder.decode_chunk(found.ids, found.count)]
                if with_ids:
                    every.append(pa.array(found.ids, pa.int32()))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(decoded, pa.string())]
            if with_ids:
                flat = pa.concat_arrays(every) if every else pa.array([], pa.int32())
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), flat))
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the text of its ids; null ids are an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(tokenizer)
        for batch in small_batches(batches, rows=128):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([vocabulary.decode(ids or []) for ids in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col)).mapInArrow(run, "doc_id long, text string")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer(), with_ids=False)
