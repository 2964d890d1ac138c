"""Near-duplicate documents with DartMinHash signatures and a banded join.

A text is a weighted set: its runs of five words, each with the times it occurs. Darts are the points
of a unit-rate Poisson process over (element, weight, rank): for each unit of an element's weight the
ranks of its darts are sums of exponential gaps drawn from a hash, so equal elements of different
texts throw equal darts. Each dart belongs to one of K coordinates; a text's signature keeps, per
coordinate, the earliest dart that hits its weighted region. Two texts agree in a coordinate with
probability equal to their weighted Jaccard similarity. Only darts with a rank below about
K (ln K + 3) / total weight are thrown, so the work is linear in the text plus K log K.

Banded join: R coordinates make a band key, B = K / R keys a text; at similarity 0.8 the chance that no
key agrees is (1 - 0.8**4)**32 < 1e-7. Candidates are then compared exactly, on whole texts.

Whole classes without all pairs:
1. texts with the same words form one copy class; its least doc_id stands for it from here on;
2. every band bucket has a leader, the member that meets most texts in its buckets, which in a group of edited copies is the least
   edited. A text is compared with the foremost of its leaders, then with those whose component it is not in (stars, not all
   pairs); buckets that still hold several components have a second star, around the foremost member outside the leader's;
3. a bucket whose members are now in one component needs nothing more; in other buckets, members whose
   sketch is like that of a member of another component (a semi join, so a row each at most) are searched
   for links across components by an exact prefix filter over what they differ in from the bucket's least member.
So every two texts that share a bucket end in one component, or have been compared or ruled out exactly,
at a cost that does not square with the size of a group of near copies or of a shared template. A comparison first looks at 2 bits of each
of the 128 coordinates, and is given up only if the estimate lies five standard deviations or more
below the threshold; otherwise the exact weighted Jaccard similarity of both texts decides.

Defined results: a null doc_id is a row of its own class and is never linked; texts without words (null,
empty, punctuation) are each a class of their own; a text of one to four words is one run of all its words; repeated
rows are copies; an empty table gives an empty table; columns other than the id and the text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import BROADCAST_IDS, Scratch, connected_components, only_ids
from tessera.llm.kernel import U128, Tokens, chunked, mix64, shingles, small_batches

WIDTH = 5
SIMILARITY = 0.8
K = 128
R = 4
BITS = 2
#: Standard deviations of the sketch's estimate below the threshold at which a pair is given up.
SLACK = 5.0
#: Pairs that one text leads within a task.
FOLLOWERS = 4096
#: Members of a bucket up to which each is held against the others' sketches before the exact search.
BUCKET = 32_768

_U = np.uint64


def weighted(words: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """A text's distinct runs of words, sorted, and how often each occurs."""
    return np.unique(shingles(words, width), return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard: sum of minima over sum of maxima."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = np.minimum(a[1][i], b[1][j]).sum()
    most = a[1].sum() + b[1].sum() - least
    return float(least / most) if most else 0.0


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


def dart_signatures(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, k: int = K) -> np.ndarray:
    """(n, k) identities of the earliest darts of n sets; zeros for a set without weight.

    elements, weights, owner: the members of all sets, one after another. Weights may be fractions: a dart
    at a height beyond the weight misses.
    """
    out = np.zeros((n, k), dtype=_U)
    total = np.bincount(owner, weights=weights, minlength=n)
    limit = k * (math.log(k) + 3) / np.maximum(total, 1e-300)
    open_sets = total > 0
    units = np.ceil(weights).astype(np.int64)
    level = np.arange(units.sum()) - np.repeat(np.cumsum(units) - units, units)
    which = np.repeat(np.arange(len(elements)), units)
    cell = mix64(elements[which] + (level.astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15))
    room = np.minimum(weights[which] - level, 1.0)
    cell_owner = owner[which]
    while open_sets.any():
        live = np.flatnonzero(open_sets[cell_owner])
        rank = np.zeros(len(live))
        ids, ranks, sets = [], [], []
        turn = 0
        while len(live):
            dart = mix64(cell[live] ^ mix64(np.full(1, turn * 2 + 1, dtype=_U)))
            rank = rank - np.log(_uniform(dart))
            near = rank < limit[cell_owner[live]]
            live, rank, dart = live[near], rank[near], dart[near]
            height = _uniform(mix64(dart + _U(0xA0761D6478BD642F)))
            hit = height < room[live]
            ids.append(dart[hit]), ranks.append(rank[hit]), sets.append(cell_owner[live][hit])
            turn += 1
        dart, rank, which_set = np.concatenate(ids), np.concatenate(ranks), np.concatenate(sets)
        slot = which_set * k + (mix64(dart ^ _U(0xE7037ED1A0B428DB)) % _U(k)).astype(np.int64)
        order = np.lexsort((dart, rank, slot))
        slot, dart = slot[order], dart[order]
        first = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1]))) if len(slot) else np.empty(0, np.int64)
        flat = out.reshape(-1)
        flat[slot[first]] = np.maximum(dart[first], _U(1))
        open_sets = open_sets & (out == 0).any(axis=1)
        limit = np.where(open_sets, limit * 2, limit)  # a coordinate without a dart: look further
    return out


def band_keys(signatures: np.ndarray, rows: int = R) -> np.ndarray:
    """(n, K / rows) keys; equal only for equal bands of the same place."""
    n, k = signatures.shape
    grouped = signatures.reshape(n, k // rows, rows)
    key = np.arange(1, k // rows + 1, dtype=_U)[None, :] * _U(0x9E3779B97F4A7C15)
    for r in range(rows):
        key = mix64(key ^ grouped[:, :, r])
    return key


def sketch_words(signatures: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The low bits of every coordinate, packed into 64-bit words."""
    n, k = signatures.shape
    per = 64 // bits
    low = (mix64(signatures) & _U((1 << bits) - 1)).reshape(n, k // per, per)
    return np.bitwise_or.reduce(low << (np.arange(per, dtype=_U) * _U(bits)), axis=2)


def least_agreement(threshold: float = SIMILARITY, k: int = K, bits: int = BITS, slack: float = SLACK) -> int:
    """Coordinates whose bits must agree for a pair to be compared exactly."""
    p = threshold + (1 - threshold) / 2**bits
    return math.floor(k * p - slack * math.sqrt(k * p * (1 - p)))


def agreement(a: str, b: str, k: int = K, bits: int = BITS) -> Column:
    """Coordinates of which the bits agree in two arrays of sketch words; BITS is 2 here."""
    differ = F.lit(0)
    for w in range(k * bits // 64):
        x = F.col(a)[w].bitwiseXOR(F.col(b)[w])
        either = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555))
        differ = differ + F.bit_count(either)
    return F.lit(k) - differ


SIGNED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("copy_a", T.LongType()),
        T.StructField("copy_b", T.LongType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
        T.StructField("sketch", T.ArrayType(T.LongType())),
    ]
)
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("copy_a", pa.int64()), ("copy_b", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])


def _lists(values: np.ndarray) -> pa.Array:
    n, k = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(values.astype(np.int64).reshape(-1)))


def sign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Each row's copy key, band keys and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            for begin, texts in chunked(batch.column(1).to_pylist()):
                tokens = Tokens(texts)
                sets = [weighted(tokens.of(i), width) for i in range(len(texts))]
                owner = np.repeat(np.arange(len(texts)), [len(s[0]) for s in sets])
                signature = dart_signatures(np.concatenate([s[0] for s in sets]), np.concatenate([s[1] for s in sets]).astype(float), owner, len(texts))
                copies = [U128.signed(tokens.of(i).tobytes()) for i in range(len(texts))]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(begin, len(texts)),
                        pa.array(np.diff(tokens.first)[: len(texts)].astype(np.int64)),
                        pa.array([c[0] for c in copies], pa.int64()),
                        pa.array([c[1] for c in copies], pa.int64()),
                        _lists(band_keys(signature)),
                        _lists(sketch_words(signature)),
                    ],
                    schema=_ARROW,
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SIGNED)


def _side_by_side(pairs: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) with both texts, sorted by a within a task, so a text that leads many pairs is cut into words once; one that
    leads more than FOLLOWERS is dealt out over several keys, with a copy of its text for each."""
    ids = scratch.save(pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select(F.col("b").alias("doc_id"))).distinct(), "ids")
    needed = scratch.save(only_ids(texts, ids, "doc_id"), "needed")
    left, right = needed.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), needed.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    # at most one in FOLLOWERS of the pairs
    hot = scratch.save(pairs.groupBy("a").agg(F.ceil(F.count("*") / FOLLOWERS).cast("int").alias("parts")).where("parts > 1"), "hot-leaders")
    parts = F.coalesce("parts", F.lit(1))
    few = hot.count() <= BROADCAST_IDS // 2
    dealt = lambda rows: rows.join(F.broadcast(hot) if few else hot, "a", "left")
    left = dealt(left).select("a", "text_a", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    pairs = dealt(pairs).select("a", "b", F.pmod(F.xxhash64("b"), parts).cast("int").alias("part"))
    return pairs.join(right, "b").join(left, ["a", "part"]).select("a", "b", "text_a", "text_b")


def _compare(pairs: DataFrame, texts: DataFrame, threshold: float, width: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose whole texts reach the threshold, with the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, set_a = None, None
        for batch in small_batches(batches, rows=256):
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found: tuple[list, list, list] = ([], [], [])
            for i in range(batch.num_rows):
                if a[i] != last:
                    last, set_a = a[i], weighted(Tokens([batch.column(2)[i].as_py()]).of(0), width)
                s = similarity(set_a, weighted(Tokens([batch.column(3)[i].as_py()]).of(0), width))
                if s >= threshold - 1e-12:
                    found[0].append(a[i]), found[1].append(b[i]), found[2].append(s)
            yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], ["a", "b", "similarity"])

    out = scratch.save(_side_by_side(pairs, texts, scratch).mapInArrow(run, "a long, b long, similarity double"), "links")
    scratch.drop("ids", "needed", "hot-leaders")
    return out


def elements(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """A text's weighted set as a plain set: the n-th occurrence of a run of words is an element of its own, so that set
    similarity is weighted similarity."""
    runs, counts = weighted(words, width)
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    runs = np.repeat(runs, counts)
    return np.where(nth == 0, runs, mix64(runs + nth.astype(_U) * _U(0xC2B2AE3D27D4EB4F)))


def _difference_pairs(leads: DataFrame, texts: DataFrame, threshold: float, width: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of documents under one leader, of different components, that can reach the threshold, exactly.

    leads: leader, copy_id, component, minor. Documents whose leaders are linked by common documents get the least of these as their
    one leader; those that reach the threshold with it are pairs too. A document is told by its difference from the leader, the
    elements that only one of both holds. Two sets of n and m elements reach the threshold t just if they differ in at
    most (n + m)(1 - t) / (1 + t) elements, and they differ where their differences from the leader do. One of the pair at least is not
    linked to the leader, so its difference is too large to be allowed, and both differences must overlap in a known number of
    elements: they share one among the first ones of each, rare ones first. Copies of one template whose own changes are not
    the same never meet, though they share the template, and meet the leader once.
    """
    q = (1 - threshold) / (1 + threshold)

    names = ["leader", "doc_id", "n", "d", "element"]

    def rows_of(held: list[tuple[int, int, int, np.ndarray]]) -> pa.RecordBatch:
        d = np.array([len(h[3]) for h in held], dtype=np.int64)
        columns = [np.repeat(np.array([h[i] for h in held], dtype=np.int64), d) for i in range(3)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (*columns, np.repeat(d, d), np.concatenate([h[3] for h in held]).view(np.int64))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, of_leader, held, size = None, None, [], 0
        near: tuple[list, list] = ([], [])
        for batch in small_batches(batches, rows=256):
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i in range(batch.num_rows):
                if a[i] != last:
                    last, of_leader = a[i], elements(Tokens([batch.column(2)[i].as_py()]).of(0), width)
                own = elements(Tokens([batch.column(3)[i].as_py()]).of(0), width)
                difference = np.setxor1d(own, of_leader, assume_unique=True)
                if len(difference) <= q * (len(own) + len(of_leader)) + 1e-9:
                    near[0].append(a[i]), near[1].append(b[i])
                held.append((a[i], b[i], len(own), difference))
                size += len(difference)
                if size > 200_000:  # differences of long texts are handed on before they pile up
                    yield rows_of(held)
                    held, size = [], 0
        if size:
            yield rows_of(held)
        if near[0]:  # rows without an element: documents that reach the threshold with the leader itself
            zero = pa.array(np.zeros(len(near[0]), dtype=np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(near[0], pa.int64()), pa.array(near[1], pa.int64()), zero, zero, pa.nulls(len(near[0]), pa.int64())], names)

    # all buckets that documents link share one leader, the least of them, so a document has one difference
    roots = connected_components(leads.select(F.col("leader").alias("a"), F.col("copy_id").alias("b")), scratch, "roots")
    members = leads.groupBy("copy_id").agg(F.max("component").alias("component"), F.max("minor").alias("minor"))
    leads = members.join(roots, members.copy_id == roots.id).select(roots.component.alias("leader"), "copy_id", members.component.alias("component"), "minor").where("leader <> copy_id")
    leads = scratch.save(leads, "leads")
    pairs = scratch.save(leads.select(F.col("leader").alias("a"), F.col("copy_id").alias("b")), "lead-pairs")
    every = scratch.save(_side_by_side(pairs, texts, scratch).mapInArrow(run, "leader long, doc_id long, n long, d long, element long"), "differences")
    found, near = every.where("element IS NOT NULL"), every.where("element IS NULL").select(F.col("leader").alias("a"), F.col("doc_id").alias("b"))
    times = found.groupBy("leader", "element").agg(F.count("*").alias("times")).where("times > 1")
    # an element of one difference only can't be shared, but it takes a place before all others
    shared = found.join(times, ["leader", "element"]).groupBy("leader", "doc_id", "n", "d").agg(F.array_sort(F.collect_list(F.struct("times", "element"))).alias("order"))
    shared = shared.join(leads.withColumnRenamed("copy_id", "doc_id"), ["leader", "doc_id"])
    most = F.floor(F.col("n") * (1 - threshold) / threshold + 1e-6)  # elements a partner can differ in
    first = F.col("d") - F.size("order")
    own = ("leader", "doc_id", "component", "minor", "n", "d")
    rows = shared.where(first <= most).select(*own, first.alias("first"), F.posexplode(F.slice("order", F.lit(1), (most - first + 1).cast("int"))).alias("at", "o"))
    rows = scratch.save(rows.select(*own, (F.col("first") + F.col("at")).alias("place"), F.col("o.element").alias("element")), "places")
    x, y = rows.where("minor").alias("x"), rows.alias("y")
    overlap = f"greatest(1, ceil((x.d + y.d - (x.n + y.n) * {q!r}D) / 2 - 1e-6D))"
    rule = "x.leader = y.leader AND x.element = y.element AND x.component <> y.component AND (NOT y.minor OR x.doc_id < y.doc_id)"
    pairs = x.join(y, F.expr(f"{rule} AND x.place <= x.d - {overlap} AND y.place <= y.d - {overlap}"))
    out = pairs.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).unionAll(near).distinct()
    out = scratch.save(out, "rest-pairs")
    scratch.drop("roots", "leads", "lead-pairs", "ids", "needed", "hot-leaders", "differences", "places")
    return out


class NearDuplicates:
    """The result of find_near_duplicates: classes (a row a document row) and links between class members."""

    def __init__(self, classes: DataFrame, links: DataFrame):
        self.classes, self.links = classes, links


def find_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY, width: int = WIDTH) -> NearDuplicates:
    """classes: doc_id, copy_id (least doc_id of the texts with the same words), class_id (least doc_id of
    the near-duplicate class), the copy key, and lead: the row's text stands for its class. links: a < b, the least ids of two copy classes, with their similarity."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = scratch.save(sign(plain, width=width), "signed")
    real = signed.where("n_words > 0 AND doc_id IS NOT NULL")
    reps = scratch.save(real.groupBy("copy_a", "copy_b").agg(F.min("doc_id").alias("copy_id"), F.min_by("bands", "doc_id").alias("bands"), F.min_by("sketch", "doc_id").alias("sketch")), "reps")
    named = None
    if reps.groupBy("copy_id").count().where("count > 1").limit(1).count():
        # one doc_id leads texts of different words: copy classes go by their place in the order of ids instead
        places = reps.select("copy_id", "copy_a", "copy_b").orderBy("copy_id", "copy_a", "copy_b").withColumn("node", F.monotonically_increasing_id())
        named = scratch.save(places, "named")
        reps = scratch.save(reps.drop("copy_id").join(named.select("copy_a", "copy_b", F.col("node").alias("copy_id")), ["copy_a", "copy_b"]), "numbered")
    sketches = reps.select(F.col("copy_id").alias("id"), "sketch")

    # the leader of a bucket is its member of most fellows over all its buckets: the text from which a group's copies differ least
    banded = reps.select(F.explode("bands").alias("band"), "copy_id")
    sizes = banded.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    placed = scratch.save(banded.join(sizes, "band").select("band", "copy_id", "size"), "placed")
    fellows = placed.groupBy("copy_id").agg(F.sum("size").alias("fellows"))
    placed = scratch.save(placed.drop("size").join(fellows, "copy_id"), "fellows")
    front = F.struct("fellows", -F.col("copy_id"))
    shared = placed.groupBy("band").agg(F.max(front.alias("f")).alias("f")).select("band", (-F.col("f.col2")).alias("leader"), F.col("f.fellows").alias("rank"))
    buckets = scratch.save(placed.join(shared, "band").select("band", "leader", "rank", "copy_id", "fellows"), "buckets")
    scratch.drop("placed", "fellows")

    def likely(pairs: DataFrame) -> DataFrame:
        out = pairs.join(sketches.select(F.col("id").alias("b"), F.col("sketch").alias("sketch_b")), "b")
        out = out.join(sketches.select(F.col("id").alias("a"), F.col("sketch").alias("sketch_a")), "a")
        return out.where(agreement("sketch_a", "sketch_b") >= least_agreement(threshold)).select("a", "b")

    first = reps.select("copy_id", "copy_a", "copy_b")
    texts = plain.where("doc_id IS NOT NULL")
    if named is not None:
        wanted = scratch.save(named.select(F.col("copy_id").alias("doc_id")).distinct(), "wanted")
        texts = copy_keys(only_ids(texts, wanted, "doc_id"), "text").join(first, ["copy_a", "copy_b"]).select(F.col("copy_id").alias("doc_id"), "text").dropDuplicates(["doc_id"])
    elif signed.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").limit(1).count():
        texts = texts.dropDuplicates(["doc_id"])

    stars = links = None

    def meet(pairs: DataFrame) -> bool:
        """Compare pairs that were not compared before; whether there were any."""
        nonlocal stars, links
        pairs = pairs.select(F.least("one", "copy_id").alias("a"), F.greatest("one", "copy_id").alias("b")).distinct()
        new = scratch.save(likely(pairs if stars is None else pairs.join(stars, ["a", "b"], "left_anti")), "pairs")
        if stars is not None and not new.limit(1).count():
            return False
        found = _compare(new, texts, threshold, width, scratch)
        stars, links = (new, found) if stars is None else (scratch.save(stars.unionAll(new), "all-pairs"), scratch.save(links.unionAll(found), "joined-links"))
        return True

    def split(components: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Members of buckets with their components, and the buckets that hold several, with the leader's component."""
        member = buckets.join(components, buckets.copy_id == components.id, "left").select("band", "leader", "copy_id", "fellows", F.coalesce("component", "copy_id").alias("component"))
        member = scratch.save(member, "member")
        major = F.max(F.when(F.col("copy_id") == F.col("leader"), F.col("component"))).alias("major")
        return member, member.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), major).where("low <> high").select("band", "major")

    # each text first meets the foremost of its leaders only, then those whose component it is not in
    meet(buckets.where("copy_id <> leader").groupBy("copy_id").agg(F.max_by("leader", F.struct("rank", -F.col("leader"))).alias("one")))
    components = connected_components(links, scratch, "components")
    member, mixed = split(components)
    if meet(member.join(mixed, "band").where("component <> major").select(F.col("leader").alias("one"), "copy_id")):
        components = connected_components(links, scratch, "components-star")
        member, mixed = split(components)
    # a second star in buckets that still hold several components: around the foremost member outside the leader's
    outside = member.join(mixed, "band").where("component <> major")
    second = outside.groupBy("band").agg(F.max_by(F.struct("copy_id", "component"), front).alias("s")).select("band", F.col("s.copy_id").alias("one"), F.col("s.component").alias("own"))
    if meet(member.join(second, "band").where("component <> own").select("one", "copy_id")):
        components = connected_components(links, scratch, "components-second")
        member, mixed = split(components)

    # buckets that still hold several components: their members are compared across components
    # of their members only those matter that look alike a member of another component of the same bucket
    open_rows = member.join(mixed, "band").join(sketches, member.copy_id == sketches.id).select("band", "leader", "copy_id", "component", (F.col("component") != F.col("major")).alias("minor"), "sketch")
    open_rows = scratch.save(open_rows, "open-rows")
    # a large bucket is not searched member by member; all its members go on to the exact search, whose cost does not square
    large = scratch.save(open_rows.groupBy("band").count().where(F.col("count") > BUCKET).select("band"), "large")
    small_rows = only_ids(open_rows, large, "band", how="left_anti")
    x, y = small_rows.where("minor").alias("x"), small_rows.alias("y")
    alike = (F.col("x.band") == F.col("y.band")) & (F.col("x.component") != F.col("y.component")) & (agreement("x.sketch", "y.sketch") >= least_agreement(threshold))
    found = x.join(y, alike, "left_semi").select("leader", "copy_id", "component", F.lit(True).alias("minor")).unionAll(y.join(x, alike, "left_semi").select("leader", "copy_id", "component", F.lit(False).alias("minor")))
    found = found.unionAll(only_ids(open_rows, large, "band").select("leader", "copy_id", "component", "minor")).where("copy_id <> leader")
    leads = scratch.save(found.groupBy("leader", "copy_id").agg(F.max("component").alias("component"), F.max("minor").alias("minor")), "open")
    scratch.drop("buckets", "member", "open-rows", "large")
    rest = _difference_pairs(leads, texts, threshold, width, scratch)
    rest = scratch.save(likely(rest).join(stars, ["a", "b"], "left_anti"), "rest")
    if rest.limit(1).count():
        links = scratch.save(links.unionAll(_compare(rest, texts, threshold, width, scratch)), "all-links")
        components = connected_components(links, scratch, "components-all")

    copies = real.select("doc_id", "copy_a", "copy_b").join(first, ["copy_a", "copy_b"])
    classes = copies.join(components.withColumnRenamed("id", "copy_id"), "copy_id", "left").select("doc_id", "copy_id", F.coalesce("component", "copy_id").alias("class_id"), "copy_a", "copy_b")
    classes = classes.withColumn("lead", F.col("copy_id") == F.col("class_id"))
    if named is not None:
        for c in ("copy_id", "class_id"):
            classes = classes.join(named.select(F.col("node").alias(c), F.col("copy_id").alias("_least")), c).withColumn(c, F.col("_least")).drop("_least")
        back = lambda c: named.select(F.col("node").alias(c), F.col("copy_id").alias(f"least_{c}"))
        links = links.join(back("a"), "a").join(back("b"), "b").select(F.col("least_a").alias("a"), F.col("least_b").alias("b"), "similarity")
    classes = classes.select("doc_id", "copy_id", "class_id", "copy_a", "copy_b", (F.col("lead") & (F.col("doc_id") == F.col("copy_id"))).alias("lead"))
    alone = signed.where("n_words = 0 OR doc_id IS NULL").select("doc_id", F.col("doc_id").alias("copy_id"), F.col("doc_id").alias("class_id"), "copy_a", "copy_b", F.lit(True).alias("lead"))
    return NearDuplicates(classes.unionAll(alone), links)


def copy_keys(rows: DataFrame, text_col: str, n_words: str = "n_words", copy_a: str = "copy_a", copy_b: str = "copy_b") -> DataFrame:
    """The rows with the number of words and the copy key of their texts."""
    at = rows.columns.index(text_col)
    schema = T.StructType([*rows.schema.fields, *(T.StructField(c, T.LongType()) for c in (n_words, copy_a, copy_b))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            n, keys = [], []
            for _, texts in chunked(batch.column(at).to_pylist()):
                tokens = Tokens(texts)
                n += np.diff(tokens.first)[: len(texts)].tolist()
                keys += [U128.signed(tokens.of(i).tobytes()) for i in range(len(texts))]
            more = [pa.array(n, pa.int64()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], schema.names)

    return rows.mapInArrow(run, schema)


def _free(columns: list[str], *names: str) -> list[str]:
    """Names like these that no column has."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, all columns kept, without the near duplicates: of each class the text of the least id stays,
    once. Rows without an id, or whose text has no words, all stay."""
    scratch = Scratch(docs.sparkSession)
    classes = scratch.save(find_near_duplicates(docs, id_col, text_col).classes, "classes")
    kind = docs.schema[id_col].dataType
    # ids of several rows are settled by the words of each row
    twice = scratch.save(docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").select(id_col), "twice")
    gone = classes.where("NOT lead AND doc_id IS NOT NULL").select(F.col("doc_id").cast(kind).alias(id_col)).distinct()
    gone = scratch.save(gone.unionAll(twice).distinct(), "gone")
    kept = only_ids(docs, gone, id_col, how="left_anti").select(*docs.columns)
    if twice.limit(1).count() == 0:
        return kept
    n_words, copy_a, copy_b = _free(docs.columns, "n_words", "copy_a", "copy_b")
    again = copy_keys(only_ids(docs, twice, id_col).select(*docs.columns), text_col, n_words, copy_a, copy_b)
    leads = classes.where("lead").select(F.col("doc_id").cast(kind).alias(id_col), F.col("copy_a").alias(copy_a), F.col("copy_b").alias(copy_b))
    one = again.where(F.col(n_words) > 0).join(leads, [id_col, copy_a, copy_b], "left_semi").dropDuplicates([id_col, copy_a, copy_b])
    return kept.unionAll(one.select(*docs.columns)).unionAll(again.where(F.col(n_words) == 0).select(*docs.columns))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).classes.select("doc_id", "copy_id", "class_id")
