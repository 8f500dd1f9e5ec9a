"""N-gram Jaccard join by chosen paths.

Texts are sets of hashes of five words in a row; two are linked if the sets'
Jaccard similarity is 0.8 or more. Texts with one set are one class of copies
and go through the join once.

A set's tokens for the recursion are the values of ``TOKENS`` min-hashes, as two
sets share such a token with the probability of their similarity. A run draws,
for the root, about ``1 / similarity`` tokens a set; sets that share a drawn
token form a bucket. A bucket of more than ``SMALL`` sets is split again on
tokens drawn for its path, ``DEPTH`` times at most; what is then still large
(many sets that are alike) is compared in blocks. Small buckets are searched by
brute force on the whole sketches. Enough runs are made that a pair at the
threshold meets in a bucket, on all levels, with probability ``RECALL``.

What the buckets find are candidates, taken generously (``SKETCH`` under the
threshold). Candidates that hang together form clusters, and inside each cluster
all pairs are compared exactly on whole sets, in blocks where the cluster has
many sets or n-grams, so a link between two sets of one cluster isn't lost even if no run found
that pair. No step emits all pairs: the exact step counts links for each set and
emits a spanning forest.

Defined cases: words are runs of anything but ASCII white space; a text of one
to four words has one n-gram, all its words; null and empty texts have no set,
are linked to nothing and are classes of their own; a null id counts as the
smallest one; rows that are repeated are copies of one class; texts are read
whole; an empty table gives an empty result; other columns are ignored by
``classes`` and kept by ``deduplicate``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, give_back, in_batches, mix, read_table, slices, span_hashes, utf8_view, words_of

WORDS, NUMERATOR, DENOMINATOR = 5, 4, 5  # similarity of 4/5
SIMILARITY = NUMERATOR / DENOMINATOR
TOKENS, RECALL, SMALL, DEPTH = 64, 0.999999, 4096, 2
#: Agreement of sketches from which a pair is a candidate: five deviations under the threshold.
SKETCH = 0.55
#: Sets and n-grams in a block of the exact step; a task holds one block and a stream of another.
BLOCK, BLOCK_GRAMS = 8192, 1 << 21
#: Bits of a bitmap of row digests (4 MB), which leaves texts that can't be asked for out of a shuffle.
FILTER_BITS = 1 << 25
#: The most frequent n-grams of a unit, those in more than ``DENSE`` sets and ``BITS`` at most, are counted by bits; the others by pairs.
DENSE, BITS = 48, 1 << 15

_STEP = [np.uint64(pow(0xBF58476D1CE4E5B9, i + 1, 1 << 64)) for i in range(WORDS)]
_RNG = np.random.default_rng(20)
_XOR = _RNG.integers(0, 1 << 32, TOKENS, dtype=np.uint32)
_MUL = _RNG.integers(0, 1 << 31, TOKENS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingles(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted set of n-gram hashes of every text."""
    n = len(offsets) - 1
    starts, ends, doc = words_of(raw, offsets)
    words = span_hashes(raw, starts, ends)
    first = np.searchsorted(doc, np.arange(n + 1))
    m = len(words) - WORDS + 1
    rolled = np.zeros(max(m, 0), np.uint64)
    for i in range(WORDS):
        if m > 0:
            rolled += words[i : i + m] * _STEP[i]
    rolled = mix(rolled)
    out = []
    for k in range(n):
        a, b = int(first[k]), int(first[k + 1])
        if b - a >= WORDS:
            out.append(np.unique(rolled[a : b - WORDS + 1]))
        elif b > a:
            own = words[a:b] * np.array(_STEP[: b - a], np.uint64)
            out.append(mix(own.sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """Min-hashes, a row for each (non-empty) set."""
    flat = np.concatenate(sets)
    low = (flat ^ (flat >> np.uint64(32))).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    out = np.empty((len(sets), TOKENS), np.uint32)
    for t in range(TOKENS):
        h = (low ^ _XOR[t]) * _MUL[t]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        out[:, t] = np.minimum.reduceat(h, starts)
    return out


def _sets_worker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's set by its digest, the buckets that it falls into first, and its sketch in one byte a token."""
    drawn = [t for run in runs_needed() for t in run]
    salt = np.array([(t + 1) << 40 for t in drawn], np.uint64)
    for batch in slices(batches, "text", 1 << 20):
        sets = shingles(*utf8_view(batch.column("text")))
        full = np.array([len(s) > 0 for s in sets], bool)
        keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        buckets, small = [None] * len(sets), [None] * len(sets)
        if full.any():
            values = sketch([s for s in sets if len(s)])
            first = mix(values[:, drawn].astype(np.uint64) + salt).view(np.int64)
            bytes_of = (mix(values.astype(np.uint64)) & np.uint64(0xFF)).astype(np.uint8)  # a minimum's own high bits are nearly all 0
            for at, k in enumerate(np.flatnonzero(full).tolist()):
                buckets[k], small[k] = first[at], bytes_of[at].tobytes()
        grams = pa.array([len(s) for s in sets], pa.int64())
        arrays = [batch.column("doc_id"), batch.column("text_md5"), pa.array(keys, pa.binary()), grams, pa.array(buckets, pa.list_(pa.int64())), pa.array(small, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text_md5", "key", "grams", "buckets", "small"])


def runs_needed(recall: float = RECALL) -> list[list[int]]:
    """The tokens that each run draws at the root; all sets draw the same ones.

    A pair at the threshold that shares a drawn token meets in that bucket, and
    in each of ``DEPTH`` further levels, should the bucket be split, it shares
    one of two tokens; runs are made until all of that fails with less than
    ``1 - recall``.
    """
    rng = np.random.default_rng(41)
    free = list(rng.permutation(TOKENS))
    runs, missed = [], 1.0
    meets = SIMILARITY * (1 - (1 - SIMILARITY) ** 2) ** DEPTH
    while missed > 1 - recall and free:
        drawn = 1 + int(rng.random() < 1 / SIMILARITY - 1)
        runs.append([int(free.pop()) for _ in range(min(drawn, len(free)))])
        missed *= (1 - meets) ** len(runs[-1])
    return runs


def _next_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Split by two tokens drawn for a bucket's path; the bucket alone tells which."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        path = batch.column("bucket").to_numpy().view(np.uint64)
        values = np.stack([np.frombuffer(x.as_py(), np.uint8) for x in batch.column("small")])
        one = mix(path + np.uint64(1))
        two = (one % np.uint64(TOKENS) + np.uint64(1) + mix(path + np.uint64(2)) % np.uint64(TOKENS - 1)) % np.uint64(TOKENS)
        for t in ((one % np.uint64(TOKENS)).astype(np.int64), two.astype(np.int64)):
            bucket = mix(path * np.uint64(31) + (t.astype(np.uint64) << np.uint64(16)) + values[np.arange(len(t)), t] + np.uint64(1))
            yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), batch.column("key"), batch.column("small")], names=["bucket", "key", "small"])


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The runs of rows with one value of ``key`` in a sorted stream."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        values = batch.column(key).to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(values[1:] != values[:-1]) + 1
        for a, b in zip([0, *edges], [*edges, len(values)], strict=True):
            if b <= a:
                continue
            if held and values[a] != current:
                yield pa.Table.from_batches(held)
                held = []
            current = values[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates of a bucket: a spanning forest of the pairs whose sketches agree."""
    a_out: list[bytes] = []
    b_out: list[bytes] = []

    def flush() -> pa.RecordBatch:
        rows = pa.RecordBatch.from_arrays([pa.array(a_out, pa.binary()), pa.array(b_out, pa.binary())], names=["a", "b"])
        a_out.clear()
        b_out.clear()
        return rows

    for table in _groups(batches, "bucket"):
        n = table.num_rows
        if n < 2:
            continue
        keys = table.column("key").to_pylist()
        order = sorted(range(n), key=keys.__getitem__)
        keys = [keys[i] for i in order]
        small = np.stack([np.frombuffer(x, np.uint8) for x in table.column("small").to_pylist()])[order]
        left = np.arange(n)
        while len(left) > 1:  # the first one left gathers all that agree with it, and those gather in turn
            queue, left = [int(left[0])], left[1:]
            while queue and len(left):
                i = queue.pop()
                near = (small[left] == small[i]).sum(1) >= SKETCH * TOKENS
                for j in left[near].tolist():
                    if keys[j] != keys[i]:
                        a_out.append(keys[i])
                        b_out.append(keys[j])
                    queue.append(j)
                left = left[~near]
        if len(a_out) >= 20_000:
            yield flush()
    if a_out:
        yield flush()
    give_back()


def _units(rows: DataFrame, blocks: DataFrame, group: str) -> DataFrame:
    """Rows of large groups, sent to every pair of blocks that theirs takes part in, as a new group; ``blocks``: the group and ``_nb``, its number of blocks."""
    big = rows.join(blocks, group)
    block = F.pmod(F.xxhash64("key"), F.col("_nb")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("_nb") - 1), lambda j: F.xxhash64(F.col(group), F.least(j, F.col("_block")), F.greatest(j, F.col("_block"))))
    return big.withColumn("_block", block).withColumn("_unit", F.explode(pairs))


def candidates(sets: DataFrame) -> DataFrame:
    """``(a, b)``: sets that some bucket brought together and whose sketches agree."""
    small = sets.select("key", "small")
    level = sets.select(F.explode("buckets").alias("bucket"), "key")
    found = None
    for depth in range(DEPTH + 1):
        counts = level.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        shared = level.join(counts, "bucket")
        if depth == 0:  # most sets are alone in their buckets; only the others take their sketches along
            shared = shared.join(small, "key")
        shared = cut_lineage(shared.select("bucket", "key", "small", "n"), f"path-{depth}")
        few = shared.filter(F.col("n") <= SMALL).select("bucket", "key", "small")
        pairs = few.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_brute, "a binary, b binary")
        found = pairs if found is None else found.unionByName(pairs)
        large = shared.filter(F.col("n") > SMALL)
        if large.isEmpty():
            break
        if depth < DEPTH:
            level = cut_lineage(large.select("bucket", "key", "small").mapInArrow(_next_buckets, "bucket long, key binary, small binary"), "path-split")
        else:
            blocks = large.groupBy("bucket").agg(F.ceil(F.any_value("n") / SMALL).cast("int").alias("_nb"))
            units = _units(large.select("bucket", "key", "small"), blocks, "bucket").select(F.col("_unit").alias("bucket"), "key", "small")
            found = found.unionByName(units.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_brute, "a binary, b binary"))
    return found


def _digest(doc_id: Column, text_md5: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id, text_md5), F.lit(FILTER_BITS)) + 1


def bitmap(rows: DataFrame) -> DataFrame:
    """``(_of, _bits)``: which digests the rows ``(doc_id, text_md5)`` have; ``FILTER_BITS`` bits at most, whatever the input."""
    found = rows.select(_digest(F.col("doc_id"), F.col("text_md5")).alias("d")).select(F.bitmap_bucket_number("d").alias("_of"), F.bitmap_bit_position("d").alias("_at"))
    return found.repartition("_of").groupBy("_of").agg(F.bitmap_construct_agg("_at").alias("_bits"))


def with_maybe(rows: DataFrame, doc_id: str, text_md5: str, bits: DataFrame) -> DataFrame:
    """Add ``_maybe``: false where the bitmap says that a row isn't in it, true for all that are and some that aren't. No shuffle."""
    digest = _digest(F.col(doc_id), F.col(text_md5))
    marked = rows.withColumn("_of", F.bitmap_bucket_number(digest)).withColumn("_at", F.bitmap_bit_position(digest))
    byte = F.conv(F.hex(F.substring("_bits", (F.col("_at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.col("_bits").isNotNull() & (F.coalesce(F.getbit(byte, F.pmod("_at", F.lit(8)).cast("int")), F.lit(0)) == 1)
    return marked.join(F.broadcast(bits), "_of", "left").withColumn("_maybe", bit).drop("_of", "_at", "_bits")


def components(edges: DataFrame) -> DataFrame:
    """``(key, root)``: the smallest key that hangs together with each key of the edges ``(a, b)``.

    Alternating stars: every key hands the least key around it first to its
    larger neighbours, then to its smaller ones, which keeps what hangs together.
    It ends when each tree is a star, whose centre is the least key; the rounds
    grow with the logarithm of the longest chain, and each writes one table.
    """
    stars = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).filter("v <> m").distinct()
    stars = cut_lineage(stars, "edges")
    while not stars.join(stars.select(F.col("m").alias("v")), "v", "left_semi").isEmpty():
        both = stars.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(stars.select(F.col("m").alias("a"), F.col("v").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        out = both.filter("b > a").join(least, "a").select(F.col("b").alias("v"), "m").distinct()
        lower = out.groupBy("v").agg(F.min("m").alias("r"))
        inner = out.join(lower, "v").select(F.explode(F.array(F.struct(F.col("m").alias("v"), F.col("r").alias("m")), F.struct("v", F.col("r").alias("m")))).alias("e"))
        stars = cut_lineage(inner.select("e.*").filter("v <> m").distinct(), "stars")
    return stars.select(F.col("v").alias("key"), F.col("m").alias("root")).unionByName(stars.select(F.col("m").alias("key"), F.col("m").alias("root")).distinct())


def linked(sizes: np.ndarray, inter: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Jaccard of 4/5 or more, in integers: 5 i >= 4 (a + b - i)."""
    return (NUMERATOR + DENOMINATOR) * inter >= NUMERATOR * (sizes + other)


class Block:
    """The sets of a block by n-gram: bits for frequent n-grams, owners for the others."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = len(sets)
        owner = np.repeat(np.arange(self.n, dtype=np.int32), [len(s) for s in sets])
        flat = np.concatenate(sets)
        order = np.argsort(flat)
        flat = flat[order]
        self.owners = owner[order]
        del owner, order
        new = np.ones(len(flat), bool)
        new[1:] = flat[1:] != flat[:-1]
        self.starts = np.append(np.flatnonzero(new), len(flat)).astype(np.int32)
        self.grams = flat[new]
        times = np.diff(self.starts)
        heavy = np.flatnonzero(times > DENSE)
        heavy = heavy[np.argsort(-times[heavy], kind="stable")[:BITS]]
        self.bit = np.full(len(times), -1, np.int32)
        self.bit[heavy] = np.arange(len(heavy), dtype=np.int32)
        self.packed = np.zeros((self.n, -(-len(heavy) // 64)), np.uint64)
        for g in heavy.tolist():
            own = self.owners[self.starts[g] : self.starts[g + 1]]
            self.packed[own, self.bit[g] >> 6] |= np.uint64(1 << (int(self.bit[g]) & 63))

    def intersections(self, s: np.ndarray) -> np.ndarray:
        """How many n-grams of ``s`` each set of the block has."""
        at = np.searchsorted(self.grams, s)
        at = at[self.grams[np.minimum(at, len(self.grams) - 1)] == s] if len(at) else at
        bits = self.bit[at]
        out = np.zeros(self.n, np.int64)
        on = bits[bits >= 0]
        if len(on):
            mask = np.zeros(self.packed.shape[1], np.uint64)
            np.bitwise_or.at(mask, on >> 6, np.uint64(1) << (on & 63).astype(np.uint64))
            used = np.flatnonzero(mask)
            out += np.bitwise_count(self.packed[:, used] & mask[used]).sum(1, dtype=np.int64)
        light = at[bits < 0]
        if len(light):
            n = (self.starts[light + 1] - self.starts[light]).astype(np.int64)
            rows = np.repeat(self.starts[light] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out += np.bincount(self.owners[rows], minlength=self.n)
        return out


class Unit:
    """The links of a cluster, or between two of its blocks, found set by set."""

    def __init__(self, first: list[tuple[bytes, int, np.ndarray]]):
        self.keys = [k for k, _, _ in first]
        self.copies = np.array([c for _, c, _ in first], np.int64)
        self.sizes = np.array([len(s) for _, _, s in first], np.int64)
        self.block = Block([s for _, _, s in first])
        self.links = np.zeros(len(first), np.int64)
        self.label = np.arange(len(first))
        self.out: tuple[list, list, list] = ([], [], [])

    def _emit(self, a: bytes, b: bytes | None, n: int) -> None:
        for column, value in zip(self.out, (a, b, n), strict=True):
            column.append(value)

    def _join(self, key: bytes, found: np.ndarray) -> None:
        """Emit links to one set of each tree, and make one tree of them."""
        trees = np.unique(self.label[found])
        for tree in trees.tolist():
            other = self.keys[int(found[self.label[found] == tree][0])]
            if other != key:
                self._emit(key, other, 0)
        self.label[np.isin(self.label, trees)] = trees[0]

    def search(self, key: bytes, copies: int, s: np.ndarray, own: int = -1) -> None:
        """``own`` is the place of a set that is one of the block."""
        found = np.flatnonzero(linked(self.sizes, self.block.intersections(s), np.int64(len(s))))
        if own >= 0:
            self.links[own] += self.copies[found].sum() - self.copies[own]
            if len(np.unique(self.label[found])) > 1:
                self._join(key, found)
        elif len(found):
            self.links[found] += copies
            self._emit(key, None, int(self.copies[found].sum()))
            self._join(key, found)

    def finish(self) -> pa.RecordBatch:
        for i in np.flatnonzero(self.links).tolist():
            self._emit(self.keys[i], None, int(self.links[i]))
        a, b, n = self.out
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(n, pa.int64())], names=["a", "b", "links"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by unit and block. A unit is a cluster, searched by its own sets, or two blocks of one, of which the first is held and the second streams by.

    Out come link counts (``b`` null) and a spanning forest of the links.
    """
    current, block, pair, held, unit = None, None, False, [], None

    def close() -> Iterator[pa.RecordBatch]:
        nonlocal unit
        if held and not pair and len(held) > 1:
            unit = Unit(held)
            for i, (key, copies, s) in enumerate(held):
                unit.search(key, copies, s, i)
        if unit is not None:
            yield unit.finish()

    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("unit", "block", "pair", "key", "copies")), batch.column("shingles"), strict=True)
        for u, b, p, key, copies, raw in rows:
            if u != current:
                yield from close()
                current, block, pair, held, unit = u, b, p, [], None
            s = np.frombuffer(raw.as_py(), np.uint64)
            if not pair or b == block:
                held.append((key, copies, s))
                continue
            if unit is None:
                unit = Unit(held)
                held = []
            unit.search(key, copies, s)
    yield from close()
    give_back()


def _sets_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 1 << 20):
        packed = pa.array([s.tobytes() for s in shingles(*utf8_view(batch.column("text")))], pa.binary())
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], packed], names=[*names, "shingles"])


def _id(column: str) -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(-(2**63)))


def classes(docs: DataFrame) -> DataFrame:
    """For every row of ``docs`` (``doc_id``, ``text``): ``doc_id, text_md5, class, n_links, copy_id, alone``.

    ``class`` holds the smallest id (and that row's digest) among the rows that
    hang together by links or copies, ``n_links`` the number of other rows linked
    to this one (copies too), ``copy_id`` the smallest id with the same set;
    ``alone`` rows are the only one of their class.
    """
    rows = in_batches(docs).select(_id("doc_id").alias("doc_id"), "text").withColumn("text_md5", F.md5(F.coalesce("text", F.lit(""))))
    sketched = cut_lineage(rows.mapInArrow(_sets_worker, "doc_id long, text_md5 string, key binary, grams long, buckets array<long>, small binary"), "sets")
    full = sketched.filter("key is not null")
    sets = cut_lineage(
        full.groupBy("key").agg(
            F.min(F.struct("doc_id", "text_md5")).alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("grams").alias("grams"), F.any_value("buckets").alias("buckets"), F.any_value("small").alias("small")
        ),
        "copies",
    )
    clusters = components(candidates(sets)).withColumnRenamed("root", "cluster")
    members = cut_lineage(clusters.join(sets.select("key", "rep", "copies", "grams"), "key"), "members")
    counts = members.groupBy("cluster").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("grams") / BLOCK_GRAMS)).cast("int").alias("_nb"))
    whole = members.join(counts.filter("_nb = 1").select("cluster"), "cluster").select(
        "key", "rep", "copies", F.xxhash64("cluster").alias("unit"), F.lit(0).alias("block"), F.lit(False).alias("pair")
    )
    parts = _units(members, counts.filter("_nb > 1"), "cluster").select("key", "rep", "copies", F.col("_unit").alias("unit"), F.col("_block").alias("block"), "cluster")
    own = F.xxhash64(F.col("cluster"), F.col("block"), F.col("block"))
    parts = parts.select("key", "rep", "copies", "unit", "block", (F.col("unit") != own).alias("pair"))
    work = whole.unionByName(parts)
    # Ids first: only texts that a bitmap of the members has are shuffled, one for each row of ``rep``. Sets are made behind the join.
    asked = with_maybe(rows, "doc_id", "text_md5", bitmap(members.select("rep.*"))).filter("_maybe")
    texts = asked.groupBy("doc_id", "text_md5").agg(F.any_value("text").alias("text"))
    placed = texts.join(work.select("*", "rep.doc_id", "rep.text_md5").drop("rep"), ["doc_id", "text_md5"]).select("unit", "key", "block", "copies", "pair", "text")
    exact = (
        placed.mapInArrow(_sets_again, "unit long, key binary, block int, copies long, pair boolean, shingles binary")
        .repartition("unit").sortWithinPartitions("unit", "block", "key").mapInArrow(_verify, "a binary, b binary, links long")
    )
    exact = cut_lineage(exact, "links")
    links = exact.filter("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"))
    roots = components(exact.filter("b is not null").select("a", "b"))
    # Only sets that are linked need a class from others; the rest are classes of their own.
    named = roots.join(sets.select("key", "rep"), "key")
    first = named.groupBy("root").agg(F.min("rep").alias("class"))
    linked_sets = named.join(first, "root").select("key", "class").join(links, "key", "left")
    by_key = sets.select("key", "rep", "copies").join(linked_sets, "key", "left").select(
        "key", F.coalesce("class", "rep").alias("class"), F.col("rep.doc_id").alias("copy_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        (F.col("class").isNull() & (F.col("copies") == 1)).alias("alone"),
    )
    out = full.select("doc_id", "text_md5", "key").join(by_key, "key").select("doc_id", "text_md5", "class", "n_links", "copy_id", "alone")
    single = sketched.filter("key is null").select(
        "doc_id", "text_md5", F.struct("doc_id", "text_md5").alias("class"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("copy_id"), F.lit(True).alias("alone")
    )
    return out.unionByName(single)


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each class stays, the one with the smallest id; null and empty texts stay as they are.

    Rows that are alone in their class, by a bitmap of those that aren't, stay
    without a shuffle; the others meet the list of them.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # its columns may have any names
    full = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    touched = classes(docs.select("doc_id", "text")).filter(~F.col("alone")).select(
        F.col("doc_id"), "text_md5", ((F.col("class.doc_id") == F.col("doc_id")) & (F.col("class.text_md5") == F.col("text_md5"))).alias("first")
    )
    touched = cut_lineage(touched.distinct(), "touched")
    rows = docs.select(whole, _id("doc_id").alias("_row_id"), F.md5(F.coalesce("text", F.lit(""))).alias("_row_md5"), full.alias("_full"))
    rows = with_maybe(rows, "_row_id", "_row_md5", bitmap(touched))
    met = rows.filter("_full and _maybe").join(
        touched.select(F.col("doc_id").alias("_row_id"), F.col("text_md5").alias("_row_md5"), "first"), ["_row_id", "_row_md5"], "left"
    )
    # Rows alike in id and text are one document; what the bitmap took in by chance stays.
    one = met.filter("first is null or first").groupBy("_row_id", "_row_md5").agg(F.any_value("row").alias("row"))
    return rows.filter("not (_full and _maybe)").select("row.*").unionByName(one.select("row.*"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("class.doc_id").alias("class_id"), "n_links", "copy_id")
