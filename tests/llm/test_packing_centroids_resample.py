"""Packing, clustering and resampling against plain Python."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from crawlsight.llm import centroids, packing, registry, resample
from crawlsight.llm.common import cut_lineage, utf8_view

# 11


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_path())
    t.no_truncation()
    t.no_padding()
    return t


def test_parts_are_encoded_as_the_whole_text(tokenizer):
    rng = np.random.default_rng(2)
    bits = ["a", "B", "don't", "'s", "'Tis", "''s", "'", "1", "23", "-", "...", "é", "É", "é", "≠", "<", "≠", "…", "漢", " ", "\n", " ", " ", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "İ", "ſ", "K", "Σ", "ς", "ß", "'LL", "\x00", "\x1c", "\x85", "🙂", "Å", "Ünï", "ÀÿÞ", "a×b"]
    encoder = packing.Encoder(packing.default_path(), remembered=300)
    for _ in range(120):
        texts = ["".join(rng.choice(bits, rng.integers(0, 30))) for _ in range(20)]
        flat, at = encoder.encode(*utf8_view(pa.array(texts)))
        for i, text in enumerate(texts):
            assert flat[at[i] : at[i + 1]].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def one_by_one(lengths, capacity):
    """Best-two-fit with one document and one bin at a time."""
    left, bins = sorted(lengths), []
    while left:
        gap, inside = capacity, []
        while (fits := [x for x in left if x <= gap]):
            left.remove(fits[-1])
            inside.append(fits[-1])
            gap -= fits[-1]
        while gap and len(inside) > 1:
            room, best = gap + min(inside), None
            for i in range(len(left)):
                for j in range(i):
                    two = (left[i] + left[j], left[i])
                    if two[0] <= room and two[0] > min(inside) and (best is None or two > best):
                        best = two
            if best is None:
                break
            small = min(inside)
            inside.remove(small)
            for x in (best[1], best[0] - best[1]):
                inside.append(x)
                left.remove(x)
            left = sorted([*left, small])
            gap = capacity - sum(inside)
        bins.append(tuple(sorted(inside)))
    return collections.Counter(bins)


@pytest.mark.parametrize("seed", range(12))
def test_bins_planned_at_once_are_those_of_one_by_one(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 20, 50, 97])
    lengths = [rng.choice([rng.randint(1, capacity), rng.randint(1, max(1, capacity // 3)), capacity // 2 + 1]) for _ in range(rng.randint(0, 160))] + [rng.randint(1, capacity)] * rng.randint(0, 40)
    planned = packing.plan(np.bincount(lengths, minlength=capacity + 1), capacity)
    number, seen = [], collections.Counter()
    for x in lengths:
        number.append(seen[x])
        seen[x] += 1
    sequence, offset = planned.find(np.array(lengths, np.int64), np.array(number, np.int64))
    bins = collections.defaultdict(list)
    for s, o, x in zip(sequence.tolist(), offset.tolist(), lengths, strict=True):
        bins[s].append((o, x))
    for inside in bins.values():
        at = 0
        for o, x in sorted(inside):
            assert o == at
            at += x
        assert at <= capacity
    assert len(bins) == planned.sequences
    assert collections.Counter(tuple(sorted(x for _, x in inside)) for inside in bins.values()) == one_by_one(lengths, capacity)


def test_packing_of_many_documents_is_planned_as_fast():
    counts = np.random.default_rng(1).integers(0, 10**9, 4097)
    counts[0] = 0
    planned = packing.plan(counts)
    assert planned.sequences * 4096 >= int((counts * np.arange(4097)).sum()) and len(planned.length) < 60_000


def test_packing(spark, sf_dir, rows, tokenizer):
    got = registry.queries()["op11_best_two_fit"](spark, sf_dir).collect()
    want = collections.Counter()
    for doc_id, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for at in range(0, len(ids), 4096):
            own = ids[at : at + 4096]
            want[doc_id, at // 4096, at, len(own), zlib.crc32(struct.pack(f"<{len(own)}I", *own))] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for inside in bins.values():
        at = 0
        for o, n in sorted(inside):
            assert o == at
            at += n
        assert at <= 4096
    assert len(bins) == -(-sum(r["length"] for r in got) // 4096)


def test_packed_sequences_hold_the_documents_ids(spark, docs, tokenizer):
    packed = cut_lineage(packing.pack(cut_lineage(packing.pieces(docs, capacity=512, ids=True), "t"), 512), "t")
    whole = {r["sequence_id"]: r["ids"] for r in packing.sequences(packed).collect()}
    assert max(map(len, whole.values())) <= 512
    texts = {r["doc_id"]: r["text"] for r in docs.filter("doc_id is not null").collect()}
    for r in packed.filter("doc_id is not null").collect():
        ids = [*tokenizer.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 1]
        assert whole[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == ids[r["start"] : r["start"] + r["length"]]


# 12


def lloyd(vectors, first, rounds):
    centers = [list(c) for c in first]
    for r in range(rounds + 1):
        own = []
        for v in vectors:
            d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centers]
            own.append((d.index(min(d)), min(d)))
        if r == rounds:
            return own, centers
        for k in range(len(centers)):
            if mine := [v for v, (c, _) in zip(vectors, own, strict=True) if c == k]:
                centers[k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]


def clustered(n, dim, seed, spread=3):
    rng = random.Random(seed)
    middles = [[rng.randint(-40, 40) for _ in range(dim)] for _ in range(6)]
    return [[x + rng.randint(-spread, spread) for x in rng.choice(middles)] for _ in range(n)]


@pytest.mark.parametrize("k,seed,spread", [(1, 1, 3), (2, 2, 0), (9, 3, 2), (12, 4, 40)])
def test_clusters_against_lloyd(spark, k, seed, spread):
    vectors = clustered(150, 5, seed, spread) + [[0] * 5] * 20  # ties and copies
    frame = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, v array<long>").repartition(3)
    first = centroids.first_centroids(frame, k)
    digests = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), i) for i in range(len(vectors)))
    assert first == [vectors[i] for _, i in digests[:k]]
    found, last = centroids.cluster(frame, first, 4)
    own, centers = lloyd(vectors, first, 4)
    assert {r["vec_id"]: (r["cluster"], r["distance"]) for r in found.collect()} == dict(enumerate(own)) and last == centers


def test_the_ball_spares_most_distances_and_keeps_ties():
    vectors = np.array(clustered(3000, 8, 7), np.int64)
    first = vectors[:: len(vectors) // 30][:30].tolist()
    now = centroids.Centroids(first)
    own, upper, lower = np.zeros(len(vectors), np.int32), np.full(len(vectors), np.inf), np.zeros(len(vectors))
    scanned = []
    for _ in range(5):
        now.assign(vectors, own, upper, lower)
        d = ((vectors[:, None, :] - now.v[None]) ** 2).sum(2)
        assert (own == d.argmin(1)).all()
        assert (upper >= np.sqrt(d.min(1)) * (1 - 1e-9)).all() and (lower <= np.sqrt(np.partition(d, 1, 1)[:, 1]) * (1 + 1e-9)).all()
        scanned.append(now.scanned)
        moved = [(vectors[own == a].sum(0) // max(1, (own == a).sum())).tolist() if (own == a).any() else c for a, c in enumerate(now.v.tolist())]
        now = centroids.Centroids(moved, now)
    assert sum(scanned[1:]) < 0.5 * 4 * len(vectors) * 30


@pytest.mark.parametrize("top", [10**3, 10**7, 10**8])
def test_large_components_stay_exact(top):
    rng = random.Random(1)
    vectors = np.array([[rng.randint(-top, top) for _ in range(4)] for _ in range(60)], np.int64)
    exact = [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y, strict=True)) for y in vectors[:7]] for x in vectors]
    assert centroids._exact(vectors, vectors[:7]).tolist() == exact


def test_which_vectors_take_part(spark, tmp_path):
    rows = [(i, [float((i * 7 + j) % 13) / 9 - 0.6 for j in range(64)], "x") for i in range(60)]
    rows += [(100, None, "x"), (101, [0.5] * 63, "x"), (102, [0.5] * 63 + [None], "x"), (103, [float("nan")] * 64, "x"), (104, [float("-inf")] * 64, "x"), (None, [0.25] * 64, "x"), (3, rows[3][1], "x")]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster string").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registry.queries()["op12_exponion_clusters"](spark, str(tmp_path)).collect()
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0) for r in got) == sorted([(False, i) for i in [*range(60), 3]] + [(True, 0)])
    assert len({r["inertia"] for r in got}) == 1 and got[0]["inertia"] == sum(r["distance"] for r in got)
    for c in {r["cluster"] for r in got}:
        assert {r["cluster_inertia"] for r in got if r["cluster"] == c} == {sum(r["distance"] for r in got if r["cluster"] == c)}


# 13

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [zlib.crc32(x.encode()) % 10_000 for x in w] + [zlib.crc32(f"{a} {b}".encode()) % 10_000 for a, b in zip(w, w[1:])]


@pytest.mark.parametrize("segment", [1, 7, 40, 1 << 20])
@pytest.mark.parametrize("runs", [1, 2, 3])
def test_segments_lose_and_repeat_no_run(segment, runs):
    rng = random.Random(segment)
    texts = [None, "", "  ", "one", "x" * 90, "Ünï ÇA 漢字 a1", *["".join(rng.choice(["a", "Bc", "é", " ", "--", "9", "\n", "\x00", "漢"]) for _ in range(rng.randint(0, 80))) for _ in range(15)], "ab cd " * 300]
    words, row, bucket, n = resample.count_batch(pa.array(texts), runs, 97, segment)
    got = collections.Counter({(r, b): c for r, b, c in zip(row.tolist(), bucket.tolist(), n.tolist(), strict=True)})
    want, sizes = collections.Counter(), []
    for i, text in enumerate(texts):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sizes.append(len(w))
        want.update((i, zlib.crc32(" ".join(w[a : a + k]).encode()) % 97) for k in range(1, runs + 1) for a in range(len(w) - k + 1))
    assert got == want and words.tolist() == sizes


def test_resampling(spark, sf_dir, rows):
    target = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = registry.queries()["op13_duckdb_resampling"](spark, sf_dir).collect()
    per = [(r[0], *features(r[1])) for r in rows]
    s, t = (collections.Counter(x for _, v in part for x in v) for part in ([p[1:] for p in per], [features(x) for x in target]))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (S + 10_000) / ((s[b] + 1.0) * (T + 10_000)))) for b in range(10_000)]
    want, able = collections.Counter(), []
    for doc_id, words, v in per:
        weight = sum(gain[x] for x in v) // len(v) if v else 0
        h = int(hashlib.sha256(f"7:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        want[doc_id, len(v), weight, score] += 1
        if words >= 20:
            able.append((-score, doc_id is None, doc_id or 0))
    assert collections.Counter((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in got) == want
    drawn = sorted((r["rank"], -r["score"], r["doc_id"] is None, r["doc_id"] or 0) for r in got if r["rank"] is not None)
    assert [d[0] for d in drawn] == list(range(1, 25 * len(able) // 100 + 1)) and [d[1:] for d in drawn] == sorted(able)[: len(drawn)]


def test_a_row_repeated_often_is_drawn_row_by_row(spark):
    text = "word " * 30
    docs = spark.createDataFrame([(1, text)] * 300 + [(i, text) for i in range(2, 102)], "doc_id long, text string").repartition(5)
    got = resample.resample(docs, spark.createDataFrame([], "text string"))
    assert sorted(r["rank"] for r in got.filter("rank is not null").collect()) == list(range(1, 101))


def test_resampling_ignores_other_columns(spark, docs):
    wide = docs.withColumn("score", docs["size"]).withColumn("rank", docs["size"]).withColumn("buckets", docs["size"])
    assert resample.resample(wide, docs).count() == docs.count()
