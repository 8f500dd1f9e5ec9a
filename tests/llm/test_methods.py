"""The methods themselves against plain Python: decoding, pruning, rules, networks, notices and the whole pipeline."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import textwrap
import time

import numpy as np
import pyarrow as pa
import pytest

from crawlsight.llm import bpe, langid, licences, nearjoin, quality, rules, secrets, topk
from crawlsight.llm.common import utf8_view

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def view(texts):
    return utf8_view(pa.array(texts, pa.string()))


# 1


def _model(k, bits=None, seed=0, floor=None):
    rng = np.random.default_rng(seed)
    code = langid.codewords(k)
    return langid.Model(tuple(f"l{i}" for i in range(k)), code, rng.normal(size=(langid.BUCKETS, code.shape[1])).astype(np.float32), rng.random(code.shape[1]) + 0.1, 0.4, floor)


def plain_margins(model, text):
    raw = text.encode()
    folded = langid.fold(np.frombuffer(raw, np.uint8)).tobytes() if raw else b""
    total, count = np.zeros(model.code.shape[1]), 0
    for n in langid.ORDERS:
        for at in range(len(folded) - n + 1):
            if folded[at + (n > 1)] == 0x20:
                continue
            h = n
            for b in folded[at : at + n]:
                h = (h * 0x01000193 + b) & 0xFFFFFFFF
            total += model.weights[((h * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - langid.BITS)]
            count += 1
    return total / math.sqrt(max(count, 1))


@pytest.mark.parametrize("k", [2, 3, 5])
def test_margins_and_decoding(spark, k):
    model = _model(k, seed=k)
    texts = ["Zwei WÖRTER hier", "a", "", "été là-bas, 42!", "漢字かな", "x " * 50, "one\nmore\ttext"]
    got = model.margins(*view(texts))
    for row, text in zip(got, texts, strict=True):
        assert np.allclose(row, plain_margins(model, text), atol=1e-4)
    probabilities = model.probabilities(got)
    for row, m in zip(probabilities, got, strict=True):
        loss = [sum(w * math.log1p(math.exp(-model.slope * margin * bit)) for w, margin, bit in zip(model.bit_weights, m, word, strict=True)) for word in model.code.tolist()]
        share = np.exp(min(loss) - np.array(loss))
        assert np.allclose(row, share / share.sum())
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in langid.predict(rows, model).collect():
        if any(c.isalpha() for c in r["text"]):
            p = model.probabilities(model.margins(*view([r["text"]])))[0]
            assert r["lang_pred"] == f"l{int(p.argmax())}" and abs(r["score"] - p.max()) < 1e-9
        else:
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)


def test_ties_go_to_the_first_language(spark):
    code = langid.codewords(3)
    model = langid.Model(("a", "b", "c"), code, np.zeros((langid.BUCKETS, code.shape[1]), np.float32), np.ones(code.shape[1]), 1.0)
    r = langid.predict(spark.createDataFrame([("word",)], "text string"), model).first()
    assert (r["lang_pred"], r["ambiguous"], r["rejected"]) == ("a", True, False)


def test_what_no_learned_language_is_like_is_rejected(spark):
    rng = np.random.default_rng(2)
    words = {"en": "the of and to in that with for was this from have they which their".split(), "de": "der die und das nicht mit für auf eine sich wird über auch werden".split()}
    rows = [(i, " ".join(rng.choice(words[lang], int(rng.integers(6, 60)))), lang) for i in range(16_000) for lang in ("en", "de")]
    model = langid.fit(spark.createDataFrame([(2 * i + (lang == "de"), t, lang) for i, t, lang in rows], "doc_id long, text string, lang string"))
    assert model.floor is not None
    junk = ["zq", "x7", "ŋ"]
    clean = [" ".join(rng.choice(words[lang], 20)) for lang in ("en", "de") for _ in range(2000)]
    got = langid.predict(spark.createDataFrame([(t,) for t in junk + clean], "text string"), model).collect()
    assert sum(r["rejected"] for r in got if r["text"] in junk) >= 1
    assert np.mean([r["rejected"] for r in got if r["text"] not in junk]) <= 3 * langid.REJECT


def test_one_repeated_id_still_trains(spark):
    rows = [(7, f"the word number {i} and more of it", "en") for i in range(300)]
    frame = spark.createDataFrame(rows * 3, "doc_id long, text string, lang string")
    model = langid.fit(frame, train_rows=20, tune_rows=2)
    assert model.languages == ("en",)


# 2


def test_engines_agree_on_every_assigned_character():
    import unicodedata

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(bpe.default_path())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    codec = bpe.Codec(bpe.default_path())
    points = [c for c in range(0x110000) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co")]
    texts = ["".join(f"a{chr(c)}b 1{chr(c)} {chr(c)}x  {chr(c)}" for c in points[i : i + 256]) for i in range(0, len(points), 256)]
    for text, enc in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert codec.encode(text.encode()).tolist() == enc.ids


@pytest.mark.parametrize("bits", [2, 4, 9])
def test_chunks_join_exactly_around_white_space_and_ideographs(bits):
    codec = bpe.Codec(bpe.default_path())
    rng = np.random.default_rng(bits)
    pieces = ["这是文章", "、", "。", "，", "字", "\n", "\r\n", "\t", " ", "\u3000", "\u00a0", "\u2009", "\x85", "\u2028", "ab", "12", "é", "...", "'s", "  ", "ñ\n", "ш ", "丿，", "\u1680 "]
    encoder = bpe.ChunkEncoder(codec, cache_bytes=1500)
    for _ in range(80):
        text = "".join(rng.choice(pieces, rng.integers(0, 250)))
        raw, offsets = view([text])
        assert encoder.encode(text.encode(), bpe.cuts(raw, offsets, bits).tolist()).tolist() == codec.encode(text.encode()).tolist()


# 3


def test_an_identifier_is_no_secret_and_a_key_is(spark):
    words = "user account session request number order basket value list house water people".split()
    key = "Zx9Qw7Lm3Tn5Vb1Kc8Yp2Rd4"
    texts = [f"my secret getUserAccessTokenFromSession2 name and {' '.join(words)}", f"credential {key} of the user account"] + [f"a token for the {' '.join(words)}"] * 5
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    model = secrets.fit(frame)
    got = [[(s["kind"], texts[i][s["start"] : s["end"]]) for s in r["spans"]] for i, r in enumerate(secrets.find(frame, model=model).collect())]
    assert got[0] == [] and got[1] == [("novel", key)] and not any(got[2:])


def test_planted_secrets_are_told_from_identifiers():
    words = "account address article basket colour customer delivery element engine factor garden history island journal kitchen language market number office parent quarter region season table value window".split()
    model = secrets.calibrated(words)
    novelty = secrets.Novelty(model.dictionary)
    keys, names = secrets.planted(words, 400, 77)
    found = [novelty.rate(*x)[1] >= model.threshold for x in keys]
    wrong = [novelty.rate(*x)[1] >= model.threshold for x in names]
    assert np.mean(found) >= 0.93 and sum(found) / (sum(found) + sum(wrong)) >= 0.93


@pytest.mark.parametrize("gap,want", [(0, 1), (90, 1), (110, 1), (118, 1), (125, 0), (300, 0)])
def test_a_run_that_reaches_into_the_window_counts_whole(gap, want):
    key = "Zx9Qw7Lm3Tn5Vb1Kc8Yp2Rd4"
    text = "bearer " + "." * gap + key
    assert [text[a:b] for a, b in secrets.candidates(text)] == [key] * want


def test_scans_take_time_by_length():
    model = secrets.default_model()
    novelty, took = secrets.Novelty(model.dictionary), []
    for n in (20_000, 80_000):
        text = "token1" * n
        began = time.perf_counter()
        secrets.scan(text, [], text, novelty, model.threshold)
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * max(took[0], 0.02)


# 4


def _search(ids, v, wanted, k=5):
    queries = topk.Queries(ids[wanted], v[wanted])
    best = topk.Best(len(wanted), k)
    for at in range(0, len(ids), topk.ROWS):
        topk.heads(queries, ids[at : at + topk.ROWS], v[at : at + topk.ROWS], best)
    cutoff, resolved = best.kth.copy(), 0
    best = topk.Best(len(wanted), k)
    for at in range(0, len(ids), topk.ROWS):
        resolved += topk.resolve(queries, ids[at : at + topk.ROWS], v[at : at + topk.ROWS], cutoff, best)
    return cutoff, best, resolved


@pytest.mark.parametrize("scale", [256, 1 << 30])
def test_pruning_is_exact_and_prunes(scale):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 64))
    x = centres[rng.integers(0, 40, 9000)] + 0.4 * rng.normal(size=(9000, 64))
    v = np.floor(scale * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int64)
    ids, wanted = rng.permutation(9000).astype(np.int64), np.arange(0, 9000, 90)
    cutoff, best, resolved = _search(ids, v, wanted)
    for place, q in enumerate(wanted):
        score = [sum(int(a) * int(b) for a, b in zip(v[q], w, strict=True)) for w in v] if scale > 256 and place < 2 else (v @ v[q]).tolist()
        want = sorted((-s, i) for s, i in zip(score, ids.tolist(), strict=True) if i != ids[q])[:5]
        mine = best.q == place
        assert [(-s, i) for s, i in zip(best.score[mine].tolist(), best.id[mine].tolist(), strict=True)] == want
        assert cutoff[place] <= -want[-1][0]
        if scale > 256 and place >= 2:
            break
    if scale == 256:
        assert resolved < 0.2 * len(ids) * len(wanted)


def test_entries_of_one_id_and_score_count_once():
    best = topk.Best(1, 2)
    best.add(np.zeros(4, np.int64), np.array([5, 5, 5, 3]), np.array([7, 7, 9, 1]))
    assert best.id.tolist() == [7, 9] and best.kth.tolist() == [5]


# 5


def test_the_verdict_is_the_first_rule_that_holds(spark):
    C = rules.Condition
    found = [(C("words", False, 30.0), C("symbols", True, 0.1)), (C("dup_lines", True, 0.25),), (C("distinct", False, 0.5), C("upper", True, 0.3), C("digits", True, 0.01))]
    texts = ["a # b " * 4, "same line\nsame line\nsame line\nother", "WORD 1 " * 40, "quite an ordinary text of some length that no rule marks at all", "", None, "# " * 50]
    measured = rules.measure(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    got = {r["doc_id"]: r["kept"] for r in measured.select("doc_id", rules.verdict(found).alias("kept")).collect()}
    for i, text in enumerate(texts):
        text = text or ""
        w = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        chars = sum(map(len, w))
        x = {
            "words": len(w), "symbols": sum(c in "#*$%&|<>" for c in text) / max(1, len(w)), "dup_lines": (len(lines) - len(set(lines))) / max(1, len(lines)), "distinct": len(set(w)) / max(1, len(w)),
            "upper": sum("A" <= c <= "Z" for c in text) / max(1, chars), "digits": sum("0" <= c <= "9" for c in text) / max(1, chars),
        }
        marked = any(all(x[c.feature] >= c.threshold if c.above else x[c.feature] < c.threshold for c in rule) for rule in found)
        assert got[i] == (not marked), text


# 7


def _brute(model, text):
    """Every line scored in plain Python."""
    out = []
    for i, line in enumerate((text or "").split("\n")):
        g = licences.grams(line)
        z = np.array(model.intercepts) + sum((np.array(model.features[x]) for x in g if x in model.features), np.zeros(len(model.intercepts)))
        e = np.exp((z - z.max()) / model.temperature)
        best = int(np.argmax(z[:-1]))
        if e[best] / e.sum() >= licences.THRESHOLD:
            own = max(len(set(licences.grams(t)) & set(g)) / len(licences.grams(t)) for t in licences.TEMPLATES[model.families[best]])
            out.append((i, model.families[best], round(float(e[best] / e.sum()), 6), round(own, 6), own >= licences.OVERLAP))
    return out


def test_lines_are_scored_as_plain_python_scores_them(spark):
    model = licences.train([f"ordinary words about nothing number {i} and more of them" for i in range(200)])
    rng = np.random.default_rng(6)
    notices = [t for ts in licences.TEMPLATES.values() for t in ts]
    pool = sorted({w for t in notices for w in t.split()}) + "plain words of the text".split()
    texts = ["\n".join([*rng.choice(notices, 2), " ".join(rng.choice(pool, 8)), "", "plain words"]) for _ in range(60)] + [None, "", "\n\n"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")
    for r in licences.scan(frame, model).collect():
        got = [(d["paragraph"], d["family"], round(d["probability"], 6), round(d["overlap"], 6), d["confirmed"]) for d in r["licences"] if d["lines"] == 1]
        assert got == _brute(model, r["text"])


def test_what_confirms_a_template_has_a_word_that_it_needs():
    rng = np.random.default_rng(9)
    for t in [t for ts in licences.TEMPLATES.values() for t in ts]:
        words, own, need = licences._TOKEN.findall(t.lower()), set(licences.grams(t)), licences.needed(t)
        assert need
        for _ in range(200):
            a = int(rng.integers(0, len(words)))
            part = words[a : a + int(rng.integers(1, len(words) + 1))] if rng.random() < 0.5 else [w for w in words if rng.random() < 0.6]
            if len(own & set(licences.grams(" ".join(part)))) >= licences.OVERLAP * len(own):
                assert need & set(part)


PROSE = "some prose before goes on\nabout nothing at all in many words here"


@pytest.fixture(scope="module")
def licence_model():
    return licences.train([f"ordinary words about nothing number {i} and more of them" for i in range(300)])


@pytest.mark.parametrize("width", [60, 72])
def test_wrapped_notices_are_found(spark, licence_model, width):
    rows = []
    for family, notices in licences.TEMPLATES.items():
        for t in notices:
            if len(lines := textwrap.wrap(t, width)) > 1:
                rows.append((family, PROSE + "\n# " + "\n# ".join(lines) + "\n" + PROSE))
    got = licences.scan(spark.createDataFrame(rows, "family string, text string"), licence_model).collect()
    found = [r["family"] in {d["family"] for d in r["licences"] if d["confirmed"]} for r in got]
    assert len(found) > 10 and np.mean(found) >= 0.95


def test_notices_that_are_no_template_are_predicted(spark, licence_model):
    notices = [
        ("mit", "This software is distributed under the terms of the MIT License."), ("apache", "This project is licensed under the Apache License 2.0"), ("apache", "Distributed under the Apache License, version 2.0, see LICENSE"),
        ("gpl", "Licensed under the GNU General Public License v3.0 or later"), ("bsd", "This code is governed by a BSD-style license found in the LICENSE file"), ("reserved", "Copyright (c) 2019 Example Ltd. All rights reserved."),
        ("cc-by-sa", "Content is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License"), ("lgpl", "This library is licensed under the GNU Lesser General Public License, version 3"),
        ("agpl", "distributed under the GNU Affero General Public License"), ("mpl", "This file is subject to the terms of the Mozilla Public License, version 2.0"), ("isc", "Published under the ISC License"),
        ("unlicense", "This is free software released into the public domain under the Unlicense"),
    ]
    assert not {t for _, t in notices} & {t for ts in licences.TEMPLATES.values() for t in ts}
    got = licences.scan(spark.createDataFrame([(f, f"{PROSE}\n{t}\n{PROSE}") for f, t in notices], "family string, text string"), licence_model).collect()
    assert np.mean([r["family"] in {d["family"] for d in r["licences"]} for r in got]) >= 0.85


# 8


def test_blocks_are_bounded_by_ngrams(spark, monkeypatch):
    monkeypatch.setattr(nearjoin, "BLOCK_GRAMS", 100)
    rows = [(i, " ".join(f"t{j}" if j != 7 * i else "changed" for j in range(90))) for i in range(9)]
    got = {r["doc_id"]: (r["class"]["doc_id"], r["n_links"]) for r in nearjoin.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (0, 1 if i else 8) for i in range(9)}  # a word changed inside a text changes five n-grams, at its start one


@pytest.mark.parametrize("bits", [1 << 25, 1 << 15])
def test_bitmaps_leave_nothing_out(spark, monkeypatch, bits):
    monkeypatch.setattr(nearjoin, "FILTER_BITS", bits)
    rows = spark.range(3000).selectExpr("id as doc_id", "md5(cast(id as string)) as text_md5")
    marked = nearjoin.with_maybe(rows, "doc_id", "text_md5", nearjoin.bitmap(rows.filter("doc_id % 10 = 0"))).select("doc_id", "_maybe").collect()
    assert all(r["_maybe"] for r in marked if r["doc_id"] % 10 == 0)
    assert sum(r["_maybe"] for r in marked) <= 300 + 3000 * 300 / bits * 2 + 5


# 10


def test_pooling_and_network_against_plain_python():
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(quality.BUCKETS, quality.WIDTH)).astype(np.float32)
    texts = ["Two words, 42 words <b>x</b>", "", "ein Wört ein Wört", "!!"]
    raw, offsets = view(texts)
    bucket, doc = quality.tokens(raw, offsets)
    got = quality.pool(raw, offsets, vectors)
    kinds = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z0-9\x80-\xff\x20\x09-\x0d]+")
    for k, text in enumerate(texts):
        own = bucket[doc == k].tolist()
        pieces = kinds.findall(text.encode())
        assert len(own) == len(pieces) and len(set(own)) == len(set(pieces))
        if not own:
            assert not got[k, :-1].any() and got[k, -1] == 0
            continue
        assert np.allclose(got[k, : quality.WIDTH], np.mean([vectors[b] for b in own], axis=0), atol=1e-4)
        assert np.allclose(got[k, quality.WIDTH : 2 * quality.WIDTH], np.mean([vectors[b] for b in sorted(set(own))], axis=0), atol=1e-4)
        assert np.allclose(got[k, 2 * quality.WIDTH :], [math.log1p(len(own)) / 8, len(set(own)) / len(own), len(text.encode()) / len(own) / 10, 1], atol=1e-5)
    net = quality.train(rng.normal(size=(200, got.shape[1])), rng.integers(0, 2, 200), epochs=3)
    for x, p in zip(got.astype(float), net.probability(got), strict=True):
        hidden = [math.tanh(sum((a - m) / s * w for a, m, s, w in zip(x, net.mean, net.scale, column, strict=True)) + b) for column, b in zip(net.w1.T, net.b1, strict=True)]
        z = (sum(h * w for h, w in zip(hidden, net.w2, strict=True)) + net.b2) / net.temperature
        assert abs(p - 1 / (1 + math.exp(-z))) < 1e-6


def test_ties_in_labels_count_as_good(spark):
    docs = spark.createDataFrame([(i, f"word{i % 5} text") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i in range(40) for q in (0, 1)], "doc_id long, quality int")
    vectors, net = quality.fit(docs, labels)
    assert {r["score"] >= 0.5 for r in quality.score(docs, (vectors, net)).collect()} == {True}


# the pipeline


def _sets(text):
    w = WORD.findall(text or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()


def _deduplicated(rows):
    """Rows in order of id; the first of each class of linked or equal sets stays."""
    rows = list(dict.fromkeys(rows))
    sets = [_sets(r[1]) for r in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                up[root(i)] = root(j)
    order = sorted(range(len(rows)), key=lambda i: (-(2**63) if rows[i][0] is None else rows[i][0], hashlib.md5((rows[i][1] or "").encode()).hexdigest()))
    first = {}
    for i in order:
        first.setdefault(root(i) if sets[i] else ("alone", i), i)
    return [rows[i] for i in first.values()]


def _mixed(rows):
    """Weighted fair queueing in plain Python; how often each row is taken."""
    size = [len(WORD.findall(r[1] or "")) for r in rows]
    total = collections.Counter()
    for r, n in zip(rows, size, strict=True):
        total[r[3]] += n
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(total.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * total[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2.0 * total[s] for s in full}
        left -= sum(2 * total[s] for s in full)
        open_ -= full
    entries = []
    for s in order:
        queue = sorted((i for i in range(len(rows)) if rows[i][3] == s), key=lambda i: (hashlib.md5(str("null" if rows[i][0] is None else rows[i][0]).encode()).hexdigest(), rows[i][0] or 0, size[i]))
        for k in range(2):
            upto = total[s] * k
            for i in queue:
                upto += size[i]
                if size[i] and target[s] > 0:
                    entries.append((upto / target[s], s or "", s is None, k, i))
    taken, held = collections.Counter(), 0
    for _, _, _, _, i in sorted(entries, key=lambda e: e[:4]):
        held += size[i]
        if held > sum(target.values()) + 1e-6:
            break
        taken[i] += 1
    return taken


def test_pipeline_against_plain_python(spark, sf_dir, rows):
    import corpus_pipeline
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(bpe.default_path())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    kept = _deduplicated([r for r in rows if any(c.isalpha() for c in r[1] or "")])
    frame = spark.createDataFrame(kept, DOCUMENTS)
    model = secrets.fit(frame)
    novelty, hidden = secrets.Novelty(model.dictionary), []
    for r in kept:
        hexes = [m.span() for m in re.finditer("[0-9a-f]+", r[1]) if m.end() - m.start() >= 16]
        text, at = "", 0
        for a, b in secrets._merged([(a, b) for _, a, b, _ in secrets.scan(r[1], hexes, r[1].lower(), novelty, model.threshold)]):
            text += r[1][at:a] + "[REDACTED]"
            at = b
        hidden.append((r[0], text + r[1][at:], *r[2:]))
    want = collections.Counter()
    for i, n in _mixed(hidden).items():
        ids = tokenizer.encode(hidden[i][1], add_special_tokens=False).ids
        want[hidden[i][0], hidden[i][3], tuple(ids), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += n
    got = collections.Counter((r["doc_id"], r["source"], tuple(r["ids"]), r["decoded_sha256"]) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert got == want


def test_pipeline_stages_on_empty_and_odd_tables(spark, empty_dir):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, empty_dir).count() == 0
    odd = spark.createDataFrame([(1, None, None, None, None, "a", 1.5, "x"), (1, None, None, None, None, "a", 1.5, "x"), (None, "", None, None, 0, "b", None, None), (3, "letters stand here", None, "s", 18, "c", 0.5, "y")], DOCUMENTS + ", rejected string, score double, _row_id string")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, "")
        rows = out.collect()
        if name not in ("BPE encoding",):
            assert out.columns == odd.columns, name
            assert [(r["rejected"], r["score"], r["_row_id"]) for r in rows if r["doc_id"] == 3 and r["text"]] == [("c", 0.5, "y")] * len([r for r in rows if r["doc_id"] == 3]), name
