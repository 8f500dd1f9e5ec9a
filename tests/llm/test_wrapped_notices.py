"""Notices over any number of lines."""

from __future__ import annotations

import textwrap

import numpy as np
import pytest

from crawlsight.llm import licences, registry

PROSE = "some prose before goes on\nabout nothing at all in many words here"


@pytest.fixture(scope="module")
def model():
    return licences.train([f"ordinary words about nothing number {i} and more of them" for i in range(300)])


@pytest.mark.parametrize("width", [1, 8, 20, 30, 45])
def test_notices_in_narrow_columns_are_found(spark, model, width):
    rows = []
    for family, notices in licences.TEMPLATES.items():
        for t in notices:
            if len(lines := textwrap.wrap(t, width, break_long_words=False, break_on_hyphens=False)) > 1:
                rows.append((family, PROSE + "\n\n// " + "\n// ".join(lines) + "\n\n" + PROSE))
    got = licences.scan(spark.createDataFrame(rows, "family string, text string"), model).collect()
    found = [r["family"] in {d["family"] for d in r["licences"] if d["confirmed"]} for r in got]
    assert len(found) > 10 and np.mean(found) >= 0.95


def plain_windows(lines, heads):
    """Words around each line with a needed word, and how many lines before it they begin."""
    out = []
    for i, words in enumerate(lines):
        if not heads & set(words):
            continue
        own = words if len(words) <= 2 * licences.SPAN else words[: licences.SPAN] + words[-licences.SPAN :]
        before, after, a, z = [], [], i, i
        while a > 0 and i - a < licences.SPAN and len(before) < licences.SPAN:
            a -= 1
            before = lines[a][-licences.SPAN :] + before
        while z + 1 < len(lines) and z - i < licences.SPAN and len(after) < licences.SPAN:
            z += 1
            after = after + lines[z][: licences.SPAN]
        if a < z:
            out.append((a, z - a + 1, before + own + after))
    return out


def test_joined_lines_are_scored_as_plain_python_scores_them(spark, model):
    rng = np.random.default_rng(8)
    notices = [t for ts in licences.TEMPLATES.values() for t in ts]
    heads = {w for t in notices for w in licences.needed(t)}
    texts = ["\n".join([*textwrap.wrap(str(rng.choice(notices)), int(rng.integers(5, 60))), *(["plain words"] * int(rng.integers(0, 4))), *textwrap.wrap(str(rng.choice(notices)), int(rng.integers(5, 200)))]) for _ in range(40)]
    texts += [" ".join(["word"] * 300) + " licensed under\nthe MIT License.", "x\n" * 200 + "Released under\nthe MIT License.\n" + "y\n" * 200]
    for r in licences.scan(spark.createDataFrame(list(enumerate(texts)), "i long, text string"), model).collect():
        lines = [licences._TOKEN.findall(x.lower()) for x in r["text"].split("\n")]
        alone = {d["family"] for d in r["licences"] if d["lines"] == 1 and d["confirmed"]}
        want = {}
        for a, n, words in plain_windows(lines, heads):
            own = set(licences.grams(" ".join(words)))
            z = np.array(model.intercepts) + sum((np.array(model.features[g]) for g in own if g in model.features), np.zeros(len(model.intercepts)))
            p = np.exp((z - z.max()) / model.temperature)
            best = int(np.argmax(z[: len(model.families)]))
            family, p = model.families[best], p[best] / p.sum()
            overlap = max(len(own & set(licences.grams(t))) / len(set(licences.grams(t))) for t in licences.TEMPLATES[family])
            if p >= licences.THRESHOLD and overlap >= licences.OVERLAP and family not in alone:
                want.setdefault(family, (a, n, round(p, 6), round(overlap, 6)))
        got = {d["family"]: (d["paragraph"], d["lines"], round(d["probability"], 6), round(d["overlap"], 6)) for d in r["licences"] if d["lines"] > 1}
        assert got == want, r["text"]


def test_paragraphs_are_counted_by_the_same_split(spark, tmp_path):
    texts = ["a\rb\rc\rd", "a\n\nb", "x y\u0085z", None, "", "\n \n\t\n", "one\r\ntwo\r\n"]
    spark.createDataFrame([(i, t, None, "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.queries()["op7_licence_scan"](spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["n_paragraphs"] for r in got} == dict(enumerate([1, 2, 1, 0, 0, 0, 2]))
