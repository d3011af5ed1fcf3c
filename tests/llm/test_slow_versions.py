"""Whole operators against slow restatements: every window, every token by itself, every character counted."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedge.llm import licenses, quality, toxicity

SF = "/root/testdata/sf0.001"


def texts_of(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def slow_scan(text, templates, coverage):
    """Windows of rising lengths at every word aligned with every template; then the best that lie apart."""
    words, found = licenses.words_of(text), []
    lie_apart = lambda a, b: a[3] <= b[2] or b[3] <= a[2]

    def best_apart(candidates, key):
        kept = []
        for c in sorted(candidates, key=key):
            if all(lie_apart(c, k) for k in kept):
                kept.append(c)
        return sorted(kept, key=lambda c: c[2])

    for name, template in templates.items():
        size, own = len(template), []
        need, reach = max(1, math.ceil(coverage * size - 1e-9)), size + size // 4 + 2
        lengths = sorted({size, *(min(reach * 2**x, 9 * size) for x in range(9))})
        worth = lambda aligned, extent: 13 * aligned - 3 * extent
        for k in range(len(words)):
            tries = []
            for n in lengths:
                p = licenses.align(template, words[k : k + n])
                tries += [p] if len(p) >= need else []
                if len(p) == size:
                    break
            if tries:
                p = max(tries, key=lambda p: worth(len(p), p[-1][1] - p[0][1] + 1))
                own.append((name, len(p) / size, k + p[0][1], k + p[-1][1] + 1, len(p)))
        found += best_apart(own, lambda c: (-worth(c[4], c[3] - c[2]), -c[4], c[2]))
    return [c[:4] for c in best_apart(found, lambda c: (-c[4], -c[1], c[0], c[2]))]


def test_licenses_with_gaps():
    """A gap of 200 words, three words between any two, other words at the ends: all words are found, at their places."""
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.COVERAGE)
    for name in ("MIT-text", "Apache-2.0-header", "GPL-3.0-header", "BSD-3-Clause"):
        notice = licenses.words_of(licenses.TEMPLATES[name])
        size, half = len(notice), len(notice) // 2
        before = [f"x{k}" for k in range(70)]
        gap = notice[:half] + [f"y{k}" for k in range(200)] + notice[half:]
        assert scanner.scan(" ".join([*before, *gap, *before])) == [(name, 1.0, 70, 70 + size + 200)]
        for between in (1, 3):
            wide = [w for k, word in enumerate(notice) for w in [word, *(f"z{k}q{n}" for n in range(between))]]
            assert scanner.scan(" ".join([*before, *wide, *before])) == [(name, 1.0, 70, 70 + (size - 1) * (between + 1) + 1)]
        far = notice[:half] + [f"y{k}" for k in range(9 * size)] + notice[half:]
        assert name not in [f[0] for f in scanner.scan(" ".join(far))]  # a notice within the notice may be found
        assert licenses.Scanner(licenses.TEMPLATES, licenses.COVERAGE, 9).scan(" ".join(far)) == [(name, 1.0, 0, 10 * size)]


def test_licenses_by_every_window(spark):
    rng, names = random.Random(9), list(licenses.TEMPLATES)
    fill = [w for t in list(texts_of(spark).values())[:20] if t for w in t.split()[:60]]
    cases = [t for t in texts_of(spark).values() if t and "icens" in t and len(t.split()) < 120][:8] + ["", None]
    for k in range(24):
        notice = licenses.TEMPLATES[names[k % len(names)]].split()
        for _ in range(rng.randint(0, max(1, len(notice) // 8))):  # words left out, put in or changed
            at = rng.randrange(len(notice))
            notice[at : at + rng.randint(0, 1)] = rng.sample(fill, rng.randint(0, 1))
        other = licenses.TEMPLATES[rng.choice(names)].split() if k % 3 == 0 else []
        cases.append(" ".join([*rng.sample(fill, 20), *notice, *rng.sample(fill, rng.randint(0, 9)), *other, *rng.sample(fill, 9)]))
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.COVERAGE)
    found = 0
    for text in cases:
        got = scanner.scan(text)
        assert got == slow_scan(text, scanner.templates, licenses.COVERAGE), text
        found += len(got)
    assert found > 20


def slow_features(text):
    text = text or ""
    kinds = dict.fromkeys("lower upper digit space feed stop sign".split(), 0)
    for c in text:
        c = c if ord(c) < 0x10000 else "￿"
        kind = "feed" if c == "\n" else "space" if c.isspace() else "digit" if c.isdigit() else "upper" if c.isupper() else "lower" if c.isalpha() else "stop" if c in ".,;:?'-" else "sign"
        kinds[kind] += 1
    k, words, lines = kinds, text.split(), text.split("\n")
    n, m, letters = max(len(text), 1), max(len(words), 1), max(kinds["lower"] + kinds["upper"], 1)
    distinct, same = len(set(words)), sum(words[i] == words[i + 1] for i in range(len(words) - 1))
    return [
        1.0, math.log(1 + len(text)), math.log(1 + len(words)), k["upper"] / letters, min(k["upper"] / letters, 0.3), k["digit"] / n, k["sign"] / n, (k["sign"] / n) ** 0.5,
        math.log(1 + 1000 * k["sign"] / n), k["stop"] / n, math.log(1 + 100 * k["stop"] / m), k["feed"] / n, distinct / m, math.log(distinct / m + 0.01),
        math.log(1 + len(words)) * (1 - distinct / m), same / m, (same / m) ** 0.5, len(set(lines)) / len(lines), (k["lower"] + k["upper"]) / m,
        (k["lower"] + k["upper"] + k["space"] + k["stop"]) / n, float(len(words) < 8), float(text == ""),
    ]


def test_quality_by_definition(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit_quality(docs.select("doc_id", "text"), labels, ~quality.held_out())
    texts = texts_of(spark) | {-1: None, -2: "", -3: "文 \U0001f389 A1\n\n"}
    frame = spark.createDataFrame([(i, t, 0.5) for i, t in texts.items()], "doc_id long, text string, score double")
    got = {r.doc_id: r for r in quality.score_quality(frame, model).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        z = [max(-8.0, min(8.0, (v - a) / s)) for v, a, s in zip(slow_features(text), model.mean, model.spread, strict=True)]
        raw = sum(a * b for a, b in zip(z, model.weights, strict=True))
        score = 1 / (1 + math.exp(-max(-40.0, min(40.0, model.slope * (raw - model.threshold) + math.log(0.3 / 0.7)))))
        assert abs(got[i].score - score) < 1e-9 and got[i].predicted == int(got[i].score >= 0.3)
    asked = {r.doc_id: r for r in quality.query(spark, SF).collect()}
    assert all(abs(asked[i].score - got[i].score) < 1e-12 for i in asked) and len(asked) == len(texts) - 3


def test_quality_on_unseen_documents(spark):
    seen = "/root/testdata/sf0.01"
    told = quality.query(spark, seen).join(spark.read.parquet(f"{seen}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(told) > 50 and np.mean([r.predicted == r.quality for r in told]) > 0.95


def test_toxicity_token_by_token(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit_toxicity(docs.select("doc_id", "text"), labels, F.lit(True))
    assert model.evidence
    bad = max(model.evidence, key=model.evidence.get).strip("^$ ")
    short = {i: t for i, t in texts_of(spark).items() if len(t or "") < 3000}
    texts = short | {-1: None, -2: "", -3: f"so {' '.join(bad)} it is", -4: f"{bad} {bad.upper()} {bad[:1] * 3 + bad[1:]}"}
    frame = spark.createDataFrame([(i, t, 0.5) for i, t in texts.items()], "doc_id long, text string, score double")
    got = {r.doc_id: r for r in toxicity.score_toxicity(frame, model).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        words = set()
        for token in (text or "").split():
            words.update(toxicity.Restorer(model.chars).readings(token))
        words.update(toxicity.Restorer(model.chars).spaced(text or ""))
        best = sorted((max([model.evidence.get(c, 0.0) for c in toxicity.clues(w)] or [0.0]) for w in words), reverse=True)
        x = math.log(1 + sum(s / (1 + k) for k, s in enumerate(best)))
        score = 1 / (1 + math.exp(-max(-30.0, min(30.0, model.slope * x + model.bias))))
        assert abs(got[i].score - score) < 1e-9 and got[i].predicted == int(got[i].score >= 0.7)
    assert got[-1].score == got[-2].score == min(r.score for r in got.values())


def test_toxicity_learns_from_every_label(spark):
    """More labels than any sample held: words, clues and scale are those of learning from all texts at once."""
    words = "the a this some one other thing word time place goes comes stays and or".split()
    kinds = ["stupid", "idiot", "moron"]
    say = lambda k: " ".join(words[(k * p + k // 7) % len(words)] for p in (1, 3, 5, 7, 11))
    rows = [(k, f"{say(k)} {kinds[k // 9 % 3] if k % 9 == 0 else ''} x{k}", int(k % 9 == 0)) for k in range(4500)]
    rows += [(9000, "seldomword seldomword", 0), (9001, rows[0][1], 1), (9002, None, 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(5)
    model = toxicity.fit_toxicity(table.select("doc_id", "text"), table.select("doc_id", "toxic"), F.lit(True))
    by_jobs = toxicity.fit_toxicity(table.select("doc_id", "text"), table.select("doc_id", "toxic"), F.lit(True), sets_in_hand=0)
    assert by_jobs.evidence == model.evidence and by_jobs.slope == model.slope
    once = sorted({(t, y) for _, t, y in rows if t is not None})
    want = toxicity.train([t for t, _ in once], [y for _, y in once])
    assert list(model.evidence) == list(want.evidence) and model.evidence == pytest.approx(want.evidence)
    assert (model.slope, model.bias) == pytest.approx((want.slope, want.bias), rel=1e-6)
    assert model.chars.tri.keys() == want.chars.tri.keys() and model.chars.total == pytest.approx(want.chars.total, rel=1e-6)
    assert model.chars.tri["se"]["l"] > 0


def test_toxicity_decodes_only_what_may_tell(monkeypatch):
    """Tokens that cannot hold a clue are not decoded; those that can give what reading all of a text's words gives."""
    model = toxicity.train(["the stupid idiot spoke"] * 5 + ["a kind letter was here", "some other words then"] * 30, [1] * 5 + [0] * 60)
    wanted = {"idiot": 1.0, "idio*": 1.0, "stup*": 1.0}
    tokens = "1d10t !d|ot$ (stuuup1d) st*pid ididiot $tupefy 5tu letter, b00ks 7all Ünnütz aaa*aa 28bca0e1aeaae1e7 s.t.u.p.i.d".split()
    text = " ".join([*tokens, "you i d 1 o t", "a-b_c x y z~q"])
    readings = toxicity.Restorer(model.chars).words(text)
    want = {w for w in readings if any(c in wanted for c in toxicity.clues(w))}
    assert len(want) > 3 and toxicity.Telling(toxicity.Restorer(model.chars), wanted)(text) == want
    clues = toxicity.Telling(toxicity.Restorer(model.chars), wanted, as_clues=True)
    assert clues(text) == {c for w in readings for c in toxicity.clues(w)} & set(wanted)
    assert [m.span() for m in toxicity.spaced_runs(text)] == [m.span() for m in toxicity._spaced.finditer(text)] != []
    decoded = []
    monkeypatch.setattr(toxicity, "decode", lambda token, chars, spaced=False: decoded.append(token) or token)
    toxicity.Telling(toxicity.Restorer(model.chars), wanted)("b00ks letter hammer 28bca0e1aeaae1e7 1d10t")
    assert decoded == ["1d10t"]
