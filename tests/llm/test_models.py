"""Language ID, quality and licence models: gradients, solvers, held-out accuracy, defined results."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from linkwell.llm import language, licences, quality
from linkwell.llm.queries import QUERIES
from linkwell.llm.shingles import word_hashes

MEDIUM = "/root/testdata/sf0.01"


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3


def test_backpropagation_equals_differences():
    rng = np.random.default_rng(0)
    model = language.new_model(["a", "b", "c"])
    for k in model:
        if k != "languages":
            model[k] = model[k].astype(np.float64)
    windows, labels = rng.integers(0, 6, (7, 5)).astype(np.uint8), np.array([0, 1, 2, 0, 1])
    states = language.states
    try:
        # the same in double precision
        language.np = type("Double", (), {"__getattr__": lambda self, n: np.float64 if n == "float32" else getattr(np, n)})()
        loss, grads = language.gradients(model, windows, labels)
        for name, g in grads.items():
            for _ in range(4):
                at = tuple(rng.integers(0, s) for s in g.shape)
                if name.endswith("_in"):
                    at = (at[0], int(rng.integers(0, 6)))
                kept, step = model[name][at], 1e-5
                model[name][at] = kept + step
                up, _ = language.gradients(model, windows, labels)
                model[name][at] = kept - step
                down, _ = language.gradients(model, windows, labels)
                model[name][at] = kept
                assert abs((up - down) / (2 * step) - g[at]) < 1e-6 + 1e-4 * abs(g[at]), name
    finally:
        language.np = np
    assert states is language.states


def test_windows_cover_whole_texts():
    texts = [b"", b"a" * 64, b"b" * 65, b"c"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    windows, row = language.cut(data, np.cumsum([0, *map(len, texts)]))
    assert row.tolist() == [1, 2, 2, 3] and [bytes(w).rstrip(b"\0") for w in windows] == [b"a" * 64, b"b" * 64, b"b", b"c"]


def test_language_of_held_out_documents(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}
    got = QUERIES["op5_language_id"](spark, MEDIUM).collect()
    assert len(got) == len(docs)
    assert all(r.held_out == (fold(r.doc_id) == 1) for r in got)
    held = [r.lang_pred == docs[r.doc_id].lang for r in got if r.held_out]
    assert np.mean(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_awkward_rows(awkward, make):
    got = language.identify(awkward).collect()
    assert len(got) == 10
    by = {r.doc_id: r for r in got}
    for d in (1, 2, 3, 8):
        assert (by[d].lang_pred, by[d].score) == ("und", 0.0)
    assert by[7].lang_pred in ("en", "fr", "de")
    assert by[5].lang_pred == by[6].lang_pred and by[5].score == by[6].score
    kept = language.accepted(awkward, 0.0)
    assert kept.columns == awkward.columns and {r.doc_id for r in kept.collect()} == {4, 5, 6, 7, None}
    assert language.identify(make([])).count() == 0
    unlabelled = language.identify(make([(2, "some words")])).first()
    assert (unlabelled.lang_pred, unlabelled.score) == ("und", 0.0)
    assert language.accepted(make([(2, "some words")])).count() == 0


def naive_position_scores(model, window):
    """The network at every position of one window, a byte at a time."""
    sig = lambda x: 1 / (1 + np.exp(-x))
    h, out = language.HIDDEN, np.zeros((len(window), len(model["languages"]))) + model["bias"][:, 0]
    for side in "fb":
        state = np.zeros(h)
        for t in range(len(window)) if side == "f" else reversed(range(len(window))):
            x, s = model[f"{side}_in"][:, window[t]].astype(float), model[f"{side}_state"] @ state
            z, r = sig(x[:h] + s[:h]), sig(x[h : 2 * h] + s[h : 2 * h])
            new = np.tanh(x[2 * h :] + r * (s[2 * h :] + model[f"{side}_new"][:, 0]))
            state = z * state + (1 - z) * new
            out[t] += model[f"{side}_out"] @ state
    e = np.exp(out - out.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def test_language_query_equals_brute_force(spark, small):
    docs = sorted((r.doc_id, r.text or "", r.lang) for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    languages = sorted({lang for _, _, lang in docs if lang})
    windows, labels = [], []
    for lang in languages:
        for d, text, own in docs:
            raw = text.encode()
            if own == lang and fold(d) != 1 and raw:
                n = -(-len(raw) // 64)
                for i in sorted({int(x) for x in np.linspace(0, n - 1, 6)}):
                    windows.append(np.frombuffer(raw[64 * i : 64 * i + 64].ljust(64, b"\0"), np.uint8))
                    labels.append(languages.index(lang))
    model = language.train(np.array(windows), np.array(labels), languages)
    got = {r.doc_id: r for r in QUERIES["op5_language_id"](spark, small).collect()}
    assert len(got) == len(docs)
    for d, text, _ in docs[::3]:
        raw, total = text.encode(), np.zeros(len(languages))
        for at in range(0, len(raw), 64):
            window = raw[at : at + 64].ljust(64, b"\0")
            p = naive_position_scores(model, list(window))
            total += p[[bool(language._LETTER[b]) for b in window]].sum(axis=0)
        if any(c.isalpha() for c in text):
            p = total / total.sum()
            assert got[d].lang_pred == languages[p.argmax()] and abs(got[d].score - p.max()) < 1e-3
        else:
            assert (got[d].lang_pred, got[d].score) == ("und", 0.0)


def test_hinge_loss_is_least():
    rng = np.random.default_rng(1)
    x, y = rng.standard_normal((60, 5)), np.where(rng.random(60) < 0.5, -1, 1)
    rows, cap = [np.arange(5)] * 60, 60 / (2 * np.array([(y < 0).sum(), (y > 0).sum()])[(y > 0).astype(int)])
    w, b = quality.dual_coordinate_descent(rows, list(x), y, 5, epochs=3000)

    def objective(w, b):
        return (w @ w + b * b) / 2 + (cap * np.maximum(0, 1 - y * (x @ w + b))).sum()

    best = objective(w, b)
    for _ in range(200):
        assert objective(w + rng.standard_normal(5) * 0.05, b + rng.standard_normal() * 0.05) >= best - 1e-2


def test_ratios_and_curve():
    r = quality.log_count_ratios(np.array([9, 0]), np.array([0, 9]))
    assert r[0] < 0 < r[1] and abs(r[0] + r[1]) < 1e-12
    a, b = quality.logistic_curve(np.array([-2.0, -1, 1, 2] * 20), np.array([0, 0, 1, 1] * 20, float))
    assert a > 0 and abs(b) < 0.2


def test_indicators_are_of_whole_rows():
    texts = ["ab ab", "", "x\nx\ny", "ab ab"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    found = list(quality.indicators(data, np.cumsum([0, *map(len, texts)])))
    assert found[0].tolist() == found[3].tolist() and len(found[1]) == 0 and set(found[0]) != set(found[2])


def test_quality_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in QUERIES["op2_quality_classifier"](spark, sf).collect()]
    assert len(got) == 10_000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [(r.score, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    good, bad = ([s for s, q in held if q == want] for want in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.98
    assert np.mean([(s >= 0.5) == q for s, q in held]) > 0.97


def naive_indicators(text):
    mask, bits, out = (1 << 64) - 1, quality.BITS, set()
    mixes = [int(x) for x in quality._MIX]
    raw = text.encode()
    for n in range(1, 5):
        for i in range(len(raw) - n + 1):
            h = 0
            for b in raw[i : i + n]:
                h = (h * 257 + b + 1) & mask
            out.add((h * mixes[n - 1] & mask) >> 64 - bits)
    words, _ = word_hashes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    words = words.tolist()
    out |= {(w * mixes[0] & mask) >> 64 - bits for w in words}
    lines = [x for x in raw.split(b"\n") if x.strip()]
    extra = [32 + (len(lines) - len(set(lines))).bit_length()]
    extra += [sum(a == b for a, b in itertools.pairwise(words)).bit_length()] if words else []
    out |= {(x + 1) * 2654435761 % (1 << bits) for x in extra}
    return sorted(out) if raw else []


def test_quality_query_equals_brute_force(spark, small):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect() if r.quality is not None}
    found = {d: np.array(naive_indicators(t), np.int64) for d, t in docs.items()}
    known = sorted((d for d in docs if d in labels and fold(d) != 1), key=lambda d: (d * 2654435761 % (1 << 32), d))
    counts = np.zeros((2, 1 << quality.BITS))
    for d in known:
        counts[labels[d]][found[d]] += 1
    ratios = np.log((counts[1] + 1) / (counts[1] + 1).sum()) - np.log((counts[0] + 1) / (counts[0] + 1).sum())
    value = lambda d: ratios[found[d]] / max(np.sqrt((ratios[found[d]] ** 2).sum()), 1e-9)
    nth, fitting, held = Counter(), [], []
    for d in known:
        nth[labels[d]] += 1
        (held if nth[labels[d]] % quality.CALIBRATE == 0 else fitting).append(d)
    y = np.array([2 * labels[d] - 1 for d in fitting])
    w, bias = quality.dual_coordinate_descent([found[d] for d in fitting], [value(d) for d in fitting], y, 1 << quality.BITS)
    n1 = sum(labels[d] for d in known)
    a, b = quality.logistic_curve(np.array([w[found[d]] @ value(d) + bias for d in held]), np.array([labels[d] for d in held], float), (n1 + 1) / (len(known) + 2))
    got = {r.doc_id: r for r in QUERIES["op2_quality_classifier"](spark, small).collect()}
    assert got.keys() == docs.keys()
    for d, r in got.items():
        want = 1 / (1 + math.exp(-max(-40, min(40, a * (w[found[d]] @ value(d) + bias) + b))))
        assert abs(r.score - want) < 1e-3 and r.held_out == (fold(d) == 1)


def test_rare_class_keeps_its_classifier(make, spark, monkeypatch):
    """Samples are drawn per class, and within a bound of features."""
    monkeypatch.setattr(quality, "SAMPLE", 40)
    monkeypatch.setattr(quality, "MOST_FEATURES", 40_000)
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(["buy", "now", "cheap"] if i % 50 == 0 else ["calm", "river", "stone"], k=20))) for i in range(2000)]
    labels = spark.createDataFrame([(i, int(i % 50 != 0), 0) for i, _ in rows], "doc_id bigint, quality int, toxic int")
    got = quality.score(make(rows), quality.fit(make(rows), labels)).collect()
    assert np.mean([r.predicted == (r.doc_id % 50 != 0) for r in got if r.held_out]) > 0.98
    assert np.mean([r.predicted == 0 for r in got if r.held_out and r.doc_id % 50 == 0]) > 0.9
    tied = quality.score(make([(1, "same words"), (2, "same words")]), {"prior": 0.5}).collect()
    assert {(r.score, r.predicted) for r in tied} == {(0.5, 1)}
    assert quality.fit(make([]), labels.limit(0)) == {"prior": 0.5}


def test_quality_of_awkward_rows(spark, awkward, make):
    labels = spark.createDataFrame([(2, 1, 0), (3, 0, 0), (4, 1, 1), (5, None, 0), (7, 0, 0), (7, 0, 0)], "doc_id bigint, quality int, toxic int")
    got = quality.score(awkward, quality.fit(awkward, labels)).collect()
    assert len(got) == 10 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (5, 6)}) == 1
    none = quality.score(awkward, quality.fit(awkward, labels.limit(0))).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.score(make([]), {"prior": 0.5}).count() == 0


# -- licences


def test_licences_are_found_and_confirmed(make):
    lines = {
        1: ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
        2: ("Released under the MIT License.", "MIT"),
        3: ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
        4: ("Licensed under CC BY-NC 4.0.", "CC-BY-NC"),
        5: ("All rights reserved.", "proprietary"),
        6: ("Er kam mit dem Zug und ging mit ihr.", None),
        7: ("Her driving licence expired in March.", None),
        8: ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "MPL-2.0"),
        9: ("released under the mit license", "MIT"),
    }
    rows = [(i, f"mit der und die\n{line}\nmore words of no meaning") for i, (line, _) in lines.items()]
    got = {(r.doc_id, r.paragraph): r for r in licences.scan(make(rows)).collect()}
    assert {k: r.family for k, r in got.items()} == {(i, 1): f for i, (_, f) in lines.items() if f}
    assert all(r.confirmed and 0.6 <= r.probability <= 1 for r in got.values())


def test_wrapped_notices_are_found(make):
    mit = "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated\ndocumentation files."
    gpl = "This program is free software: you can redistribute it and/or\nmodify it under the terms of the GNU General Public License."
    rows = [(1, f"# about\n\n{mit}\n\nplain words"), (2, f"first line\n{gpl}\nlast line"), (3, "Released under the MIT License.\nAll rights reserved.\nplain")]
    got = {(r.doc_id, r.paragraph, r.n_lines, r.family) for r in licences.scan(make(rows)).collect() if r.confirmed}
    assert {(1, 2, "MIT"), (2, 1, "GPL-3.0"), (3, 0, "MIT"), (3, 1, "proprietary")} == {(d, p, f) for d, p, _, f in got}
    assert {(1, 3), (3, 1)} <= {(d, n) for d, _, n, _ in got}


def test_scan_equals_brute_force(spark):
    """Each line of a whole table, scored one by one."""
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").limit(300)
    model = licences.train(licences.sample_lines(docs))
    at = {g: i for i, g in enumerate(model["vocabulary"])}
    want = {}
    for r in docs.collect():
        for i, line in enumerate((r.text or "").split("\n")):
            grams = licences.grams(line)
            of = [at[g] for g in grams if g in at]
            z = model["weights"][of].sum(axis=0) + model["weights"][-1]
            p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            family = model["families"][p.argmax()]
            if of and p.argmax() and round(p.max(), 6) >= licences.LEAST_PROBABILITY:
                share = max(len(set(licences.pairs_of(t)) & set(grams)) / len(licences.pairs_of(t)) for t in licences.TEMPLATES[family])
                want[r.doc_id, i] = (family, round(p.max(), 4), round(share, 4))
    got = {(r.doc_id, r.paragraph): (r.family, round(r.probability, 4), round(r.similarity, 4)) for r in licences.scan(docs, model).collect() if r.n_lines == 1}
    assert got and got == want


def test_every_licence_line_of_a_table_is_found(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()
    known = {t for texts in licences.TEMPLATES.values() for t in texts}
    want = {(r.doc_id, i) for r in docs for i, line in enumerate(r.text.split("\n")) if line in known}
    got = QUERIES["op6_licence_scans"](spark, MEDIUM).collect()
    assert want and {(r.doc_id, r.paragraph) for r in got} == want
    assert all(r.confirmed for r in got)


def test_long_lines_and_ties(make):
    long = "plain words of prose " * 100_000 + "Released under the MIT License."
    rows = [(1, long), (2, f"{long}\nAll rights reserved."), (3, "All rights reserved.\nAll rights reserved.")]
    got = sorted((r.doc_id, r.paragraph, r.n_lines, r.family) for r in licences.scan(make(rows)).collect())
    assert got == [(1, 0, 1, "MIT"), (2, 0, 1, "MIT"), (2, 1, 1, "proprietary"), (3, 0, 1, "proprietary"), (3, 1, 1, "proprietary")]


def test_licences_of_awkward_rows(awkward, make):
    assert licences.scan(awkward).count() == 0
    assert licences.scan(make([])).count() == 0
    twice = licences.scan(make([(1, "All rights reserved."), (1, "All rights reserved.")])).collect()
    assert len(twice) == 2


def test_grams_agree_with_columns(spark):
    from pyspark.sql import functions as F

    texts = ["Version 2.0 of it, it", "", "one", "CC BY-NC 4.0"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", licences.gram_column(F.col("t")).alias("g"))
    assert [sorted(r.g) for r in rows.orderBy("i").collect()] == [licences.grams(t) for t in texts]


def test_the_sample_drops_no_paragraph(make):
    ordinary = ["See LICENSE for details", "Version 2 was released", "Der Zug kam mit und unter the work", "All of it under the rights reserved by law", "the general public"] * 3
    model = licences.train(ordinary)
    lines = [t for texts in licences.TEMPLATES.values() for t in texts]
    lines += [" ".join(w[i:j]) for w in map(str.split, lines) for i in range(0, len(w), 2) for j in (i + 1, i + 3, i + 5)]
    lines += ["4.0license", "3.0 CC BY-NC 4.0x", "xMIT License_", "RELEASED under the MIT LICENSE", "License.5 of", *ordinary, *licences.DECOYS]
    at = {g: i for i, g in enumerate(model["vocabulary"])}
    want = set()
    for i, line in enumerate(lines):
        of = [at[g] for g in licences.grams(line) if g in at]
        z = model["weights"][of].sum(axis=0) + model["weights"][-1]
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        if of and p.argmax() and round(p.max(), 6) >= licences.LEAST_PROBABILITY:
            want.add((i, model["families"][p.argmax()]))
    assert (lines.index("Released under the MIT License."), "MIT") in want
    assert {(r.doc_id, r.family) for r in licences.scan(make(list(enumerate(lines))), model).collect()} == want


@pytest.mark.parametrize("seed", [1, 2])
def test_random_prose_has_no_licence(make, seed):
    rng = random.Random(seed)
    words = "the of and to in is it that was for on are with as his they be at one have this from".split()
    assert licences.scan(make([(i, " ".join(rng.choices(words, k=40))) for i in range(50)])).count() == 0
