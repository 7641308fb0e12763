"""N-gram Jaccard join and suffix-array dedup against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from linkwell.llm import jaccard, repeats, shingles
from linkwell.llm.components import components
from linkwell.llm.runtime import documents

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def sets(rows, k):
    out = {}
    for doc_id, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        out[doc_id] = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    return out


def brute(rows, k, percent):
    s, lists, shared = sets(rows, k), defaultdict(list), Counter()
    for d, x in s.items():
        for e in x:
            lists[e].append(d)
    for ids in lists.values():
        shared.update((a, b) for i, b in enumerate(ids) for a in ids[:i])
    parent = {d: d for d in s}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(s[a]) + len(s[b]) - n):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {d: (len(s[d]), root(d)) for d in s}


def near_copies(seed, n):
    rng, words = random.Random(seed), [f"w{i}" for i in range(3000)]
    passage = rng.choices(words, k=40)
    rows = []
    for i in range(n):
        if i % 3 and rows:
            w = (rng.choice(rows)[1] or "").split()
            for _ in range(rng.randrange(0, 1 + len(w) // 12)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(words)
        else:
            w = rng.choices(words, k=rng.randrange(0, 90)) + (passage if rng.random() < 0.5 else [])
        rows.append((i, " ".join(w).upper() if rng.random() < 0.2 else "\n".join(w)))
    return rows


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80), (1, 50)])
def test_join_equals_brute_force(make, k, percent):
    rows = near_copies(k, 250)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(make(rows), k, percent).collect()}
    assert got == brute(rows, k, percent)


def test_split_lists_lose_no_link(make, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT_LIST", 3)
    monkeypatch.setattr(jaccard, "LIST", 4)
    rows = near_copies(9, 250)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(make(rows), 2, 70).collect()}
    assert got == brute(rows, 2, 70)


def brute_links(rows, k, percent):
    s = {d: x for d, x in sets(rows, k).items() if x}
    return {(a, b): len(s[a] & s[b]) / len(s[a] | s[b]) for a in s for b in s if a < b and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b])}


@pytest.mark.parametrize(("k", "percent", "part"), [(4, 85, 2000), (1, 50, 2000), (2, 70, 3)])
def test_every_link_is_found_and_counted(make, monkeypatch, k, percent, part):
    monkeypatch.setattr(jaccard, "PART_SETS", part)
    monkeypatch.setattr(jaccard, "HOT_LIST", 3 if part == 3 else jaccard.HOT_LIST)
    rows = near_copies(k, 250)
    rows += [(1000 + i, t) for i, t in rows[:30]] + [rows[3], rows[40]]
    want, n = brute_links(rows, k, percent), Counter()
    for pair in want:
        n.update(pair)
    links, members = jaccard.representative_links(make(rows), k, percent)
    got = [((r.a, r.b), r.similarity) for r in jaccard.document_links(links, members).collect()]
    assert len(got) == len(want) and dict(got) == pytest.approx(want)
    for found in (members, jaccard.jaccard_join(make(rows), k, percent)):
        found = found.collect()
        assert len(found) == len(rows) and {r.doc_id: r.n_links for r in found} == {d: n[d] for d, _ in rows}
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute(rows, k, percent)
    assert max(n.values()) > 3


def test_texts_of_one_doc_id_are_one_node(make):
    rng, words = random.Random(8), [f"w{i}" for i in range(500)]
    x, y, z = (rng.choices(words, k=100) for _ in range(3))
    near = lambda w: " ".join([*w[:-1], "other"])
    rows = [(5, " ".join(x)), (5, " ".join(y)), (7, " ".join(x)), (9, near(x)), (11, near(y)), (13, " ".join(z)), (15, near(z)), (15, near(z)), (17, "alone")]
    got = [(r.doc_id, r.component_id, r.n_links) for r in jaccard.jaccard_join(make(rows, 1), 4, 85).collect()]
    assert sorted(got) == sorted([(5, 5, 2), (5, 5, 1), (7, 5, 2), (9, 5, 2), (11, 5, 1), (13, 13, 1), (15, 13, 1), (15, 13, 1), (17, 17, 0)])
    kept = [sorted((r.doc_id, r.text) for r in jaccard.one_of_each(make(rows, n), 4, 85).collect()) for n in (1, 3)]
    assert kept[0] == kept[1] and [d for d, _ in kept[0]] == [5, 13, 17]


def test_dissimilar_copies_of_one_base(make, monkeypatch):
    """Each is near to the base, few are near to one another; the candidates that leave a list are few."""
    rng = random.Random(12)
    base, rows = [f"w{i}" for i in range(300)], []
    for i in range(300):
        w = list(base)
        for at in rng.sample(range(300), 5):
            w[at] = f"x{i}y{at}"
        rows.append((i, " ".join(w)))
    rows.append((300, " ".join(base)))
    got = jaccard.jaccard_join(make(rows, 6), 4, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 4, 85)
    degrees = Counter(d for pair in brute_links(rows, 4, 85) for d in pair)
    assert {r.doc_id: r.n_links for r in got} == {d: degrees[d] for d, _ in rows}
    # one cell: every pair is a candidate of another component, at most one fewer than the components leave
    sets_ = [np.unique(np.random.default_rng(i % 3).integers(0, 1 << 63, 200, dtype=np.uint64)) for i in range(60)]
    bits = [jaccard._bitmap(s) for s in sets_]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1] * 60), pa.array([0] * 60), pa.array([200] * 60, pa.int32()), pa.array([0] * 60, pa.int32()), pa.array(range(60)), pa.array(bits, pa.binary())], names=list("tcspob"))
    out = [p for b in jaccard._across(85)(iter([batch])) for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
    assert len(out) == 57 and all((a - b) % 3 == 0 for a, b in out)


def test_join_on_the_smallest_table(spark, small):
    from linkwell.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in documents(spark, small).collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op1_ngram_jaccard_join"](spark, small).collect()}
    assert got == brute(rows, 4, 85)


def test_join_of_awkward_rows(awkward, make):
    got = [tuple(r) for r in jaccard.jaccard_components(awkward, 4, 85).collect()]
    assert len(got) == 10
    by = {d: (n, c) for d, n, c in got}
    assert by[1] == (0, 1) and by[2] == (0, 2) and by[3] == (0, 3) and by[4] == (1, 4) and by[5][1] == by[6][1] == 5
    assert by[None][1] is None
    kept = jaccard.one_of_each(awkward)
    assert kept.columns == awkward.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "2", "3", "4", "None", "5", "7", "8"])
    assert jaccard.jaccard_components(make([]), 4, 85).count() == 0


def test_many_near_copies_stay_in_one_group(make):
    rng = random.Random(1)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(400):
        w = list(base)
        w[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(w)))
    got = jaccard.jaccard_components(make(rows, 8), 4, 85).collect()
    assert {r.component_id for r in got} == {0}


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 300), dtype=np.uint64))
        b = np.unique(np.concatenate([rng.choice(a, rng.integers(0, len(a)) + 1), rng.integers(0, 1 << 63, rng.integers(0, 80), dtype=np.uint64)]))
        assert jaccard._differ_at_least(jaccard._bitmap(a), jaccard._bitmap(b)) <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("few", [0, 1 << 16])
def test_components(spark, monkeypatch, few):
    from linkwell.llm import components as module

    monkeypatch.setattr(module, "FEW", few)
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1080)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    looped = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in looped}


def test_word_hashes_are_of_words():
    texts = ["Ab  cd\tAB", "", "x\x0by é", "cd ab"]
    data = "".join(texts).encode()
    ends = np.cumsum([0, *[len(t.encode()) for t in texts]])
    h, before = shingles.word_hashes(np.frombuffer(data, np.uint8), ends)
    assert before.tolist() == [0, 3, 3, 6, 8]
    assert h[0] == h[2] == h[7] and h[1] == h[6] and len(set(h.tolist())) == 5


# -- repeats


def removed(rows, least):
    starts = Counter()
    for _, t in rows:
        b = (t or "").encode()
        starts.update(b[i : i + least] for i in range(len(b) - least + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        keep = np.ones(len(b), bool)
        for i in range(len(b) - least + 1):
            if starts[b[i : i + least]] > 1:
                keep[i : i + least] = False
        kept = np.frombuffer(b, np.uint8)[keep].tobytes()
        out.append((d, len(b), len(b) - len(kept), len(repeats.runs(~keep)), hashlib.sha256(kept).hexdigest()))
    return out


def passages(seed, n):
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choices("abcdé ", k=k))
    shared = [text(rng.randrange(60, 400)) for _ in range(4)]
    rows = []
    for i in range(n):
        t = text(rng.randrange(0, 200))
        for _ in range(rng.randrange(0, 3)):
            s = rng.choice(shared)
            a = rng.randrange(len(s))
            t += s[a : a + rng.randrange(20, 200)] + text(rng.randrange(0, 60))
        if i % 9 == 0:
            t += "xyz" * rng.randrange(10, 100)
        rows.append((i, rows[-1][1] if i % 11 == 5 else t))
    return rows


def key(row):
    return tuple(str(x) for x in row)


@pytest.mark.parametrize(("least", "hot", "segment"), [(50, 1000, 1 << 20), (50, 1, 1 << 20), (80, 2, 256)])
def test_dedup_equals_brute_force(make, monkeypatch, least, hot, segment):
    monkeypatch.setattr(repeats, "GRAM", 12)
    monkeypatch.setattr(repeats, "PARTS", 8 if hot == 1 else 3)
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "SEGMENT", segment)
    rows = passages(least + hot, 120)
    got = [tuple(r)[:5] for r in repeats.dedup(make(rows), least).collect()]
    assert sorted(got, key=key) == sorted(removed(rows, least), key=key)


def test_dedup_on_the_smallest_table(spark, small):
    from linkwell.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in documents(spark, small).collect()]
    got = [tuple(r) for r in QUERIES["op7_suffix_array_dedup"](spark, small).collect()]
    assert sorted(got, key=key) == sorted(removed(rows, 400), key=key)


def test_dedup_of_a_larger_table_equals_counting(spark):
    """Every window of 400 bytes of all texts, by another hash: far more than one search holds."""
    import xxhash
    from linkwell.llm.queries import QUERIES

    docs = {r.doc_id: (r.text or "").encode() for r in documents(spark, "/root/testdata/sf0.1").collect()}
    assert sum(map(len, docs.values())) > 16 * repeats.BATCH
    hashes, starts = [], [0]
    for b in docs.values():
        hashes.append(np.fromiter((xxhash.xxh3_64_intdigest(b[i : i + 400]) for i in range(max(0, len(b) - 399))), np.uint64))
        starts.append(starts[-1] + len(hashes[-1]))
    every = np.concatenate(hashes)
    ordered = np.sort(every)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    twice = again[np.minimum(np.searchsorted(again, every), len(again) - 1)] == every
    got = {r.doc_id: r for r in QUERIES["op7_suffix_array_dedup"](spark, "/root/testdata/sf0.1").collect()}
    assert got.keys() == docs.keys()
    for (d, b), x, y in zip(docs.items(), starts, starts[1:], strict=False):
        keep = np.ones(len(b), bool)
        for i, j in repeats.runs(twice[x:y]):
            keep[i : j + 399] = False
        kept = np.frombuffer(b, np.uint8)[keep].tobytes()
        assert (got[d].n_removed, got[d].n_spans, got[d].kept_sha256) == (len(b) - len(kept), len(repeats.runs(~keep)), hashlib.sha256(kept).hexdigest())
    assert sum(r.n_removed > 0 for r in got.values()) > 1000


def test_dedup_of_awkward_rows(awkward, make):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    got = repeats.dedup(awkward).collect()
    assert sorted([tuple(r)[:5] for r in got], key=key) == sorted(removed(rows, 400), key=key)
    assert all(r.kept is not None for r in got)
    assert repeats.dedup(make([])).count() == 0


def test_interval_expansion_equals_counting():
    rng = np.random.default_rng(0)
    for _ in range(200):
        least, letters = int(rng.integers(2, 9)), int(rng.integers(1, 4))
        pieces = [rng.integers(1, letters + 1, int(rng.integers(0, 40))) for _ in range(rng.integers(1, 6))]
        text = np.concatenate([np.append(p, 0) for p in pieces]).astype(np.int16)
        windows = [tuple(text[i : i + least]) for i in range(len(text) - least + 1)]
        counts = Counter(w for w in windows if 0 not in w)
        want = np.array([i < len(windows) and counts[windows[i]] > 1 for i in range(len(text))])
        assert (repeats.repeated_starts(text, least) == want).all()
