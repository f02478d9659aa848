"""Near duplicates and repeated passages against brute force."""
import hashlib
import random
import re

import numpy as np
import pytest

from tallybench.llm import minhash, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, size):
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[i: i + size]) for i in range(max(len(words) - size + 1, 1))) if words else frozenset()


def classes(rows, size):
    """(shingles, component, kept) of each row by comparing all pairs."""
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
                parent[find(a)] = find(b)
    order = lambda i: (rows[i][0] is not None, rows[i][0] or 0)
    least = {}
    for a in range(len(rows)):
        least.setdefault(find(a), []).append(a)
    least = {k: min(v, key=order) for k, v in least.items()}
    return [(i, len(s), rows[least[find(a)]][0], i == rows[least[find(a)]][0]) for a, ((i, _), s) in enumerate(zip(rows, sets))]


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(docs, texts, size):
    got = [tuple(r) for r in minhash.near_duplicates(docs, size=size).collect()]
    assert sorted(got, key=str) == sorted(classes(texts, size), key=str)


def family(draw, n, words):
    base = [f"w{draw.randrange(400)}" for _ in range(words)]
    out = []
    for _ in range(n):
        text = list(base)
        for _ in range(draw.randrange(0, 14)):
            text[draw.randrange(words)] = f"w{draw.randrange(40)}"
        out.append(" ".join(text))
    return out


def test_a_large_family_of_variants(spark):
    """Links that no hub shows: variants of a text, many near the threshold."""
    draw = random.Random(11)
    rows = [(i, t) for i, t in enumerate(family(draw, 700, 100) + family(draw, 40, 30) + [" ".join(f"u{draw.randrange(9000)}" for _ in range(80)) for _ in range(200)])]
    got = [tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), size=2).collect()]
    assert sorted(got) == sorted(classes(rows, 2))


def test_empty_tables(nothing, docs):
    assert minhash.near_duplicates(nothing).count() == 0
    assert substrings.report(nothing).count() == 0
    assert substrings.without_repeats(nothing).columns == docs.columns
    assert substrings.without_repeats(nothing).count() == 0


def test_sketches_fill_and_estimate():
    draw = np.random.default_rng(2)
    pool = draw.integers(0, 1 << 63, 1500, dtype=np.uint64)
    sets = [pool[:1000], pool[100:1100], pool[500:1500], pool[:1], pool[1:4]]
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    table = minhash.sketches(doc, np.concatenate(sets), len(sets), 512)
    assert (table != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    assert abs((table[0] == table[1]).mean() - 900 / 1100) < 0.07
    assert abs((table[0] == table[2]).mean() - 500 / 1500) < 0.09
    alone = minhash.sketches(np.zeros(1000, int), pool[:1000], 1, 512)
    assert (alone[0] == table[0]).all()  # a sketch depends on its own set alone


def covered(rows, window):
    """Kept words and flags of each row, by all windows of all smaller ids."""
    starts = {}
    for i, t in rows:
        words = WORD.findall(t or "")
        if i is not None:
            for k in range(len(words) - window + 1):
                key = tuple(words[k: k + window])
                starts[key] = min(starts.get(key, i), i)
    out = []
    for i, t in rows:
        words = WORD.findall(t or "")
        gone = [False] * len(words)
        if i is not None:
            for k in range(len(words) - window + 1):
                if starts[tuple(words[k: k + window])] < i:
                    gone[k: k + window] = [True] * window
        out.append((i, t, words, gone))
    return out


@pytest.mark.parametrize("window", [50, 12, 3])
def test_substrings(docs, texts, window):
    got = sorted((tuple(r) for r in substrings.report(docs, window=window).collect()), key=str)
    want = [(i, len(w), sum(g), hashlib.sha256(" ".join(x for x, y in zip(w, g) if not y).encode()).hexdigest()) for i, _, w, g in covered(texts, window)]
    assert got == sorted(want, key=str)


def test_texts_without_repeats(docs, texts):
    rows = substrings.without_repeats(docs, window=50)
    assert rows.schema == docs.schema or rows.columns == docs.columns
    got = sorted(((r.doc_id, tuple(WORD.findall(r.text or "")), r.source, r.h[0]) for r in rows.collect()), key=str)
    want = [(i, tuple(x for x, y in zip(w, g) if not y), f"s{n % 3}", n) for n, (i, _, w, g) in enumerate(covered(texts, 50))]
    assert got == sorted(want, key=str)
    kept = {r.h[0]: r.text for r in rows.collect()}
    assert all(kept[n] == t for n, (_, t, _, g) in enumerate(covered(texts, 50)) if not any(g))


def test_automaton_finds_what_a_search_finds():
    draw = random.Random(6)
    for window in (2, 3, 5):
        automaton, before = substrings.Automaton(), []
        for owner in range(30):
            words = [draw.randrange(3) for _ in range(draw.randrange(0, 25))]
            known = {tuple(b[i: i + window]) for b in before for i in range(len(b) - window + 1)}
            assert automaton.covered(words, owner, window) == [i for i in range(len(words) - window + 1) if tuple(words[i: i + window]) in known]
            automaton.add(words, owner)
            before.append(words)
        low = min(i for i, b in enumerate(before) if b)
        assert all(f is None or f >= low for f in automaton.first)


def test_least_hubs_keep_components_with_few_links(spark):
    from tallybench.llm.groups import components
    rng = random.Random(4)
    rows = [(a, rng.randrange(0, 20)) for a in range(20, 400) for _ in range(30)]  # a crowd with many hubs
    rows += [(500, 500), (600, 599), (601, 600), (700, 650), (701, 650), (701, 651)]
    links = spark.createDataFrame(rows, "a long, b long")
    few = minhash.least_hubs(links)
    assert few.count() < links.distinct().count() / 5
    assert sorted(map(tuple, components(few).collect())) == sorted(map(tuple, components(links).collect()))
