"""Even shards with few cuts; neighbours against brute force."""
from collections import Counter, defaultdict

import numpy as np
import zlib

from tallybench.llm import groups, hnsw, ranks, shards


def test_shards(docs, texts, nothing):
    rows = shards.shard_documents(docs, shards=4).collect()
    count = Counter(r.shard for r in rows)
    assert len(rows) == len(texts) and max(count.values()) - min(count.values()) <= 1
    for s in count:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(count[s]))
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in rows) == sorted((i or -1, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts)
    held = defaultdict(set)
    for r in rows:
        if r.size > 8:
            held[r.size, r.text_crc32].add(r.shard)
    by_text = Counter(t for _, t in texts if t)
    quota = len(texts) // 4
    for text, n in by_text.items():  # whole where it fits; the large one in as few as it can
        assert len(held[len(text.encode()) + 8, zlib.crc32(text.encode())]) <= -(-n // quota) + (n > quota)
    assert all(r.law == "rows" and r.grown_shard is None for r in rows)
    assert shards.shard_documents(nothing).count() == 0
    few = shards.shard_documents(docs.limit(3)).collect()
    assert len({r.shard for r in few}) == 3


def shards_of_texts(spark, texts, n):
    rows = shards.shard_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), shards=n).collect()
    count, held = Counter(r.shard for r in rows), defaultdict(set)
    assert len(rows) == len(texts) and max(count.values()) - min(count.values()) <= 1
    for r in rows:
        held[texts[r.doc_id]].add(r.shard)
    return held


def test_shards_of_a_table_in_which_every_text_has_copies(spark):
    held = shards_of_texts(spark, [f"text {i % 240}" for i in range(480)], 24)
    assert len(held) == 240 and all(len(s) == 1 for s in held.values())
    mixed = [f"three {i % 24}" for i in range(72)] + [f"two {i % 96}" for i in range(192)]  # 11 a shard: 3 + 4 x 2
    assert all(len(s) == 1 for s in shards_of_texts(spark, mixed, 24).values())
    odd = shards_of_texts(spark, [f"text {i % 132}" for i in range(264)], 24)  # 11 a shard: a row of each is left
    assert sum(len(s) > 1 for s in odd.values()) == 12


def test_small_groups_stay_whole_beside_large_ones(spark):
    texts = ["large"] * 150 + ["middle"] * 70 + [f"pair {i % 60}" for i in range(120)] + [f"alone {i}" for i in range(60)]
    held = shards_of_texts(spark, texts, 4)
    assert len(held.pop("large")) == 2 and all(len(s) == 1 for s in held.values())


def test_placement_and_propagation():
    draw = np.random.default_rng(6)
    for n in range(60):
        sizes = {int(s): int(c) for s, c in zip(draw.integers(2, 60, 8), draw.integers(1, 40, 8))}
        total = sum(s * c for s, c in sizes.items()) + int(draw.integers(0, 50)) * (n % 2)
        quotas = [total // 7 + (s < total % 7) for s in range(7)]
        for tight in (True, False):
            whole, cut, room = shards.placement(sizes, quotas, tight)
            before = sum(r * r for _, _, parts in cut for r in parts.values())
            shards.propagate([parts for _, _, parts in cut], room)
            assert sum(r * r for _, _, parts in cut for r in parts.values()) >= before and len(cut) < 7
            load, numbers = Counter(), defaultdict(list)
            for size, first, end, shard in whole:
                load[shard] += size * (end - first)
                numbers[size] += range(first, end)
            for size, number, parts in cut:
                assert sum(parts.values()) == size and min(parts.values()) > 0
                load.update(parts)
                numbers[size].append(number)
            assert [load[s] + room[s] for s in range(7)] == quotas and min(room) >= 0
            assert {s: sorted(v) for s, v in numbers.items()} == {s: list(range(c)) for s, c in sizes.items()}
    parts, room = [{0: 1, 1: 1}], [0, 1]  # a member leaves a full shard for one with room
    shards.propagate(parts, room)
    assert parts == [{1: 2}] and room == [1, 0]
    parts, room = [{0: 3, 1: 2}, {0: 2, 1: 3}], [0, 0]  # rows cross both ways
    shards.propagate(parts, room)
    assert sorted(map(sorted, (p.items() for p in parts))) == [[(0, 5)], [(1, 5)]]


def test_ranks_of_a_crowded_group(spark):
    df = spark.range(5000).selectExpr("id", "case when id % 3 = 0 then 7 else id % 50 end as g")
    rows = ranks.ranked(df, "g", "id", "r", 5000 * 50_000).collect()
    found = defaultdict(list)
    for r in rows:
        found[r.g].append(r.r)
    assert all(sorted(v) == list(range(len(v))) for v in found.values()) and len(rows) == 5000


def test_components(spark):
    draw = np.random.default_rng(4)
    links = [(int(a), int(b)) for a, b in draw.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(1, 90)]
    parent = {x: x for link in links for x in link}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    rows = groups.components(spark.createDataFrame(links, "a long, b long")).collect()
    own = {x for a, b in links if a != b for x in (a, b)}
    assert {r.node: r.root for r in rows} == {x: find(x) for x in own}
    assert groups.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute(rows, k):
    ids = np.array([i for i, _ in rows])
    vectors = np.array([v for _, v in rows])
    out = {}
    for i, v in rows:
        if i % 20 == 0:
            score = vectors @ v
            order = np.lexsort((ids, -score))
            out[i] = [(int(ids[j]), float(score[j])) for j in order if ids[j] != i][:k]
    return out


def test_neighbours(spark):
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(12, 16))
    vectors = centres[draw.integers(0, 12, 1500)] + 0.4 * draw.normal(size=(1500, 16))
    vectors = vectors.astype(np.float32).astype(float)
    vectors[500:1000] = vectors[20]  # a third are copies
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    bad = [(2000, None), (2020, []), (2040, [0.0] * 16), (2060, [float("nan")] * 16), (2080, [None] + [1.0] * 15), (2100, [float("inf")] * 16), (None, [1.0] * 16), (2120, [1.0, 2.0])]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows + bad + rows[:3]], "vec_id long, embedding array<float>, score string, rank int")
    got = defaultdict(list)
    for r in hnsw.nearest(table, table.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    want = brute([(i, np.array(v)) for i, v in rows], 20)
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * 20 * len(want)
    exact = {i: v for i, v in rows}
    for q, found in got.items():
        assert len(found) == 20 and q not in {i for i, _ in found}
        assert np.allclose([s for _, s in found], [np.dot(exact[q], exact[i]) for i, _ in found], rtol=1e-12)
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
    copy = got[20]  # a query among the copies: the smallest ids first
    assert [i for i, _ in copy] == [i for i, _ in want[20]]


def test_recall_of_a_full_shard():
    draw, n = np.random.default_rng(5), hnsw.SHARD_ROWS
    centres = draw.normal(size=(200, 64))
    vectors = (centres[draw.integers(0, 200, n)] + 0.4 * draw.normal(size=(n, 64))).astype(np.float32).astype(float)
    order, layers = hnsw.build(vectors, np.arange(n))
    asked = np.arange(0, n, 20)
    unit = vectors[asked] / np.linalg.norm(vectors[asked], axis=1)[:, None]
    queries = np.concatenate([unit, np.zeros((len(asked), 1))], axis=1).astype(np.float32)
    near = hnsw.search(hnsw.lifted(vectors[order]), layers, queries, hnsw.SEARCH_WIDTH)[0]
    hits = 0
    for query, found in zip(asked, near):
        score = vectors @ vectors[query]
        score[query] = -np.inf
        best = sorted({int(order[j]) for j in found if j >= 0} - {int(query)}, key=lambda j: -score[j])[:20]
        hits += len({*best} & {*np.argsort(-score)[:20].tolist()})
    print(f"recall {hits / (20 * len(asked)):.4f} of {len(asked)} queries")
    assert hits >= 0.9 * 20 * len(asked)


def test_few_vectors(spark):
    table = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(4)] + [(20, [2.0, 1.0])], "vec_id long, embedding array<double>")
    rows = hnsw.nearest(table, table.where("vec_id % 20 = 0")).collect()
    assert sorted((r.query_id, r.vec_id) for r in rows) == sorted([(0, i) for i in (1, 2, 3, 20)] + [(20, i) for i in range(4)])
    assert hnsw.nearest(table.limit(0), table.limit(0)).count() == 0
