"""The Merkle manifest against a plain tree per source."""
import hashlib
import random
import zlib

import pytest

from tallybench.llm import merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long, g string, slot array<int>, hash string"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i: i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def siblings(tree, i):
    for level in tree[:-1]:
        s = i - i % 3
        yield "".join(level[s:i]), "".join(level[i + 1: s + 3])
        i //= 3


def expected(rows):
    groups = {}
    for row in rows:
        cut = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[1] is not None
        leaf, changed = leaf_of(row, row[1]), leaf_of(row, row[1].replace("\n", "") if cut else row[1])
        groups.setdefault(row[3], []).append((row[0] is not None, row[0] or 0, leaf, changed))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(groups[s])]) for s in order}
    top = levels([trees[s][-1][0] for s in order])
    out = []
    for place, s in enumerate(order):
        for i, (known, key, leaf, changed) in enumerate(sorted(groups[s])):
            path = [*siblings(trees[s], i), *siblings(top, place)]
            folded = changed
            for left, right in path:
                folded = digest(left + folded + right)
            out.append((key if known else None, leaf, trees[s][-1][0], top[-1][0], digest("".join(a + b for a, b in path)), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def found(spark, rows):
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    return sorted(map(tuple, merkle.manifest(docs, tampered=merkle.without_line_breaks()).collect()), key=str)


def row(key, text, source, lang="aa", n=1):
    return (key, text, lang, source, n, "mine", [1], "own")


def test_sizes_around_powers_of_three_and_far_keys(spark):
    draw = random.Random(3)
    rows = [row(draw.randrange(-2**63, 2**63), f"x\n{i}", f"s{size}") for size in (1, 2, 3, 4, 9, 10, 81, 82, 244) for i in range(size)]
    rows += [row(k, "a\nb", "ends") for k in (-2**63, 2**63 - 1, -1, 0, 63, 64)]
    assert found(spark, rows) == expected(rows)


def test_nulls_ties_repeats_and_many_groups(spark):
    rows = [row(i % 40, f"t{i % 7}\n", None if i % 3 else "é", None if i % 5 else "l", None if i % 2 else i) for i in range(300)]
    rows += [row(None, None, "z"), row(None, "", "z"), row(None, "", "z"), row(7, "w\n" * 50_000, "z")]
    rows += [row(5, "same\n", "hot")] * 200 + [row(i, "", f"one{i}") for i in range(100)] + [row(0, "", "")]
    assert found(spark, rows) == expected(rows)


def test_one_row_and_no_row(spark):
    assert found(spark, [row(1, "a", None)]) == expected([row(1, "a", None)])
    assert found(spark, []) == []


def test_the_directory_has_levels(spark, monkeypatch):
    monkeypatch.setattr(merkle, "DIRECTORY", 2)
    rows = [row(i * 77, str(i), "a" if i % 3 else "b") for i in range(400)]
    assert found(spark, rows) == expected(rows)


@pytest.mark.parametrize("value", ["text", "lang", "n_chars", "source", "doc_id"])
def test_any_changed_field_fails(spark, value):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([row(i, f"t{i}", f"s{i % 4}") for i in range(20)], DOCS)
    column = F.col(value)
    other = F.concat(column, F.lit("!")) if value in ("text", "lang", "source") else column + 1
    got = merkle.manifest(docs, tampered={value: F.when(F.col("doc_id") == 7, other).otherwise(column)}).collect()
    assert [r.doc_id for r in got if not r.verified] == [7]
