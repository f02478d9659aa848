import random

import pytest

DOCS = ("doc_id long, text string, lang string, source string, n_chars long, score string, h array<int>")
WORDS = [a + b for a in ("ba", "ke", "li", "mo", "nu", "sé", "Ta", "ör") for b in ("n", "st", "ra", "le", "do", "", "x,", "ß.")]


def passage(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return "".join(draw.choice(WORDS) + draw.choice([" ", " ", " ", " ", " ", "\n", "  "]) for _ in range(n)).strip()


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text): copies, near copies, shared passages, empty and very long texts, nulls."""
    shared, base = passage(1, 70), passage(2, 120)
    rows = [(i, passage(100 + i, 20 + 7 * (i % 30))) for i in range(60)]
    rows += [(100 + i, base) for i in range(40)]                                    # a third are copies
    rows += [(200 + i, f"{base} {passage(300 + i, i % 9)}") for i in range(12)]     # near copies
    rows += [(300 + i, f"{passage(400 + i, 30)} {shared} {passage(500 + i, 25)}") for i in range(9)]
    rows += [(400, None), (401, ""), (402, " \n\t "), (403, "one"), (404, "One"), (405, "12 34 !!"), (406, passage(7, 30_000)),
             (407, "a b " * 80), (408, passage(7, 30_000)[5000:]), (None, passage(8, 60)), (None, None), (103, base), (103, base),
             (409, "𝄞 é́ — “q”   x y 漢字 \x1c z"), (410, "w" * 20_000), (411, "\n\n" + shared), (412, "#$% |a| <b> " * 30), (413, "l\n" * 9 + "m n o p")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, None if n % 5 == 0 else "aa" if n % 2 else "bb", f"s{n % 3}", len(t or ""), "x", [n]) for n, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
