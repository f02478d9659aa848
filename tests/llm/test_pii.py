"""Base spans against plain patterns; added spans, redaction, odd rows."""
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tallybench.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 13 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


CASES = [
    "mail a.b@c.de, x@y and a@b.c@d.e, é@é.é _x%+-@a-.b-.c. 1@2.3", "ip 1.2.3.4.5.6.7.8 256.1.1.1 0001.002.3.255 1.2.3 1.2.3.4", "4111 1111-1111 1111 and 4111111111111112",
    "4111111111111111", "+1 (988) 555-2485, +12 3, +4.9.1.5.1.2.3.4.5.6-", "𝄞𝄞 a@b.co 🎉 +49 151 23456789 x", None, "", "+" * 50, "1" * 5000, "a" * 5000 + "@", "1-" * 3000, "1." * 3000 + "@a.b",
    "a@b.c_d@e.f.", "+1(2)3.4-5 6 7 8 9 0", "..@-.-", "1.1.1.1@2.2.2.2", "\u0000 a@b.c   4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1",
]


def test_base_spans(spark):
    draw = random.Random(9)
    cases = CASES + ["".join(draw.choice("0123456789411.. -+@ab()é") for _ in range(draw.randrange(1, 90))) for _ in range(600)]
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    for r in pii.report(docs, pii.Detector()).collect():
        want = spans(cases[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (cases[r.doc_id], want, r.spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k) for w in want) for k in pii.KINDS]
        assert [s for s in r.spans.split(",") if s and not s.startswith("secret")] == want


@pytest.fixture(scope="module")
def secrets():
    draw = random.Random(3)
    text = lambda chars, n: "".join(draw.choice(chars) for _ in range(n))
    rows = []
    for i in range(240):
        key = {0: "password=" + text("0123456789abcdef", 18), 1: f'token = "{text("0123456789abcdef", 40)}"', 2: "AKIA" + text("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16),
               3: "", 4: "version 2.0 of 2019 in 3.4", 5: "extraordinarily unquestionable"}[i % 6]
        rows.append((i, f"word {key} more words {i} here", "x"))
    return rows


def test_added_spans(spark, secrets):
    docs = spark.createDataFrame(secrets, "doc_id long, text string, _base string")
    detector = pii.train(docs)
    assert detector.model is not None
    for r in pii.report(docs, detector).collect():
        found = [s for s in r.spans.split(",") if s.startswith("secret")]
        assert len(found) == (r.doc_id % 6 < 3), (secrets[r.doc_id], r.spans)
        if found:
            _, start, end = found[0].split(":")
            value = re.search(r'password=(\w+)|"(\w+)"|(AKIA\w+)', secrets[r.doc_id][1])
            assert secrets[r.doc_id][1][int(start): int(end)] in value.groups()
    clean = pii.redact(docs, detector)
    assert clean.columns == docs.columns
    for r in clean.collect():
        assert ("[SECRET]" in r.text) == (r.doc_id % 6 < 3) and not re.search("AKIA|[0-9a-f]{18}", r.text)


def test_training_reads_all_texts(spark):
    """Secrets in one half of the keys only, and in texts that a sample of 4000 would leave out."""
    even = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    key = F.concat(F.lit("password=x7"), F.col("doc_id").cast("string"), F.lit("q9z"))
    docs = spark.range(8000).withColumnRenamed("id", "doc_id").withColumn("text", F.when(even, F.lit("version-of-2019-and-later")).otherwise(key))
    assert pii.train(docs).model is not None


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "a@b.c é +49 151 23456789, 4111111111111111"), (2, None), (3, "none"), (4, "1.1.1.1@2.2.2.2 end")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redact(docs, pii.Detector()).collect()}
    assert got == {1: "[EMAIL] é [PHONE], [CARD]", 2: None, 3: "none", 4: "[EMAIL] end"}


def test_secrets_that_hold_base_spans(spark):
    cases = ["token=abq4111111111111111yz end", "password=x1-a@b.co", "secret=k9/1.2.3.4/q/5.6.7.8", "token=a@b.co", "token=4111111111111111 token=abcdef1234"]
    want = ["token=[SECRET][CARD][SECRET] end", "password=[EMAIL]", "secret=[SECRET][IP][SECRET][IP]", "token=[EMAIL]", "token=[CARD] token=[SECRET]"]
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    assert [r.text for r in pii.redact(docs, pii.Detector()).orderBy("doc_id").collect()] == want
    found = {r.doc_id: r.spans for r in pii.report(docs, pii.Detector()).collect()}
    assert found[0] == "card:9:25,secret:6:9,secret:25:27" and found[3] == "email:6:12"


def test_odd_rows(docs, texts, nothing):
    detector = pii.train(docs)
    assert pii.report(docs, detector).count() == len(texts)
    assert pii.train(nothing).model is None
    assert pii.report(nothing, detector).count() == 0
    assert pii.redact(nothing, detector).columns == docs.columns
