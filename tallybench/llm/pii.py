"""Personal data: high-recall candidates, boosted trees, calibrated thresholds, redaction.

Spans are half-open ranges of code points. Four base kinds are fixed by pattern and check
(email, ip, card, phone: leftmost matches without overlap; a match that fails its check is
dropped and not tried again). Beside them, overlapping generators propose candidates for
``secret`` (keys, tokens, passwords, identity numbers): long mixed runs, assigned values,
quoted values, grouped digits. Boosted trees score each candidate by its format and context;
those above a threshold, calibrated for precision on half of the training candidates, are
kept and overlaps are merged. What a base span covers is left to it; the rest of the secret
is reported, in parts if need be, where it holds a letter or a digit.

The trees learn from the candidates of all texts, labelled by strong checks: known key
formats, identity numbers and values assigned to a telling name are personal, all other
candidates and long plain words are not. Candidates of equal format and context are one
training row of their number. If there is one label only, the strong checks decide alone.
Trees are applied as column expressions, so no Python runs on executors.

Null texts count as empty: no spans. Repeated rows give repeated results; columns other
than the key and the text are not read by ``find_spans`` and stay as they are in ``redact``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

PRECISION = 0.95
TREES, DEPTH = 8, 3

#: Possessive forms of the base patterns: the same matches, in time linear in the text.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ["email", "ip", "card", "phone"]

#: Generators of candidates: pattern, and what a text must hold for it to be tried.
GENERATORS = [
    (r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{12,}+", "[0-9]"),
    (r"(?<![A-Za-z0-9])[A-Z0-9]{16,}+(?![A-Za-z0-9])", "[A-Z0-9]{16}"),
    (r"(?<=[=:]\x20?[\"']?)[^\s\"',;=:]{6,}+", "[=:]"),
    (r"(?<=[\"'])[^\s\"']{8,}+(?=[\"'])", "[\"']"),
    (r"(?<![0-9])[0-9]{3}[\x20.-][0-9]{2,3}[\x20.-][0-9]{4}(?![0-9])", "[0-9]"),
]
PLAIN_WORDS = r"(?<![A-Za-z])[A-Za-z]{12,}+"
TELLING = r"(?i)(pass(word|wd|phrase)?|pwd|secret|token|api.?key|auth|credential|ssn|iban)[\"']?\x20?[=:]\x20?[\"']?$"
KNOWN = r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{20,}|xox[abp]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{30,}|[0-9]{3}-[0-9]{2}-[0-9]{4})$"

_SPAN = "array<struct<start:int,stop:int,value:string>>"
_PLACES = "array<struct<start:int,stop:int>>"


def matches(text: Column, pattern: str, needs: str) -> Column:
    """All matches with their places; only texts that hold ``needs`` are searched."""
    steps = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
                       lambda gap, found: F.struct(F.length(gap).alias("gap"), found.alias("found"), F.length(found).alias("size")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def walk(acc: Column, step: Column) -> Column:
        begin = acc["at"] + step["gap"]
        end = begin + step["size"]
        span = F.struct(begin.alias("start"), end.alias("stop"), step["found"].alias("value"))
        return F.when(step["found"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.array_append(acc["out"], span).alias("out")))

    return F.when(text.rlike(needs), F.aggregate(steps, start, walk, lambda acc: acc["out"])).otherwise(F.array().cast(_SPAN))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _small_parts(value: Column) -> Column:
    parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    return F.forall(parts, lambda p: F.when(F.length(p) <= 3, p.cast("int") <= 255).otherwise(False))


def _luhn(value: Column) -> Column:
    digits = F.reverse(_digits(value))
    doubled = F.translate(digits, "0123456789", "0246813579")
    each = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.when(i % 2 == 0, doubled.substr(i, F.lit(1))).otherwise(digits.substr(i, F.lit(1))).cast("int"))
    total = F.aggregate(each, F.lit(0), lambda a, d: a + d)
    return F.when(F.length(digits).between(13, 19), total % 10 == 0).otherwise(False)


def base_spans(text: Column) -> list[tuple[str, Column]]:
    """(kind, spans) of the base kinds, in the order of KINDS."""
    return [
        ("email", matches(text, EMAIL, "@")),
        ("ip", F.filter(matches(text, IP, r"[0-9]\.[0-9]"), lambda s: _small_parts(s["value"]))),
        ("card", F.filter(matches(text, CARD, "[0-9]"), lambda s: _luhn(s["value"]))),
        ("phone", F.filter(matches(text, PHONE, r"\+[0-9]"), lambda s: F.length(_digits(s["value"])).between(9, 15))),
    ]


def _share(value: Column, keep: str) -> Column:
    return F.length(F.regexp_replace(value, f"[^{keep}]", "")) / F.greatest(F.length(value), F.lit(1))


FEATURES = ["size", "digits", "upper", "lower", "hexadecimal", "changes", "distinct", "assigned", "telling"]


def features(value: Column, left: Column) -> list[Column]:
    """Format and context of a candidate, as FEATURES names them."""
    return [
        F.length(value).cast("double"), _share(value, "0-9"), _share(value, "A-Z"), _share(value, "a-z"), _share(value, "0-9a-fA-F"),
        (F.length(F.regexp_replace(value, r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])", "|")) - F.length(value)) / F.greatest(F.length(value), F.lit(1)),
        F.size(F.array_distinct(F.split(value, ""))) / F.greatest(F.length(value), F.lit(1)),
        left.rlike(r"[=:]\x20?[\"']?$").cast("double"), left.rlike(TELLING).cast("double"),
    ]


def _left(text: Column, span: Column) -> Column:
    begin = F.greatest(span["start"] - 24, F.lit(0))
    return text.substr(begin + 1, span["start"] - begin)


def strong(value: Column, left: Column) -> Column:
    """The checks that label the training sample."""
    mixed = value.rlike("[0-9]") & (F.length(value) >= 6)
    return value.rlike(KNOWN) | (left.rlike(TELLING) & mixed)


def _score(model, names: list[Column]) -> Column:
    """The margin of boosted trees as a column expression."""

    def grow(node) -> Column:
        if node.subtreeDepth() == 0:
            return F.lit(float(node.prediction()))
        split = node.split()
        return F.when(names[split.featureIndex()] <= float(split.threshold()), grow(node.leftChild())).otherwise(grow(node.rightChild()))

    parts = [F.lit(float(w)) * grow(t._call_java("rootNode")) for t, w in zip(model.trees, model.treeWeights)]
    return reduce(lambda a, b: a + b, parts)


class Detector:
    """Trees and threshold for the added kind; without trees the strong checks decide."""

    def __init__(self, model=None, threshold: float = 0.0):
        self.model, self.threshold = model, threshold

    def accepts(self, value: Column, left: Column) -> Column:
        if self.model is None:
            return strong(value, left)
        return _score(self.model, features(value, left)) >= self.threshold

    def secrets(self, text: Column, base: Column) -> Column:
        """Accepted candidates, overlaps merged, as far as they lie outside the base spans."""
        found = F.concat(*(matches(text, p, needs) for p, needs in GENERATORS))
        kept = F.filter(found, lambda s: self.accepts(s["value"], _left(text, s)))
        return F.when(F.size(kept) > 0, F.filter(outside(merged(kept), base), lambda s: text.substr(s["start"] + 1, s["stop"] - s["start"]).rlike(r"[\p{L}\p{N}]"))) \
            .otherwise(F.array().cast(_PLACES))


def _places(spans: Column) -> Column:
    return F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"))))


def merged(spans: Column) -> Column:
    """Unions of overlapping spans (start, stop), by start."""

    def walk(done: Column, span: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["stop"], span["stop"]).alias("stop"))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["stop"] > span["start"]),
                      F.array_append(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), joined)).otherwise(F.array_append(done, span))

    return F.aggregate(_places(spans), F.array().cast(_PLACES), walk)


def outside(spans: Column, base: Column) -> Column:
    """The parts of ``spans`` (start, stop; by start) that no base span covers."""
    part = lambda start, stop: F.struct(start.alias("start"), stop.alias("stop"))
    more = lambda out, start, stop: F.when(start < stop, F.array_append(out, part(start, stop))).otherwise(out)

    def left(span: Column) -> Column:
        touching = _places(F.filter(base, lambda b: (b["start"] < span["stop"]) & (b["stop"] > span["start"])))
        first = F.struct(span["start"].alias("at"), F.array().cast(_PLACES).alias("out"))
        step = lambda acc, b: F.struct(F.greatest(acc["at"], b["stop"]).alias("at"), more(acc["out"], acc["at"], b["start"]).alias("out"))
        return F.aggregate(touching, first, step, lambda acc: more(acc["out"], acc["at"], span["stop"]))

    return F.flatten(F.transform(spans, left))


def train(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Detector:
    """Fit the trees on half of all texts, by a hash of the key; the threshold comes from the other half."""
    rows = docs.select((F.pmod(F.hash(key), F.lit(2)) == 0).alias("fit"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    t = F.col("_text")
    spans = F.concat(*(matches(t, p, needs) for p, needs in GENERATORS), matches(t, PLAIN_WORDS, "[A-Za-z]{12}"))
    found = rows.select("fit", t, F.explode(spans).alias("s")).select("fit", F.col("s.value").alias("value"), _left(t, F.col("s")).alias("left"))
    named = [c.alias(n) for n, c in zip(FEATURES, features(F.col("value"), F.col("left")))]
    found = found.select(strong(F.col("value"), F.col("left")).cast("double").alias("label"), "fit", *named)
    found = found.groupBy("label", "fit", *FEATURES).agg(F.count("*").cast("double").alias("weight"))
    found = cut_lineage(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found))
    if {r[0] for r in found.where("fit").select("label").distinct().collect()} != {0.0, 1.0}:
        return Detector()
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=5, weightCol="weight").fit(found.where("fit"))
    margin = F.round(_score(model, [F.col(n) for n in FEATURES]), 6)
    held = found.where(~F.col("fit")).groupBy(margin.alias("m")).agg(F.sum(F.col("label") * F.col("weight")).alias("hits"), F.sum("weight").alias("n")).orderBy(F.desc("m")).collect()
    hits = n = 0
    threshold = 0.0
    for row in held:  # the lowest threshold that keeps the precision
        hits, n = hits + row.hits, n + row.n
        if hits >= PRECISION * n:
            threshold = row.m - 1e-6
    return Detector(model, threshold)


def _texts(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["stop"].cast("string")))


def find_spans(docs: DataFrame, detector: Detector, text: str = "text") -> DataFrame:
    """``docs`` with _base: a struct of the base spans by kind, and _secret: added spans."""
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("_base", F.struct(*(c.alias(k) for k, c in base_spans(t))))
    return out.withColumn("_secret", detector.secrets(t, F.concat(*(F.col(f"_base.{k}") for k in KINDS))))


def report(docs: DataFrame, detector: Detector, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per text: counts by base kind, the digest of the base spans, all spans, added spans."""
    rows = find_spans(docs.select(key, text), detector, text)
    base = F.concat(*(_texts(k, F.col(f"_base.{k}")) for k in KINDS))
    return rows.select(key, *(F.size(f"_base.{k}").cast("long").alias(f"n_{k}") for k in KINDS),
                       F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
                       F.array_join(F.concat(base, _texts("secret", F.col("_secret"))), ",").alias("spans"),
                       F.size("_secret").cast("long").alias("n_secret"))


def redact(docs: DataFrame, detector: Detector, text: str = "text") -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in brackets.

    Overlapping spans become one, named after the first, the longest of those. Null texts stay null.
    """
    rows = find_spans(docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("_rest"), F.col(text).alias("_text")), detector, "_text")
    own = lambda k, spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["stop"]).alias("last"), F.lit(f"[{k.upper()}]").alias("mark")))
    spans = F.array_sort(F.concat(*(own(k, F.col(f"_base.{k}")) for k in KINDS), own("secret", F.col("_secret"))))
    t = F.col("_text")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def walk(acc: Column, s: Column) -> Column:
        between = t.substr(acc["at"] + 1, s["start"] - acc["at"])
        placed = F.array_append(F.array_append(acc["out"], between), s["mark"])
        return F.when(s["start"] >= acc["at"], F.struct((-s["last"]).alias("at"), placed.alias("out"))) \
            .otherwise(F.struct(F.greatest(acc["at"], -s["last"]).alias("at"), acc["out"].alias("out")))

    whole = F.aggregate(spans, start, walk, lambda acc: F.concat(F.array_join(acc["out"], ""), t.substr(acc["at"] + 1, F.length(t))))
    changed = F.when(F.size(spans) > 0, whole).otherwise(t)
    return rows.select(*((changed if c == text else F.col("_rest").getField(c)).alias(c) for c in docs.columns))
