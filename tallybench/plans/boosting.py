"""Gradient-boosted trees over one table of binned rows, watched on validation rows.

One tree a class is grown in every round (one in all for two classes or for values), all of
them together, level by level: each task sums gradients and curvatures of its rows by class,
node, feature and bin, the sums of a node are added in one place, and the driver, which gets
matrices whose size does not depend on the rows, picks the cuts. The rows are binned and
written once; their margins are written anew every ``WRITTEN`` rounds, and what later trees add
is computed on the way. With more than two classes the gradients are those of the joint
softmax, so probabilities sum to one without any rescaling.

All rounds are scored on the validation rows in one plan, by AUC or by loss, and the model is
cut after its best round, the first of equal ones. With ``patience`` the loss is looked at
every so many rounds and growth ends when it has not fallen since the look before.
"""

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.curves import roc_auc, score_counts
from ..session import cut_lineage
from ..shipping import shipped

BINS = 64
WRITTEN = 10   # rounds after which margins are written
ROWS = 8192    # rows worked on at a time


def _matrix(column):
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _walk(node_feature, right, depth):
    """Leaf of each row: ``right(feature, node)`` says which rows go right at their node."""
    node = np.zeros(right.rows, np.int64)
    for _ in range(depth):
        f = node_feature[node]
        node = 2 * node + 1 + ((f >= 0) & right(np.maximum(f, 0), node))
    return node - ((1 << depth) - 1)


class _Above:
    """Whether a row's value lies above the cut of its node."""

    def __init__(self, values, cuts):
        self.values, self.cuts, self.rows = values, cuts, len(values)
        self.at = np.arange(len(values))

    def __call__(self, feature, node):
        return ~(self.values[self.at, feature] <= self.cuts[node])  # missing values go right


def _gradients(objective, margins, y):
    """First and second derivatives of the loss by each margin."""
    if objective == "values":
        return margins - y[:, None], np.ones_like(margins)
    if objective == "binary":
        p = 1 / (1 + np.exp(-margins))
        return p - y[:, None], p * (1 - p)
    p = _softmax(margins)
    return p - (y[:, None] == np.arange(margins.shape[1])), p * (1 - p)


def _softmax(margins):
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _loss(objective, margins, y):
    """Loss of each row."""
    if objective == "values":
        return (margins[:, 0] - y) ** 2
    if objective == "binary":
        return np.logaddexp(0, margins[:, 0]) - y * margins[:, 0]
    top = margins.max(axis=1)
    return top + np.log(np.exp(margins - top[:, None]).sum(axis=1)) - margins[np.arange(len(y)), y.astype(int)]


@dataclass
class Boosted:
    """Complete trees of one depth as arrays (round, class, node); what tasks receive."""

    objective: str
    depth: int
    start: np.ndarray                 # margins before the first round, by class
    feature: np.ndarray               # of a node; -1: no cut, rows go left
    cut: np.ndarray                   # rows above it go right
    value: np.ndarray                 # of a leaf, learning rate included
    losses: list = field(default_factory=list)   # validation loss of each round grown
    best: int = 0                     # rounds kept

    def margins(self, x, rounds=None):
        """(row, round, class): margins after each round, or after the last only."""
        steps = self.best if rounds is None else rounds
        out = np.empty((len(x), steps, len(self.start)))
        total = np.repeat(self.start[None, :], len(x), axis=0)
        for r in range(steps):
            for c in range(len(self.start)):
                leaf = _walk(self.feature[r, c], _Above(x, self.cut[r, c]), self.depth)
                total[:, c] += self.value[r, c][leaf]
            out[:, r] = total
        return out, total

    def shortened(self, rounds):
        return Boosted(self.objective, self.depth, self.start, self.feature[:rounds], self.cut[:rounds], self.value[:rounds], self.losses, rounds)

    # -- scoring ---------------------------------------------------------

    def _scored(self, df, keep, make, schema):
        rows = shipped(df.select(*keep, F.col("label").cast("double").alias("label"), F.col("features").cast("array<double>").alias("features")))
        shared = df.sparkSession.sparkContext.broadcast(self)
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:len(keep)])
        names = [*keep, *[s.split()[0] for s in schema]]

        def run(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    part = batch.slice(at, ROWS)
                    y = part.column(len(keep)).to_numpy(zero_copy_only=False)
                    made = make(shared.value, _matrix(part.column(len(keep) + 1)), y)
                    yield pa.RecordBatch.from_arrays([*part.columns[:len(keep)], *made], names)

        return rows.mapInArrow(run, ", ".join([kinds, *schema]))

    def predict(self, df, row_id="row_id", keep=()) -> DataFrame:
        """(row_id, *keep, y_true, y_pred, prob, score) of classes, (..., y_true, y_pred) of values."""
        if self.objective == "values":
            return self._scored(df, [row_id, *keep], lambda m, x, y: [pa.array(y), pa.array(m.margins(x)[1][:, 0])], ["y_true double", "y_pred double"])

        def classes(model, x, y):
            last = model.margins(x)[1]
            p = _softmax(last) if model.objective == "classes" else 1 / (1 + np.exp(-np.hstack([-last, last])))
            lists = pa.ListArray.from_arrays(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32), pa.array(p.ravel()))
            return [pa.array(y.astype(np.int32)), pa.array(p.argmax(axis=1).astype(np.int32)), lists, pa.array(p[:, 1])]

        return self._scored(df, [row_id, *keep], classes, ["y_true int", "y_pred int", "prob array<double>", "score double"])

    def staged(self, df, row_id="row_id", rounds=None) -> DataFrame:
        """(row_id, y_true, stages): the margin of class 1 after every round, one array a row."""
        steps = len(self.feature) if rounds is None else rounds

        def stages(model, x, y):
            m, _ = model.margins(x, steps)
            m = m[:, :, -1] if m.shape[2] == 1 else m[:, :, 1]
            lists = pa.ListArray.from_arrays(np.arange(0, m.size + 1, max(steps, 1), dtype=np.int32)[: len(x) + 1], pa.array(np.ascontiguousarray(m).ravel()))
            return [pa.array(y.astype(np.int32)), lists]

        return self._scored(df, [row_id], stages, ["y_true int", "stages array<double>"])

    # -- written form ----------------------------------------------------

    def save(self, spark, folder) -> None:
        """A table of nodes and leaves, and one row of what holds for all trees."""
        nodes = [(r, c, n, int(f), float(t), None) for (r, c, n), f, t in zip(np.ndindex(*self.feature.shape), self.feature.ravel(), self.cut.ravel())]
        nodes += [(r, c, n, None, None, float(v)) for (r, c, n), v in zip(np.ndindex(*self.value.shape), self.value.ravel())]
        spark.createDataFrame(nodes, "round int, class int, node int, feature int, cut double, value double").write.parquet(f"{folder}/trees")
        spark.createDataFrame([(self.objective, self.depth, [float(s) for s in self.start], [float(x) for x in self.losses], self.best)],
                              "objective string, depth int, start array<double>, losses array<double>, best int").write.parquet(f"{folder}/model")

    @staticmethod
    def load(spark, folder) -> "Boosted":
        m = spark.read.parquet(f"{folder}/model").first()
        rows = spark.read.parquet(f"{folder}/trees").toArrow().to_pydict()
        shape = (m.best, len(m.start))
        feature, cut = np.full(shape + ((1 << m.depth) - 1,), -1), np.zeros(shape + ((1 << m.depth) - 1,))
        value = np.zeros(shape + (1 << m.depth,))
        for r, c, n, f, t, v in zip(*(rows[k] for k in ("round", "class", "node", "feature", "cut", "value"))):
            if v is None:
                feature[r, c, n], cut[r, c, n] = f, t
            else:
                value[r, c, n] = v
        return Boosted(m.objective, m.depth, np.array(m.start), feature, cut, value, m.losses, m.best)


# -- growth ---------------------------------------------------------------


def bin_edges(train, bins=BINS):
    """Distinct quantiles of every feature; they balance the bins, their exact place is free."""
    width = train.agg(F.max(F.size("features"))).first()[0]
    columns = train.select(*[F.get("features", F.lit(i)).alias(f"x{i}") for i in range(width)])
    levels = [i / bins for i in range(1, bins)]
    found = columns.approxQuantile(columns.columns, levels, 0.25 / bins)
    return [np.unique([v for v in q if v == v]) for q in found]


def _binned(df, edges):
    """(label, bins, base): a byte a feature."""
    shared = df.sparkSession.sparkContext.broadcast(edges)

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(1))
            b = np.stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(shared.value)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in b], pa.binary())], ["label", "bins"])

    rows = shipped(df.select(F.col("label").cast("double").alias("label"), F.col("features").cast("array<double>").alias("features")))
    return rows.mapInArrow(run, "label double, bins binary")


def _of_batch(batch, start):
    """Labels, bins and margins of a batch."""
    y = batch.column(0).to_numpy(zero_copy_only=False)
    b = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(len(y), -1)
    base = _matrix(batch.column(2)) if batch.num_columns > 2 else np.repeat(start[None, :], len(y), axis=0)
    return y, b, base


def _moved(base, b, feature, cut_bin, value, depth):
    """Margins with the trees (round, class, node) added; bins are compared with bins."""
    out = base.copy()
    for r in range(len(feature)):
        for c in range(out.shape[1]):
            out[:, c] += value[r, c][_walk(feature[r, c], _Above(b, cut_bin[r, c]), depth)]
    return out


def _with_margins(rows, start, trees, depth):
    """Rows with the margins after ``trees`` written beside them."""
    shared = rows.sparkSession.sparkContext.broadcast((start, trees))

    def run(batches):
        start, trees = shared.value
        for batch in batches:
            y, b, base = _of_batch(batch, start)
            m = _moved(base, b, *trees, depth)
            lists = pa.ListArray.from_arrays(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32), pa.array(m.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["label", "bins", "base"])

    return cut_lineage(shipped(rows).mapInArrow(run, "label double, bins binary, base array<double>"))


def _node_sums(rows, objective, start, trees, partial, level, depth, features):
    """{(class, node of the level): sums (feature, bin, [g, h])} over all rows."""
    shared = rows.sparkSession.sparkContext.broadcast((start, trees, partial))
    width = 1 << level

    def run(batches):
        start, trees, (feature, cut_bin) = shared.value
        sums = np.zeros((len(start), width * features * BINS, 2))
        offsets = np.arange(features) * BINS
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                y, b, base = _of_batch(batch.slice(at, ROWS), start)
                g, h = _gradients(objective, _moved(base, b, *trees, depth), y)
                above = [_Above(b, cut_bin[c]) for c in range(len(start))]
                for c in range(len(start)):
                    node = _walk(feature[c], above[c], level)
                    place = (node[:, None] * (features * BINS) + offsets[None, :] + b).ravel()
                    for k, weight in enumerate((g, h)):
                        sums[c, :, k] += np.bincount(place, np.repeat(weight[:, c], features), sums.shape[1])
        for c in range(len(start)):
            parts = sums[c].reshape(width, -1)
            yield pa.RecordBatch.from_arrays([pa.array([c] * width, pa.int32()), pa.array(range(width), pa.int32()),
                                              pa.array([p.tobytes() for p in parts], pa.binary())], ["c", "node", "sums"])

    def add(table):
        total = sum(np.frombuffer(s.as_buffer()) for s in table.column("sums").combine_chunks())
        return pa.table({"c": table.column("c").slice(0, 1), "node": table.column("node").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    schema = "c int, node int, sums binary"
    found = shipped(rows).mapInArrow(run, schema).groupBy("c", "node").applyInArrow(add, schema).collect()  # a matrix per node
    return {(r.c, r.node): np.frombuffer(r.sums).reshape(features, BINS, 2) for r in found}


def _best_cut(sums, used, l2, least):
    """(gain, feature, bin, left (g, h), right (g, h)) of the best cut of a node."""
    left = np.cumsum(sums, axis=1)
    whole = left[0, -1]
    right = whole[None, None, :] - left
    score = lambda s: s[..., 0] ** 2 / (s[..., 1] + l2)
    gain = score(left) + score(right) - score(whole)
    gain[(left[..., 1] < least) | (right[..., 1] < least) | ~used] = -np.inf
    f, b = np.unravel_index(gain.argmax(), gain.shape)
    return gain[f, b], int(f), int(b), left[f, b], right[f, b], whole


def _watched_losses(rows, objective, start, trees, depth):
    """Mean loss after each of ``trees``, from the margins beside the rows."""
    shared = rows.sparkSession.sparkContext.broadcast((start, trees))
    steps = len(trees[0])

    def run(batches):
        start, (feature, cut_bin, value) = shared.value
        n, total = 0, np.zeros(steps)
        for batch in batches:
            y, b, m = _of_batch(batch, start)
            n += len(y)
            for r in range(steps):
                m = _moved(m, b, feature[r: r + 1], cut_bin[r: r + 1], value[r: r + 1], depth)
                total[r] += _loss(objective, m, y).sum()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tolist()], pa.list_(pa.float64()))], ["n", "total"])

    found = shipped(rows).mapInArrow(run, "n long, total array<double>").collect()  # a row per task
    n = sum(r.n for r in found)
    return (np.sum([r.total for r in found], axis=0) / max(n, 1)).tolist()


def stage_areas(model, val, row_id="row_id") -> DataFrame:
    """(stage, roc_auc): exact AUC on ``val`` after every round, in one grouped pass."""
    long = model.staged(val, row_id).select("y_true", F.posexplode("stages").alias("stage", "score"))
    return roc_auc(score_counts(long, ["stage"]), ["stage"]).select((F.col("stage") + 1).alias("stage"), "roc_auc")


def best_stage(areas) -> int:
    """The first stage with the largest area; all rounds if there is none (one class only)."""
    found = areas.filter("roc_auc is not null").agg(F.max_by("stage", F.struct("roc_auc", -F.col("stage")))).first()[0]
    return found if found is not None else areas.agg(F.max("stage")).first()[0]


def boost(train, val=None, objective="binary", rounds=5000, rate=0.01, depth=6, l2=1.0, least=1e-3,
          watch=None, patience=None, row_id="row_id") -> Boosted:
    """Grow trees on ``train`` (features, label) and cut the model where ``val`` is best.

    ``objective``: ``binary`` (labels 0 and 1), ``classes`` (0 .. C-1) or ``values``. ``watch``:
    ``auc`` or ``loss`` (``auc`` for binary labels, else ``loss``, if not given).
    """
    watch = watch or ("auc" if objective == "binary" else "loss")
    edges = bin_edges(train)
    rows = cut_lineage(_binned(train, edges))
    stats = rows.agg(F.count("*"), F.avg("label"), F.max("label")).first()
    if not stats[0]:
        raise ValueError("no rows to learn from")
    if objective == "values":
        start = np.array([stats[1]])
    elif objective == "binary":
        share = min(max(stats[1], 1e-6), 1 - 1e-6)
        start = np.array([np.log(share / (1 - share))])
    else:
        seen = {int(r["label"]): r["count"] for r in rows.groupBy("label").count().collect()}
        start = np.log(np.array([max(seen.get(c, 0), 1e-6) for c in range(int(stats[2]) + 1)]) / stats[0])
    watched = cut_lineage(_binned(val, edges)) if val is not None else None
    k, nodes = len(start), (1 << depth) - 1
    feature, cut_bin, value = np.full((0, k, nodes), -1), np.zeros((0, k, nodes)), np.zeros((0, k, nodes + 1))
    used = np.zeros((len(edges), BINS), bool)
    for f, e in enumerate(edges):
        used[f, : len(e)] = True
    losses, since, looked = [], 0, 0
    for r in range(rounds):
        f_new, b_new, v_new = np.full((k, nodes), -1), np.zeros((k, nodes)), np.zeros((k, nodes + 1))
        recent = feature[since:], cut_bin[since:], value[since:]
        for level in range(depth):
            sums = _node_sums(rows, objective, start, recent, (f_new, b_new), level, depth, len(edges))
            for (c, node), s in sums.items():
                at = (1 << level) - 1 + node
                gain, f, b, left, right, whole = _best_cut(s, used, l2, least)
                leaf = node << (depth - level)
                if gain > 1e-12:
                    f_new[c, at], b_new[c, at] = f, b
                    half = 1 << (depth - level - 1)
                    v_new[c, leaf] = -rate * left[0] / (left[1] + l2)
                    v_new[c, leaf + half] = -rate * right[0] / (right[1] + l2)
                elif whole[1] > 0:
                    v_new[c, leaf] = -rate * whole[0] / (whole[1] + l2)
        feature, cut_bin, value = (np.concatenate([a, n[None]]) for a, n in ((feature, f_new), (cut_bin, b_new), (value, v_new)))
        done = r + 1 == rounds
        if done or len(feature) - since == WRITTEN:
            recent = feature[since:], cut_bin[since:], value[since:]
            if watched is not None:
                losses += _watched_losses(watched, objective, start, recent, depth)
                watched = _with_margins(watched, start, recent, depth)
            if not done:
                rows = _with_margins(rows, start, recent, depth)
            since = len(feature)
        if patience and len(losses) - looked >= patience:
            if looked and min(losses[looked:]) >= min(losses[:looked]):
                break
            looked = len(losses)
    at = np.maximum(feature, 0)
    places = cut_bin.astype(int)
    cut = np.array([e[np.minimum(p, len(e) - 1)] if len(e) else 0.0 for e, p in ((edges[f], p) for f, p in zip(at.ravel(), places.ravel()))], float).reshape(feature.shape)
    model = Boosted(objective, depth, start, feature, cut, value, losses, len(feature))
    if val is None:
        return model
    return model.shortened(best_stage(stage_areas(model, val, row_id)) if watch == "auc" else int(np.argmin(losses)) + 1)
