"""Turning raw model outputs into probabilities, decisions and losses."""

from pyspark.sql import Column, functions as F

from .distance import total


def once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, also where a lambda inside names it for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def binary_decision(logit: Column) -> Column:
    """0/1 decision; a probability of exactly one half rounds to 0."""
    return F.rint(sigmoid(logit)).cast("int")


def softmax(logits: Column) -> Column:
    """Softmax of an array column, shifted by its maximum so exp cannot overflow."""
    shifted = once(logits, lambda v: once(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top))))
    return shares(shifted)


def shares(values: Column) -> Column:
    """Each value divided by their sum."""
    return once(values, lambda v: once(total(v), lambda whole: F.transform(v, lambda x: x / whole)))


def argmax(values: Column) -> Column:
    """Zero-based position of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def mean_of_members(members: Column) -> Column:
    """Position-wise mean of an array of equally long arrays."""

    def mean(all_):
        first = F.transform(F.element_at(all_, 1), lambda x: x * 0.0)
        summed = F.aggregate(all_, first, lambda acc, m: F.zip_with(acc, m, lambda x, y: x + y))
        return F.transform(summed, lambda s: s / F.size(all_))

    return once(members, mean)


def mean_of_values(values: Column) -> Column:
    return total(values) / F.size(values)


def ensemble_probability(member_logits: Column) -> Column:
    """Softmax per ensemble member, then the mean over members."""
    return mean_of_members(F.transform(member_logits, softmax))


def bce_with_logits(logit: Column, y: Column) -> Column:
    """Binary cross-entropy of a logit, in the form that cannot overflow."""
    return F.greatest(logit, F.lit(0.0)) - logit * y + F.log1p(F.exp(-F.abs(logit)))


def cross_entropy(logits: Column, y: Column) -> Column:
    """-log softmax(logits)[y]."""
    def log_norm(v):
        return once(F.array_max(v), lambda top: top + F.log(total(F.transform(v, lambda x: F.exp(x - top)))))

    return once(logits, lambda v: log_norm(v) - F.element_at(v, y.cast("int") + 1))


def squared_error(pred: Column, y: Column) -> Column:
    return (pred - y) * (pred - y)
