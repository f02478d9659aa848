"""Merkle manifest of a dataset: leaves per group, a root of each group, one root of all.

A leaf is the hash of a row's fields. Leaves of a group ascend by key; every three
consecutive nodes (the last run: fewer, even one) become the hash of their hashes, level by
level, until one is left. Group roots, ordered by group (null first, by UTF-8 bytes), are
reduced the same way. Hashes are sha256 in lower-case hex and enter the next as text.

1. *Coordinates by rank.* Per group the keys form a bitmap of which only non-empty 64-bit
   words are kept, each made by a bitwise OR that is merged before and after the shuffle. A
   popcount directory sums the words in blocks of 1024, blocks in blocks, and so on, as far
   as the keys are spread; so the base of a word is known without sorting a group, and the
   slot of a row is that base plus the set bits below its own. A step sees 1024 rows at most.
2. *Keyed slot arrays.* 81 nodes of a group meet by slot / 81 in one array, placed by their
   slot, which reduces four levels at once; no task sees more of a group than such arrays.
3. *Paths.* From the root down, each array learns the siblings above it; the siblings of a
   row are those in its array, then those.

Defined cases: null keys form a value below all others; rows of equal key in a group ascend
by leaf, and equal rows are neighbours, each a leaf of its own. Null fields count as ``-``.
Texts are hashed whole. A table without rows has no result rows. Columns other than the
named ones are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage

LEVELS = 4             # levels reduced in one array
ARRAY = 3 ** LEVELS    # nodes in it
DIRECTORY = 10         # bits of a directory block: 1024 entries
NULL_WORD = -(1 << 57) - 1  # below the word of every key


def field(value: Column) -> Column:
    """A field as text: ``-`` if null, else its UTF-8 byte count, a colon and itself."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*(field(v) for v in values)), 256)


def _levels(n: str) -> Column:
    powers = ", ".join(f"{3 ** k}L" for k in range(40))
    return F.expr(f"size(filter(array({powers}), p -> p < {n}))")


def _directory(words: DataFrame) -> DataFrame:
    """Words (g, word, bits, n) with ``base``, the rows of the group in earlier words, and ``total``."""
    levels = [words]
    while levels[-1].groupBy("g").count().agg(F.max("count")).first()[0] > 1 << DIRECTORY:
        up = F.shiftright("word", DIRECTORY).alias("word")
        levels.append(cut_lineage(levels[-1].groupBy("g", up).agg(F.sum("n").alias("n"))))

    def before(*keys):
        return F.coalesce(F.sum("n").over(W.partitionBy(*keys).orderBy("word").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))

    placed = levels.pop().withColumn("base", before("g")).withColumn("total", F.sum("n").over(W.partitionBy("g")))
    for level in reversed(levels):
        known = placed.select("g", F.col("word").alias("up"), F.col("base").alias("first"), "total")
        inside = level.withColumn("up", F.shiftright("word", DIRECTORY)).withColumn("base", before("g", "up"))
        placed = inside.join(known, ["g", "up"]).withColumn("base", F.col("base") + F.col("first")).drop("up", "first")
    return placed


def slots(leaves: DataFrame) -> DataFrame:
    """Leaves (g, id, hash, ...) with ``slot``, from 0 in each group, and ``total``."""
    word = F.coalesce(F.shiftright("id", 6), F.lit(NULL_WORD))
    place = F.coalesce(F.col("id").bitwiseAND(63), F.lit(0)).cast("int")
    bit = F.expr("shiftleft(1L, place)")
    keyed = leaves.withColumn("word", word).withColumn("place", place)
    words = cut_lineage(keyed.groupBy("g", "word").agg(F.bit_or(bit).alias("bits"), F.count("*").alias("n")))
    known = _directory(words).withColumn("single", F.col("n") == F.bit_count("bits"))
    joined = keyed.join(known.drop("n").hint("shuffle_hash"), ["g", "word"])
    below = F.bit_count(F.col("bits").bitwiseAND(F.expr("~shiftleft(-1L, place)")))
    names = leaves.columns
    single = joined.where("single").select(*names, (F.col("base") + below).alias("slot"), "total")
    if words.where(F.col("n") > F.bit_count("bits")).isEmpty():
        return single
    # Keys that occur more than once: equal rows are counted, others ordered by their hash.
    equal = joined.where("not single").groupBy(*names, "word", "base", "total").agg(F.count("*").alias("copies"))
    equal = equal.withColumn("head", F.substring("hash", 1, 3))
    sizes = equal.groupBy("g", "word", "id", "head").agg(F.sum("copies").alias("n"))
    earlier = W.partitionBy("g", "word").orderBy(F.asc_nulls_first("id"), "head").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select(F.col("g").alias("_g"), F.col("word").alias("_word"), F.col("id").alias("_id"), F.col("head").alias("_head"),
                         F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    order = [F.asc_nulls_last(c) for c in names if c not in ("g", "id", "hash")]
    inside = W.partitionBy("g", "word", "id", "head").orderBy("hash", *order).rowsBetween(W.unboundedPreceding, -1)
    equal = equal.withColumn("inside", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
    same = (F.col("g") == F.col("_g")) & (F.col("word") == F.col("_word")) & F.col("id").eqNullSafe(F.col("_id")) & (F.col("head") == F.col("_head"))
    first = F.col("base") + F.col("offset") + F.col("inside")
    several = equal.join(sizes, same).select(*names, F.explode(F.sequence(first, first + F.col("copies") - 1)).alias("slot"), "total")
    return single.unionByName(several)


def _arrays(nodes: DataFrame, done: int) -> DataFrame:
    """Nodes (g, slot, total, item with hash) in arrays of 81 by slot, reduced by four levels.

    ``done`` levels are below the nodes. Gives g, block, total, items, steps (levels that
    this array reduces), levels (the hashes of each) and hash, the node above.
    """
    block, place = F.expr(f"slot div {ARRAY}"), F.expr(f"cast(slot % {ARRAY} as int)")
    out = nodes.groupBy("g", block.alias("block")).agg(
        F.max("total").alias("total"), F.count("*").cast("int").alias("size"),
        F.map_from_entries(F.collect_list(F.struct(place, "item"))).alias("by_slot"))
    out = out.withColumn("items", F.expr("transform(sequence(0, size - 1), i -> by_slot[i])")).drop("by_slot", "size")
    out = out.withColumn("steps", F.least(F.lit(LEVELS), _levels("total") - done))
    out = out.withColumn("h0", F.expr("transform(items, x -> x.hash)"))
    for k in range(LEVELS):
        up = f"transform(sequence(0, (size(h{k}) - 1) div 3), i -> sha2(array_join(slice(h{k}, cast(i * 3 + 1 as int), 3), ''), 256))"
        out = out.withColumn(f"h{k + 1}", F.expr(f"if(steps > {k}, {up}, h{k})"))
    levels = [f"h{k}" for k in range(LEVELS)]
    return out.select("g", "block", "total", "items", "steps", F.array(*levels).alias("levels"), F.expr(f"h{LEVELS}[0]").alias("hash"))


class Tree:
    """The arrays of all groups of leaves, round by round, and the root of each group."""

    def __init__(self, nodes: DataFrame):
        self.rounds = []
        roots = None
        while True:
            done = len(self.rounds) * LEVELS
            arrays = cut_lineage(_arrays(nodes, done))
            self.rounds.append(arrays)
            over = _levels("total") <= done + LEVELS
            ended = arrays.where(over).select("g", "hash")
            roots = ended if roots is None else roots.unionByName(ended)
            rest = arrays.where(~over)
            if rest.isEmpty():
                break
            nodes = rest.select("g", F.col("block").alias("slot"), "total", F.struct("hash").alias("item"))
        self.roots = roots

    def paths(self, above: DataFrame, of_items: str) -> DataFrame:
        """One row per leaf: g, block and the struct ``of_items`` (an expression of a leaf's
        ``i``, ``items``, ``steps``, ``levels`` and the ``path`` above its array).

        ``above`` holds g, ``path`` (siblings of the group's root and of the nodes above it:
        an array of what is left and right of the node, level by level) and more columns.
        """
        last = len(self.rounds) - 1
        carried = [c for c in above.columns if c not in ("g", "path")]
        down = None
        for number in range(last, -1, -1):
            arrays = self.rounds[number]
            over = _levels("total") <= (number + 1) * LEVELS
            known = arrays.where(over).join(above, "g")
            if down is not None:
                known = known.unionByName(arrays.where(~over).join(down, ["g", "block"]))
            if number:
                item = F.expr(f"transform(items, (x, i) -> struct(block * {ARRAY} + i as block, concat({PATH}, path) as path))")
                down = cut_lineage(known.select("g", *carried, F.explode(item).alias("x")).select("g", "x.*", *carried))
        return known.select(*carried, F.explode(F.expr(f"transform(items, (x, i) -> {of_items})")).alias("x")).select(*carried, "x.*")


#: The siblings of item ``i`` in its array, level by level: what is left and right of its node.
PATH = f"""transform(slice(array({', '.join(str(3 ** k) for k in range(LEVELS))}), 1, steps), (p, k) -> struct(
    array_join(slice(levels[k], cast(i div p - i div p % 3 + 1 as int), cast(i div p % 3 as int)), '') as left,
    array_join(slice(levels[k], cast(i div p + 2 as int), cast(2 - i div p % 3 as int)), '') as right))"""


def _in_order(roots: DataFrame) -> DataFrame:
    """Group roots as nodes of one group, in the order of ``g``: a distributed sort."""
    placed = cut_lineage(roots.orderBy("g").select("g", "hash", F.monotonically_increasing_id().alias("at")))
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # a row per sorted partition
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("n").over(W.partitionBy()).alias("total"))
    return placed.withColumn("part", part).join(F.broadcast(sizes), "part").select(
        F.lit("").alias("g"), (F.col("base") + place).alias("slot"), "total", F.struct("hash", F.col("g").alias("group")).alias("item"))


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "source", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
             tampered: dict[str, Column] | None = None) -> DataFrame:
    """One row per row: key, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``proof_sha256`` is the hash of all siblings from the leaf up to the root, left to right.
    ``folded_root`` is what the siblings give for the row as it would be with the values of
    ``tampered`` (columns by field name; unchanged fields are left out), and ``verified``
    whether that equals the root.
    """
    changed = leaf(*((tampered or {}).get(f, F.col(f)) for f in fields))
    g = F.when(F.col(group).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    leaves = docs.select(g.alias("g"), F.col(key).cast("long").alias("id"), leaf(*(F.col(f) for f in fields)).alias("hash"), changed.alias("changed"))
    leaves = leaves.withColumn("changed", F.nullif("changed", "hash"))
    leaves = cut_lineage(leaves)
    if leaves.isEmpty():
        return leaves.select(F.col("id").alias(key), F.col("hash").alias("leaf"), *(F.col("hash").alias(c) for c in ("subroot", "root", "proof_sha256", "folded_root")),
                             F.lit(True).alias("verified"))
    tree = Tree(slots(leaves).select("g", "slot", "total", F.struct("hash", "id", "changed").alias("item")))
    top = Tree(_in_order(tree.roots))
    empty = "cast(array() as array<struct<left: string, right: string>>)"
    whole = top.roots.select("g", F.expr(empty).alias("path"), F.col("hash").alias("root"))
    above = top.paths(whole, f"struct(x.group as g, x.hash as subroot, concat({PATH}, path) as path)")
    siblings = f"concat({PATH}, path)"
    row = (f"struct(x.id as id, x.hash as leaf, sha2(array_join(transform({siblings}, s -> concat(s.left, s.right)), ''), 256) as proof_sha256, "
           f"aggregate({siblings}, coalesce(x.changed, x.hash), (h, s) -> sha2(concat(s.left, h, s.right), 256)) as folded_root)")
    found = tree.paths(above, row)
    return found.select(F.col("id").alias(key), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def without_line_breaks(key: str = "doc_id", text: str = "text") -> dict[str, Column]:
    """The tampering of the query: line breaks go where 2 divides the crc32 of the key as text."""
    even = F.crc32(F.col(key).cast("string").cast("binary")) % 2 == 0
    return {text: F.when(even, F.translate(F.col(text), "\n", "")).otherwise(F.col(text))}
