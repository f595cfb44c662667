"""Training sets from trees and trajectories: supervised rows, preference pairs, step rewards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import materialise
from . import tree

IGNORE = -100.0


# Supervised ----------------------------------------------------------------------------------


def inner_min(values: Column) -> Column:
    """Smallest value of a chain without its root; 1 for a chain of one."""
    return F.coalesce(F.array_min(F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0)))), F.lit(1.0))


def supervised(records: DataFrame, k: int | None = None, only_without_negatives: bool = False) -> DataFrame:
    """(id, conversations, label, inter) of records (id, question, pos, neg): each positive chain as
    one conversation; the k with the highest :func:`inner_min` (for records without negatives alone, if asked)."""
    rows = records.select("id", "question", F.size("neg").alias("_neg"), F.posexplode("pos").alias("_i", "_t"))
    rows = rows.withColumn("_value", inner_min(F.col("_t.chain.value")))
    if k is not None:
        rank = F.row_number().over(W.partitionBy("id").orderBy(F.desc("_value"), "_i"))
        keep = rank <= k
        if only_without_negatives:
            keep = keep | (F.col("_neg") > 0)
        rows = rows.withColumn("_keep", keep).filter("_keep")
    message = lambda who, c: F.struct(F.lit(who).alias("from"), c.alias("value"))
    talk = F.array(message("human", F.col("question")), message("gpt", T.path_text(F.col("_t.chain.step"))))
    return rows.select("id", talk.alias("conversations"), F.lit(1.0).alias("label"), F.lit(False).alias("inter"))


def messages(conversations: Column | str, system: str) -> Column:
    """Role and content by position: even turns are the user's, odd ones the assistant's."""
    message = lambda role, c: F.struct(role.alias("role"), c.alias("content"))
    turns = F.transform(T.col(conversations), lambda c, i: message(F.when(i % 2 == 0, "user").otherwise("assistant"), c["value"]))
    return F.concat(F.array(message(F.lit("system"), F.lit(system))), turns)


def learn_advantage(steps: DataFrame) -> DataFrame:
    """Steps (traj, idx, v) with ``label``: the ignore label where the value falls."""
    before = F.lag("v").over(W.partitionBy("traj").orderBy("idx"))
    return steps.withColumn("label", F.when(F.col("v") < before, F.lit(IGNORE)).otherwise(F.col("v")))


# Preference pairs ----------------------------------------------------------------------------


CELLS, CELL_BITS = 16, 16


def far_apart(high: DataFrame, low: DataFrame, keys: list[str], top: str, bottom: str, gap: float) -> DataFrame:
    """Pairs of rows with equal keys whose ``top`` is more than ``gap`` over ``bottom``; all but few of the pairs that are made are such.

    Values are numbered by cells of a part of the gap. A cell is behind another if there is a bit, the first in which
    they differ, that it has and the other hasn't: then both have the same bits before. So a row of ``high`` looks under each bit it
    has, one of ``low`` under each it hasn't, and the two meet once, in an equi-join; only pairs in the border cell are
    compared for nothing. Rows that are within the gap of all others of their keys are left out before. Values beyond
    the numbered cells count in the last one, so none are lost. Null and NaN values make no pairs."""
    known = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    high, low = high.filter(known(top)), low.filter(known(bottom))
    ends = high.groupBy(*keys).agg(F.max(top).alias("_top")).join(low.groupBy(*keys).agg(F.min(bottom).alias("_bottom")), keys)
    ends = ends.filter(F.col("_top") - F.col("_bottom") > gap)
    return _meet(high.join(ends, keys), low.join(ends, keys), keys, top, bottom, gap)


def _meet(high: DataFrame, low: DataFrame, keys: list[str], top: str, bottom: str, gap: float) -> DataFrame:
    """:func:`far_apart` of tables that have the largest ``_top`` and smallest ``_bottom`` of their keys."""
    width, last = gap / CELLS, (1 << CELL_BITS) - 1
    cell = lambda c: F.least(F.greatest(F.floor(c / width) + (1 << CELL_BITS - 1), F.lit(0)), F.lit(last)).cast("int")
    # A little below the border: rounding must not lose a pair.
    start = lambda c: cell(c + gap - width * 1e-6)
    bits = F.sequence(F.lit(0), F.lit(CELL_BITS - 1))
    right = lambda c, j: F.call_function("shiftright", F.col(c), j)

    def looked_up(df: DataFrame, has: bool) -> DataFrame:
        node = lambda j: right("_at", j) + (0 if has else 1)
        met = lambda j: node(j) > right("_end", j) if has else node(j) <= right("_end", j)
        places = F.transform(F.filter(bits, lambda j: (F.pmod(right("_at", j), F.lit(2)) == int(has)) & met(j)), lambda j: F.struct(j.alias("bit"), node(j).alias("node")))
        border = F.array(F.struct(F.lit(-1).alias("bit"), F.col("_at").alias("node")))
        placed = df.withColumn("_cell", F.explode(F.concat(border, places)))
        return placed.withColumns({"_bit": F.col("_cell.bit"), "_node": F.col("_cell.node")}).drop("_at", "_end", "_cell", "_top", "_bottom")

    tall = high.filter(F.col(top) - F.col("_bottom") > gap).withColumns({"_at": cell(F.col(top)), "_end": start(F.col("_bottom"))})
    short = low.filter(F.col("_top") - F.col(bottom) > gap).withColumns({"_at": start(F.col(bottom)), "_end": cell(F.col("_top"))})
    met = looked_up(tall, True).join(looked_up(short, False), [*keys, "_bit", "_node"])
    return met.filter(F.col(top) - F.col(bottom) > gap).drop("_bit", "_node")


def level_pairs(node: DataFrame, gap: float = 0.8, text: str = "step", walk: DataFrame | None = None) -> DataFrame:
    """(tree_id, chosen, rejected, finished): nodes of one level under different parents that have
    other children too, whose values differ by more than ``gap``. Nodes of one path text count as the first of them. The higher
    one is chosen; pairs with a smaller difference aren't made (:func:`far_apart`). ``walk`` is :func:`tree.walked`, if it is known.

    Writes the nodes that can pair, as they are read several times."""
    kids = node.filter("pid is not null").groupBy("tree_id", "pid").agg(F.count(F.lit(1)).alias("_kids"))
    known = (tree.walked(node, text) if walk is None else walk).filter("first").select("tree_id", "nid", "parent_path")
    own = node.select("tree_id", "nid", "pid", "depth", "v").join(known, ["tree_id", "nid"])
    some = own.join(kids.filter("_kids > 1").select("tree_id", "pid"), ["tree_id", "pid"], "left_semi")
    some = some.join(kids.select("tree_id", F.col("pid").alias("nid"), "_kids"), ["tree_id", "nid"], "left")
    some = some.select("tree_id", "depth", "nid", "parent_path", "v", F.col("_kids").isNull().alias("leaf")).filter(~F.isnan("v"))
    ends = some.groupBy("tree_id", "depth").agg(F.max("v").alias("_top"), F.min("v").alias("_bottom")).filter(F.col("_top") - F.col("_bottom") > gap)
    some = materialise(some.join(ends, ["tree_id", "depth"]).filter((F.col("_top") - F.col("v") > gap) | (F.col("v") - F.col("_bottom") > gap)), "level")
    side = lambda p: some.select("tree_id", "depth", "_top", "_bottom", *[F.col(c).alias(f"{p}_{c}") for c in ("nid", "parent_path", "v", "leaf")])
    pairs = _meet(side("a"), side("b"), ["tree_id", "depth"], "a_v", "b_v", gap)
    return pairs.filter(F.col("a_parent_path") != F.col("b_parent_path")).select(
        "tree_id", F.col("a_nid").alias("chosen"), F.col("b_nid").alias("rejected"), (F.col("a_leaf") & F.col("b_leaf")).alias("finished")
    )


def finish_pairs(node: DataFrame, gap: float = 0.8, text: str = "step") -> DataFrame:
    """(tree_id, chosen, rejected): nodes of type Finish with value 1 against those with value 0 whose path
    minima differ by more than ``gap``, unless :func:`level_pairs` has them as leaves. The trees are walked once; the walk is written."""
    walk = materialise(tree.walked(node, text), "walk")
    met = walk.filter("under_first").select("tree_id", "nid", "value")
    ends = node.filter("type = 'Finish' and v in (0, 1)").select("tree_id", "nid", "v").join(met, ["tree_id", "nid"])
    good = ends.filter("v = 1").select("tree_id", F.col("nid").alias("chosen"), F.col("value").alias("_c"))
    bad = ends.filter("v = 0").select("tree_id", F.col("nid").alias("rejected"), F.col("value").alias("_r"))
    pairs = far_apart(good, bad, ["tree_id"], "_c", "_r", gap).select("tree_id", "chosen", "rejected")
    known = level_pairs(node, gap, text, walk).filter("finished").select("tree_id", "chosen", "rejected")
    return pairs.join(known, ["tree_id", "chosen", "rejected"], "left_anti")


def sibling_pairs(node: DataFrame) -> DataFrame:
    """(tree_id, parent, chosen, rejected): each parent's best and worst child, when they differ; the first of equals."""
    kids = node.filter("pid is not null").groupBy("tree_id", F.col("pid").alias("parent")).agg(
        F.max(F.struct("v", -F.col("nid"))).alias("_b"), F.min(F.struct("v", "nid")).alias("_w")
    )
    return kids.filter(F.col("_b.v") > F.col("_w.v")).select("tree_id", "parent", (-F.col("_b.col2")).alias("chosen"), F.col("_w.nid").alias("rejected"))


def leaf_pairs(node: DataFrame) -> DataFrame:
    """(tree_id, k, chosen, rejected): leaves in the order of their path minimum, highest first
    (then by number): the k-th correct one with the k-th from last wrong one."""
    ends = tree.leaves(node).select("tree_id", "nid", "v").join(tree.path_min(node), ["tree_id", "nid"])
    by = W.partitionBy("tree_id")
    good = ends.filter("v = 1").select("tree_id", F.col("nid").alias("chosen"), F.row_number().over(by.orderBy(F.desc("value"), "nid")).alias("k"))
    bad = ends.filter("v = 0").select("tree_id", F.col("nid").alias("rejected"), F.row_number().over(by.orderBy("value", F.desc("nid"))).alias("k"))
    return good.join(bad, ["tree_id", "k"])


# Step rewards --------------------------------------------------------------------------------


def step_index(steps: DataFrame, text: str = "text") -> DataFrame:
    """Steps (traj, idx, text) with ``step_idx``: running count of the pieces of earlier steps."""
    pieces = F.size(F.split(F.col(text), "\n\nStep", -1))
    before = W.partitionBy("traj").orderBy("idx").rowsBetween(W.unboundedPreceding, -1)
    return steps.withColumn("step_idx", F.coalesce(F.sum(pieces).over(before), F.lit(0)))


def reward_labels(values: Column | str, factor: float = 1.0, soft: bool = False) -> Column:
    """Labels adjusted by a look-back penalty, as an array. The first two stay. Hard: v less factor *
    (last label - v). Soft: a dip is judged by the value after it, and the last step stays. The last label
    is already adjusted, so this is a fold."""
    v = T.col(values)
    n = F.size(v)

    def step(labels: Column, i: Column) -> Column:
        now, last = F.get(v, i), F.element_at(labels, -1)
        hard = now - factor * (last - now)
        if not soft:
            return F.concat(labels, F.array(F.when(i <= 1, now).otherwise(hard)))
        following = F.get(v, i + 1)
        dip = (now < last) & (now < following)
        new = F.when((i <= 1) | (i == n - 1), now).when(dip, now - factor * (last - following)).otherwise(hard)
        return F.concat(labels, F.array(new))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), F.slice(v, 1, 1), lambda a, i: F.when(i < n, step(a, i)).otherwise(a))


def reward_label_rows(steps: DataFrame, factor: float = 1.0, soft: bool = False) -> DataFrame:
    """(traj, idx, label) of steps (traj, idx, v)."""
    ordered = steps.groupBy("traj").agg(F.array_sort(F.collect_list(F.struct("idx", F.col("v").cast("double").alias("v")))).alias("s"))
    labels = reward_labels(F.col("s.v"), factor, soft)
    return ordered.select("traj", F.posexplode(labels).alias("idx", "label"))


def penalties(values: Column | str, labels: Column | str) -> Column:
    """What the adjustment took from each value."""
    return F.zip_with(T.col(values), T.col(labels), lambda a, b: a - b)


def hard_labels(values: Column | str, labels: Column | str, threshold: float = 0.0, hrm: bool = False) -> Column:
    """1 where the value is above the threshold (hrm: or, after the first step, not below the last adjusted label)."""
    v, lab = T.col(values), T.col(labels)
    return F.transform(v, lambda x, i: F.when((x > threshold) | (F.lit(hrm) & (i > 0) & (x >= F.get(lab, i - 1))), 1).otherwise(0))


def path_variance(values: Column | str) -> Column:
    """Population variance of step values."""
    v = T.col(values)
    n = F.size(v)
    mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.nullif(n, F.lit(0))
    return F.aggregate(F.transform(v, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x) / F.nullif(n, F.lit(0))


def reward_rows(records: DataFrame, k: int = -1, factor: float = 1.0, soft: bool = False, threshold: float = 0.0) -> DataFrame:
    """(id, prompt, completions, labels, penalties) of records (id, question, pos, neg) with both
    kinds: per record the k chains of each kind whose values vary most (-1: as many as the scarcer kind has)."""
    both = records.filter((F.size("pos") > 0) & (F.size("neg") > 0))
    k_ = {-1: F.least(F.size("pos"), F.size("neg")), 0: F.greatest(F.size("pos"), F.size("neg"))}.get(k, F.lit(k))
    kinds = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("pos").alias("terms")), F.struct(F.lit(1).alias("kind"), F.col("neg").alias("terms"))))
    rows = both.select("id", "question", k_.alias("_k"), kinds.alias("x")).select("id", "question", "_k", "x.kind", F.posexplode("x.terms").alias("i", "t"))
    rows = rows.withColumn("values", F.col("t.chain.value"))
    order = ["i"] if k == 0 else [F.desc(path_variance("values")), "i"]
    rows = rows.withColumn("_r", F.row_number().over(W.partitionBy("id", "kind").orderBy(*order))).filter(F.col("_r") <= F.col("_k"))
    labels = reward_labels("values", factor, soft)
    # Offsets of the steps: pieces of all steps before.
    steps = F.col("t.chain.step")
    pieces = F.transform(steps, lambda s: F.size(F.split(s, "\n\nStep", -1)))
    offset = lambda i: F.aggregate(F.slice(pieces, F.lit(1), i), F.lit(0), lambda a, x: a + x)
    completions = F.transform(steps, lambda s, i: F.concat(F.lit("Step "), offset(i).cast("string"), F.lit(": "), s))
    rows = rows.withColumns({"completions": completions, "soft": labels})
    out = F.col("soft") if soft else hard_labels("values", "soft", threshold).cast("array<double>")
    return rows.select("id", F.col("question").alias("prompt"), "completions", out.alias("labels"), penalties("values", "soft").alias("penalties"))


def token_labels(lengths: Column | str, labels: Column | str, limit: int | None = None) -> Column:
    """Labels at the last token of each step but the first, the ignore label elsewhere; ``lengths`` are token counts of the steps."""
    n, lab = T.col(lengths), T.col(labels)
    parts = F.transform(n, lambda x, i: F.concat(F.array_repeat(F.lit(IGNORE), F.greatest(x - 1, F.lit(0))), F.when(x > 0, F.array(F.when(i > 0, F.get(lab, i)).otherwise(IGNORE))).otherwise(F.array().cast("array<double>"))))
    flat = F.flatten(parts)
    return flat if limit is None else F.slice(flat, 1, limit)


#: A word with the white space before it, or what white space is left at the end: the pieces of a text, nothing lost.
PIECES = r"\s*[^\s]+|\s+$"


def piece_lengths(text: Column | str, pattern: str = PIECES) -> Column:
    """Lengths of the tokens that a pattern cuts a text into, in letters."""
    return F.transform(F.regexp_extract_all(T.col(text), F.lit(pattern), F.lit(0)), F.char_length)


def text_labels(tokens: Column | str, steps: Column | str, labels: Column | str, limit: int | None = None) -> Column:
    """One label for each token of a text that was cut into tokens as a whole: a step's label at the last token that ends in it,
    the ignore label elsewhere and for the first step.

    ``tokens`` and ``steps`` are lengths, in the same unit, of what the text is made of. A token over a border counts in the step
    it ends in; a step no token ends in has no label. ``limit`` cuts the tokens, with their labels. Both lists of ends are
    sorted, so they are merged; null where any of the three is null."""
    from ..functions import python_functions as P

    out = P.labels_at_ends_udf(T.col(tokens), T.col(steps), T.col(labels).cast("array<double>"), F.lit(IGNORE))
    return out if limit is None else F.slice(out, 1, limit)


def within_tokens(df: DataFrame, tokens: str, limit: int) -> DataFrame:
    """Rows whose text has at most ``limit`` tokens, of a column of token lengths."""
    return df.filter(F.size(tokens) <= limit)


def pad(arr: Column | str, size: Column | int, value) -> Column:
    """An array filled up with ``value`` on the right."""
    a = T.col(arr)
    size = F.lit(size) if isinstance(size, int) else size
    return F.concat(a, F.array_repeat(F.lit(value), F.greatest(size - F.size(a), F.lit(0))))


def collate(df: DataFrame, batch: list[str], arr: str, value) -> DataFrame:
    """Arrays padded to the longest of their batch."""
    longest = F.max(F.size(arr)).over(W.partitionBy(*batch))
    return df.withColumn("_size", longest).withColumn(arr, pad(arr, F.col("_size"), value)).drop("_size")


# Scores from logits --------------------------------------------------------------------------


def sigmoid(x: Column | str) -> Column:
    return 1.0 / (1.0 + F.exp(-T.col(x)))


def softmax(x: Column | str) -> Column:
    """Shares of an array of logits, shifted by the largest."""
    v = T.col(x)
    e = F.transform(v, lambda y: F.exp(y - F.array_max(v)))
    return F.transform(e, lambda y: y / F.aggregate(e, F.lit(0.0), lambda a, z: a + z))


def step_probability(logits: Column | str) -> Column:
    return F.try_element_at(softmax(logits), F.lit(2))


def penalised_probability(logits: Column | str, penalty_logits: Column | str, weight: float = 0.5) -> Column:
    return step_probability(logits) - weight * step_probability(penalty_logits)


def binary_cross_entropy(p: Column | str, label: Column | str) -> Column:
    q = F.least(F.greatest(T.col(p), F.lit(1e-12)), F.lit(1 - 1e-12))
    y = T.col(label)
    return -(y * F.ln(q) + (1 - y) * F.ln(1 - q))


def log_softmax(x: Column | str) -> Column:
    """Logarithms of the shares of an array of logits."""
    top = lambda v: F.array_max(v)
    rest = lambda v: F.ln(F.aggregate(v, F.lit(0.0), lambda a, y: a + F.exp(y - top(v))))
    return T.bound(T.col(x), lambda v: T.bound(top(v) + rest(v), lambda whole: F.transform(v, lambda y: y - whole)))


def soft_cross_entropy(logits: Column | str, label: Column | str) -> Column:
    """Of two logits, against the probability of the second."""
    y = T.col(label)
    return T.bound(log_softmax(logits), lambda v: -(y * v[1] + (1 - y) * v[0]))


def logit_cross_entropy(logit: Column | str, label: Column | str) -> Column:
    """Binary cross entropy of a logit, without overflow; labels are kept a little under 1."""
    x, y = T.col(logit), F.least(F.greatest(T.col(label), F.lit(0.0)), F.lit(1 - 1e-4))
    return F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))


def huber(p: Column | str, label: Column | str, delta: float = 0.5) -> Column:
    """Half the square of a difference up to ``delta``, in proportion to it beyond."""
    d = F.abs(T.col(p) - T.col(label))
    return F.when(d <= delta, 0.5 * d * d).otherwise(delta * (d - 0.5 * delta))


def _hybrid(logits: Column, label: Column) -> Column:
    near = F.least(F.greatest(label, F.lit(0.0)), F.lit(1 - 1e-4))
    return 0.5 * logit_cross_entropy(logits[1], label) + 0.5 * huber(sigmoid(logits[1]), near)


#: Losses of a token's two logits against a label between 0 and 1.
LOSSES: dict[str, Callable[[Column, Column], Column]] = {
    "soft": soft_cross_entropy,
    "mse": lambda logits, label: F.pow(step_probability(logits) - label, F.lit(2)),
    "huber": lambda logits, label: huber(step_probability(logits), label),
    "bce": lambda logits, label: logit_cross_entropy(logits[1], label),
    "hybrid": _hybrid,
}


def token_loss(kind: str, logits: Column | str, label: Column | str) -> Column:
    """A token's loss; null, which means leave out, where the label is the ignore label."""
    y = T.col(label)
    return F.when(y != IGNORE, LOSSES[kind](T.col(logits), y))


def penalised_loss(logits: Column | str, label: Column | str, penalty_logits: Column | str, penalty: Column | str, kind: str = "soft", weight: float = 0.3) -> Column:
    """The mean over rows of a loss and ``weight`` times the cross entropy of the penalties: an aggregate. Rows count for each
    part by that part's own label."""
    known = F.when(T.col(penalty) != IGNORE, soft_cross_entropy(penalty_logits, (T.col(penalty) > 0).cast("double")))
    return F.avg(token_loss(kind, logits, label)) + weight * F.coalesce(F.avg(known), F.lit(0.0))


def mean_loss(losses: Column | str) -> Column:
    """Mean of the token losses that are not 0."""
    some = F.filter(T.col(losses), lambda x: x != 0)
    return F.aggregate(some, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(some), F.lit(0))


def blend(model: Column | str, known: Column | str) -> Column:
    """Half a model's score, half the known one."""
    return (T.col(model) + T.col(known)) * 0.5
