"""Chat formatting with budgeted windows, in DataFrame functions only.

Prefix sums of turn tokens lay a conversation out over cells of ``budget / 2`` tokens. The turns that lie
inside one cell are a span, and a turn that crosses the end of a cell is a span of its own. Each span becomes
one window: the system turn (the first turn, if a system turn), up to ``history`` last turns of the span before
that together hold ``budget / 4`` tokens at most, and the span's own turns. Only assistant texts of the
span's own turns are under the loss mask, so every target is learned once. No turn is ever cut or
dropped, so a window exceeds the budget where one own turn is over half of it or the system turn over a quarter, and only there.

Tokens are a parameter: a column of counts, or the estimate of a token for each three bytes of UTF-8 and
four for the marks of a turn.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn. Inside roles and texts a backslash becomes two,
``<|`` becomes ``<\\|`` and in roles a line feed becomes a backslash and n, so control strings of the template
never occur inside. Pairs of backslashes, found from the left, tell what stands for itself when this is undone.

Edge cases: null text and null role count as empty; rows of a conversation are ordered by
turn (null first), equal turns by role, then text; repeated rows are turns of their own; a null
conv_id is a conversation. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import text_of

START, END = "<|im_start|>", "<|im_end|>"


def _literal(c: Column, find: str, put: str) -> Column:
    return F.replace(c, F.lit(find), F.lit(put))


def escape(c: Column) -> Column:
    return _literal(_literal(c, "\\", "\\\\"), "<|", "<\\|")


def escape_role(c: Column) -> Column:
    return _literal(escape(c), "\n", "\\n")


def unescape(c: Column) -> Column:
    part = lambda p: _literal(_literal(p, "\\n", "\n"), "<\\|", "<|")
    return F.array_join(F.transform(F.split(c, r"\\\\"), part), "\\")


def estimate(text: Column) -> Column:
    """Tokens of a turn: one for three bytes, and four for its marks."""
    return F.ceil(F.octet_length(text) / 3) + 4


def windows(turns: DataFrame, budget: int = 2048, history: int = 2, tokens: Column | None = None) -> DataFrame:
    """One row per window: conv_id, window, formatted, n_repeated (leading turns that only
    repeat), loss_spans (array of start, length in code points of ``formatted``)."""
    role, text = text_of("role"), text_of("text")
    cell = budget // 2
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    count = estimate(text) if tokens is None else F.coalesce(tokens.cast("long"), F.lit(0))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), count.alias("tokens"))
    before = F.coalesce(F.sum("tokens").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("before", before)
    first, last = F.floor(F.col("before") / cell), F.floor((F.col("before") + F.greatest("tokens", F.lit(1)) - 1) / cell)
    rows = rows.select(
        "conv_id", "role", "text", "tokens",
        F.row_number().over(order).alias("k"),
        F.when(first == last, first).alias("cell"),  # null for a turn that crosses
    )
    # Spans are numbered by the first turn in them, without gaps.
    by_k = W.partitionBy("conv_id").orderBy("k")
    here, ago = F.col("cell"), F.lag("cell").over(by_k)
    opens = ((F.col("k") > 1) & (here.isNull() | ago.isNull() | (here != ago))).cast("int")
    rows = rows.withColumn("window", F.sum(opens).over(by_k))
    from_end = W.partitionBy("conv_id", "window").orderBy(F.desc("k"))
    rows = rows.withColumn("left", F.row_number().over(from_end)).withColumn("tail", F.sum("tokens").over(from_end))
    rows = rows.withColumn("last", F.max("window").over(W.partitionBy("conv_id")))
    # A turn goes to its own window, and as history to the next; the system turn goes to all.
    # 0 = system, 1 = history, 2 = own.
    system = (F.col("k") == 1) & (F.col("role") == "system")
    own = F.array(F.struct(F.col("window").alias("to"), F.lit(2).alias("part")))
    nxt = F.struct((F.col("window") + 1).alias("to"), F.lit(1).alias("part"))
    everywhere = F.transform(
        F.sequence(F.lit(1).cast("bigint"), F.greatest(F.col("last"), F.lit(1))), lambda x: F.struct(x.alias("to"), F.lit(0).alias("part"))
    )
    copies = (
        F.when(F.col("last") == 0, own)
        .when(system, F.concat(own, everywhere))
        .when((F.col("left") <= history) & (F.col("tail") <= budget // 4) & (F.col("window") < F.col("last")), F.concat(own, F.array(nxt)))
        .otherwise(own)
    )
    body = escape(F.col("text"))
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    rows = rows.select(
        "conv_id", "k", head.alias("head"), body.alias("body"), (F.col("role") == "assistant").alias("target"), F.explode(copies).alias("copy")
    )
    turn = F.struct("copy.part", "k", "head", "body", "target")
    grouped = rows.groupBy("conv_id", F.col("copy.to").alias("window")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    whole = lambda t: F.concat(t["head"], t["body"], F.lit(END + "\n"))
    # Walk the window's few turns with the running length; each own assistant turn adds a span.
    start = F.struct(
        F.lit(1).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")
    )
    walk = lambda s, t: F.struct(
        (s["at"] + F.char_length(whole(t))).alias("at"),
        F.when(
            t["target"] & (t["part"] == 2),
            F.concat(
                s["spans"],
                F.array(
                    F.struct(
                        (s["at"] + F.char_length(t["head"])).alias("start"), F.char_length(t["body"]).cast("long").alias("length")
                    )
                ),
            ),
        ).otherwise(s["spans"]).alias("spans"),
    )
    return grouped.select(
        "conv_id",
        "window",
        F.array_join(F.transform("turns", whole), "").alias("formatted"),
        F.size(F.filter("turns", lambda t: t["part"] < 2)).alias("n_repeated"),
        F.aggregate("turns", start, walk)["spans"].alias("loss_spans"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted window: array of (role, text), unescaped."""
    parts = F.split(formatted, r"<\|im_start\|>")
    parts = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))

    def turn(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        at = F.char_length(role) + 2
        return F.struct(unescape(role).alias("role"), unescape(p.substr(at, F.char_length(p) - at - len(END))).alias("text"))

    return F.transform(parts, turn)


def digest(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from its windows: turns, loss text and sizes."""
    turns = F.slice(read_back(F.col("formatted")), F.col("n_repeated") + 1, F.greatest(F.size(read_back(F.col("formatted"))), F.lit(1)))
    loss = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"].cast("int"), s["length"].cast("int"))))
    rows = formatted.select(
        "conv_id",
        "window",
        F.char_length("formatted").alias("chars"),
        F.size(turns).alias("n"),
        F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
        F.array_join(loss, "").alias("loss"),
    )
    rows = rows.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.sort_array(F.collect_list(F.struct("window", "said", "loss"))).alias("w")
    )
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    said, loss = F.array_join(F.col("w.said"), ""), F.array_join(F.col("w.loss"), "")
    return rows.select(
        "conv_id",
        "n_turns",
        sha(said).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        sha(loss).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
