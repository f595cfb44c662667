"""The functions that built-in expressions can't give, as Arrow-batched pandas UDFs."""

from __future__ import annotations

import ast
import math
import operator
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import symbolic, text

# Balanced braces -----------------------------------------------------------------------------


def braces(text: str, start: int) -> int:
    """Index of the brace that closes the one before ``start``; the text's length without one."""
    depth = 1
    for m in re.compile(r"[{}]").finditer(text, start):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.start()
    return len(text)


def boxed_all(text: str | None) -> list[str] | None:
    r"""Contents of every closed ``\boxed{...}``, outermost first to last."""
    if text is None:
        return None
    out, at = [], 0
    mark = "\\boxed{"
    while (found := text.find(mark, at)) >= 0:
        start = found + len(mark)
        end = braces(text, start)
        if end == len(text):
            break
        out.append(text[start:end])
        at = end
    return out


def boxed_last(text: str | None) -> str | None:
    """What the last "boxed" holds: its braces' content, or the text up to a dollar sign."""
    if text is None:
        return None
    rest = text.rpartition("boxed")[2]
    if rest.startswith("{"):
        return rest[1 : braces(rest, 1)]
    return rest.split("$")[0].strip()


# Arithmetic without eval ---------------------------------------------------------------------

_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Mod: operator.mod, ast.FloorDiv: operator.floordiv}
_COMPARE = {ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge}
_CALLS = {"min": min, "max": max, "round": round, "abs": abs, "int": int, "float": float, "pow": None, "sqrt": math.sqrt, "log": math.log, "log10": math.log10, "exp": math.exp, "floor": math.floor, "ceil": math.ceil}


def _power(a: float, b: float) -> float:
    if abs(b) > 1000 or (a and abs(b) * math.log10(abs(a) + 1) > 300):
        raise ValueError("power too large")
    return a**b


def arithmetic(expression: str) -> float | int | bool | tuple:
    """The value of an arithmetic expression; anything but numbers, operators and a few functions is
    refused, and powers are bounded."""

    def value(n: ast.AST):
        match n:
            case ast.Expression(body=b):
                return value(b)
            case ast.Constant(value=v) if isinstance(v, int | float):
                return v
            case ast.Tuple(elts=es) | ast.List(elts=es):
                return tuple(map(value, es))
            case ast.UnaryOp(op=ast.USub(), operand=x):
                return -value(x)
            case ast.UnaryOp(op=ast.UAdd(), operand=x):
                return value(x)
            case ast.BinOp(left=a, op=ast.Pow(), right=b):
                return _power(value(a), value(b))
            case ast.BinOp(left=a, op=op, right=b) if type(op) in _BINARY:
                return _BINARY[type(op)](value(a), value(b))
            case ast.Compare(left=a, ops=[op], comparators=[b]) if type(op) in _COMPARE:
                return _COMPARE[type(op)](value(a), value(b))
            case ast.IfExp(test=t, body=a, orelse=b):
                return value(a) if value(t) else value(b)
            case ast.Call(func=f, args=args, keywords=[]):
                name = f.attr if isinstance(f, ast.Attribute) else getattr(f, "id", "")
                if name == "pow":
                    return _power(*map(value, args))
                if name in _CALLS:
                    return _CALLS[name](*map(value, args))
        raise ValueError("not plain arithmetic")

    if len(expression) > 2000:
        raise ValueError("too long")
    return value(ast.parse(expression.strip(), mode="eval"))


def without_signs(text: str) -> str:
    """:func:`text.clean_units` for a plain string."""
    x = re.sub(r"(?<![\d}])\\?π", "3.14", text.replace("\\pi", "π"))
    x = re.sub(r"(?<=\d)\\?π", "*3.14", x).replace("%", "/100")
    return re.sub("°C?| C", "", re.sub("[$¥]", "", x))


def number(text: str | None) -> float | None:
    """A number from text with units, LaTeX or arithmetic; null when it is none."""
    if text is None:
        return None
    x = without_signs(text)
    x = re.sub(r"\\[td]?frac\{([^{}]*)\}\{([^{}]*)\}", r"((\1)/(\2))", x)
    x = re.sub(r"\\sqrt\{([^{}]*)\}", r"sqrt(\1)", x).replace("\\times", "*").replace("\\cdot", "*").replace("^", "**")
    try:
        v = arithmetic(x)
        v = v[0] if isinstance(v, tuple) else v
        return float(v)
    except (ValueError, SyntaxError, TypeError, ArithmeticError, IndexError, RecursionError, MemoryError):
        return symbolic.value(text)


def shown(v: float) -> str:
    """Whole numbers without a point."""
    return str(int(v)) if abs(v) < 1e16 and v == int(v) else str(v)


# Medical calculators -------------------------------------------------------------------------

#: Kinds of result by calculator number.
DATE_IDS = {13, 68}
PAIR_IDS = {69}
INTEGER_IDS = {4, 15, 16, 17, 18, 20, 21, 25, 27, 28, 29, 32, 33, 36, 43, 45, 48, 51}
DECIMAL_IDS = {2, 3, 5, 6, 7, 8, 9, 10, 11, 19, 22, 23, 24, 26, 30, 31, 38, 39, 40, 44, 46, 49, 56, 57, 58, 59, 60, 61, 62, 63, 64, 65, 66, 67}

NUMBER = re.compile(r"-?\d+(?:\.\d+)?")
DATE = re.compile(r"^(0?[1-9]|1[0-2])/(0?[1-9]|[12]\d|3[01])/(\d{4})")
PAIR = re.compile(r"\(?(\d+)\s*(?:weeks?)?,?\s*(\d+)\s*(?:days?)?\s*\)?")
#: What a formula written by a model has instead of an operator, or too much.
FORMULA_WORDS = {
    "^": "**", "is odd": "% 2 == 1", "is even": "% 2 == 0",
    "weight": "", "height": "", "mg/dl": "", "g/dl": "", "mmol/L": "", "kg": "", "g": "", "mEq/L": "",
}
_WORDS = re.compile("|".join(re.escape(w) for w in sorted(FORMULA_WORDS, key=len, reverse=True)))
NONE = "N/A"


def formula_value(inner: str) -> str:
    """The value of a formula up to a remark, with brackets put where they lack; "N/A" if it has none."""
    plain = _WORDS.sub(lambda m: FORMULA_WORDS[m[0]], inner).partition("#")[0]
    lack = plain.count("(") - plain.count(")")
    return value_of("(" * -lack + plain + ")" * lack)


def value_of(text: str, divisor: int | None = None) -> str:
    try:
        v = arithmetic(text)
        return str(v if divisor is None else v / divisor)
    except (ValueError, SyntaxError, TypeError, ArithmeticError):
        return NONE


def _date(text: str) -> str | None:
    m = DATE.search(text)
    return m and f"{int(m[1]):02}/{int(m[2]):02}/{m[3]}"


def pair_of(text: str) -> tuple[str, ...] | None:
    """Weeks and days, in any brackets and quotes."""
    m = PAIR.search(text.translate(str.maketrans("[]", "()", "'\"")))
    return m and m.groups()


def _behind(pattern: str, make, last: bool = False):
    """A reader: what ``make`` gives for the first (or last) match of the pattern."""
    compiled = re.compile(pattern)

    def read(text: str) -> str | None:
        found = list(compiled.finditer(text))
        return make(found[-1 if last else 0]) if found else None

    return read


#: Kinds of calculators: their numbers and the readers of an answer, of which the first that finds something counts.
CALCULATORS = [
    (DATE_IDS, [_date]),
    (PAIR_IDS, [lambda text: (p := pair_of(text)) and f"({p[0]}, {p[1]})"]),
    (INTEGER_IDS, [
        _behind(r"(\d+) out of", lambda m: m[1]),
        _behind(r"-?\d+(?:, ?-?\d+)+", lambda m: str(m[0].count(",") + 1)),
        _behind(NUMBER.pattern, lambda m: m[0], last=True),
    ]),
    (DECIMAL_IDS, [
        _behind(r"str\((.*)\)", lambda m: formula_value(m[1])),
        _behind(r"(-?\d+(?:\.\d+)?)\s*mL/min/1.73", lambda m: value_of(m[1])),
        _behind(r"(-?\d+(?:\.\d+)?)%", lambda m: value_of(m[1], 100), last=True),
        _behind(NUMBER.pattern, lambda m: value_of(m[0].lstrip("0")), last=True),
    ]),
]


def calculator_answer(text: str | None, calculator: int | None) -> str | None:
    """A calculator's answer in its canonical form, "N/A" when there is none; null for unknown ones."""
    if text is None:
        return None
    for numbers, readers in CALCULATORS:
        if calculator in numbers:
            return next(filter(None, (read(text) for read in readers)), NONE)
    return None


def calculator_correct(answer: str | None, gold: str | None, calculator: int | None, low: str | None, high: str | None) -> int | None:
    """1 or 0 by the kind of result; null for unknown calculators."""
    try:
        if calculator in DATE_IDS:
            a, g = (DATE.search(x) for x in (answer, gold))
            return int(bool(a and g) and tuple(map(int, a.groups())) == tuple(map(int, g.groups())))
        if calculator in PAIR_IDS:
            a, g = pair_of(answer), pair_of(gold)
            return int(bool(a and g) and tuple(map(int, a)) == tuple(map(int, g)))
        if calculator in INTEGER_IDS:
            return int(round(arithmetic(answer)) == arithmetic(gold))
        if calculator in DECIMAL_IDS:
            return int(arithmetic(low) <= arithmetic(answer) <= arithmetic(high))
    except (ValueError, SyntaxError, TypeError, ArithmeticError, AttributeError):
        return 0
    return None


# Longest common subsequence ------------------------------------------------------------------


def lcs_recall(text: str | None, gold: str | None) -> float | None:
    """Length of the longest common subsequence of words, as a share of the gold text's."""
    if text is None or gold is None:
        return None
    a, b = text.split(), gold.split()
    if not b:
        return 0.0
    # Bit-parallel: one word of a per step over all of b.
    where: dict[str, int] = {}
    for i, w in enumerate(b):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for w in a:
        m = row & where.get(w, 0)
        row = ((row + m) | (row - m)) & full
    return (len(b) - row.bit_count()) / len(b)


def best_token_f1(text: str | None, golds: list[str | None] | None) -> float | None:
    """The best F1 of the words of ``text`` with those of a gold text, as multisets."""
    known = [] if golds is None else [g for g in golds if g is not None]
    if text is None or not known:
        return None
    mine = Counter(w for w in text.split(" ") if w)
    best = 0.0
    for gold in known:
        other = Counter(w for w in gold.split(" ") if w)
        same = (mine & other).total()
        best = max(best, 2.0 * same / (mine.total() + other.total()) if same else 0.0)
    return best


def _lift(kind: T.DataType, f):
    def one(a: pd.Series) -> pd.Series:
        return pd.Series([f(None if x is None else x) for x in a], dtype=object)

    return F.pandas_udf(one, kind)


boxed_all_udf = _lift(T.ArrayType(T.StringType()), boxed_all)
boxed_last_udf = _lift(T.StringType(), boxed_last)
number_udf = _lift(T.DoubleType(), number)


@F.pandas_udf(T.StringType())
def calculator_answer_udf(text: pd.Series, calculator: pd.Series) -> pd.Series:
    return pd.Series([calculator_answer(t, None if pd.isna(c) else int(c)) for t, c in zip(text, calculator, strict=True)], dtype=object)


@F.pandas_udf(T.IntegerType())
def calculator_correct_udf(answer: pd.Series, gold: pd.Series, calculator: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
    rows = zip(answer, gold, calculator, low, high, strict=True)
    return pd.Series([calculator_correct(a, g, None if pd.isna(c) else int(c), x, y) for a, g, c, x, y in rows], dtype="Int64")


@F.pandas_udf(T.DoubleType())
def lcs_recall_udf(text: pd.Series, gold: pd.Series) -> pd.Series:
    return pd.Series([lcs_recall(t, g) for t, g in zip(text, gold, strict=True)], dtype=object)


@F.pandas_udf(T.DoubleType())
def best_token_f1_udf(text: pd.Series, golds: pd.Series) -> pd.Series:
    return pd.Series([best_token_f1(t, g) for t, g in zip(text, golds, strict=True)], dtype=object)


# Labels of tokens ----------------------------------------------------------------------------


def labels_at_ends(tokens, steps, labels, ignore: float) -> np.ndarray | None:
    """Merges the ends of tokens and of steps: a step's label at the last token that ends in it."""
    if tokens is None or steps is None or labels is None:
        return None
    token_ends, step_ends = np.cumsum(np.asarray(tokens, np.int64)), np.cumsum(np.asarray(steps, np.int64))
    out = np.full(len(token_ends), float(ignore))
    last = np.searchsorted(token_ends, step_ends, side="right") - 1
    for i in range(1, min(len(last), len(labels))):
        if last[i] > last[i - 1] and labels[i] is not None:
            out[last[i]] = labels[i]
    return out


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def labels_at_ends_udf(tokens: pd.Series, steps: pd.Series, labels: pd.Series, ignore: pd.Series) -> pd.Series:
    return pd.Series([labels_at_ends(*row) for row in zip(tokens, steps, labels, ignore, strict=True)], dtype=object)


# Answers of mathematical data sets -----------------------------------------------------------

ANY_NUMBER = re.compile(r"-?\d*\.?\d+")
WHOLE_OR_QUOTIENT = re.compile(r"-?\d+/?\.?\d*")


@dataclass(frozen=True)
class Said:
    """An output's answer: its text, and whether it stands behind a trigger phrase."""

    text: str
    told: bool


def trimmed(n: str) -> str:
    """A number without useless zeros in front or behind; a quotient as its value; others as they are."""
    try:
        return shown(float(n))
    except ValueError:
        v = number(n)
        return n if v is None else shown(v)


def letters(last: str):
    """A reader of single letters from A on."""
    pattern = re.compile(rf"\b[A-{last}]\b")
    return lambda said: pattern.findall(said.text.upper())


def bare(said: Said) -> list[str]:
    return [said.text.strip().strip(".")]


def figures(said: Said) -> list[str]:
    return [trimmed(n) for n in WHOLE_OR_QUOTIENT.findall(said.text.replace(",", ""))]


def boxed(said: Said) -> list[str]:
    return [boxed_last(said.text)] if "boxed" in said.text else []


def last_number(said: Said) -> list[str]:
    return [] if said.told else (ANY_NUMBER.findall(said.text)[-1:] or [""])


def side_without_unit(said: Said) -> list[str]:
    """What is behind the last equals sign, without a unit behind a number."""
    side = said.text.rpartition("=")[2].strip()
    return [re.sub(r"^([\d.]+)\s\D+$", r"\1", side)]


def truth(said: Said) -> list[str]:
    low = said.text.lower()
    words = {"True": ("yes", "true"), "False": ("no", "false")}
    return [name for name, ws in words.items() if any(w in low for w in ws)][:1]


def lettered(said: Said) -> list[str]:
    return [said.text] if re.search(r"\([a-f]\)", said.text.lower()) else []


def theorem_value(said: Said) -> list[str]:
    """The value of the side behind the last equals sign, or that side without a unit."""
    inner = boxed(said) or [said.text]
    if not said.told:
        return last_number(Said(inner[0], False))
    side = without_signs(inner[0].rpartition("=")[2].strip())
    v = number(side)
    return [re.sub(r"^(-?[\d.]+)\s(?:\D+|\S+)$", r"\1", side) if v is None else shown(v)]


#: Readers of the answers of data sets, in the order they are tried; names that others contain stand last.
READERS = {
    **dict.fromkeys(("aqua", "sat", "arc"), [letters("J"), bare]),
    "numglue": [letters("B"), figures],
    **dict.fromkeys(("gsm8k", "svamp", "deepmind", "simuleq"), [figures]),
    "math": [boxed, last_number, side_without_unit],
    "theoremqa": [truth, lettered, theorem_value],
}
READERS_BY_PART = {"mmlu": [letters("J"), bare], "gpqa": [letters("D"), bare], "bbh": [lambda said: [said.text]]}


def readers_of(dataset: str) -> list:
    found = READERS.get(dataset) or next((r for name, r in READERS_BY_PART.items() if name in dataset), None)
    if found is None:
        raise ValueError(f"unknown data set {dataset}")
    return found


def said_in(pred: str, triggers: tuple[str, ...]) -> Said:
    """The text behind the last trigger phrase. Outputs that repeat a phrase go on with questions of their own, so
    their first paragraph counts."""
    text = pred.strip("\n")
    if any(text.count(t) > 1 for t in triggers):
        text = text.partition("\n\n")[0]
    *before, last = re.split("|".join(triggers), text) if triggers else [text]
    return Said(last.strip("\n").rstrip(".").rstrip("/").strip(" "), bool(before))


def raw_answer(dataset: str, triggers: tuple[str, ...], pred: str | None) -> str | None:
    """The first answer found behind a trigger phrase, the last one found without."""
    if pred is None:
        return None
    said = said_in(pred, triggers)
    found: list[str] = next(filter(None, (read(said) for read in readers_of(dataset))), [""])
    return found[0 if said.told else -1]


def clean_answer(c: Column | str, dataset: str, triggers: tuple[str, ...] = ("The answer is", "the answer is")) -> Column:
    """The answer of a data set's output; of ``math`` in one LaTeX spelling."""
    readers_of(dataset)
    raw = _lift(T.StringType(), lambda t: raw_answer(dataset, triggers, t))(F.col(c) if isinstance(c, str) else c)
    if dataset == "math":
        raw = text.latex(raw)
    return text.strip_right(text.strip_right(raw, "."), "/")


def svamp_correct(text: str | None, gold: float | None) -> float | None:
    """A boxed or told number within a thousandth of the gold one, else its digits in the answer."""
    if text is None or gold is None:
        return None
    boxes = boxed_all(text)
    if boxes:
        v = number(boxes[0])
        return float(abs(v - gold) < 1e-3) if v is not None else float(boxes[0] in str(gold))
    m = re.findall(r"(?i)the answer is(.*)(?:\.|$)", text if text.endswith(".") else text + ".")
    if not m:
        return 0.0
    said = m[-1].strip().strip(".")
    try:
        return float(abs(gold - float(said)) < 1e-3)
    except ValueError:
        return float(abs(gold - int(gold)) < 1e-4 and str(int(gold)) in said)


@F.pandas_udf(T.DoubleType())
def svamp_correct_udf(text: pd.Series, gold: pd.Series) -> pd.Series:
    return pd.Series([svamp_correct(t, None if pd.isna(g) else float(g)) for t, g in zip(text, gold, strict=True)], dtype=object)
