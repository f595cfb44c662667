r"""Values of LaTeX expressions, so that answers of equal value count as equal however they are spelled.

An expression is read once into a quotient of polynomials with exact fractions as coefficients. Their unknowns are letters, π, i, the
square roots of primes, and roots, powers and functions that are no rational function of these, each by the value of what it is
applied to. Two expressions are equal if cross products are, exactly. ``key`` is one text for all spellings of a value, so Spark can
group, join and count by it: the quotient's value at fixed pseudo-random points of the field of p\ :sup:`2` elements, p = 2\ :sup:`127` - 1, in which
all square roots of whole numbers exist. Equal values have equal keys; different ones share a key with a chance of about degree / p.

Rules where notation leaves a choice: a whole number right before ``\frac`` of whole numbers is a mixed number; ``2^10`` takes
the whole exponent; a comma before each three digits belongs to a number, others separate the parts of a tuple; of
``x = ...`` the right side counts; the percent sign divides by 100; three letters in a row are a word, not a product. Text that is no such expression, or that goes beyond the limits
below, has no value (null) and is compared as text.
"""

from __future__ import annotations

import hashlib
import math
import re
from fractions import Fraction
from functools import cache, lru_cache, wraps

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as text_functions

MAX_LETTERS, MAX_TERMS, MAX_POWER, MAX_BITS, MAX_FACTOR = 500, 400, 64, 2048, 100_000
P = (1 << 127) - 1

Monomial = tuple[tuple[str, int], ...]
Polynomial = dict[Monomial, Fraction]
Quotient = tuple[Polynomial, Polynomial]
ONE: Polynomial = {(): Fraction(1)}


class NoValue(ValueError):
    """The text is no expression with a value."""


# Polynomials ---------------------------------------------------------------------------------


def add(a: Polynomial, b: Polynomial) -> Polynomial:
    out = dict(a)
    for m, c in b.items():
        out[m] = out.get(m, Fraction(0)) + c
    return {m: c for m, c in out.items() if c}


def multiply(a: Polynomial, b: Polynomial) -> Polynomial:
    if len(a) * len(b) > MAX_TERMS * MAX_TERMS:
        raise NoValue("too many terms")
    out: Polynomial = {}
    for m, c in a.items():
        for n, d in b.items():
            powers = dict(m)
            for unknown, k in n:
                powers[unknown] = powers.get(unknown, 0) + k
            factor = c * d
            for unknown in [u for u, k in powers.items() if k > 1 and u[0] == "√"]:
                # The square of a root is what it is the root of.
                factor *= int(unknown[1:]) ** (powers[unknown] // 2)
                powers[unknown] %= 2
            key = tuple(sorted((u, k) for u, k in powers.items() if k))
            out[key] = out.get(key, Fraction(0)) + factor
    out = {m: c for m, c in out.items() if c}
    if len(out) > MAX_TERMS or any(c.numerator.bit_length() + c.denominator.bit_length() > MAX_BITS for c in out.values()):
        raise NoValue("too large")
    return out


def plus(a: Quotient, b: Quotient) -> Quotient:
    if a[1] == b[1]:
        return add(a[0], b[0]), a[1]
    return add(multiply(a[0], b[1]), multiply(b[0], a[1])), multiply(a[1], b[1])


def times(a: Quotient, b: Quotient) -> Quotient:
    return multiply(a[0], b[0]), multiply(a[1], b[1])


def inverse(a: Quotient) -> Quotient:
    if not a[0]:
        raise NoValue("division by zero")
    return a[1], a[0]


def whole(v: Fraction | int) -> Quotient:
    return ({(): Fraction(v)} if v else {}), ONE


def unknown(name: str) -> Quotient:
    return {((name, 1),): Fraction(1)}, ONE


def constant(a: Quotient) -> Fraction | None:
    if any(m for p in a for m in p):
        return None
    return a[0].get((), Fraction(0)) / a[1][()]


def equal(a: Quotient, b: Quotient) -> bool:
    return multiply(a[0], b[1]) == multiply(b[0], a[1])


def to_power(base: Quotient, exponent: Quotient) -> Quotient:
    e = constant(exponent)
    if e is None:
        return unknown(f"power {key_of(base)} {key_of(exponent)}")
    if e.denominator != 1:
        return root(to_power(base, whole(e.numerator)), e.denominator)
    if abs(e) > MAX_POWER and constant(base) not in (0, 1, -1):
        c = constant(base)
        if c is None or abs(e) * max(c.numerator.bit_length(), c.denominator.bit_length()) > MAX_BITS:
            raise NoValue("power too large")
    if e < 0:
        base = inverse(base)
    elif e == 0 and not base[0]:
        raise NoValue("0^0")
    out, left = whole(1), abs(int(e))
    while left:
        if left & 1:
            out = times(out, base)
        left >>= 1
        base = times(base, base) if left else base
    return out


def root(a: Quotient, n: int) -> Quotient:
    """Square roots of fractions by the primes of a whole number; other roots where they are exact."""
    c = constant(a)
    if c is None or n < 2 or (n > 2 and c < 0 and n % 2 == 0):
        return unknown(f"root{n} {key_of(a)}")
    if n > 2:
        sides = [round(abs(x) ** (1 / n)) if x.bit_length() < 900 else 0 for x in (c.numerator, c.denominator)]
        if sides[0] ** n == abs(c.numerator) and sides[1] ** n == c.denominator:
            return whole(Fraction(sides[0] if c >= 0 else -sides[0], sides[1]))
        return unknown(f"root{n} {key_of(a)}")
    inner, outer, out = abs(c.numerator * c.denominator), Fraction(1, c.denominator), whole(1)
    factor = 2
    while factor * factor <= inner and factor < MAX_FACTOR:
        while inner % (factor * factor) == 0:
            inner //= factor * factor
            outer *= factor
        if inner % factor == 0:
            inner //= factor
            out = times(out, unknown(f"√{factor}"))
        factor += 1
    if (side := math.isqrt(inner)) ** 2 == inner:
        outer, inner = outer * side, 1
    if inner == 0:
        return whole(0)
    if inner > 1:
        out = times(out, unknown(f"√{inner}"))
    if c < 0:
        out = times(out, unknown("√-1"))
    return times(out, whole(outer))


# Reading -------------------------------------------------------------------------------------

#: Signs of LaTeX that stand for others, and what has no value of its own.
SAME = {
    r"\times": "*", r"\cdot": "*", "×": "*", "·": "*", r"\div": "/", "÷": "/", "−": "-", "–": "-", r"\pi": "π", r"\%": "%", "**": "^",
    r"\dfrac": r"\frac", r"\tfrac": r"\frac", r"\cfrac": r"\frac", r"\lbrace": "{", r"\rbrace": "}", "[": "(", "]": ")",
}
DROPPED = re.compile(r"\\left|\\right|\\[!,;: ]|\\displaystyle|\$|~|\s")
WORD = re.compile(r"(?<![\\A-Za-z])[A-Za-z]{3,}")
FUNCTIONS = {rf"\{f}" for f in ("sin", "cos", "tan", "cot", "sec", "csc", "ln", "log", "exp", "arcsin", "arccos", "arctan")}
TOKEN = re.compile(r"\d{1,3}(?:,\d{3})+(?![\d,])(?:\.\d+)?|\d+(?:\.\d+)?|\.\d+|\\[A-Za-z]+|\\[%!,;: ]|\*\*|.", re.DOTALL | re.ASCII)


class Reader:
    """A reader by precedence: sums of products of powers."""

    def __init__(self, text: str):
        if len(text) > MAX_LETTERS:
            raise NoValue("too long")
        if WORD.search(text):
            raise NoValue("words")
        found = TOKEN.findall(text.strip().removesuffix("."))
        self.tokens = [SAME.get(t, t) for t in found if not DROPPED.fullmatch(t)]
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, wanted: str = "") -> str:
        t = self.peek()
        if not t or (wanted and t != wanted):
            raise NoValue(f"{wanted or 'more'} expected")
        self.at += 1
        return t

    def sum(self) -> Quotient:
        out = self.product()
        while self.peek() in ("+", "-"):
            sign = self.take()
            out = plus(out, times(whole(1 if sign == "+" else -1), self.product()))
        return out

    def product(self) -> Quotient:
        out = self.signed()
        while (t := self.peek()) and t not in ("+", "-", ",", ")", "}", "=", "|"):
            if t in ("*", "/"):
                self.take()
            elif t[0].isdigit():
                raise NoValue("two numbers without a sign")
            out = times(out, inverse(self.signed()) if t == "/" else self.signed())
        return out

    def signed(self) -> Quotient:
        if self.peek() in ("+", "-"):
            return times(whole(-1 if self.take() == "-" else 1), self.signed())
        return self.power()

    def power(self) -> Quotient:
        out = self.single()
        while self.peek() in ("^", "%"):
            if self.take() == "%":
                out = times(out, whole(Fraction(1, 100)))
            elif self.peek() in ("+", "-"):
                out = to_power(out, times(whole(-1 if self.take() == "-" else 1), self.single()))
            else:
                return to_power(out, self.power())  # from right to left
        return out

    def group(self) -> Quotient:
        r"""What a command takes: braces, or one letter or digit; of a longer number its first digit, as in \frac12."""
        t = self.peek()
        if t[:1].isdigit() and len(t) > 1:
            self.tokens[self.at : self.at + 1] = [t[0], t[1:]]
        return self.single()

    def single(self) -> Quotient:
        t = self.take()
        if t[0].isdigit() or (t[0] == "." and len(t) > 1):
            v = Fraction(t.replace(",", ""))
            if self.peek() == r"\frac" and t.isdigit():
                mark = self.at
                part = constant(self.single())
                if part is not None and 0 <= part < 1:
                    return whole(v + part)
                self.at = mark
            return whole(v)
        if t in ("(", "{"):
            out = self.sum()
            self.take(")" if t == "(" else "}")
            return out
        if t == r"\frac":
            return times(self.group(), inverse(self.group()))
        if t in (r"\sqrt", "√"):
            n = Fraction(2)
            if self.peek() == "(" and t == r"\sqrt" and self.tokens[self.at + 2 : self.at + 4] == [")", "{"]:
                self.take()
                n = constant(self.single()) or Fraction(0)
                self.take(")")
            if n.denominator != 1 or not 2 <= n <= MAX_POWER:
                raise NoValue("kind of root")
            return root(self.group(), int(n))
        if t in FUNCTIONS:
            n = self.power_of_function()
            value = self.group() if self.peek() in ("(", "{") else self.signed()
            return to_power(unknown(f"{t} {key_of(value)}"), n)
        if len(t) == 1 and (t.isalpha() or t == "π"):
            return unknown(t)
        if re.fullmatch(r"\\[A-Za-z]+", t) and t[1:] in GREEK:
            return unknown(t)
        raise NoValue(f"{t} has no value")

    def power_of_function(self) -> Quotient:
        if self.peek() != "^":
            return whole(1)
        self.take()
        return self.group()

    def parts(self) -> tuple[str, tuple[Quotient, ...]]:
        """The sides of brackets around, if these hold several parts, and the parts."""
        if self.tokens[:1] and self.tokens[0].isalpha() and self.tokens[1:2] == ["="]:
            self.at = 2
        start = self.at
        try:
            out = [self.sum()]
            if self.peek() == "":
                return "", tuple(out)
        except NoValue:
            out = []
        self.at, around = start, ""
        if self.peek() == "(" and self.tokens[-1] == ")":
            around = "()"
            self.take()
            self.tokens.pop()
        out = [self.sum()]
        while self.peek():
            self.take(",")
            out.append(self.sum())
        return around, tuple(out)


#: Letters by name that stand for unknowns.
GREEK = frozenset("alpha beta gamma delta epsilon theta lambda mu nu rho sigma tau phi psi omega infty".split())


@cache
def _power_in_field(a: int, n: int) -> int:
    return pow(a, n, P)


def _times(x: tuple[int, int], y: tuple[int, int]) -> tuple[int, int]:
    return (x[0] * y[0] - x[1] * y[1]) % P, (x[0] * y[1] + x[1] * y[0]) % P


def _place(name: str) -> tuple[int, int]:
    """The point of the field at which an unknown is taken."""
    if name[0] == "√":
        n = int(name[1:]) % P
        # -1 is no square here, so of n and -n one is.
        side = _power_in_field(n, (P + 1) // 4)
        return (side, 0) if side * side % P == n else (0, _power_in_field(P - n, (P + 1) // 4))
    return int.from_bytes(hashlib.sha256(name.encode()).digest()[:16], "big") % P, 0


def _at_points(p: Polynomial) -> tuple[int, int]:
    total = (0, 0)
    for m, c in p.items():
        value = (c.numerator * pow(c.denominator, -1, P) % P, 0)
        for name, k in m:
            place = _place(name)
            for _ in range(k):
                value = _times(value, place)
        total = ((total[0] + value[0]) % P, (total[1] + value[1]) % P)
    return total


def key_of(a: Quotient) -> str:
    (x, y), (u, v) = _at_points(a[0]), _at_points(a[1])
    size = (u * u + v * v) % P
    if not size:
        raise NoValue("division by zero")
    out = _times((x, y), (u * pow(size, -1, P) % P, (P - v) * pow(size, -1, P) % P))
    return f"{out[0]:x}:{out[1]:x}"


#: Results a worker keeps of each function, the latest used: answers repeat, and reading one takes far longer than finding it.
KEPT = 1 << 16


def kept(f):
    """A function of texts that keeps its results. Texts over the limit, which have no value, aren't kept."""
    found = lru_cache(KEPT)(f)

    @wraps(f)
    def of(*texts: str | None):
        return f(*texts) if any(t is not None and len(t) > MAX_LETTERS for t in texts) else found(*texts)

    return of


@kept
def read(text: str | None) -> tuple[str, tuple[Quotient, ...]] | None:
    """The parts of an expression; null for text without a value."""
    if not text:
        return None
    try:
        around, parts = Reader(text).parts()
        return around, parts
    except (ValueError, RecursionError, ZeroDivisionError, OverflowError):
        return None


@kept
def key(text: str | None) -> str | None:
    found = read(text)
    try:
        return None if found is None else found[0][:1] + ", ".join(map(key_of, found[1])) + found[0][1:]
    except ValueError:
        return None


@kept
def same(a: str | None, b: str | None) -> bool | None:
    """Whether two expressions are equal; null if one has no value."""
    x, y = read(a), read(b)
    if x is None or y is None:
        return None
    try:
        return x[0] == y[0] and len(x[1]) == len(y[1]) and all(map(equal, x[1], y[1]))
    except ValueError:
        return None


@kept
def value(text: str | None) -> float | None:
    """The real number an expression without unknowns stands for."""
    found = read(text)
    if found is None or len(found[1]) != 1:
        return None

    def at(p: Polynomial) -> float:
        return math.fsum(float(c) * math.prod(_real(u) ** k for u, k in m) for m, c in p.items())

    try:
        top, bottom = map(at, found[1][0])
        return top / bottom
    except (ValueError, OverflowError, ZeroDivisionError):
        return None


def _real(name: str) -> float:
    if name == "π":
        return math.pi
    if name[0] == "√":
        return math.sqrt(int(name[1:]))
    raise NoValue(f"{name} is no number")


# Columns -------------------------------------------------------------------------------------


@F.pandas_udf(T.StringType())
def key_udf(a: pd.Series) -> pd.Series:
    return pd.Series([key(x) for x in a], dtype=object)


@F.pandas_udf(T.BooleanType())
def same_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([same(x, y) for x, y in zip(a, b, strict=True)], dtype=object)


@F.pandas_udf(T.DoubleType())
def value_udf(a: pd.Series) -> pd.Series:
    return pd.Series([value(x) for x in a], dtype=object)


def value_key(c: Column | str) -> Column:
    """One text for all spellings of a value, to group and join by; other texts stand for themselves, in one LaTeX spelling."""
    x = text_functions.col(c)
    return F.coalesce(F.concat(F.lit("="), key_udf(x)), text_functions.latex(x))


def equal_in_value(a: Column | str, b: Column | str) -> Column:
    """Whether two answers are equal as expressions, or as texts in one LaTeX spelling where one has no value."""
    x, y = text_functions.col(a), text_functions.col(b)
    return F.coalesce(same_udf(x, y), text_functions.latex(x) == text_functions.latex(y))
