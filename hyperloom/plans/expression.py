"""The expression language: names, ``+``, ``*``, ``^`` and parentheses.

``*`` binds tighter than ``+``, ``^`` tighter than ``*``. A sum is one n-ary node and is normalized
once; a parenthesised sum is a node of its own.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from typing import Protocol, TypeVar

from pyspark.sql import Column
from pyspark.sql import functions as F

T = TypeVar("T")


class ParseError(ValueError):
    """The text is not an expression."""


class InvalidExpressionError(ParseError):
    def __init__(self) -> None:
        super().__init__("Invalid expression")


class UnexpectedTokenError(ParseError):
    def __init__(self, token: str) -> None:
        super().__init__(f"Unexpected token: {token}")


class MismatchedParenthesesError(ParseError):
    def __init__(self) -> None:
        super().__init__("Mismatched parentheses")


class UnknownValueError(KeyError):
    """A name that the evaluation has no value for."""

    def __str__(self) -> str:
        return f"Unknown value: {self.args[0]}"


class Algebra(Protocol[T]):
    """What an evaluation needs to know about its values."""

    def add_many(self, terms: list[T]) -> T: ...
    def multiply(self, left: T, right: T) -> T: ...
    def power(self, base: T, exponent: int) -> T: ...


class Expression:
    """Base of the four nodes. ``+`` flattens sums, ``*`` nests to the left, ``**`` is a power."""

    @staticmethod
    def of(value: object) -> Expression:
        return value if isinstance(value, Expression) else Value(str(value))

    @staticmethod
    def parse(text: str, *, strict: bool = False) -> Expression:
        """Read ``text``. What follows a complete expression is ignored unless ``strict``."""
        return _Reader(text).whole(strict)

    def __add__(self, other: object) -> Expression:
        parts = lambda e: e.terms if isinstance(e, Plus) else (e,)
        return Plus((*parts(self), *parts(Expression.of(other))))

    def __mul__(self, other: object) -> Expression:
        return Mul(self, Expression.of(other))

    def __pow__(self, exponent: int) -> Expression:
        return Pow(self, exponent)

    @property
    def is_value(self) -> bool:
        return isinstance(self, Value)

    def names(self) -> Iterator[str]:
        """Names from left to right, as often as they occur."""
        raise NotImplementedError

    def evaluate(self, lookup: Callable[[str], T | None], algebra: Algebra[T]) -> T:
        """The value of the expression; the first name without a value raises UnknownValueError."""
        raise NotImplementedError

    def column(self, symbols: Mapping[str, Column], algebra: Algebra[Column]) -> Column:
        """One Column expression over the columns that stand for the names."""
        return self.evaluate(symbols.get, algebra)


@dataclass(frozen=True)
class Value(Expression):
    name: str

    def names(self) -> Iterator[str]:
        yield self.name

    def evaluate(self, lookup: Callable[[str], T | None], algebra: Algebra[T]) -> T:
        if (found := lookup(self.name)) is None:
            raise UnknownValueError(self.name)
        return found

    def __str__(self) -> str:
        return self.name


@dataclass(frozen=True, eq=False)
class Plus(Expression):
    terms: tuple[Expression, ...]

    def names(self) -> Iterator[str]:
        for t in self.terms:
            yield from t.names()

    def evaluate(self, lookup: Callable[[str], T | None], algebra: Algebra[T]) -> T:
        return algebra.add_many([t.evaluate(lookup, algebra) for t in self.terms])

    def __str__(self) -> str:
        return f"({' + '.join(map(str, self.terms))})"

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Plus) and Counter(self.terms) == Counter(other.terms)

    def __hash__(self) -> int:
        return hash(("+", frozenset(Counter(self.terms).items())))


@dataclass(frozen=True, eq=False)
class Mul(Expression):
    left: Expression
    right: Expression

    def names(self) -> Iterator[str]:
        yield from self.left.names()
        yield from self.right.names()

    def evaluate(self, lookup: Callable[[str], T | None], algebra: Algebra[T]) -> T:
        return algebra.multiply(self.left.evaluate(lookup, algebra), self.right.evaluate(lookup, algebra))

    def __str__(self) -> str:
        return f"({self.left} * {self.right})"

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Mul) and Counter((self.left, self.right)) == Counter((other.left, other.right))

    def __hash__(self) -> int:
        return hash(("*", frozenset(Counter((self.left, self.right)).items())))


@dataclass(frozen=True)
class Pow(Expression):
    base: Expression
    exponent: int

    def __post_init__(self) -> None:
        if not 0 <= self.exponent < 1 << 32:
            raise ValueError("an exponent is an integer from 0 to 2^32 - 1")

    def names(self) -> Iterator[str]:
        yield from self.base.names()

    def evaluate(self, lookup: Callable[[str], T | None], algebra: Algebra[T]) -> T:
        return algebra.power(self.base.evaluate(lookup, algebra), self.exponent)

    def __str__(self) -> str:
        return f"({self.base} ^ {self.exponent})"


class _Reader:
    """Recursive descent over tokens: operators stand alone, all else between blanks is a name."""

    TOKEN = re.compile(r"[()+*^]|[^\s()+*^]+")

    def __init__(self, text: str) -> None:
        self.tokens = self.TOKEN.findall(text)
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self) -> str:
        if (token := self.peek()) is None:
            raise InvalidExpressionError
        self.at += 1
        return token

    def whole(self, strict: bool) -> Expression:
        found = self.sum()
        if strict and (left := self.peek()) is not None:
            raise UnexpectedTokenError(left)
        return found

    def series(self, operator: str, part: Callable[[], Expression]) -> list[Expression]:
        parts = [part()]
        while self.peek() == operator:
            self.at += 1
            parts.append(part())
        return parts

    def sum(self) -> Expression:
        terms = self.series("+", self.product)
        return terms[0] if len(terms) == 1 else Plus(tuple(terms))

    def product(self) -> Expression:
        first, *others = self.series("*", self.power)
        for other in others:
            first = Mul(first, other)
        return first

    def power(self) -> Expression:
        base = self.primary()
        if self.peek() != "^":
            return base
        self.at += 1
        exponent = self.take()
        if not exponent.isdecimal() or int(exponent) >= 1 << 32:
            raise UnexpectedTokenError(exponent)
        return Pow(base, int(exponent))

    def primary(self) -> Expression:
        token = self.take()
        if token == "(":
            inner = self.sum()
            if self.peek() != ")":
                raise MismatchedParenthesesError
            self.at += 1
            return inner
        if token in ")+*^":
            raise UnexpectedTokenError(token)
        return Value(token)


class NumberAlgebra:
    """Plain arithmetic on Python integers."""

    def add_many(self, terms: list[int]) -> int:
        return sum(terms)

    def multiply(self, left: int, right: int) -> int:
        return left * right

    def power(self, base: int, exponent: int) -> int:
        return base**exponent


class ColumnNumberAlgebra:
    """Integer arithmetic on Columns of Spark type ``kind``; overflow is Spark's ANSI error."""

    def __init__(self, kind: str = "bigint") -> None:
        self.kind = kind

    def add_many(self, terms: list[Column]) -> Column:
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        return total.cast(self.kind)

    def multiply(self, left: Column, right: Column) -> Column:
        return (left * right).cast(self.kind)

    def power(self, base: Column, exponent: int) -> Column:
        """By repeated squaring, so that integers stay exact."""
        out, square = None, base
        while exponent:
            if exponent & 1:
                out = square if out is None else (out * square).cast(self.kind)
            exponent >>= 1
            if exponent:
                square = (square * square).cast(self.kind)
        return F.lit(1).cast(self.kind) if out is None else out.cast(self.kind)
