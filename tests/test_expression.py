from __future__ import annotations

import pytest

from hyperloom.plans.expression import (
    Expression,
    InvalidExpressionError,
    MismatchedParenthesesError,
    NumberAlgebra,
    Pow,
    UnexpectedTokenError,
    UnknownValueError,
    Value,
)

parse = Expression.parse


#: Texts whose reading must stay as it is elsewhere, among them a trailing parenthesis that is ignored.
PINNED = [
    ("1 + 2 * 3", "(1 + (2 * 3))"),
    ("(( abc + def ) *    ghi) )", "((abc + def) * ghi)"),
    ("x * y ^ 2", "(x * (y ^ 2))"),
]


@pytest.mark.parametrize(
    ("text", "shown"),
    [
        *PINNED,
        ("(low+high)*7", "((low + high) * 7)"),
        ("p*q + r + s*(t + u*v) + w", "((p * q) + r + (s * (t + (u * v))) + w)"),
        ("(north * east) ^ 12", "((north * east) ^ 12)"),
        ("a*b*c", "((a * b) * c)"),
        ("3-MEDIUM+Brand#13", "(3-MEDIUM + Brand#13)"),
        ("a b", "a"),
        ("x ^ 2 ^ 3", "(x ^ 2)"),
    ],
)
def test_display(text, shown):
    assert str(parse(text)) == shown


#: The messages are fixed values: callers of the interface see them.
@pytest.mark.parametrize(
    ("text", "error", "message"),
    [
        ("", InvalidExpressionError, "Invalid expression"),
        ("1 +", InvalidExpressionError, "Invalid expression"),
        ("x ^", InvalidExpressionError, "Invalid expression"),
        ("1 * (2 + 3", MismatchedParenthesesError, "Mismatched parentheses"),
        ("(a b)", MismatchedParenthesesError, "Mismatched parentheses"),
        ("1 + * 2", UnexpectedTokenError, r"Unexpected token: \*"),
        ("x ^ y", UnexpectedTokenError, "Unexpected token: y"),
        ("x ^ -1", UnexpectedTokenError, "Unexpected token: -1"),
        ("x ^ 4294967296", UnexpectedTokenError, "Unexpected token"),
    ],
)
def test_errors(text, error, message):
    with pytest.raises(error, match=message):
        parse(text)


def test_strict():
    with pytest.raises(UnexpectedTokenError):
        parse("a b", strict=True)


def test_equality():
    assert parse("a + b + c") == parse("c + a + b") and hash(parse("a + b")) == hash(parse("b + a"))
    assert parse("a * b") == parse("b * a") and hash(parse("a * b")) == hash(parse("b * a"))
    assert parse("a + a + b") != parse("a + b + b") and parse("(a + b) + c") != parse("a + b + c")
    assert parse("a ^ 2") != parse("a ^ 3")


def test_builders():
    a, b, c = map(Value, "abc")
    assert (a + b) + c == parse("a + b + c") and str(a + (b + c)) == "(a + b + c)"
    assert str((a + b) * c) == "((a + b) * c)" and a.is_value and not (a * b).is_value
    assert str(a**2 * "d") == "((a ^ 2) * d)"
    with pytest.raises(ValueError):
        Pow(a, -1)


def test_evaluation():
    value = lambda text: parse(text).evaluate({"x": 2, "y": 3}.get, NumberAlgebra())
    assert (value("x + y * x"), value("(x + y) ^ 3"), value("x ^ 0")) == (8, 125, 1)
    with pytest.raises(UnknownValueError, match="z"):
        value("x + z * w")
