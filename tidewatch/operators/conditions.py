"""Rule conditions inside stateful tasks, where there is no Column to evaluate.

The same texts as `rules.rule_condition` takes, and the same three-valued results: a missing value makes comparisons and arithmetic null,
`==` and `!=` are null-safe, division by zero is null, and a null condition does not hold. The words are Python's own, so its parser reads them.
"""

from __future__ import annotations

import ast
import math
import re
from collections.abc import Callable, Mapping
from typing import Any

_QUOTED = r"'[^']*'|\"[^\"]*\""
_WORDS = {"null": "None", "true": "True", "false": "False"}
_SIGNS = {"<=>": "==", "=": "=="}


def _python_text(condition: str) -> str:
    out = []
    for token in re.findall(rf"{_QUOTED}|[\w.]+|<=>|[<>=!]=|[^\s]", condition):
        word = token.lower()
        if word in ("and", "or", "not", "in", "is"):
            token = word
        out.append(_WORDS.get(word, _SIGNS.get(token, token)))
    return " ".join(out)


def _alike(a: Any, b: Any) -> tuple[Any, Any]:
    """Text beside a number is read as one; what is no number is null."""
    if isinstance(a, str) != isinstance(b, str) and a is not None and b is not None:
        try:
            return (float(a), b) if isinstance(a, str) else (a, float(b))
        except ValueError:
            return None, None
    return a, b


def _number(a: Any) -> Any:
    if isinstance(a, str):
        try:
            return float(a)
        except ValueError:
            return None
    return a


def _arithmetic(op: ast.operator, a: Any, b: Any) -> Any:
    a, b = _number(a), _number(b)
    if a is None or b is None:
        return None
    match op:
        case ast.Add():
            return a + b
        case ast.Sub():
            return a - b
        case ast.Mult():
            return a * b
        case ast.Div():
            return a / b if b else None
        case ast.Mod():
            if not b:
                return None
            return math.fmod(a, b) if isinstance(a, float) or isinstance(b, float) else a - b * int(a / b)
    raise ValueError(f"not usable in a condition: {type(op).__name__}")


def _compared(op: ast.cmpop, a: Any, b: Any) -> bool | None:
    match op:
        case ast.In() | ast.NotIn():
            items = b if isinstance(b, tuple) else (b,)
            if a is None:
                return None
            found = True if any(_compared(ast.Eq(), a, x) for x in items if x is not None) else None if None in items else False
            return found if isinstance(op, ast.In) or found is None else not found
        case ast.Is():
            return a is b
        case ast.IsNot():
            return a is not b
    a, b = _alike(a, b)
    if isinstance(op, ast.Eq | ast.NotEq):
        return (a == b) == isinstance(op, ast.Eq)
    if a is None or b is None:
        return None
    match op:
        case ast.Lt():
            return a < b
        case ast.LtE():
            return a <= b
        case ast.Gt():
            return a > b
        case ast.GtE():
            return a >= b
    raise ValueError(f"not usable in a condition: {type(op).__name__}")


_CALLS = {
    "try_divide": lambda a, b: _arithmetic(ast.Div(), a, b),
    "try_mod": lambda a, b: _arithmetic(ast.Mod(), a, b),
    "contains": lambda a, b: None if a is None or b is None else str(b) in str(a),
}


def _value(node: ast.expr, names: Mapping[str, Any]) -> Any:
    match node:
        case ast.Constant(value):
            return value
        case ast.Name(name):
            return names[name]
        case ast.Tuple(items) | ast.List(items):
            return tuple(_value(x, names) for x in items)
        case ast.BoolOp(op, parts):
            stop = isinstance(op, ast.Or)
            seen = [_value(x, names) for x in parts]
            return stop if any(x is stop for x in seen) else None if None in seen else not stop
        case ast.UnaryOp(ast.Not(), part):
            inner = _value(part, names)
            return None if inner is None else not inner
        case ast.UnaryOp(ast.USub(), part):
            inner = _number(_value(part, names))
            return None if inner is None else -inner
        case ast.BinOp(left, op, right):
            return _arithmetic(op, _value(left, names), _value(right, names))
        case ast.Compare(left, ops, rights):
            out = _value(left, names)
            for op, right in zip(ops, rights, strict=True):
                out = _compared(op, out, _value(right, names))
            return out
        case ast.Call(ast.Name(name), args) if name in _CALLS:
            return _CALLS[name](*(_value(x, names) for x in args))
    raise ValueError(f"not usable in a condition: {ast.dump(node)}")


def condition_test(condition: str) -> tuple[Callable[[Mapping[str, Any]], bool], set[str]]:
    """The condition as a test of named values, and the names it reads. An empty condition holds."""
    if not (condition or "").strip():
        return lambda names: True, set()
    tree = ast.parse(_python_text(condition), mode="eval").body
    used = {n.id for n in ast.walk(tree) if isinstance(n, ast.Name)} - set(_CALLS)
    return lambda names: _value(tree, names) is True, used
