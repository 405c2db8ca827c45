"""The expression language of schemas: conditions (`flags & 0x01`, `value == 'SIZE'`) and counts
(`(max - min + 1) * count`). One parser; its tree is evaluated in Python or becomes a Column."""

from __future__ import annotations

import operator
import re
from collections.abc import Callable

LEVELS = [["||"], ["&&"], ["|"], ["^"], ["&"], ["===", "!==", "==", "!="], ["<=", ">=", "<", ">"], ["<<", ">>"], ["+", "-"], ["*", "/", "%"]]
TOKEN = re.compile(r"\s*(?:(0[xX][0-9A-Fa-f]+|\d+)n?|'([^']*)'|\"([^\"]*)\"|((?:\.\./)*[A-Za-z_][\w]*(?:\.[A-Za-z_]\w*)*)|(===|!==|<<|>>|&&|\|\||[=!<>]=|[-+*/%&|^!~()<>]))")
COUNT_OPERATORS = set("+-*/()")


class ExprError(ValueError):
    """kind: parse_error, undefined_field, division_by_zero or invalid_operand."""

    def __init__(self, kind: str, text: str):
        super().__init__(f"{kind}: {text}")
        self.kind = kind


def _tokens(text: str) -> list[tuple[str, object]]:
    out, at = [], 0
    while text[at:].strip():
        m = TOKEN.match(text, at)
        if not m:
            raise ExprError("parse_error", f"unexpected {text[at:].strip()[0]!r} in {text!r}")
        number, single, double, name, sign = m.groups()
        if number is not None:
            out.append(("value", int(number, 0 if number[:2].lower() == "0x" else 10)))
        elif single is not None or double is not None:
            out.append(("value", single if single is not None else double))
        elif name is not None:
            out.append(("value", name == "true") if name in ("true", "false") else ("name", name))
        else:
            out.append(("sign", sign))
        at = m.end()
    return out


def parse(text: str, counts: bool = False) -> tuple:
    """The tree of an expression; counts: allow only what a count may use."""
    tokens, at = _tokens(text), 0
    if counts:
        for kind, t in tokens:
            if kind == "sign" and t not in COUNT_OPERATORS or kind == "value" and not isinstance(t, int) or isinstance(t, bool):
                raise ExprError("parse_error", f"{t!r} may not be used in the count {text!r}")

    def peek() -> object:
        return tokens[at][1] if at < len(tokens) and tokens[at][0] == "sign" else None

    def unary() -> tuple:
        nonlocal at
        if at >= len(tokens):
            raise ExprError("parse_error", f"{text!r} ends too early")
        kind, t = tokens[at]
        at += 1
        if kind != "sign":
            return (kind, t)
        if t == "(":
            inner = level(0)
            if peek() != ")":
                raise ExprError("parse_error", f"a parenthesis is open in {text!r}")
            at += 1
            return inner
        if t in ("!", "-", "~") and not counts:
            return ("unary", t, unary())
        raise ExprError("parse_error", f"unexpected {t!r} in {text!r}")

    def level(k: int) -> tuple:
        nonlocal at
        if k == len(LEVELS):
            return unary()
        left = level(k + 1)
        while (sign := peek()) in LEVELS[k]:
            at += 1
            left = ("binary", sign, left, level(k + 1))
        return left

    tree = level(0)
    if at < len(tokens):
        raise ExprError("parse_error", f"unexpected {tokens[at][1]!r} in {text!r}")
    return tree


def names(tree: tuple) -> set[str]:
    if tree[0] == "name":
        return {tree[1]}
    return set().union(*(names(x) for x in tree[1:] if isinstance(x, tuple)))


def _divide(a: int, b: int) -> int:
    if b == 0:
        raise ExprError("division_by_zero", "division by zero")
    q = abs(a) // abs(b)
    return q if (a < 0) == (b < 0) else -q


_SIGNS: dict[str, Callable] = {"|": operator.or_, "^": operator.xor, "&": operator.and_, "==": operator.eq, "===": operator.eq, "!=": operator.ne, "!==": operator.ne, "<=": operator.le, ">=": operator.ge, "<": operator.lt, ">": operator.gt, "<<": operator.lshift, ">>": operator.rshift, "+": operator.add, "-": operator.sub, "*": operator.mul, "/": _divide, "%": lambda a, b: a - b * _divide(a, b)}


def compiled(tree: tuple) -> Callable:
    """A function of a lookup (name -> value) that evaluates the tree."""
    if tree[0] == "value":
        return lambda look: tree[1]
    if tree[0] == "name":
        return lambda look: look(tree[1])
    if tree[0] == "unary":
        inner = compiled(tree[2])
        return {"!": lambda look: not inner(look), "-": lambda look: -inner(look), "~": lambda look: ~inner(look)}[tree[1]]
    sign, a, b = tree[1], compiled(tree[2]), compiled(tree[3])
    if sign == "&&":
        return lambda look: a(look) and b(look)
    if sign == "||":
        return lambda look: a(look) or b(look)
    apply = _SIGNS[sign]

    def run(look: Callable) -> object:
        x, y = a(look), b(look)
        if sign not in ("==", "===", "!=", "!==") and (isinstance(x, str) != isinstance(y, str) or x is None or y is None):
            raise ExprError("invalid_operand", f"{x!r} {sign} {y!r}")
        return apply(x, y)

    return run


def evaluate(text: str, values: dict) -> int:
    """A count over plain values; dotted names go into nested ones."""

    def look(name: str) -> object:
        here: object = values
        for part in name.split("."):
            if not isinstance(here, dict) or part not in here:
                raise ExprError("undefined_field", name)
            here = here[part]
        if isinstance(here, bool) or not isinstance(here, int):
            raise ExprError("invalid_operand", f"{name} is not an integer")
        return here

    return compiled(parse(text, counts=True))(look)


def to_column(tree: tuple, look: Callable):
    """The tree as a Column; look gives the Column of a name. Null where an operand is missing."""
    from pyspark.sql import functions as F

    if tree[0] == "value":
        return F.lit(tree[1])
    if tree[0] == "name":
        return look(tree[1])
    if tree[0] == "unary":
        inner = to_column(tree[2], look)
        return {"!": lambda: ~_truth(inner, tree[2]), "-": lambda: -inner, "~": lambda: F.bitwise_not(inner)}[tree[1]]()
    sign, a, b = tree[1], to_column(tree[2], look), to_column(tree[3], look)
    if sign in ("&&", "||"):
        a, b = _truth(a, tree[2]), _truth(b, tree[3])
        return a & b if sign == "&&" else a | b
    if sign not in ("==", "===", "!=", "!==") or _boolean(tree[2]) != _boolean(tree[3]):
        a, b = (x.cast("long") if _boolean(t) else x for x, t in ((a, tree[2]), (b, tree[3])))
    if sign in ("/", "%"):
        return F.call_function("div", a, b) if sign == "/" else a % b
    own = {"|": lambda: a.bitwiseOR(b), "^": lambda: a.bitwiseXOR(b), "&": lambda: a.bitwiseAND(b), "<<": lambda: F.call_function("shiftleft", a, b), ">>": lambda: F.call_function("shiftright", a, b)}
    return own[sign]() if sign in own else _SIGNS[sign](a, b)


def _boolean(tree: tuple) -> bool:
    return tree[0] == "unary" and tree[1] == "!" or tree[0] == "binary" and tree[1] in ("&&", "||", "==", "===", "!=", "!==", "<", ">", "<=", ">=")


def _truth(column, tree: tuple):
    return column if _boolean(tree) or tree[0] == "value" and isinstance(tree[1], bool) else column != 0


def condition(tree: tuple, look: Callable):
    """The tree as a boolean Column; a missing operand counts as false."""
    from pyspark.sql import functions as F

    return F.coalesce(_truth(to_column(tree, look), tree), F.lit(False))
