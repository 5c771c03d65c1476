"""Expression strings: a Python expression over named arrays, turned into columns."""

from __future__ import annotations

import ast
from collections.abc import Callable

BINARY = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.FloorDiv: "//", ast.Mod: "%", ast.Pow: "**", ast.LShift: "<<", ast.RShift: ">>", ast.BitAnd: "&", ast.BitOr: "|", ast.BitXor: "^", ast.MatMult: "@"}
COMPARE = {ast.Eq: "==", ast.NotEq: "!=", ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">="}
UNARY = {ast.USub: "-", ast.UAdd: "+", ast.Invert: "~"}


def evaluate(text: str, names: dict[str, object], binary: Callable, unary: Callable, is_array: Callable[[object], bool]) -> object:
    """Walk the expression; binary and unary are called with an operator symbol where an array takes part.

    Allowed are operators, one comparison, names and constants; `and`, `or`,
    `not`, `is` and `in` for scalars alone. Anything else is a ValueError, an
    unknown name a NameError, an array's truth a TypeError.
    """
    try:
        tree = ast.parse(text, mode="eval").body
    except SyntaxError as e:
        raise ValueError(f"not an expression: {text!r}") from e

    def scalar(value: object) -> object:
        if is_array(value):
            raise TypeError("an array has no single truth value")
        return value

    def walk(node: ast.AST) -> object:
        if isinstance(node, ast.Constant):
            return node.value
        if isinstance(node, ast.Name):
            if node.id not in names:
                raise NameError(f"name {node.id!r} is not defined")
            return names[node.id]
        if isinstance(node, ast.BinOp) and type(node.op) in BINARY:
            return binary(BINARY[type(node.op)], walk(node.left), walk(node.right))
        if isinstance(node, ast.UnaryOp):
            if isinstance(node.op, ast.Not):
                return not scalar(walk(node.operand))
            return unary(UNARY[type(node.op)], walk(node.operand))
        if isinstance(node, ast.BoolOp):
            value: object = None
            for part in node.values:
                value = scalar(walk(part))
                if bool(value) == isinstance(node.op, ast.Or):
                    return value
            return value
        if isinstance(node, ast.Compare):
            if len(node.ops) != 1:
                raise ValueError("chained comparisons are not supported")
            op, a, b = node.ops[0], walk(node.left), walk(node.comparators[0])
            if type(op) in COMPARE:
                return binary(COMPARE[type(op)], a, b)
            a, b = scalar(a), scalar(b)
            return {ast.Is: lambda: a is b, ast.IsNot: lambda: a is not b, ast.In: lambda: a in b, ast.NotIn: lambda: a not in b}[type(op)]()
        raise ValueError(f"unsupported syntax: {type(node).__name__}")

    return walk(tree)
