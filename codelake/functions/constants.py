"""Integer expressions, enums and defines of C text.

Expressions on their own are evaluated by Spark's functions. Enums and defines are
short Arrow helpers: a member may refer to any earlier one, so a text's names
are worked out in order. Each takes one file's text and leaves rows to Spark.
"""

from __future__ import annotations

import ast
import operator
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_BINARY = {
    ast.BitOr: operator.or_, ast.BitAnd: operator.and_, ast.BitXor: operator.xor, ast.LShift: operator.lshift, ast.RShift: operator.rshift,
    ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.floordiv, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod,
}
_UNARY = {ast.USub: operator.neg, ast.UAdd: operator.pos, ast.Invert: operator.invert}
#: The shift of each packed parameter.
SLOT_SHIFTS = {"BPARAM1": 24, "BPARAM2": 16, "BPARAM3": 8, "BPARAM4": 0}


def evaluate(expression: str, names: dict[str, int] | None = None) -> int | None:
    """The integer an expression comes to; / floors. Null for anything that is not plain integer arithmetic."""

    def value(node: ast.AST) -> int:
        match node:
            case ast.Constant(value=int() as number) if not isinstance(number, bool):
                return number
            case ast.Name(id=name):
                return (names or {})[name]
            case ast.UnaryOp(op=op, operand=x):
                return _UNARY[type(op)](value(x))
            case ast.BinOp(left=x, op=op, right=y):
                return _BINARY[type(op)](value(x), value(y))
            case ast.Call(func=ast.Name(id=name), args=[x], keywords=[]):
                return (value(x) & 0xFF) << SLOT_SHIFTS[name]
        raise KeyError(type(node))

    try:
        found = value(ast.parse(expression.strip(), mode="eval").body)
    except (SyntaxError, KeyError, ValueError, ArithmeticError, RecursionError, MemoryError):
        return None
    return found if -(2**63) <= found < 2**63 else None


def _bare(text: str) -> str:
    return re.sub(r"/\*.*?\*/|//[^\n]*", " ", text, flags=re.S)


def enum_members(text: str, enum: str) -> list[tuple[str, int]]:
    body = re.search(rf"\benum\s+{re.escape(enum)}\b[^{{;]*\{{([^}}]*)", _bare(text))
    found: dict[str, int] = {}
    following = 0
    for member in body[1].split(",") if body else ():
        name, _, given = (part.strip() for part in member.partition("="))
        if not re.fullmatch(r"[A-Za-z_]\w*", name):
            continue
        number = evaluate(given, found) if given else following
        number = following if number is None else number
        found[name], following = number, number + 1
    return list(found.items())


def define_values(text: str) -> list[tuple[str, int]]:
    found: dict[str, int] = {}
    for name, given in re.findall(r"(?m)^[ \t]*#[ \t]*define[ \t]+([A-Za-z_]\w*)[ \t]+(\S[^\n]*)$", _bare(re.sub(r"\\[ \t]*\n", " ", text))):
        number = evaluate(given, found)
        if number is not None:
            found[name] = number
    return list(found.items())


_NAMED = "array<struct<name:string,value:bigint>>"


#: How closely binary operators bind; unary ones bind closer than all.
_BINDS = {"|": 1, "^": 2, "&": 3, "<<": 4, ">>": 4, "+": 5, "-": 5, "*": 6, "/": 6, "//": 6, "%": 6}
_TOKEN = rf"(?:0[xX][0-9a-fA-F]++(?!\w)|(?:0++|[1-9][0-9]*+)(?!\w)|(?:{'|'.join(SLOT_SHIFTS)})\s*\(|<<|>>|//|[-+*/%&|^~()])"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _shifted(x: Column, n: Column) -> Column:
    """x << n, null where bits are lost."""
    out = F.call_function("shiftleft", x, n.cast("int"))
    return F.when(x == 0, 0).when((n <= 62) & (F.call_function("shiftright", out, n.cast("int")) == x), out)


def _applied(op: Column, x: Column, y: Column) -> Column:
    """The value of a binary operator; null where there is none or where it doesn't fit a long."""
    # Division floors: the remainder has the divisor's sign.
    least = F.pmod(x, F.abs(y))
    remainder = F.when((y < 0) & (least > 0), least + y).otherwise(least)
    quotient = F.try_divide((x.cast("decimal(20,0)") - remainder), y.cast("decimal(20,0)")).try_cast("bigint")
    right = F.call_function("shiftright", x, F.least(y, F.lit(63)).cast("int"))
    out = F.when(op == "|", x.bitwiseOR(y)).when(op == "^", x.bitwiseXOR(y)).when(op == "&", x.bitwiseAND(y))
    out = out.when(op == "+", F.try_add(x, y)).when(op == "-", F.try_subtract(x, y)).when(op == "*", F.try_multiply(x, y))
    out = out.when(op.isin("<<", ">>") & (y < 0), None).when(op == "<<", _shifted(x, y)).when(op == ">>", right)
    return out.when(y == 0, None).when(op == "%", remainder).otherwise(quotient)


def _stacks(values: Column, ops: Column, operand: Column, bad: Column) -> Column:
    return F.struct(values.alias("values"), ops.alias("ops"), operand.alias("operand"), F.coalesce(bad, F.lit(True)).alias("bad"))


def _top(stack: Column, below: int = 0) -> Column:
    return F.get(stack, F.size(stack) - 1 - below)


def _popped(stack: Column, n: int = 1) -> Column:
    return F.slice(stack, F.lit(1), F.greatest(F.size(stack) - n, F.lit(0)))


def int_value(expression: Column) -> Column:
    """What `evaluate` gives without names, by Spark's own functions: operands and operators wait on two stacks.

    Values on the way are longs here; where one doesn't fit, the result is null.
    """
    none = F.array().cast("array<string>")
    start = _stacks(F.array().cast("array<bigint>"), none, F.lit(True), F.lit(False))
    binds = lambda op: reduce(lambda out, k: out.when(op == k, _BINDS[k]), _BINDS, F.when(op.startswith("u"), 9)).otherwise(0)

    def reduced(acc: Column, _: Column, least: Column) -> Column:
        """Applies the last operator if it binds as closely as `least`."""
        last = F.struct(_top(acc["ops"]).alias("op"), _top(acc["values"]).alias("y"), _top(acc["values"], 1).alias("x"))

        def value(k: Column) -> Column:
            one = F.when(k["op"] == "u-", F.try_subtract(F.lit(0).cast("bigint"), k["y"])).when(k["op"] == "u~", F.bitwise_not(k["y"])).when(k["op"] == "u+", k["y"])
            return F.when(k["op"].startswith("u"), one).otherwise(_applied(k["op"], k["x"], k["y"]))

        def put(new: Column) -> Column:
            rest = F.when(_top(acc["ops"]).startswith("u"), _popped(acc["values"])).otherwise(_popped(acc["values"], 2))
            return _stacks(F.concat(rest, F.array(new)), _popped(acc["ops"]), acc["operand"], new.isNull())

        waits = ~acc["bad"] & (F.size(acc["ops"]) > 0) & (binds(_top(acc["ops"])) >= least)
        return F.when(waits, _let(_let(last, value), put)).otherwise(acc)

    def step(acc: Column, token: Column) -> Column:
        # Brackets and the end apply all that waits, down to the opening bracket, which binds nothing.
        least = F.when(token.isin(*_BINDS) & ~acc["operand"], binds(token)).when(token.isin(")", ";"), 1)
        applied = F.aggregate(F.sequence(F.lit(0), F.size(acc["ops"])), acc, lambda a, i: reduced(a, i, least))
        return _let(F.when(least.isNull(), acc).otherwise(applied), lambda a: taken(a, token))

    def taken(acc: Column, token: Column) -> Column:
        values, ops, bad, operand = acc["values"], acc["ops"], acc["bad"], acc["operand"]
        binary = token.isin(*_BINDS) & ~operand
        push = lambda op: F.concat(ops, F.array(op))
        opened = _top(ops)
        shift = reduce(lambda out, k: out.when(opened.startswith(k), _shifted(_top(values).bitwiseAND(F.lit(0xFF)), F.lit(SLOT_SHIFTS[k]))), SLOT_SHIFTS, F.when(opened == "(", _top(values)))
        closed = F.concat(_popped(values), F.array(shift))
        number = token.rlike("^[0-9]")
        return (
            F.when(bad, acc)
            .when(number, _stacks(F.concat(values, F.array(int_token(token))), ops, F.lit(False), ~operand | int_token(token).isNull()))
            .when(F.endswith(token, F.lit("(")), _stacks(values, push(token), F.lit(True), ~operand))
            .when(binary, _stacks(values, push(token), F.lit(True), F.lit(False)))
            .when(token.isin("+", "-", "~") & operand, _stacks(values, push(F.concat(F.lit("u"), token)), F.lit(True), F.lit(False)))
            .when(token == ")", _stacks(closed, _popped(ops), F.lit(False), operand | shift.isNull()))
            .when(token == ";", _stacks(values, ops, operand, operand | (F.size(ops) > 0)))
            .otherwise(_stacks(values, ops, operand, F.lit(True)))
        )

    tokens = F.concat(F.regexp_extract_all(expression, F.lit(f"({_TOKEN})"), 1), F.array(F.lit(";")))
    found = F.aggregate(tokens, start, step, lambda acc: F.when(~acc["bad"], _top(acc["values"])))
    # A plain number, as most are, needs no stacks.
    return F.when(F.trim(expression).rlike(r"^(?:0|[1-9][0-9]*|0[xX][0-9a-fA-F]+)$"), int_token(F.trim(expression))).when(expression.rlike(rf"^(?:\s*{_TOKEN})++\s*$"), found)


def enum_of(text: Column, enum: str) -> Column:
    """array of (name, value), in order."""
    return F.udf(lambda x: enum_members(x or "", enum), _NAMED, useArrow=True)(text)


def defines_of(text: Column) -> Column:
    """array of (name, value) of the defines that come to an integer, in order."""
    return F.udf(lambda x: define_values(x or ""), _NAMED, useArrow=True)(text)


def int_token(token: Column) -> Column:
    """A decimal or hexadecimal number as written, else null."""
    digits = F.regexp_extract(token, r"^-?0[xX]([0-9a-fA-F]+)$", 1)
    hexadecimal = F.conv(F.when(digits != "", digits), 16, 10).try_cast("bigint") * F.when(token.startswith("-"), -1).otherwise(1)
    return F.coalesce(hexadecimal, token.try_cast("bigint"))


def packed(expression: Column) -> Column:
    """(raw, value, slots): the text with single blanks, its number if it has one, and what stands in each of four slots."""
    squeezed = F.trim(F.regexp_replace(expression, r"\s+", " "))
    raw = F.when(squeezed == "", "0").otherwise(squeezed)
    slots = [F.regexp_extract(raw, rf"\b{name}\(((?:[^()]|\([^()]*\))*)\)", 1) for name in SLOT_SHIFTS]
    return F.struct(raw.alias("raw"), int_value(raw).alias("value"), F.array(*(F.when(s != "", F.trim(s)) for s in slots)).alias("slots"))
