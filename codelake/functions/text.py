"""Lexing of source text with Spark's own functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


# A string of C, which ends on its line, or a character. All loops are possessive: they neither go back nor call themselves, so time and
# stack stay in bounds on lines of any length.
_QUOTED = r"""(?:"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\[^\n][0-9a-fA-F]*+)')"""
#: How deep brackets may lie in one another.
DEEPEST = 16


def _within(opening: str, closing: str, brackets: str) -> str:
    """A pattern of what may stand between two brackets of these kinds."""
    inner = f"(?:{_QUOTED}|[^{brackets}\"']++|[\"'])*+"
    for _ in range(DEEPEST):
        inner = f"(?:{_QUOTED}|[^{brackets}\"']++|[\"']|[{opening}]{inner}[{closing}])*+"
    return inner


def without_block_comments(text: Column) -> Column:
    """Strings and line comments may hold what looks like a block comment."""
    return F.regexp_replace(text, rf"(?s)({_QUOTED}|//[^\n]*+)|/\*.*?\*/", "$1")


def without_comments(text: Column) -> Column:
    """A line without comments; strings may hold what looks like one."""
    return F.trim(F.regexp_replace(text, rf"(?s)({_QUOTED})|/\*.*?\*/|//.*", "$1"))


#: Stands behind the text while it is split.
_END = "\0"


def split_top_level(text: Column, separator: str = ",") -> Column:
    """The pieces between separators outside of strings and of any (), [] or {}, whose kinds aren't told apart.

    A closing bracket without an opening one is an ordinary character; from an
    opening one that is never closed on, nothing is split.
    """
    brackets, end = r"()\[\]{}", r"\x00"
    sep = re.escape(separator)
    group = rf"[(\[{{]{_within(r'(\[{', r')\]}', brackets + end)}[)\]}}]"
    piece = rf"(?:{_QUOTED}|[^{brackets}\"'{sep}{end}]++|{group}|[\"')\]}}]|[(\[{{][^{end}]*+)*+"
    return F.regexp_extract_all(F.concat(text, F.lit(_END)), F.lit(rf"(?s)({piece})(?:{sep}|{end})"), 1)


def call_of(line: Column) -> Column:
    """(name, args) of a call that a line starts with, else null; no arguments give an empty array."""
    bare = without_comments(line)
    pattern = rf"^\s*([A-Za-z_]\w*)\s*\(({_within('(', ')', '()')})\)"
    body = F.trim(F.regexp_extract(bare, pattern, 2))
    args = F.when(body == "", F.array().cast("array<string>")).otherwise(F.transform(split_top_level(body), lambda a: F.trim(a)))
    return F.when(bare.rlike(pattern), F.struct(F.regexp_extract(bare, pattern, 1).alias("name"), args.alias("args")))


def macro_args(line: Column, name: str) -> Column:
    """The arguments of the macro `name` that a line starts with, else null; none give one empty argument."""
    call = call_of(line)
    found = F.when(F.size(call["args"]) == 0, F.array(F.lit(""))).otherwise(call["args"])
    return F.when(call["name"] == name, found)


def acts(mask: Column) -> Column:
    """Six booleans: in which acts an object stands, from ALL_ACTS or ACT_1 | ACT_2 ..."""
    named = F.transform(F.split(mask, r"\|"), lambda x: F.trim(x))
    return F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: (F.trim(mask) == "ALL_ACTS") | F.array_contains(named, F.concat(F.lit("ACT_"), i.cast("string"))))


def snippet(text: Column, length: int = 70) -> Column:
    return F.substring(F.regexp_replace(text, r"\s+", " "), 1, length)


def hex_of(value: Column, digits: int = 8) -> Column:
    return F.concat(F.lit("0x"), F.lpad(F.hex(value), digits, "0"))


def json_list(items: Column) -> Column:
    """["a", "b"] with a blank after each comma."""
    quoted = F.transform(items, lambda x: F.concat(F.lit('"'), F.regexp_replace(x, r'([\\"])', r"\\$1"), F.lit('"')))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def c_string(expression: Column, macros: Column | None = None) -> Column:
    """Adjacent literals and macros joined; macros is an array of (name, value), of which the last of a name counts. An unknown name is empty."""

    def literal(token: Column) -> Column:
        body = F.substring(token, F.lit(2), F.length(token) - 2)
        marks = {r"\n": "\n", r"\t": "\t", "\\\n": ""}

        def plain(part: Column) -> Column:
            out = F.when(part.startswith("\\"), F.substring(part, 2, 1)).otherwise(part)
            for mark, meant in marks.items():
                out = F.when(part == mark, F.lit(meant)).otherwise(out)
            return out

        return F.array_join(F.transform(F.regexp_extract_all(body, F.lit(r"(?s)(\\.|[^\\]+)"), 1), plain), "")

    def name(token: Column) -> Column:
        if macros is None:
            return F.lit("")
        return F.coalesce(F.try_element_at(F.filter(macros, lambda m: m["name"] == token), F.lit(-1))["value"], F.lit(""))

    tokens = F.regexp_extract_all(expression, F.lit(r'(?s)("(?:[^"\\]++|\\.)*+"|[A-Za-z_]\w*)'), 1)
    return F.array_join(F.transform(tokens, lambda t: F.when(t.startswith('"'), literal(t)).otherwise(name(t))), "")
