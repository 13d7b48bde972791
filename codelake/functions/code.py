"""Functions, their calls and the tables of a C file, found by a tolerant scan.

A helper for one file's text: it only says what stands where. Who reaches what,
and whose it is, are joins in codelake.operators.mining.
"""

from __future__ import annotations

import bisect
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r'/\*.*?\*/|//[^\n]*|"(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)*\'|^[ \t]*#(?:[^\n\\]|\\.)*|[A-Za-z_]\w*|\d[\w.]*|->|[^\sA-Za-z_]', re.S | re.M)
_NOT_CALLED = {"if", "for", "while", "switch", "return", "sizeof", "do", "else", "case", "void", "int", "char", "float", "double", "long", "short", "unsigned", "signed"}
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}

FUNCTION = (
    "struct<name:string,line:int,params:array<string>,calls:array<struct<seq:int,call:string,args:array<string>,line:int,condition:string,cases:array<string>>>,"
    "returns:array<struct<value:string,conditions:array<string>>>,switch:array<struct<label:string,empty:boolean,handler:string>>,words:array<string>>"
)
TABLE = "struct<name:string,rows:array<struct<model:string,behavior:string,function:string>>>"


class _Code:
    """Tokens without comments and directives, and for every bracket its partner."""

    def __init__(self, text: str):
        kept = [m for m in _TOKEN.finditer(text) if not m[0].startswith(("/*", "//")) and not m[0].lstrip().startswith("#")]
        self.text, self.word, self.at = text, [m[0] for m in kept], [m.span() for m in kept]
        self.ends = [m.start() for m in re.finditer("\n", text)]
        self.partner: dict[int, int] = {}
        opened: list[int] = []
        for i, w in enumerate(self.word):
            if w in _OPEN:
                opened.append(i)
            elif w in _CLOSE:
                while opened and _OPEN[self.word[opened[-1]]] != w:
                    opened.pop()  # a bracket that nothing closes
                if opened:
                    self.partner[opened.pop()] = i

    def line(self, i: int) -> int:
        return bisect.bisect_left(self.ends, self.at[i][0]) + 1

    def source(self, start: int, end: int) -> str:
        """The text of tokens start to end (exclusive), without comments, blanks squeezed."""
        if start >= end:
            return ""
        raw = self.text[self.at[start][0] : self.at[end - 1][1]]
        return " ".join(re.sub(r"/\*.*?\*/|//[^\n]*", " ", raw, flags=re.S).split())

    def parts(self, start: int) -> list[tuple[int, int]]:
        """Token ranges between the commas inside the bracket at start."""
        end, found, begin, i = self.partner[start], [], start + 1, start + 1
        while i < end:
            if self.word[i] == ",":
                found.append((begin, i))
                begin = i + 1
            i = self.partner.get(i, i) + 1
        return [*found, (begin, end)] if end > begin else found


def _statement_end(code: _Code, i: int, stop: int) -> int:
    """The token after the statement that begins at i."""
    if i >= stop:
        return stop
    if code.word[i] == "{":
        return code.partner.get(i, stop) + 1
    if code.word[i] in ("if", "for", "while", "switch") and i + 1 in code.partner:
        after = _statement_end(code, code.partner[i + 1] + 1, stop)
        if code.word[i] == "if" and after < stop and code.word[after] == "else":
            return _statement_end(code, after + 1, stop)
        return after
    while i < stop and code.word[i] != ";":
        i = code.partner.get(i, i) + 1
    return min(i + 1, stop)


def _guards(code: _Code, start: int, stop: int) -> list[tuple[int, int, str, bool]]:
    """(from, to, condition, met) of every arm of every if; a condition guards itself too."""
    found = []
    for i in range(start, stop):
        if code.word[i] != "if" or i + 1 not in code.partner:
            continue
        close = code.partner[i + 1]
        condition, then = code.source(i + 2, close), _statement_end(code, close + 1, stop)
        found.append((i, then, condition, True))
        if then < stop and code.word[then] == "else":
            found.append((then, _statement_end(code, then + 1, stop), condition, False))
    return found


def _cases(code: _Code, start: int, stop: int) -> list[list[tuple[int, int, str | None]]]:
    """For every switch its (from, to, label), from the token after the colon; default has no label."""
    found = []
    for i in range(start, stop):
        body = code.partner.get(i + 1, stop) + 1
        if code.word[i] != "switch" or body >= stop or code.word[body] != "{":
            continue
        end, marks, k = code.partner.get(body, stop), [], body + 1
        while k < end:
            if code.word[k] in ("case", "default"):
                colon = next((c for c in range(k, end) if code.word[c] == ":"), end)
                marks.append((k, colon + 1, code.source(k + 1, colon) if code.word[k] == "case" else None))
                k = colon
            k = code.partner.get(k, k) + 1
        found.append([(begin, following[0], label) for (_, begin, label), following in zip(marks, [*marks[1:], (end,)], strict=True)])
    return found


def functions(text: str) -> list[tuple]:
    """Definitions in order, each with its calls, outer ones before those in their arguments."""
    code, found, i = _Code(text), [], 0
    while i < len(code.word):
        close = code.partner.get(i)
        if code.word[i] == "(" and close is not None and i and code.word[close + 1 : close + 2] == ["{"] and re.match(r"[A-Za-z_]", code.word[i - 1]) and close + 1 in code.partner:
            names = (code.word[begin:end] for begin, end in code.parts(i))
            params = [next((w for w in reversed(p) if re.match(r"[A-Za-z_]", w)), None) if len(p) > 1 else None for p in names]
            start, stop = close + 2, code.partner[close + 1]
            guards, switches, calls, returns = _guards(code, start, stop), _cases(code, start, stop), [], []
            called: list[tuple[int, str]] = []
            for k in range(start, stop - 1):
                if code.word[k + 1] == "(" and k + 1 in code.partner and re.match(r"[A-Za-z_]", code.word[k]) and code.word[k] not in _NOT_CALLED and code.word[k - 1] not in (".", "->"):
                    near = max((g for g in guards if g[0] <= k < g[1]), key=lambda g: g[0], default=None)
                    condition = near and (near[2] if near[3] else f"!({near[2]})")
                    cases = [label for cs in switches for begin, end, label in cs if begin <= k < end and label]
                    calls.append((len(calls), code.word[k], [code.source(*p) for p in code.parts(k + 1)], code.line(k), condition, cases))
                    called.append((k, code.word[k]))
                elif code.word[k] == "return":
                    around = sorted((g for g in guards if g[0] <= k < g[1]), reverse=True)
                    returns.append((code.source(k + 1, _statement_end(code, k, stop) - 1), [g[2] for g in around]))
            switch = [(label, begin == end, next((w for k, w in called if begin <= k < end and w.startswith("act_")), None)) for begin, end, label in (switches[0] if switches else ())]
            found.append((code.word[i - 1], code.line(i - 1), params, calls, returns, switch, sorted({w for w in code.word[start:stop] if re.match(r"[A-Za-z_]", w)})))
            i = stop + 1
        elif code.word[i] in ("{", "(", "[") and close is not None:
            i = close + 1
        else:
            i += 1
    return found


def tables(text: str) -> list[tuple]:
    """Arrays that name behaviours or functions: a row of braces pairs its first model with its first behaviour."""
    code, found = _Code(text), []
    for i in range(2, len(code.word) - 1):
        if code.word[i] != "=" or code.word[i + 1] != "{" or code.word[i - 1] not in ("]", ")") or i + 1 not in code.partner:
            continue
        back = i - 1
        while back >= 0 and code.word[back] not in (";", "{", "}"):
            back -= 1
        declared = code.word[back + 1 : i]
        name = next((w for w, following in zip(declared, declared[1:], strict=False) if following == "[" and re.match(r"[A-Za-z_]", w)), None)
        if name is None:
            continue
        rows = []
        for begin, end in code.parts(i + 1):
            words = code.word[begin:end]
            behavior = next((w for w in words if re.match(r"bhv[A-Z0-9]\w*$", w)), None)
            model = next((w for w in words if w.startswith("MODEL_")), None) if "{" in words else None
            function = words[0] if len(words) == 1 and re.match(r"[a-z_]\w*$", words[0]) and behavior is None else None
            if behavior or function:
                rows.append((model if behavior else None, behavior, function))
        if rows:
            found.append((name, rows))
    return found


def functions_of(text: Column) -> Column:
    return F.udf(lambda x: functions(x or ""), f"array<{FUNCTION}>", useArrow=True)(text)


def tables_of(text: Column) -> Column:
    return F.udf(lambda x: tables(x or ""), f"array<{TABLE}>", useArrow=True)(text)
