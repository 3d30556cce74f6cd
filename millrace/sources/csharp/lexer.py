"""Tokens of C# text. Nothing here raises on odd input: what fits nothing is a one-character token."""

from __future__ import annotations

import re
from bisect import bisect_right
from typing import NamedTuple

_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z)|(?m:^)[ \t]*\#[^\n]*)
    |(?P<str>\"\"\"+.*?\"\"\"+|(?:\$@|@\$|@)"(?:[^"]|"")*"|\$?"(?:\\.|[^"\\\n])*")
    |(?P<chr>'(?:\\.|[^'\\\n])+')
    |(?P<id>@?[^\W\d]\w*)
    |(?P<num>\d[\w.]*)
    |(?P<op>=>|\?\.|\?\?=?|::|&&|\|\||==|!=|<=|>=|\+\+|--|\+=|-=|\*=|/=|->|.)""",
    re.S | re.X,
)


class Token(NamedTuple):
    kind: str
    text: str
    start: int
    end: int
    line: int


class Source:
    """Tokens of a text, with lines counted from 1."""

    def __init__(self, text: str) -> None:
        self.text = text
        self._breaks = [m.start() for m in re.finditer("\n", text)]
        self.tokens: list[Token] = []
        line, at = 1, 0
        for m in _TOKEN.finditer(text):
            if (kind := m.lastgroup) != "skip":
                start, end = m.span()
                line, at = line + text.count("\n", at, start), start
                self.tokens.append(Token(kind, m[0], start, end, line))

    def line(self, offset: int) -> int:
        return bisect_right(self._breaks, offset - 1) + 1

    def slice(self, first: int, last: int) -> str:
        """The text of tokens first..last (inclusive)."""
        return self.text[self.tokens[first].start : self.tokens[last].end] if first <= last else ""


_PAIRS = {"(": ")", "[": "]", "{": "}"}


def closing(tokens: list[Token], i: int, end: int) -> int:
    """Index of the bracket that closes the one at ``i``; ``end - 1`` where none does."""
    want: list[str] = []
    for j in range(i, end):
        t = tokens[j].text
        if tokens[j].kind == "op":
            if t in _PAIRS:
                want.append(_PAIRS[t])
            elif want and t == want[-1]:
                want.pop()
                if not want:
                    return j
            elif t in ")]}" and t in want:  # a bracket was forgotten inside
                while want and want[-1] != t:
                    want.pop()
                want.pop()
                if not want:
                    return j
    return end - 1


def generic_end(tokens: list[Token], i: int, end: int) -> int | None:
    """Index of the '>' that closes a list of type arguments opened at ``i``, or None if it is a comparison."""
    depth = 0
    for j in range(i, end):
        t = tokens[j]
        if t.text == "<":
            depth += 1
        elif t.text == ">":
            depth -= 1
            if depth == 0:
                return j
        elif not (t.kind == "id" or t.text in (",", ".", "?", "[", "]", "::", "(", ")")):
            return None
    return None
