"""Declarations, statements and calls of one C# file, as plain records.

The parser follows brackets and a few keywords; what it does not know it steps over to the next ';' or balanced '}', so
every text gives a result. Comments are no statements.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from .lexer import Source, closing, generic_end

# Keywords of the language.
MODIFIERS = set("public private protected internal static abstract sealed virtual override readonly async partial extern unsafe new const volatile required file ref event implicit explicit fixed".split())
TYPE_WORDS = {"class", "struct", "interface", "record", "enum"}
NO_CALL = set("if while for foreach switch catch using lock fixed return typeof sizeof default checked unchecked when await throw in is as else do new out ref case yield var and or not goto stackalloc".split())
PARAMETER_WORDS = {"this", "ref", "out", "in", "params", "scoped", "readonly"}


@dataclass
class Attribute:
    name: str
    argument: str | None


@dataclass
class Method:
    owner: str
    name: str
    ret: str
    params: list[str]
    signature: str
    flags: set[str]
    attributes: list[Attribute]
    start: int
    end: int
    body: tuple[int, int] | None  # tokens of the block, braces included
    rest: tuple[int, int]  # tokens that may hold calls: body or expression
    constructor: bool
    order: int = 0


@dataclass
class Field:
    owner: str
    name: str
    type: str
    flags: set[str]


@dataclass
class Type:
    name: str
    kind: str
    bases: list[str]
    flags: set[str]
    attributes: list[Attribute]
    outer: Type | None
    start: int
    end: int
    methods: list[Method] = field(default_factory=list)
    fields: list[Field] = field(default_factory=list)
    types: list[Type] = field(default_factory=list)
    tokens: tuple[int, int] = (0, 0)


@dataclass
class Call:
    caller_class: str
    caller_method: str
    callee: str
    target: str
    line: int
    arguments: list[str]
    literals: list[str | None]
    first: int
    last: int


@dataclass
class Statement:
    """kind is the keyword or 'block', 'simple', 'local_function', 'label', 'pattern'; parts depend on it."""

    kind: str
    start: int
    end: int
    parts: dict = field(default_factory=dict)
    span: tuple[int, int] = (0, -1)
    head: tuple[int, int] = (0, -1)
    step: tuple[int, int] = (0, -1)


def literal(text: str) -> str | None:
    """The value of a plain string literal, else None."""
    return text[1:-1] if len(text) >= 2 and text[0] == '"' and text[-1] == '"' and not text.startswith('"""') else None


class File:
    """All facts of one file."""

    def __init__(self, text: str) -> None:
        self.source = Source(text)
        self.tokens = self.source.tokens
        self.types: list[Type] = []
        self.methods: list[Method] = []  # in the order they appear
        self.creations: list[tuple[str, str]] = []
        self.calls: list[Call] = []
        self._members(0, len(self.tokens), None)
        for m in self.methods:
            if m.owner:
                self._scan(m)

    # declarations

    def _members(self, i: int, end: int, owner: Type | None) -> None:
        t = self.tokens
        while i < end:
            before = i
            attributes, i = self._attributes(i, end)
            first = before
            flags: set[str] = set()
            while i < end and t[i].text in MODIFIERS and not (t[i].text in ("file", "required", "record", "partial") and i + 1 < end and t[i + 1].text in ("(", "=", ";")):
                flags.add(t[i].text)
                i += 1
            if i >= end:
                break
            word = t[i].text
            if word == "namespace":
                j = self._until(i, end, ("{", ";"))
                if j < end and t[j].text == "{":
                    close = closing(t, j, end)
                    self._members(j + 1, close, owner)
                    i = close + 1
                else:
                    i = j + 1
            elif word == "using" and owner is None or word in ("extern", "delegate"):
                i = self._until(i, end, (";",)) + 1
            elif word in TYPE_WORDS and i + 1 < end and t[i + 1].kind == "id":
                i = self._type(i, end, owner, flags, attributes, first)
            elif word in ("}", ";", ")", "]", ","):
                i += 1
            else:
                i = self._member(i, end, owner, flags, attributes, first)
            if i <= before:
                i = before + 1

    def _attributes(self, i: int, end: int) -> tuple[list[Attribute], int]:
        t, found = self.tokens, []
        while i < end and t[i].text == "[":
            close = closing(t, i, end)
            j = i + 1
            while j < close:
                if t[j].kind == "id":
                    name = t[j].text
                    while j + 2 < close and t[j + 1].text in (".", ":", "::") and t[j + 2].kind == "id":
                        name = t[j + 2].text if t[j + 1].text != ":" else t[j + 2].text
                        j += 2
                    argument = None
                    if j + 1 < close and t[j + 1].text == "(":
                        stop = closing(t, j + 1, close)
                        argument = next((v for k in range(j + 2, stop) if (v := literal(t[k].text)) is not None), None)
                        j = stop
                    found.append(Attribute(name, argument))
                j += 1
            i = close + 1
        return found, i

    def _until(self, i: int, end: int, stops: tuple[str, ...]) -> int:
        """First of ``stops`` outside brackets; ``end`` if none comes."""
        t = self.tokens
        while i < end:
            if t[i].text in stops:
                return i
            if t[i].kind == "op" and t[i].text in "([{":
                i = closing(t, i, end)
            i += 1
        return end

    def _type(self, i: int, end: int, owner: Type | None, flags: set[str], attributes: list[Attribute], first: int) -> int:
        t = self.tokens
        kind = t[i].text
        if kind == "record" and t[i + 1].text in ("class", "struct") and i + 2 < end:
            i += 1
        name = t[i + 1].text
        j = i + 2
        if j < end and t[j].text == "<":
            j = (generic_end(t, j, end) or j) + 1
        primary = None
        if j < end and t[j].text == "(":
            close = closing(t, j, end)
            primary = (j, close)
            j = close + 1
        bases: list[str] = []
        if j < end and t[j].text == ":":
            j += 1
            while j < end and t[j].text not in ("{", ";") and t[j].text != "where":
                k = j
                while k < end and t[k].text not in (",", "{", ";") and t[k].text != "where":
                    if t[k].text == "<":
                        k = generic_end(t, k, end) or k
                    elif t[k].text == "(":
                        k = closing(t, k, end)
                    k += 1
                # a plain name or the head of a generic one; qualified names are none
                if t[j].kind == "id" and not any(t[x].text in (".", "::") for x in range(j, k) if not any(t[y].text == "<" for y in range(j, x))):
                    bases.append(t[j].text)
                j = k + 1 if k < end and t[k].text == "," else k
        j = self._until(j, end, ("{", ";"))
        close = closing(t, j, end) if j < end and t[j].text == "{" else min(j, end - 1)
        made = Type(name, kind, bases, flags, attributes, owner, t[first].line, t[close].line, tokens=(i, close + 1))
        self.types.append(made)
        if owner is not None:
            owner.types.append(made)
        if primary and kind in ("class", "struct", "record"):
            inner = self.source.slice(*primary)
            line = t[i].line
            m = Method(name, ".ctor", "void", self._parameters(*primary), f".ctor ({inner})", set(), [], line, line, None, (0, 0), True)
            made.methods.append(m)
        if kind != "enum" and j < end and t[j].text == "{":
            self._members(j + 1, close, made)
        return close + 1

    def _parameters(self, opened: int, close: int) -> list[str]:
        """The types of a parameter list."""
        t, found, i = self.tokens, [], opened + 1
        while i < close:
            _, i = self._attributes(i, close)
            while i < close and t[i].text in PARAMETER_WORDS:
                i += 1
            j = i
            while j < close and t[j].text != ",":
                if t[j].text == "<":
                    j = generic_end(t, j, close) or j
                elif t[j].kind == "op" and t[j].text in "([{":
                    j = closing(t, j, close)
                j += 1
            stop = next((k for k in range(i, j) if t[k].text == "="), j)
            if stop - i >= 2:
                found.append(self.source.slice(i, stop - 2))
            i = j + 1
        return found

    def _member(self, i: int, end: int, owner: Type | None, flags: set[str], attributes: list[Attribute], first: int) -> int:
        t, j = self.tokens, i
        while j < end and t[j].text not in ("(", "{", "=", ";", "=>"):
            if t[j].text == "<":
                j = generic_end(t, j, end) or j
            elif t[j].text == "[":
                j = closing(t, j, end)
            j += 1
        if j < end and t[j].text == "(" and (j == i or t[j - 1].text in (",",) or (t[j - 1].kind == "op" and t[j - 1].text != ">")):
            j = self._until(closing(t, j, end) + 1, end, ("(", "{", "=", ";", "=>"))  # a tuple type in front
        if j >= end:
            return end
        if t[j].text == "(":
            name_at = j - 1
            if t[name_at].text == ">":
                depth = 0
                while name_at > i:
                    depth += {">": 1, "<": -1}.get(t[name_at].text, 0)
                    name_at -= 1
                    if depth == 0:
                        break
            close = closing(t, j, end)
            stop = self._until(close + 1, end, ("{", ";", "=>"))
            if t[name_at].kind == "id" and name_at >= i and stop <= end:
                constructor = name_at == i and owner is not None
                if name_at == i and not constructor:
                    return self._statement_end(i, end)  # a call at the top level
                body, rest, last = None, (0, 0), min(stop, end - 1)
                if stop < end and t[stop].text == "{":
                    last = closing(t, stop, end)
                    body = rest = (stop, last + 1)
                elif stop < end and t[stop].text == "=>":
                    last = min(self._until(stop, end, (";",)), end - 1)
                    rest = (stop, last + 1)
                if constructor and t[close + 1].text == ":" if close + 1 < end else False:
                    rest = (close + 1, rest[1]) if rest[1] else rest
                destructor = i > 0 and t[name_at - 1].text == "~"
                ret = "void" if constructor or destructor else self.source.slice(i, name_at - 1)
                params = self._parameters(j, close)
                name = t[name_at].text
                signature = f"{ret} {name}" + (f"({', '.join(params)})" if params else "")
                m = Method(owner.name if owner else "", name, ret, params, signature, flags, attributes, t[first].line, t[last].line, body, rest, constructor, len(self.methods))
                if not destructor and owner is not None:
                    self.methods.append(m)
                    owner.methods.append(m)
                return last + 1
            return min(stop, end - 1) + 1
        if t[j].text == "{":
            close = closing(t, j, end)
            if close + 1 < end and t[close + 1].text == "=":
                return self._until(close + 1, end, (";",)) + 1
            return close + 1
        stop = min(self._until(j, end, (";",)), end - 1)
        if t[j].text in ("=", ";") and owner is not None and j - i >= 2 and t[j - 1].kind == "id":
            names = [t[j - 1].text]
            kind = self.source.slice(i, j - 2)
            if "," in kind and "<" not in kind and "(" not in kind:  # int a, b;
                words = kind.replace(",", " ").split()
                kind, names = words[0], [*words[1:], *names]
            owner.fields += [Field(owner.name, n, kind, flags) for n in names]
        return stop + 1

    def _statement_end(self, i: int, end: int) -> int:
        return self._until(i, end, (";",)) + 1

    # calls

    def _scan(self, m: Method) -> None:
        found = self._calls(self.source, *m.rest)
        made = [c for c in self._creations(*m.rest)]
        self.calls += [Call(m.owner, m.name, *c) for c in sorted(found, key=lambda c: (c[5], -c[6]))]
        self.creations += [(m.owner, c) for c in made]

    def _creations(self, first: int, last: int) -> list[str]:
        t, found = self.tokens, []
        for i in range(first, last - 2):
            if t[i].text == "new" and t[i + 1].kind == "id" and t[i + 2].text in ("(", "{") and t[i + 1].text not in ("class",):
                found.append(t[i + 1].text)
        return found

    def _calls(self, source: Source, first: int, last: int, line: int | None = None) -> list[tuple]:
        """(callee, target, line, arguments, literals, first offset, last offset) of each call among the tokens."""
        t, found = source.tokens, []
        for i in range(first, last):
            tok = t[i]
            if tok.kind == "str" and tok.text[0] in "$@" and "$" in tok.text[:2]:
                found += self._holes(tok, line or tok.line)
            if tok.text != "(" or i == first:
                continue
            name = i - 1
            callee_end = name
            if t[name].text == ">":
                depth = 0
                while name > first:
                    depth += {">": 1, "<": -1}.get(t[name].text, 0)
                    if depth == 0:
                        break
                    name -= 1
                if generic_end(t, name, i) != callee_end:
                    continue
                name -= 1
            if name < first or t[name].kind != "id" or t[name].text in NO_CALL:
                continue
            before = t[name - 1] if name > first else None
            target = ""
            begin = name
            if before is not None and before.text in (".", "?.", "->"):
                begin = self._primary(t, name - 2, first)
                target = source.text[t[begin].start : t[name - 2].end] if begin <= name - 2 else ""
                if begin > first and t[begin - 1].text == "new":
                    continue
                if target.endswith("?") or target.endswith("!"):
                    target = target[:-1]
            elif before is not None and (before.text == "new" or (before.kind == "id" and before.text not in NO_CALL) or before.text in (">", "]", "?") and self._declares(t, name, i, last)):
                continue
            close = closing(t, i, last)
            arguments, literals = self._arguments(source, i, close)
            found.append((source.text[t[name].start : t[callee_end].end], target, line or tok_line(t, begin), arguments, literals, t[begin].start, t[close].end))
        return found

    def _declares(self, t: list, name: int, opened: int, end: int) -> bool:
        close = closing(t, opened, end)
        return close + 1 < end and t[close + 1].text in ("{", "=>")

    def _holes(self, tok, line: int) -> list[tuple]:
        """Calls within the holes of an interpolated string."""
        text, found, i = tok.text, [], 0
        while i < len(text):
            if text[i] == "{":
                if text[i + 1 : i + 2] == "{":
                    i += 2
                    continue
                depth, j = 1, i + 1
                while j < len(text) and depth:
                    depth += {"{": 1, "}": -1}.get(text[j], 0)
                    j += 1
                inner = Source(text[i + 1 : j - 1])
                base = tok.start + i + 1
                found += [(*c[:5], c[5] + base, c[6] + base) for c in self._calls(inner, 0, len(inner.tokens), line)]
                i = j
            else:
                i += 1
        return found

    @staticmethod
    def _primary(t: list, i: int, first: int) -> int:
        """Start of the expression that ends at token ``i``."""
        while i >= first:
            x = t[i].text
            if x in (")", "]", "}"):
                depth = 0
                while i >= first:
                    if t[i].kind == "op":
                        depth += 1 if t[i].text in ")]}" else -1 if t[i].text in "([{" else 0
                    if depth == 0:
                        break
                    i -= 1
                if i > first and t[i - 1].text == ">":  # type arguments of a call
                    k, depth = i - 1, 0
                    while k >= first:
                        depth += {">": 1, "<": -1}.get(t[k].text, 0)
                        if depth == 0:
                            break
                        k -= 1
                    if generic_end(t, k, i) == i - 1:
                        i = k
                if i > first and (t[i - 1].kind == "id" and t[i - 1].text not in NO_CALL or t[i - 1].text in (")", "]")):
                    i -= 1
                    continue
            elif x in ("!", "?") and i > first:
                i -= 1
                continue
            elif t[i].kind not in ("id", "str", "num", "chr"):
                return i + 1
            if i - 1 >= first and t[i - 1].text in (".", "?.", "->", "::"):
                i -= 2
                continue
            return max(i, first)
        return first

    def _arguments(self, source: Source, opened: int, close: int) -> tuple[list[str], list[str | None]]:
        """Identifier arguments; and every argument that is an identifier or a plain string, as its text."""
        t, names, plain, i = source.tokens, [], [], opened + 1
        while i < close:
            j = i
            while j < close and t[j].text != ",":
                if t[j].kind == "op" and t[j].text in "([{":
                    j = closing(t, j, close)
                j += 1
            if j - i == 1:
                if t[i].kind == "id":
                    names.append(t[i].text)
                    plain.append(t[i].text)
                elif (v := literal(t[i].text)) is not None:
                    plain.append(v)
            i = j + 1
        return names, plain

    # statements

    def statements(self, m: Method) -> list[Statement]:
        """The statements of a method's block."""
        assert m.body
        return self._block(m.body[0] + 1, m.body[1] - 1)

    def _block(self, i: int, end: int) -> list[Statement]:
        found = []
        while i < end:
            s, i = self._statement(i, end)
            if s is not None:
                found.append(s)
        return found

    def _make(self, kind: str, first: int, last: int, **parts) -> tuple[Statement, int]:
        t = self.tokens
        return Statement(kind, t[first].line, self.source.line(t[last].end - 1), parts, (first, last), (first, self._paren(first, last + 1) - 1)), last + 1

    def _paren(self, i: int, end: int) -> int:
        """Index after the parentheses that follow token ``i``."""
        return closing(self.tokens, i + 1, end) + 1 if i + 1 < end and self.tokens[i + 1].text == "(" else i + 1

    def _inner(self, i: int, end: int) -> tuple[Statement | None, int]:
        return self._statement(i, end) if i < end else (None, end)

    def _statement(self, i: int, end: int) -> tuple[Statement | None, int]:
        t = self.tokens
        word = t[i].text
        if word == ";":
            return None, i + 1
        if word == "{":
            close = closing(t, i, end)
            return self._make("block", i, close, body=self._block(i + 1, close))
        if word in ("}", ")", "]"):
            return None, i + 1
        if word == "await" and i + 1 < end and t[i + 1].text in ("foreach", "using"):
            made, nxt = self._statement(i + 1, end)
            if made is not None:
                made.start = t[i].line
            return made, nxt
        if word == "if":
            then, j = self._inner(self._paren(i, end), end)
            other = None
            if j < end and t[j].text == "else":
                other, j = self._inner(j + 1, end)
            return self._make("if", i, j - 1, then=then, other=other)
        if word in ("while", "lock", "fixed", "foreach") or (word == "using" and i + 1 < end and t[i + 1].text == "("):
            body, j = self._inner(self._paren(i, end), end)
            return self._make(word, i, j - 1, body=body)
        if word == "for":
            opened = i + 1
            close = closing(t, opened, end) if opened < end else end - 1
            semi = self._until(opened + 1, close, (";",))
            init = self._make("simple", opened + 1, semi - 1)[0] if semi > opened + 1 else None
            body, j = self._inner(close + 1, end)
            made, j = self._make("for", i, j - 1, init=init, body=body)
            again = self._until(semi + 1, close, (";",))
            made.head, made.step = (semi + 1, again - 1), (again + 1, close - 1)
            return made, j
        if word == "do":
            body, j = self._inner(i + 1, end)
            stop = min(self._until(j, end, (";",)), end - 1)
            made, nxt = self._make("do", i, stop, body=body)
            made.head = (j, stop)
            return made, nxt
        if word == "switch" and i + 1 < end and t[i + 1].text == "(":
            j = self._paren(i, end)
            if j < end and t[j].text == "{":
                close = closing(t, j, end)
                return self._make("switch", i, close, sections=self._sections(j + 1, close))
        if word == "try":
            body, j = self._inner(i + 1, end)
            catches, last = [], None
            while j < end and t[j].text in ("catch", "finally"):
                what = t[j].text
                j = self._paren(j, end) if what == "catch" else j + 1
                if j < end and t[j].text == "when":
                    j = self._paren(j, end)
                block, j = self._inner(j, end)
                if what == "catch":
                    catches.append(block)
                else:
                    last = block
            return self._make("try", i, j - 1, body=body, catches=catches, final=last)
        if word in ("checked", "unchecked", "unsafe") and i + 1 < end and t[i + 1].text == "{":
            close = closing(t, i + 1, end)
            return self._make("simple", i, close)
        if word in ("return", "throw", "break", "continue", "goto"):
            return self._make(word, i, min(self._until(i, end, (";",)), end - 1))
        if word == "yield":
            return self._make("yield", i, min(self._until(i, end, (";",)), end - 1))
        if t[i].kind == "id" and i + 1 < end and t[i + 1].text == ":" and word not in ("case", "default"):
            return self._make("label", i, i + 1)
        local = self._local_function(i, end)
        if local is not None:
            return self._make("local_function", i, local)
        return self._make("simple", i, min(self._until(i, end, (";",)), end - 1))

    def _local_function(self, i: int, end: int) -> int | None:
        """Last token of a local function that starts at ``i``, if one does."""
        t, j = self.tokens, i
        while j < end and t[j].text in MODIFIERS:
            j += 1
        names = 0
        while j < end and t[j].text != "(":
            if t[j].text == "<":
                stop = generic_end(t, j, end)
                if stop is None:
                    return None
                j = stop
            elif t[j].kind == "id" and t[j].text not in NO_CALL - {"ref"}:
                names += 1 if j == i or t[j - 1].text not in (".", "::") else 0
            elif t[j].text not in (".", "::", "?", "[", "]"):
                return None
            j += 1
        if j >= end or names != 2:
            return None
        close = closing(t, j, end)
        k = close + 1
        while k < end and t[k].text == "where":
            k = self._until(k, end, ("{", "=>", ";"))
        if k < end and t[k].text == "{":
            return closing(t, k, end)
        if k < end and t[k].text == "=>":
            return min(self._until(k, end, (";",)), end - 1)
        return None

    def _sections(self, i: int, end: int) -> list[list[Statement]]:
        t, found = self.tokens, []
        while i < end:
            if t[i].text not in ("case", "default"):
                i += 1
                continue
            children: list[Statement] = []
            if t[i].text == "case":
                colon = self._until(i, end, (":",))
                when = next((k for k in range(i + 1, colon) if t[k].text == "when"), colon)
                if when > i + 1:
                    children.append(self._make("pattern", i + 1, when - 1)[0])
                if when < colon:
                    children.append(self._make("pattern", when, colon - 1)[0])
            else:
                colon = self._until(i, end, (":",))
            i = colon + 1
            while i < end and not (t[i].text == "case" or (t[i].text == "default" and i + 1 < end and t[i + 1].text == ":")):
                s, i = self._statement(i, end)
                if s is not None:
                    children.append(s)
            found.append(children)
        return found


def tok_line(tokens: list, i: int) -> int:
    return tokens[i].line
