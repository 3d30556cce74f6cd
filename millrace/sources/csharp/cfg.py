"""Control-flow graphs from statements: numbered blocks and edges in the order they are made.

In the compatible mode control falls through jumps, bodies of using, lock and foreach are one block, and a for loop has
no block for its increment. The strict mode follows jumps and enters those bodies, chains the statements of a switch section,
ends a do loop in a condition of its own, and lets any block of a try throw. Its blocks know the tokens they read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from .parser import File, Method, Statement

Range = tuple[int, int] | None


@dataclass
class Graph:
    blocks: list[tuple[int, str, int, int]] = field(default_factory=list)
    edges: list[tuple[int, int, str]] = field(default_factory=list)
    spans: dict[int, tuple[int, int, bool]] = field(default_factory=dict)


class Builder:
    """Blocks are numbered over the whole file."""

    def __init__(self, strict: bool = False) -> None:
        self.strict, self.next = strict, 0

    def method(self, file: File, m: Method) -> Graph:
        self.g = Graph()
        self._loops: list[tuple[int, int]] = []
        entry, exit_ = self._new("Entry", m.start, m.end), self._new("Exit", m.start, m.end)
        self.exit = exit_
        body = self._chain(file.statements(m))
        if body is None:
            self._edge(entry, exit_, "Seq")
        else:
            self._edge(entry, body[0], "Seq")
            self._leave(body[1], exit_, "Seq")
        return self.g

    def _new(self, kind: str, start: int, end: int, reads: tuple[int, int] | None = None, loop: bool = False) -> int:
        self.g.blocks.append((self.next, kind, start, end))
        if reads is not None:
            self.g.spans[self.next] = (*reads, loop)
        self.next += 1
        return self.next - 1

    def _edge(self, src: int, dst: int, kind: str) -> None:
        self.g.edges.append((src, dst, kind))

    def _leave(self, src: int | None, dst: int, kind: str) -> None:
        """An edge out of the end of a range, unless control never gets there."""
        if src is not None and src >= 0 and src not in self.jumped:
            self._edge(src, dst, kind)

    @property
    def jumped(self) -> set[int]:
        if not hasattr(self.g, "jumped"):
            self.g.jumped = set()  # type: ignore[attr-defined]
        return self.g.jumped  # type: ignore[attr-defined]

    def _chain(self, statements: list[Statement]) -> Range:
        whole: Range = None
        for s in statements:
            made = self._build(s)
            if made is None:
                continue
            if whole is None:
                whole = made
            else:
                self._leave(whole[1], made[0], "Seq")
                whole = (whole[0], made[1])
        return whole

    def _build(self, s: Statement | None) -> Range:
        if s is None:
            return None
        special = getattr(self, f"_{s.kind}", None)
        if special is not None:
            return special(s)
        if s.kind in ("local_function", "label", "goto", "pattern") or (s.kind == "foreach" and not self.strict):
            b = self._new("Unknown", s.start, s.end, s.span)
            return b, b
        if self.strict and s.kind in ("using", "lock", "fixed"):
            b = self._new("Statement", s.start, s.start, s.head)
            body = self._build(s.parts["body"])
            if body is None:
                return b, b
            self._edge(b, body[0], "Seq")
            return b, body[1]
        b = self._new("Statement", s.start, s.end, s.span)
        if self.strict and s.kind in ("return", "throw", "break", "continue"):
            to = self.exit if s.kind in ("return", "throw") or not self._loops else self._loops[-1][s.kind == "break"]
            self._edge(b, to, s.kind.capitalize())
            self.jumped.add(b)
        return b, b

    def _block(self, s: Statement) -> Range:
        return self._chain(s.parts["body"])

    def _yield(self, s: Statement) -> Range:
        b = self._new("Resume", s.start, s.end, s.span)
        return b, b

    def _if(self, s: Statement) -> Range:
        cond, merge = self._new("Condition", s.start, s.end, s.head), self._new("Statement", s.start, s.end)
        for branch, kind in ((s.parts["then"], "CondTrue"), (s.parts["other"], "CondFalse")):
            made = self._build(branch)
            if made is None:
                if kind == "CondFalse" or self.strict:
                    self._edge(cond, merge, kind)
                continue
            self._edge(cond, made[0], kind)
            if branch.kind not in ("return", "throw"):
                self._leave(made[1], merge, "Seq")
        return cond, merge

    def _looped(self, header: int, exit_: int, body: Statement | None, back: int | None = None) -> None:
        self._loops.append((back if back is not None else header, exit_))
        made = self._build(body)
        self._loops.pop()
        if made is None:
            self._edge(header, exit_, "CondTrue")
        else:
            self._edge(header, made[0], "CondTrue")
            self._leave(made[1], back if back is not None else header, "LoopBack" if back is None else "Seq")
        if back is not None:
            self._edge(back, header, "LoopBack")
        self._edge(header, exit_, "CondFalse")

    def _while(self, s: Statement) -> Range:
        header, exit_ = self._new("LoopHeader", s.start, s.end, s.head, s.kind == "foreach"), self._new("LoopExit", s.start, s.end)
        self._looped(header, exit_, s.parts["body"])
        return header, exit_

    def _foreach(self, s: Statement) -> Range:
        if self.strict:
            return self._while(s)
        b = self._new("Unknown", s.start, s.end)
        return b, b

    def _for(self, s: Statement) -> Range:
        header, exit_ = self._new("LoopHeader", s.start, s.end, s.head), self._new("LoopExit", s.start, s.end)
        first = header
        if s.parts["init"] is not None:
            init = self._new("Statement", s.parts["init"].start, s.parts["init"].end, s.parts["init"].span)
            self._edge(init, header, "Seq")
            first = init if self.strict else header
        self._looped(header, exit_, s.parts["body"], self._new("Statement", s.start, s.start, s.step) if self.strict else None)
        return first, exit_

    def _do(self, s: Statement) -> Range:
        header, exit_ = self._new("LoopHeader", s.start, s.end), self._new("LoopExit", s.start, s.end)
        if self.strict:
            cond = self._new("Condition", s.end, s.end, s.head)
            self._loops.append((cond, exit_))
            made = self._build(s.parts["body"])
            self._loops.pop()
            self._edge(header, made[0] if made else cond, "Seq")
            if made:
                self._leave(made[1], cond, "Seq")
            self._edge(cond, header, "LoopBack")
            self._edge(cond, exit_, "CondFalse")
            return header, exit_
        self._loops.append((header, exit_))
        made = self._build(s.parts["body"])
        self._loops.pop()
        if made is not None:
            self._edge(header, made[0], "Seq")
            self._leave(made[1], exit_, "CondFalse")
            self._leave(made[1], header, "LoopBack")
        return header, exit_

    def _switch(self, s: Statement) -> Range:
        header, merge = self._new("Condition", s.start, s.end, s.head), self._new("Statement", s.start, s.end)
        self._loops.append((self._loops[-1][0] if self._loops else header, merge))
        if self.strict:
            labels: list[int] = []
            for children in s.parts["sections"]:
                made = self._chain(children)
                if made is None:
                    labels.append(header)
                    continue
                for before in dict.fromkeys([*labels, header]):
                    self._edge(before, made[0], "CondTrue" if before == header else "Seq")
                labels = [made[1]] if all(c.kind == "pattern" for c in children) else []
                if not labels:
                    self._leave(made[1], merge, "Seq")
            for before in dict.fromkeys(labels):
                self._edge(before, merge, "Seq")
            self._loops.pop()
            self._edge(header, merge, "CondFalse")
            return header, merge
        for children in s.parts["sections"]:
            if not children:
                self._edge(header, merge, "CondTrue")
            for child in children:
                made = self._build(child)
                if made is None:
                    continue
                self._edge(header, made[0], "CondTrue")
                if child.kind not in ("break", "continue"):
                    self._leave(made[1], merge, "Seq")
        self._loops.pop()
        self._edge(header, merge, "CondFalse")
        return header, merge

    def _strict_try(self, s: Statement) -> Range:
        first = self.next
        body = self._build(s.parts["body"])
        if body is None:
            return self._build(s.parts["final"])
        inside = range(first, self.next)
        ends = [body[1]]
        thrown: list[int] = []
        for c in s.parts["catches"]:
            at = self.next
            made = self._build(c) or (self._new("Statement", c.start, c.end),) * 2 if c is not None else None
            if made is not None:
                for b in inside:
                    self._edge(b, made[0], "Throw")
                ends.append(made[1])
                thrown += range(at, self.next)
        last = self._build(s.parts["final"])
        if last is None:
            merge = self._new("Statement", s.end, s.end)
            last = merge, merge
        elif not s.parts["catches"]:
            thrown += inside
        for e in ends:
            self._leave(e, last[0], "Seq" if e == body[1] else "Finally")
        if s.parts["final"] is not None and s.parts["final"].parts.get("body"):
            for b in thrown:
                if b not in ends:
                    self._edge(b, last[0], "Throw")
        return body[0], last[1]

    def _try(self, s: Statement) -> Range:
        if self.strict:
            return self._strict_try(s)
        body = self._build(s.parts["body"])
        caught = []
        for c in s.parts["catches"]:
            made = self._build(c)
            if made is not None:
                caught.append(made)
                if body is not None:
                    self._edge(body[1], made[0], "Throw")
        last = self._build(s.parts["final"])
        if last is not None:
            for made in caught:
                self._leave(made[1], last[0], "Finally")
            if body is not None:
                self._leave(body[1], last[0], "Seq")
        if body is None:
            return None
        return body[0], (last or (caught[-1] if caught else body))[1]


def graphs(file: File, strict: bool = False) -> list[tuple[Method, Graph]]:
    """The graph of every method with a block, in file order."""
    b = Builder(strict)
    return [(m, b.method(file, m)) for m in file.methods if m.body]
