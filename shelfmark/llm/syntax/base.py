"""Lexing and the shared parts of the recursive-descent parsers.

A parser works on the kinds of tokens: a reserved word or punctuator is its own kind, ``i`` is
an identifier, ``n`` a number, ``s`` a string, ``?`` a character the language does not know,
and the empty string the end. Statements descend recursively, binary operators climb
precedences, and after an error the parser skips to a point where a statement can begin
(panic mode), so every error of a file is found.
"""

from __future__ import annotations

import re


# Nested statements and expressions that are read; what lies deeper has no verdict.
DEEPEST = 5000
# Frames of the interpreter for that depth; they lie on the heap.
FRAMES = 60 * DEEPEST


class TooDeep(Exception):
    """A text that nests too deep to be read."""


class Bad(Exception):
    def __init__(self, at: int, why: str):
        super().__init__(why)
        self.at, self.why = at, why


class Kinds(dict):
    """Token text to kind, remembered for one language."""

    def __init__(self, words: str, extra: str = "_$"):
        self.words, self.extra = frozenset(words.split()), extra
        super().__init__()

    def __missing__(self, t: str) -> str:
        if len(self) > 300_000:
            self.clear()
        c = t[0]
        if t in self.words:
            k = t
        elif len(t) > 1 and t[-1] in "\"'`" and c not in "'\"`" and (c.isalpha() or c in "$@%/"):
            k = "s"
        elif c.isalpha() or c in self.extra or (c > "\x7f" and c.isidentifier()):
            k = "i"
        elif c.isdigit() or (c == "." and len(t) > 1 and t[1].isdigit()):
            k = "n"
        elif c in "\"'`":
            k = "s" if len(t) > 1 else "?"
        elif c in "@#$\\`~" and len(t) == 1 and c not in "@#~":
            k = "?"
        elif c > "\x7f" or c < " " and c != "\n":
            k = "?"
        else:
            k = t
        self[t] = k
        return k


def lexer(token: str, skip: str) -> re.Pattern:
    """A pattern whose only group is the next token; blanks and comments before it are skipped."""
    return re.compile(rf"(?:{skip})*({token}|\n|[\s\S]|\Z)")


OPEN = {"(": ")", "[": "]", "{": "}"}
BRACKETS = frozenset("()[]{}")


class Parser:
    LEX: re.Pattern
    KINDS: Kinds
    NAME = ""

    def __init__(self, src: str):
        self.src = src
        self.errors: list[tuple[int, str]] = []
        self.t, self.nl = self.read(src)
        self.k = [self.KINDS[x] for x in self.t]
        for _ in range(6):
            self.k.append("")
            self.t.append("")
            self.nl.append(True)
        self.i = 0
        self.deep = 0
        self.match = self.brackets()

    def read(self, src: str) -> tuple[list[str], list[bool]]:
        tokens, lines, fresh = [], [], True
        for x in self.LEX.findall(src):
            if x == "\n":
                fresh = True
            elif x:
                tokens.append(x)
                lines.append(fresh)
                fresh = False
        return tokens, lines

    def brackets(self) -> dict[int, int]:
        stack, match = [], {}
        for j, k in enumerate(self.k):
            if k in BRACKETS:
                if k in OPEN:
                    stack.append(j)
                    stack.append(OPEN[k])
                elif stack and stack[-1] == k:
                    stack.pop()
                    match[stack.pop()] = j
        return match

    OWN: tuple[str, ...] = ()  # tokens that a reader adds
    table: list[int] | None = None

    def token_lines(self) -> list[int]:
        """Lines of the tokens read from the text; made once, and only for files with errors."""
        out, n, at, src = [], 1, 0, self.src
        for m in self.LEX.finditer(src):
            x = m.group(1)
            if x and x[0] != "\n":
                n += src.count("\n", at, m.start(1))
                at = m.start(1)
                out.append(n)
        out.append(src.count("\n", 0, len(src.rstrip())) + 1)
        return out

    def line(self, at: int) -> int:
        if self.table is None:
            self.table = self.token_lines()
        if self.OWN:
            at = sum(x not in self.OWN for x in self.t[:at])
        return self.table[min(at, len(self.table) - 1)]

    def fail(self, why: str):
        raise Bad(self.i, why)

    def need(self, kind: str):
        if self.k[self.i] != kind:
            raise Bad(self.i, f"expected {kind}")
        self.i += 1

    def have(self, kind: str) -> bool:
        if self.k[self.i] == kind:
            self.i += 1
            return True
        return False

    def name(self):
        if self.k[self.i] != "i" and self.k[self.i] not in self.SOFT:
            raise Bad(self.i, "expected a name")
        self.i += 1

    SOFT: frozenset[str] = frozenset()

    def note(self, e: Bad):
        at = min(e.at, len(self.t) - 6)
        end = not self.k[at]
        self.errors.append((at, ("unexpected end: " if end else f"at {self.t[at][:20]!r}: ") + e.why))

    def recover(self, start: int):
        """Panic mode: on to the next ; or line, or to the } that ends the block."""
        k, i = self.k, max(self.i, start)
        while k[i]:
            if k[i] in OPEN and i in self.match:
                i = self.match[i] + 1
                if k[i - 1] == "}":
                    break
                continue
            if k[i] == "}":
                break
            i += 1
            if k[i - 1] == ";" or self.nl[i]:
                break
        self.i = i if i > start else start + 1

    def statements(self, end: str, one=None):
        """Statements up to ``end``; errors inside are noted and skipped."""
        one = one or self.statement
        self.deep += 1
        if self.deep > DEEPEST:
            raise TooDeep
        while True:
            k = self.k[self.i]
            if k == end:
                break
            if not k:
                self.deep -= 1
                self.fail(f"expected {end}")
            start, deep = self.i, self.deep
            try:
                one()
                if self.i == start:
                    self.fail("unexpected token")
            except Bad as e:
                self.deep = deep
                self.note(e)
                if not self.k[max(self.i, e.at)]:
                    self.i = len(self.t) - 6
                    self.deep -= 1
                    return
                self.i = max(self.i, start)
                if end == "" and self.k[self.i] == "}":
                    self.i += 1
                else:
                    self.recover(start)
        self.deep -= 1

    def block(self, one=None):
        self.need("{")
        self.statements("}", one)
        if not self.have("}") and self.k[self.i]:
            self.fail("expected }")

    def run(self) -> list[tuple[int, str]]:
        """All errors as (line, message), the first cause first; TooDeep for a text without a verdict."""
        try:
            self.file()
        except Bad as e:
            self.note(e)
        return [(self.line(at), why) for at, why in sorted(self.errors)]

    def file(self):
        self.statements("")

    # expressions by precedence climbing ------------------------------------------------
    BINARY: dict[str, int] = {}
    PREFIX: frozenset[str] = frozenset()
    RIGHT = 2  # precedences up to this bind to the right

    def expr(self, least: int = 0):
        k = self.k
        self.deep += 1
        if self.deep > DEEPEST:
            raise TooDeep
        self.unary()
        while True:
            op = k[self.i]
            p = self.BINARY.get(op)
            if p is None or p < least:
                break
            if self.binary(op):
                continue
            self.i += 1
            self.expr(p if p <= self.RIGHT else p + 1)
        self.deep -= 1

    def binary(self, op: str) -> bool:
        """Operators with a form of their own; True if one was read."""
        if op == "?":
            self.i += 1
            self.expr()
            self.need(":")
            self.expr(self.RIGHT)
            return True
        return False

    def unary(self):
        while self.k[self.i] in self.PREFIX:
            self.i += 1
        self.primary()
        self.postfix()

    def items(self, end: str, one, trailing: bool = True, holes: bool = False):
        """one, one, ... up to and with ``end``."""
        k = self.k
        if k[self.i] == end:
            self.i += 1
            return
        while True:
            if holes:
                while k[self.i] == ",":
                    self.i += 1
                if k[self.i] == end:
                    break
            one()
            if k[self.i] != ",":
                break
            self.i += 1
            if k[self.i] == end and trailing:
                break
        self.need(end)


def levels(*rows: str) -> dict[str, int]:
    return {op: p for p, row in enumerate(rows, 1) for op in row.split()}
