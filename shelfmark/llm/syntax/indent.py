"""Python 3: blocks by indentation."""

from __future__ import annotations

import ast
import re
import warnings

from shelfmark.llm.syntax.base import Bad, Kinds, Parser, levels, lexer

PREFIX = r"(?:[rRbBuUfFtT]|[rR][bBfFtT]|[bBfFtT][rR])?"
LONG = rf'{PREFIX}"""(?:[^"\\]|\\[\s\S]|"(?!""))*"""|{PREFIX}' + r"'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''"
SHORT = rf'{PREFIX}"(?:[^"\\\n]|\\[\s\S])*"|{PREFIX}' + r"'(?:[^'\\\n]|\\[\s\S])*'"
NUMBER = r"0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?[jJ]?(?!\w)"
WORDS = (
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal "
    "not or pass raise return try while with yield"
)


class Python(Parser):
    NAME = "python"
    LEX = lexer(rf"[^\W\d]\w*+(?![\"'])|\n[ \t\f]*|{NUMBER}|{LONG}|{SHORT}|[^\W\d]\w*|\.\.\.|\*\*=|//=|<<=|>>=|:=|->|==|!=|<=|>=|\*\*|//|<<|>>|[-+*/%&|^@]=", r"[ \t\f\r﻿]+|#[^\n]*|\\\r?\n")
    KINDS = Kinds(WORDS, "_")
    BINARY = levels("if", "or", "and", "in not is < > <= >= == !=", "|", "^", "&", "<< >>", "+ -", "* / // % @", "**")
    ASSIGN = frozenset("+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split())
    RIGHT = 0

    def read(self, src):
        tokens, depth, stack, fresh = [], 0, [0], True
        width = src[: len(src) - len(src.lstrip(" \t\f"))]
        for x in self.LEX.findall(src):
            if x[:1] == "\n":
                if not depth:
                    width = x[1:]
                    if not fresh:
                        fresh = True
                        tokens.append("\n")
                continue
            if not x:
                break
            if fresh:
                fresh = False
                at = len(width.expandtabs(8)) if "\t" in width else len(width)
                if at != stack[-1]:
                    while at < stack[-1]:
                        stack.pop()
                        tokens.append("\x02")
                    if at != stack[-1]:
                        stack.append(at)
                        tokens.append("\x01")
            if x in "([{":
                depth += 1
            elif x in ")]}" and depth:
                depth -= 1
            tokens.append(x)
        if tokens and not fresh:
            tokens.append("\n")
        tokens.extend(["\x02"] * (len(stack) - 1))
        return tokens, [False] * len(tokens)

    OWN = ("\n", "\x01", "\x02", "")

    def recover(self, start):
        k, i = self.k, max(self.i, start)
        while k[i] and k[i] != "\n":
            i += 1
        if k[i]:
            i += 1
        depth = 0
        while k[i] == "\x01" or depth:
            depth += (k[i] == "\x01") - (k[i] == "\x02")
            i += 1
            if not k[i]:
                break
        self.i = max(i, start + 1)

    def file(self):
        self.statements("")

    def suite(self):
        self.need(":")
        if self.have("\n"):
            if not self.have("\x01"):
                self.fail("expected an indented block")
            self.statements("\x02")
            self.have("\x02")
        else:
            self.simple()

    def statement(self):
        k = self.k[self.i]
        f = self.TABLE.get(k)
        if f:
            return f(self)
        if k == "i" and self.t[self.i] == "match" and self.k[self.i + 1] not in ("=", ".", ")", ",", ":", "\n", "[") and self.match_ahead():
            return self.match_()
        self.simple()

    def simple(self):
        while True:
            self.small()
            if not self.have(";") or self.k[self.i] == "\n":
                break
        if not self.have("\n"):
            self.fail("expected a new line")

    def small(self):
        k = self.k
        a = k[self.i]
        if a in ("pass", "break", "continue"):
            self.i += 1
        elif a == "return":
            self.i += 1
            if k[self.i] not in ("\n", ";"):
                self.testlist()
        elif a == "raise":
            self.i += 1
            if k[self.i] not in ("\n", ";"):
                self.expr()
                if self.have("from"):
                    self.expr()
        elif a in ("global", "nonlocal"):
            self.i += 1
            self.name()
            while self.have(","):
                self.name()
        elif a == "del":
            self.i += 1
            self.testlist()
        elif a == "assert":
            self.i += 1
            self.expr()
            if self.have(","):
                self.expr()
        elif a == "import":
            self.i += 1
            while True:
                self.dotted()
                if self.have("as"):
                    self.name()
                if not self.have(","):
                    break
        elif a == "from":
            self.i += 1
            dots = False
            while k[self.i] in (".", "..."):
                self.i += 1
                dots = True
            if k[self.i] == "i":
                self.dotted()
            elif not dots:
                self.fail("expected a module")
            self.need("import")
            if self.have("*"):
                return
            if self.have("("):
                self.items(")", self.alias)
            else:
                self.alias()
                while self.have(","):
                    self.alias()
        elif a == "i" and self.t[self.i] == "type" and k[self.i + 1] == "i":
            self.i += 2
            if k[self.i] == "[":
                self.i = self.match.get(self.i, self.i) + 1
            self.need("=")
            self.expr()
        else:
            self.testlist()
            if self.have(":"):
                self.expr()
                if self.have("="):
                    self.testlist()
            elif k[self.i] in self.ASSIGN:
                self.i += 1
                self.testlist()
            else:
                while self.have("="):
                    self.testlist()

    def alias(self):
        self.name()
        if self.have("as"):
            self.name()

    def dotted(self):
        self.name()
        while self.have("."):
            self.name()

    def testlist(self):
        while True:
            self.have("*")
            if self.k[self.i] == "yield":
                self.yield_()
            else:
                self.named()
            if not self.have(",") or self.k[self.i] in ("=", "\n", ")", "]", "}", ":", ";") or self.k[self.i] in self.ASSIGN:
                return

    def yield_(self):
        self.i += 1
        if self.have("from"):
            return self.expr()
        if self.k[self.i] not in ("\n", ")", "]", "}", "=", ";"):
            self.testlist()

    def named(self):
        self.expr()
        if self.k[self.i] == ":=":
            self.i += 1
            self.expr()

    def binary(self, op):
        k = self.k
        if op == "if":
            self.i += 1
            self.expr(2)
            self.need("else")
            self.expr()
            return True
        if op == "not":
            self.i += 1
            self.need("in")
            self.expr(5)
            return True
        if op == "is":
            self.i += 1
            self.have("not")
            self.expr(5)
            return True
        if op == "in" and self.no_in:
            return False
        return False

    no_in = False

    def expr(self, least=0):
        if self.no_in and least < 5:
            least = 5
        super().expr(least)

    def unary(self):
        k = self.k
        while k[self.i] in ("not", "-", "+", "~", "await"):
            self.i += 1
        self.primary()
        self.postfix()

    def comprehension(self):
        while self.k[self.i] in ("for", "async"):
            self.have("async")
            self.need("for")
            self.targets()
            self.need("in")
            self.expr(2)
            while self.k[self.i] == "if":
                self.i += 1
                self.expr(2)
                if self.k[self.i] == ":=":
                    self.i += 1
                    self.expr(2)

    def targets(self):
        save, self.no_in = self.no_in, True
        while True:
            self.have("*")
            self.expr()
            if not self.have(",") or self.k[self.i] == "in":
                break
        self.no_in = save

    def element(self):
        if self.k[self.i] in ("*", "**"):
            self.i += 1
        if self.k[self.i] == "yield":
            return self.yield_()
        self.named()
        if self.have(":"):
            self.expr()
        self.comprehension()

    def argument(self):
        k = self.k
        if k[self.i] in ("*", "**"):
            self.i += 1
            return self.expr()
        if k[self.i] == "i" and k[self.i + 1] == "=":
            self.i += 2
            return self.expr()
        self.named()
        self.comprehension()

    def slice(self):
        if self.have("*"):
            return self.expr()
        k = self.k
        if k[self.i] != ":":
            self.named()
        while self.have(":"):
            if k[self.i] not in (":", ",", "]"):
                self.expr()

    def primary(self):
        k = self.k
        a = k[self.i]
        if a in ("i", "n", "None", "True", "False", "..."):
            self.i += 1
        elif a == "s":
            while k[self.i] == "s":
                self.i += 1
        elif a in "([{" and a:
            save, self.no_in = self.no_in, False
            self.i += 1
            self.items({"(": ")", "[": "]", "{": "}"}[a], self.element)
            self.no_in = save
        elif a == "lambda":
            self.i += 1
            while k[self.i] != ":":
                if k[self.i] in ("*", "**", "/", ","):
                    self.i += 1
                else:
                    self.name()
                    if self.have("="):
                        self.expr()
                    if k[self.i] not in (",", ":"):
                        self.fail("expected :")
            self.i += 1
            self.expr()
        else:
            self.fail("expected an expression")

    def postfix(self):
        k = self.k
        while True:
            a = k[self.i]
            if a == ".":
                self.i += 1
                self.name()
            elif a == "(":
                save, self.no_in = self.no_in, False
                self.i += 1
                self.items(")", self.argument)
                self.no_in = save
            elif a == "[":
                save, self.no_in = self.no_in, False
                self.i += 1
                if k[self.i] == "]":
                    self.fail("expected an index")
                self.items("]", self.slice)
                self.no_in = save
            else:
                return

    def if_(self):
        self.i += 1
        self.named()
        self.suite()
        while self.have("elif"):
            self.named()
            self.suite()
        if self.have("else"):
            self.suite()

    def while_(self):
        self.i += 1
        self.named()
        self.suite()
        if self.have("else"):
            self.suite()

    def for_(self):
        self.i += 1
        self.targets()
        self.need("in")
        self.testlist()
        self.suite()
        if self.have("else"):
            self.suite()

    def try_(self):
        self.i += 1
        self.suite()
        ok = False
        while self.have("except"):
            ok = True
            self.have("*")
            if self.k[self.i] != ":":
                self.testlist()
                if self.have("as"):
                    self.name()
            self.suite()
        if self.have("else"):
            self.suite()
        if self.have("finally"):
            ok = True
            self.suite()
        if not ok:
            self.fail("expected except or finally")

    def with_(self):
        self.i += 1
        j = self.match.get(self.i)
        if self.k[self.i] == "(" and j and self.k[j + 1] == ":":
            self.i += 1
            self.items(")", self.with_item)
        else:
            self.with_item()
            while self.have(","):
                self.with_item()
        self.suite()

    def with_item(self):
        self.element()
        if self.have("as"):
            self.expr()

    def def_(self):
        self.i += 1
        self.name()
        if self.k[self.i] == "[":
            self.i = self.match.get(self.i, self.i) + 1
        self.need("(")
        self.items(")", self.parameter)
        if self.have("->"):
            self.expr()
        self.suite()

    def parameter(self):
        if self.have("/"):
            return
        if self.k[self.i] in ("*", "**"):
            self.i += 1
            if self.k[self.i] == ",":
                return
        self.name()
        if self.have(":"):
            self.have("*")
            self.expr()
        if self.have("="):
            self.expr()

    def class_(self):
        self.i += 1
        self.name()
        if self.k[self.i] == "[":
            self.i = self.match.get(self.i, self.i) + 1
        if self.have("("):
            self.items(")", self.argument)
        self.suite()

    def decorated(self):
        self.i += 1
        self.named()
        self.need("\n")
        if self.k[self.i] not in ("@", "def", "class", "async"):
            self.fail("expected a function or class")
        self.statement()

    def async_(self):
        self.i += 1
        if self.k[self.i] not in ("def", "for", "with"):
            self.fail("expected def, for or with")
        self.statement()

    def match_ahead(self):
        j = self.i + 1
        while self.k[j] not in ("\n", ""):
            if self.k[j] in ("(", "[", "{"):
                j = self.match.get(j, j)
            j += 1
        return self.k[j - 1] == ":" and self.k[j + 1] == "\x01" and self.t[j + 2] == "case"

    def match_(self):
        self.i += 1
        self.testlist()
        self.need(":")
        self.need("\n")
        self.need("\x01")
        while self.t[self.i] == "case":
            self.i += 1
            while self.k[self.i] not in (":", "\n", ""):
                self.i = self.match.get(self.i, self.i) + 1
            self.suite()
        self.need("\x02")

    def run(self):
        """Errors of this parser; what it rejects must be rejected by the interpreter's own grammar, too."""
        found = super().run()
        if not found:
            return []
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(self.src.lstrip("﻿"))
            return []
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return found


for _c in ("\n", "\x01", "\x02"):
    Python.KINDS[_c] = _c
Python.TABLE = {
    "if": Python.if_, "while": Python.while_, "for": Python.for_, "try": Python.try_, "with": Python.with_, "def": Python.def_, "class": Python.class_, "@": Python.decorated, "async": Python.async_,
}
