"""JavaScript with modules, and TypeScript."""

from __future__ import annotations

import re

from shelfmark.llm.syntax.base import Bad, Kinds, Parser, levels, lexer

STRING = r'"(?:[^"\\\n]|\\[\s\S])*"|' + r"'(?:[^'\\\n]|\\[\s\S])*'"
TEMPLATE = r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{(?:[^{}`]|`[^`]*`|\{[^{}]*\})*\})*`"
NUMBER = r"0[xXbBoO][\da-fA-F_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?(?![\w$])"
PUNCT = r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|\*\*"
SKIP = r"[ \t\r\f\v\xa0﻿]+|//[^\n]*|/\*[\s\S]*?\*/"
REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
# Reserved words.
WORDS = (
    "break case catch class const continue debugger default delete do else export extends finally for function if import in "
    "instanceof new return super switch this throw try typeof var void while with null true false enum"
)


class JavaScript(Parser):
    NAME = "javascript"
    TS = False
    LEX = lexer(rf"#?[A-Za-z_$\u0080-￿][\w$]*|{NUMBER}|{STRING}|{TEMPLATE}|{PUNCT}", SKIP)
    KINDS = Kinds(WORDS, "_$#")
    BINARY = levels("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=", "?", "??", "||", "&&", "|", "^", "&", "== != === !==", "< > <= >= instanceof in", "<< >> >>>", "+ -", "* / %", "**")
    PREFIX = frozenset("+ - ! ~ ++ -- typeof void delete".split())
    STMT_END = frozenset(";})]")

    def read(self, src):
        if src.startswith("#!"):
            src = "//" + src[2:]
        tokens, lines = super().read(src)
        if "/" in tokens or "/=" in tokens:  # a division, or a regular expression
            return self.read_slowly(src)
        return tokens, lines

    def read_slowly(self, src):
        tokens, lines, fresh, at, n = [], [], True, 0, len(src)
        while at <= n:
            m = self.LEX.match(src, at)
            x, at2 = m.group(1), m.end()
            if x == "\n":
                fresh = True
            elif not x:
                break
            else:
                if x in ("/", "/="):
                    before = tokens[-1] if tokens else "("
                    if not (before[-1] in ")]}\"'`" or before[-1].isalnum() or before[-1] in "_$") or before in ("return", "typeof", "case", "in", "of", "else", "void", "delete"):
                        r = REGEX.match(src, m.start(1))
                        if r:
                            x, at2 = "/re/'", r.end()
                tokens.append(x)
                lines.append(fresh)
                fresh = False
            at = at2
        return tokens, lines

    # statements
    def end(self):
        k = self.k[self.i]
        if k == ";":
            self.i += 1
        elif k != "}" and k and not self.nl[self.i]:
            self.fail("expected ; or a new line")

    def statement(self):
        i, k = self.i, self.k
        a = k[i]
        f = self.TABLE.get(a)
        if f:
            return f(self)
        if a == "i":
            t, b = self.t[i], k[i + 1]
            if b == ":" :
                self.i += 2
                return self.statement()
            if t in ("let", "const") and (b in ("i", "[", "{")):
                return self.declare()
            if t == "async" and b == "function" and not self.nl[i + 1]:
                self.i += 1
                return self.function()
            if self.TS and self.typed(t, b):
                return
        elif a == "@":
            self.decorators()
            return self.statement()
        self.sequence()
        self.end()

    def typed(self, t, b):
        return False

    def sequence(self):
        self.expr()
        while self.k[self.i] == ",":
            self.i += 1
            self.expr()

    def declare(self):
        self.i += 1
        self.bindings()
        self.end()

    def bindings(self):
        while True:
            pattern = self.k[self.i] in "[{" and self.k[self.i] != ""
            self.target()
            if self.TS:
                self.have("!")
                if self.have(":"):
                    self.type()
            if self.have("="):
                self.expr()
            elif pattern and self.t[self.i] not in ("of", "in"):
                self.fail("a pattern needs a value")
            if not self.have(","):
                return

    def target(self):
        k = self.k[self.i]
        if k in ("[", "{") and self.i in self.match:
            self.primary()
        else:
            self.name()

    def function(self, named=True):
        self.i += 1
        self.have("*")
        if self.k[self.i] == "i":
            self.i += 1
        elif named:
            self.fail("expected a function name")
        self.signature()
        if self.TS and self.k[self.i] != "{":
            return self.end()
        self.block()

    def signature(self):
        if self.TS and self.k[self.i] == "<":
            self.angles()
        self.need("(")
        self.items(")", self.parameter)
        if self.TS and self.have(":"):
            self.type()

    def parameter(self):
        while self.k[self.i] == "@":
            self.decorators(once=True)
        self.have("...")
        if self.TS:
            while self.t[self.i] in ("public", "private", "protected", "readonly", "override") and self.k[self.i + 1] in ("i", "{", "["):
                self.i += 1
            if self.k[self.i] == "this":
                self.i += 1
            else:
                self.target()
            self.have("?")
            if self.have(":"):
                self.type()
        else:
            self.target()
        if self.have("="):
            self.expr()

    def decorators(self, once=False):
        while self.have("@"):
            if self.k[self.i] == "(":
                self.primary()
            else:
                self.name()
            while self.have("."):
                self.i += 1
            if self.k[self.i] == "(":
                self.i += 1
                self.items(")", self.argument)
            if once:
                return

    def klass(self, named=True):
        self.i += 1
        if self.k[self.i] == "i" and self.t[self.i] != "implements":
            self.i += 1
            if self.TS and self.k[self.i] == "<":
                self.angles()
        elif named:
            self.fail("expected a class name")
        if self.have("extends"):
            self.unary()
            if self.TS and self.k[self.i] == "<":
                self.angles()
        if self.TS and self.t[self.i] == "implements":
            self.i += 1
            self.type()
            while self.have(","):
                self.type()
        self.block(self.member)

    MODIFIERS = frozenset("static async get set".split())
    TS_MODIFIERS = MODIFIERS | frozenset("public private protected readonly abstract declare override accessor".split())

    def member(self):
        if self.have(";"):
            return
        self.decorators()
        mods = self.TS_MODIFIERS if self.TS else self.MODIFIERS
        while self.t[self.i] in mods and self.k[self.i + 1] not in ("(", "=", ";", "}", ":", "?", "!") and not (self.nl[self.i + 1] and self.t[self.i] != "static"):
            self.i += 1
            if self.k[self.i] == "{":
                return self.block()
        self.have("*")
        k = self.k[self.i]
        if k == "[":
            if self.TS and self.k[self.i + 1] == "i" and self.k[self.i + 2] == ":":
                self.i = self.match.get(self.i, self.i) + 1
            else:
                self.i += 1
                self.expr()
                self.need("]")
        elif k in ("i", "n", "s") or k in self.KINDS.words:
            self.i += 1
        else:
            self.fail("expected a class member")
        if self.TS:
            self.have("?") or self.have("!")
        if self.k[self.i] == "(" or (self.TS and self.k[self.i] == "<"):
            self.signature()
            if self.TS and self.k[self.i] != "{":
                return self.end()
            return self.block()
        if self.TS and self.have(":"):
            self.type()
        if self.have("="):
            self.expr()
        self.end()

    def paren(self):
        self.need("(")
        self.sequence()
        self.need(")")

    def if_(self):
        self.i += 1
        self.paren()
        self.statement()
        if self.have("else"):
            self.statement()

    def while_(self):
        self.i += 1
        self.paren()
        self.statement()

    def do(self):
        self.i += 1
        self.statement()
        self.need("while")
        self.paren()
        self.have(";")

    def for_(self):
        self.i += 1
        if self.t[self.i] == "await":
            self.i += 1
        self.need("(")
        if self.k[self.i] != ";":
            if self.k[self.i] in ("var", "const") or self.t[self.i] == "let":
                self.i += 1
                save = self.BINARY
                self.BINARY = self.NO_IN
                try:
                    self.bindings()
                finally:
                    self.BINARY = save
            else:
                save = self.BINARY
                self.BINARY = self.NO_IN
                try:
                    self.sequence()
                finally:
                    self.BINARY = save
            if self.k[self.i] == "in" or self.t[self.i] == "of":
                self.i += 1
                self.sequence()
                self.need(")")
                return self.statement()
        self.need(";")
        if self.k[self.i] != ";":
            self.sequence()
        self.need(";")
        if self.k[self.i] != ")":
            self.sequence()
        self.need(")")
        self.statement()

    def return_(self):
        self.i += 1
        if self.k[self.i] not in (";", "}", "") and not self.nl[self.i]:
            self.sequence()
        self.end()

    def throw(self):
        self.i += 1
        self.sequence()
        self.end()

    def jump(self):
        self.i += 1
        if self.k[self.i] == "i" and not self.nl[self.i]:
            self.i += 1
        self.end()

    def try_(self):
        self.i += 1
        self.block()
        ok = False
        if self.have("catch"):
            ok = True
            if self.have("("):
                self.target()
                if self.TS and self.have(":"):
                    self.type()
                self.need(")")
            self.block()
        if self.have("finally"):
            ok = True
            self.block()
        if not ok:
            self.fail("expected catch or finally")

    def switch(self):
        self.i += 1
        self.paren()
        self.block(self.case)

    def case(self):
        if self.have("case"):
            self.sequence()
        else:
            self.need("default")
        self.need(":")
        while self.k[self.i] not in ("case", "default", "}", ""):
            self.statement()

    def empty(self):
        self.i += 1

    def import_(self):
        if self.k[self.i + 1] in ("(", "."):
            self.sequence()
            return self.end()
        self.i += 1
        if self.TS and self.t[self.i] == "type" and self.k[self.i + 1] in ("i", "{", "*") and self.t[self.i + 1] != "from":
            self.i += 1
        if not self.have("s"):
            if self.k[self.i] == "i":
                self.i += 1
                if self.TS and self.have("="):
                    self.expr()
                    return self.end()
                if self.k[self.i] == ",":
                    self.i += 1
            if self.have("*"):
                self.word("as")
                self.name()
            elif self.have("{"):
                self.items("}", self.specifier)
            self.word("from")
            self.need("s")
        if self.t[self.i] in ("with", "assert") and self.k[self.i + 1] == "{":
            self.i += 1
            self.primary()
        self.end()

    def word(self, w):
        if self.t[self.i] != w:
            self.fail(f"expected {w}")
        self.i += 1

    def specifier(self):
        if self.TS and self.t[self.i] == "type" and self.k[self.i + 1] == "i" and self.t[self.i + 1] != "as":
            self.i += 1
        if self.k[self.i] not in ("i", "s") and self.k[self.i] not in self.KINDS.words:
            self.fail("expected a name")
        self.i += 1
        if self.t[self.i] == "as":
            self.i += 1
            if self.k[self.i] not in ("i", "s") and self.k[self.i] not in self.KINDS.words:
                self.fail("expected a name")
            self.i += 1

    def export(self):
        self.i += 1
        k, t = self.k[self.i], self.t[self.i]
        if k == "default":
            self.i += 1
            k, t = self.k[self.i], self.t[self.i]
            if k == "function":
                return self.function(False)
            if t == "async" and self.k[self.i + 1] == "function":
                self.i += 1
                return self.function(False)
            if k == "class" or (t == "abstract" and self.k[self.i + 1] == "class"):
                self.i += t == "abstract"
                return self.klass(False)
            if k == "@":
                self.decorators()
                return self.klass(False)
            if self.TS and t == "interface":
                return self.statement()
            self.expr()
            return self.end()
        if self.TS and t == "type" and self.k[self.i + 1] in ("{", "*"):
            self.i += 1
            k = self.k[self.i]
        if k == "*":
            self.i += 1
            if self.t[self.i] == "as":
                self.i += 2
            self.word("from")
            self.need("s")
            return self.end()
        if k == "{":
            self.i += 1
            self.items("}", self.specifier)
            if self.t[self.i] == "from":
                self.i += 1
                self.need("s")
            return self.end()
        if self.TS and k == "=":
            self.i += 1
            self.expr()
            return self.end()
        if k in ("var", "const", "function", "class", "@", "enum") or t in ("let", "async") or (self.TS and t in ("interface", "type", "abstract", "declare", "namespace", "module", "enum", "import")):
            return self.statement()
        self.fail("cannot be exported")

    # expressions
    def argument(self):
        self.have("...")
        self.expr()

    def unary(self):
        k = self.k
        while True:
            a = k[self.i]
            if a in self.PREFIX:
                self.i += 1
            elif a == "i" and self.t[self.i] in ("await", "yield") and not self.nl[self.i + 1] and (k[self.i + 1] in ("i", "s", "n", "(", "[", "{", "new", "this", "function", "class", "!", "import", "super", "*")):
                self.i += 1
                if k[self.i] == "*":
                    self.i += 1
            else:
                break
        self.primary()
        self.postfix()

    def primary(self):
        i, k = self.i, self.k
        a = k[i]
        if a == "i":
            t = self.t[i]
            if k[i + 1] == "=>":
                self.i += 2
                return self.arrow()
            if t == "async" and not self.nl[i + 1]:
                if k[i + 1] == "function":
                    self.i += 1
                    return self.function(False)
                if k[i + 1] == "i" and k[i + 2] == "=>":
                    self.i += 3
                    return self.arrow()
                if k[i + 1] in ("(", "<") and self.is_arrow(i + 1):
                    self.i += 1
                    return self.arrow_function()
            if t[0] == "#" and k[i + 1] != "in":
                self.fail("unexpected private name")
            self.i += 1
        elif a in ("n", "s", "this", "null", "true", "false", "super"):
            self.i += 1
        elif a == "(":
            if self.is_arrow(i):
                return self.arrow_function()
            self.i += 1
            self.sequence()
            self.need(")")
        elif a == "[":
            self.i += 1
            self.items("]", self.argument, holes=True)
        elif a == "{":
            self.i += 1
            self.items("}", self.property)
        elif a == "function":
            self.function(False)
        elif a == "class":
            self.klass(False)
        elif a == "new":
            self.i += 1
            if self.have("."):
                self.name()
            else:
                self.primary()
                while self.k[self.i] in (".", "["):
                    if self.have("."):
                        self.i += 1
                    else:
                        self.i += 1
                        self.sequence()
                        self.need("]")
                if self.TS and self.k[self.i] == "<":
                    self.angles()
        elif a == "import":
            self.i += 1
            if self.have("."):
                self.name()
            elif self.k[self.i] != "(":
                self.fail("import stands in an expression")
        elif a == "<" and self.TS and (j := self.angle_end(i)) > 0:
            self.i = j
            if k[j] == "(" and self.is_arrow(j):
                return self.arrow_function()
            self.unary()
        else:
            self.fail("expected an expression")

    def is_arrow(self, i):
        if self.k[i] == "<":
            i = self.angle_end(i)
            if i < 0 or self.k[i] != "(":
                return False
        j = self.match.get(i)
        if j is None:
            return False
        if self.k[j + 1] == "=>":
            return True
        if self.TS and self.k[j + 1] == ":":
            save, deep = self.i, self.deep
            try:
                self.i = j + 2
                self.type()
                return self.k[self.i] == "=>"
            except Bad:
                return False
            finally:
                self.i, self.deep = save, deep
        return False

    def arrow_function(self):
        self.signature()
        self.need("=>")
        self.arrow()

    def arrow(self):
        if self.k[self.i] == "{":
            save = self.BINARY
            self.BINARY = type(self).BINARY
            self.block()
            self.BINARY = save
        else:
            self.expr()

    def property(self):
        if self.have("..."):
            return self.expr()
        k = self.k
        while self.t[self.i] in ("get", "set", "async") and k[self.i + 1] not in ("(", ":", ",", "}", "="):
            self.i += 1
        star = self.have("*")
        a = k[self.i]
        if a == "[":
            self.i += 1
            self.expr()
            self.need("]")
        elif a in ("i", "s", "n") or a in self.KINDS.words:
            self.i += 1
        else:
            self.fail("expected a property")
        b = k[self.i]
        if b == ":":
            self.i += 1
            self.expr()
        elif b == "(" or (b == "<" and self.TS):
            self.signature()
            self.block()
        elif b == "=" and a == "i":
            self.i += 1
            self.expr()
        elif a != "i" or star:
            self.fail("expected :")

    def postfix(self):
        k = self.k
        while True:
            a = k[self.i]
            if a == "(":
                self.i += 1
                self.items(")", self.argument)
            elif a == "." or a == "?.":
                self.i += 1
                b = k[self.i]
                if a == "?." and b in ("(", "["):
                    continue
                if b != "i" and b not in self.KINDS.words:
                    self.fail("expected a name")
                self.i += 1
            elif a == "[":
                self.i += 1
                self.sequence()
                self.need("]")
            elif a in ("++", "--") and not self.nl[self.i]:
                self.i += 1
            elif a == "s" and self.t[self.i][0] == "`":
                self.i += 1
            elif self.TS and a == "!" and not self.nl[self.i] and k[self.i + 1] != "=":
                self.i += 1
            elif self.TS and a == "i" and self.t[self.i] in ("as", "satisfies") and not self.nl[self.i]:
                self.i += 1
                self.type()
            elif self.TS and a == "<" and (j := self.angle_end(self.i)) > 0 and (k[j] == "(" or self.t[j][:1] == "`"):
                self.i = j
            else:
                return


    def angle_end(self, i):
        return -1


JavaScript.NO_IN = {k: v for k, v in JavaScript.BINARY.items() if k != "in"}
JavaScript.TABLE = {
    "{": lambda p: p.block(), ";": JavaScript.empty, "var": JavaScript.declare, "const": JavaScript.declare, "function": JavaScript.function, "class": JavaScript.klass,
    "if": JavaScript.if_, "while": JavaScript.while_, "do": JavaScript.do, "for": JavaScript.for_, "return": JavaScript.return_, "throw": JavaScript.throw,
    "break": JavaScript.jump, "continue": JavaScript.jump, "try": JavaScript.try_, "switch": JavaScript.switch, "import": JavaScript.import_, "export": JavaScript.export,
    "debugger": JavaScript.jump,
}


class TypeScript(JavaScript):
    NAME = "typescript"
    TS = True
    ANGLE_OK = frozenset("i , . ? & | [ ] extends : ; => typeof this null true false void n s in = - + { } ( ) new import function ...".split())

    def angle_end(self, i):
        """Index after the > that closes the < at i, or -1 if this is no list of types."""
        depth, k = 0, self.k
        while True:
            a = k[i]
            if a == "<":
                depth += 1
            elif a in (">", ">>", ">>>"):
                depth -= len(a)
                if depth <= 0:
                    return i + 1 if depth == 0 else -1
            elif a in ("(", "[", "{"):
                j = self.match.get(i)
                if j is None:
                    return -1
                i = j
            elif a not in self.ANGLE_OK or a in (")", "]", "}", ";"):
                return -1
            i += 1

    def angles(self):
        j = self.angle_end(self.i)
        if j < 0:
            self.fail("expected type arguments")
        self.i = j

    def typed(self, t, b):
        i = self.i
        if t == "type" and b == "i" and not self.nl[i + 1]:
            self.i += 2
            if self.k[self.i] == "<":
                self.angles()
            self.need("=")
            self.type()
            self.end()
            return True
        if t == "interface" and b == "i":
            self.i += 2
            if self.k[self.i] == "<":
                self.angles()
            if self.have("extends"):
                self.type()
                while self.have(","):
                    self.type()
            if self.k[self.i] != "{":
                self.fail("expected {")
            self.type()
            return True
        if t == "abstract" and b == "class":
            self.i += 1
            self.klass()
            return True
        if t in ("declare",) and (b in ("i", "class", "function", "var", "const", "enum")):
            self.i += 1
            if self.t[self.i] == "global" and self.k[self.i + 1] == "{":
                self.i += 1
                self.block()
            else:
                self.statement()
            return True
        if t in ("namespace", "module") and b in ("i", "s") and not self.nl[i + 1]:
            self.i += 2
            while self.have("."):
                self.name()
            if self.k[self.i] == "{":
                self.block()
            else:
                self.end()
            return True
        return False

    def enum(self):
        self.i += 1
        self.name()
        self.need("{")
        self.items("}", self.enum_member)

    def enum_member(self):
        if self.k[self.i] not in ("i", "s"):
            self.fail("expected a name")
        self.i += 1
        if self.have("="):
            self.expr()

    def declare(self):
        if self.k[self.i] == "const" and self.k[self.i + 1] == "enum":
            self.i += 1
            return self.enum()
        return super().declare()

    def type(self):
        """A type, with unions, intersections, conditionals, arrays and predicates."""
        k = self.k
        if k[self.i] in ("|", "&"):
            self.i += 1
        while True:
            self.type_part()
            if k[self.i] in ("|", "&"):
                self.i += 1
                continue
            if self.t[self.i] == "is" and not self.nl[self.i]:
                self.i += 1
                continue
            break
        if k[self.i] == "extends" and not self.nl[self.i]:
            self.i += 1
            self.type()
            self.need("?")
            self.type()
            self.need(":")
            self.type()

    def type_part(self):
        i, k = self.i, self.k
        a, t = k[i], self.t[i]
        if a == "i" and t in ("keyof", "readonly", "unique", "infer", "asserts") and k[i + 1] in ("i", "typeof", "(", "[", "{", "this"):
            self.i += 1
            return self.type_part()
        if a == "new" or (a == "i" and t == "abstract" and k[i + 1] == "new"):
            self.i += 1 + (a != "new")
            return self.type_part()
        if a == "<":
            self.angles()
            return self.type_part()
        if a == "(":
            j = self.match.get(i)
            if j is None:
                self.fail("expected )")
            if k[j + 1] == "=>":
                self.i += 1
                self.items(")", self.parameter)
                self.i += 1
                return self.type()
            self.i += 1
            self.type()
            self.need(")")
        elif a == "{":
            self.i += 1
            while k[self.i] != "}":
                self.type_member()
            self.i += 1
        elif a == "[":
            self.i += 1
            self.items("]", self.tuple_member)
        elif a == "typeof":
            self.i += 1
            return self.type_part()
        elif a == "-" and k[i + 1] == "n":
            self.i += 2
        elif a in ("i", "s", "n", "void", "null", "this", "true", "false", "import", "super"):
            self.i += 1
            if a == "import" and k[self.i] == "(":
                self.i = self.match.get(self.i, self.i) + 1
            while k[self.i] == ".":
                self.i += 2
            if k[self.i] == "<" and not self.nl[self.i]:
                self.angles()
        else:
            self.fail("expected a type")
        while k[self.i] == "[" and not self.nl[self.i]:
            self.i += 1
            if k[self.i] != "]":
                self.type()
            self.need("]")

    def tuple_member(self):
        self.have("...")
        if self.k[self.i] == "i" and (self.k[self.i + 1] == ":" or (self.k[self.i + 1] == "?" and self.k[self.i + 2] == ":")):
            self.i += 2 if self.k[self.i + 1] == ":" else 3
        self.type()
        self.have("?")

    def type_member(self):
        k = self.k
        while self.t[self.i] in ("readonly", "get", "set", "+", "-", "static") and k[self.i + 1] not in (":", "(", "?", ";", ","):
            self.i += 1
        if k[self.i] == "new":
            self.i += 1
        if k[self.i] == "[":
            self.i = self.match.get(self.i, self.i) + 1
        elif k[self.i] in ("i", "s", "n") or k[self.i] in self.KINDS.words:
            self.i += 1
        elif k[self.i] not in ("(", "<"):
            self.fail("expected a type member")
        if k[self.i] in ("-", "+"):
            self.i += 1
        self.have("?")
        if k[self.i] == "<":
            self.angles()
        if self.have("("):
            self.items(")", self.parameter)
        if self.have(":"):
            self.type()
        if k[self.i] in (";", ","):
            self.i += 1
        elif k[self.i] != "}" and not self.nl[self.i]:
            self.fail("expected ;")


TypeScript.TABLE = JavaScript.TABLE | {"const": TypeScript.declare, "enum": TypeScript.enum}
