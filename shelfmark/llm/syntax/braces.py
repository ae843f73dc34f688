"""Java, C#, C and Go."""

from __future__ import annotations

import re

from shelfmark.llm.syntax.base import Bad, Kinds, Parser, levels, lexer

STRING = r'"(?:[^"\\\n]|\\.)*"'
CHAR = r"'(?:[^'\\\n]|\\[^\n]{1,9}?)'"
NUMBER = r"0[xX][\da-fA-F_]*\.?[\da-fA-F_]*(?:[pP][+-]?\d+)?[uUlLfFdD]*|0[bB][01_]+[uUlL]*|(?:\d[\d_']*(?:\.(?!\.)[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?[uUlLfFdDmMi]*(?!\w)"
SKIP = r"[ \t\r\f\v\xa0﻿]+|//[^\n]*|/\*[\s\S]*?\*/"
NAMES_ONLY = r"[A-Za-z_\u0080-￿]\w*"
NAMES = r"[A-Za-z_$\u0080-￿][\w$]*"


class Typed(Parser):
    """What Java and C# share: types told from expressions by looking ahead."""

    PRIMITIVES: frozenset[str] = frozenset()
    MODIFIERS: frozenset[str] = frozenset()
    CALLS_ONLY = True
    ANGLE = frozenset()

    def angle_end(self, i):
        depth, k = 0, self.k
        while True:
            a = k[i]
            if a == "<":
                depth += 1
            elif a == ">":
                depth -= 1
                if not depth:
                    return i + 1
            elif a == "[" or a == "(":
                j = self.match.get(i)
                if j is None:
                    return -1
                i = j
            elif a not in self.ANGLE and a not in self.PRIMITIVES:
                return -1
            i += 1

    def type_end(self, i):
        """Index after the type that begins at i, or -1."""
        k = self.k
        while k[i] == "@":
            i += 2
            if k[i] == "(":
                i = self.match.get(i, i) + 1
        a = k[i]
        if a in self.PRIMITIVES:
            i += 1
        elif a == "i":
            i += 1
            while True:
                if k[i] == "<":
                    i = self.angle_end(i)
                    if i < 0:
                        return -1
                if k[i] in (".", "::") and k[i + 1] == "i":
                    i += 2
                else:
                    break
        elif a == "(" and self.NAME == "c#":
            j = self.match.get(i)
            if j is None or j < i + 3:
                return -1
            i = j + 1
        else:
            return -1
        return self.type_tail(i)

    def type_tail(self, i):
        k = self.k
        while k[i] == "[" and k[i + 1] == "]":
            i += 2
        return i

    def type(self):
        j = self.type_end(self.i)
        if j < 0:
            self.fail("expected a type")
        self.i = j

    def expression_statement(self):
        start = self.i
        self.expr()
        end = self.i
        self.need(";")
        if self.CALLS_ONLY:
            k = self.k
            if k[start] in ("++", "--", "new", "await") or k[end - 1] in (")", "++", "--") or (self.NAME == "java" and k[start] == "switch"):
                return
            for j in range(start, end):
                if self.BINARY.get(k[j]) == 1:
                    return
            raise Bad(start, "not a statement")

    def paren(self):
        self.need("(")
        self.expr()
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
        self.need(";")

    def return_(self):
        self.i += 1
        if self.k[self.i] != ";":
            self.expr()
        self.need(";")

    def jump(self):
        self.i += 1
        self.have("i")
        self.need(";")

    def empty(self):
        self.i += 1

    def argument(self):
        self.expr()

    def declarators(self):
        while True:
            self.name()
            while self.k[self.i] == "[":
                self.need("[")
                if self.k[self.i] != "]":
                    self.expr()
                self.need("]")
            if self.have("="):
                self.value()
            if not self.have(","):
                return

    def value(self):
        if self.k[self.i] == "{":
            self.array()
        else:
            self.expr()

    def array(self):
        self.need("{")
        self.items("}", self.value)

    def arguments(self):
        self.need("(")
        self.items(")", self.argument, trailing=False)


# Reserved words.
JAVA_WORDS = (
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if "
    "implements import instanceof int interface long native new package private protected public return short static strictfp super switch "
    "synchronized this throw throws transient try void volatile while true false null"
)


class Java(Typed):
    NAME = "java"
    LEX = lexer(rf'{NAMES}|{NUMBER}|"""[ \t\r\f]*\n(?:[^\\"]|\\[\s\S]|"(?!""))*"""|{STRING}|{CHAR}|\.\.\.|->|::|<<=|==|!=|<=|>=|&&|\|\||\+\+|--|[-+*/%&|^]=|<<', SKIP)
    KINDS = Kinds(JAVA_WORDS)
    PRIMITIVES = frozenset("boolean byte char double float int long short void".split())
    MODIFIERS = frozenset("public protected private static abstract final native synchronized transient volatile strictfp default".split())
    BINARY = levels("= += -= *= /= %= &= |= ^= <<=", "?", "||", "&&", "|", "^", "&", "== !=", "< > <= >= instanceof", "<<", "+ -", "* / %")
    PREFIX = frozenset("+ - ! ~ ++ --".split())
    ANGLE = frozenset("i , . ? & extends super @".split())

    def file(self):
        self.statements("", self.top)

    def top(self):
        if self.have(";"):
            return
        if self.k[self.i] in ("package", "import"):
            self.i += 1
            self.have("static")
            self.name()
            while self.have("."):
                if self.k[self.i] == "*":
                    self.i += 1
                else:
                    self.name()
            return self.need(";")
        self.modifiers()
        if self.k[self.i] == "package":
            return self.top()
        if not self.kind():
            self.fail("expected a class, interface, enum or record")

    def modifiers(self):
        k = self.k
        while True:
            a = k[self.i]
            if a == "@" and k[self.i + 1] != "interface":
                self.i += 1
                self.name()
                while self.have("."):
                    self.name()
                if self.have("("):
                    self.items(")", self.annotation_value)
            elif a in self.MODIFIERS and not (a == "default" and k[self.i + 1] in (":", "->")):
                self.i += 1
            elif a == "i" and self.t[self.i] in ("sealed", "non") and k[self.i + 1] in ("i", "class", "interface", "-", "public", "abstract"):
                self.i += 3 if self.t[self.i] == "non" else 1
            else:
                return

    def annotation_value(self):
        if self.k[self.i] == "i" and self.k[self.i + 1] == "=":
            self.i += 2
        if self.k[self.i] == "@":
            self.modifiers()
        elif self.k[self.i] == "{":
            self.i += 1
            self.items("}", self.annotation_value)
        else:
            self.expr(2)

    def kind(self) -> bool:
        k, a = self.k, self.k[self.i]
        if a == "@" and k[self.i + 1] == "interface":
            self.i += 1
            a = "interface"
        record = a == "i" and self.t[self.i] == "record" and k[self.i + 1] == "i" and k[self.i + 2] in ("(", "<")
        if a not in ("class", "interface", "enum") and not record:
            return False
        self.i += 1
        self.name()
        if k[self.i] == "<":
            self.angles()
        if record:
            self.need("(")
            self.items(")", self.parameter, trailing=False)
        while k[self.i] in ("extends", "implements") or self.t[self.i] == "permits":
            self.i += 1
            self.type()
            while self.have(","):
                self.type()
        if a == "enum":
            self.need("{")
            while k[self.i] in ("i", "@"):
                self.modifiers()
                self.name()
                if k[self.i] == "(":
                    self.arguments()
                if k[self.i] == "{":
                    self.block(self.member)
                if not self.have(","):
                    break
            if self.have(";"):
                self.statements("}", self.member)
            self.need("}")
        else:
            self.block(self.member)
        return True

    def angles(self):
        j = self.angle_end(self.i)
        if j < 0:
            self.fail("expected type parameters")
        self.i = j

    def member(self):
        if self.have(";"):
            return
        k = self.k
        if k[self.i] == "{" or (k[self.i] == "static" and k[self.i + 1] == "{"):
            self.have("static")
            return self.block()
        self.modifiers()
        if self.kind():
            return
        if k[self.i] == "<":
            self.angles()
        if k[self.i] == "i" and k[self.i + 1] in ("(", "{"):  # constructor
            self.i += 1
            if k[self.i] == "{":
                return self.block()
        else:
            self.type()
            if k[self.i + 1] != "(":
                self.declarators()
                return self.need(";")
            self.name()
        self.need("(")
        self.items(")", self.parameter, trailing=False)
        self.i = self.type_tail(self.i)
        if self.have("throws"):
            self.type()
            while self.have(","):
                self.type()
        if self.have("default"):
            self.annotation_value()
        if not self.have(";"):
            self.block()

    def parameter(self):
        self.modifiers()
        self.type()
        self.have("...")
        if not self.have("this"):
            self.name()
        self.i = self.type_tail(self.i)

    def statement(self):
        i, k = self.i, self.k
        a = k[i]
        f = self.TABLE.get(a)
        if f:
            return f(self)
        if a == "i":
            if k[i + 1] == ":":
                self.i += 2
                return self.statement()
            if self.t[i] == "yield" and k[i + 1] not in ("=", ".", "(", "++", "--", "["):
                return self.return_()
        if a in self.MODIFIERS or a == "@" or a in ("class", "interface", "enum") or (a == "i" and self.t[i] in ("record", "sealed")):
            if a == "synchronized" and k[i + 1] == "(":
                self.i += 1
                self.paren()
                return self.block()
            self.modifiers()
            if self.kind():
                return
            if a != "i":
                self.type()
                self.declarators()
                return self.need(";")
        if self.is_declaration():
            self.type()
            self.declarators()
            return self.need(";")
        self.expression_statement()

    def is_declaration(self):
        j = self.type_end(self.i)
        return j > 0 and self.k[j] == "i" and self.k[j + 1] in ("=", ";", ",", "[", ":", "i", "n", "s", "}", "")

    def for_(self):
        self.i += 1
        self.need("(")
        if self.k[self.i] != ";":
            self.modifiers()
            if self.is_declaration():
                self.type()
                if self.k[self.i + 1] == ":":
                    self.i += 2
                    self.expr()
                    self.need(")")
                    return self.statement()
                self.declarators()
            else:
                self.expr()
                while self.have(","):
                    self.expr()
        self.need(";")
        if self.k[self.i] != ";":
            self.expr()
        self.need(";")
        self.items(")", self.expr, trailing=False)
        self.statement()

    def try_(self):
        self.i += 1
        ok = False
        if self.have("("):
            ok = True
            while self.k[self.i] != ")":
                self.modifiers()
                if self.is_declaration():
                    self.type()
                    self.declarators()
                else:
                    self.expr()
                if not self.have(";"):
                    break
            self.need(")")
        self.block()
        while self.have("catch"):
            ok = True
            self.need("(")
            self.modifiers()
            self.type()
            while self.have("|"):
                self.type()
            self.name()
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
        if self.have("default"):
            pass
        else:
            self.need("case")
            while True:
                if not self.have("default"):
                    if self.is_declaration() or (self.type_end(self.i) > 0 and self.k[self.type_end(self.i)] == "i"):
                        self.type()
                        self.name()
                    else:
                        self.expr(2)
                if self.t[self.i] == "when":
                    self.i += 1
                    self.expr(2)
                if not self.have(","):
                    break
        if self.have("->"):
            if self.k[self.i] == "{":
                return self.block()
            if self.k[self.i] == "throw":
                return self.statement()
            self.expr()
            return self.need(";")
        self.need(":")
        while self.k[self.i] not in ("case", "default", "}", ""):
            self.statement()

    def throw(self):
        self.i += 1
        self.expr()
        self.need(";")

    def assert_(self):
        self.i += 1
        self.expr()
        if self.have(":"):
            self.expr()
        self.need(";")

    def binary(self, op):
        k = self.k
        if op == "instanceof":
            self.i += 1
            self.have("final")
            self.type()
            if k[self.i] == "(":
                self.i = self.match.get(self.i, self.i) + 1
            self.have("i")
            return True
        if op == ">":
            self.i += 1
            while k[self.i] in (">", ">="):
                self.i += 1
            self.have("=")
            self.expr(11)
            return True
        return super().binary(op)

    def lambda_body(self):
        if self.k[self.i] == "{":
            self.block()
        else:
            self.expr()

    def primary(self):
        i, k = self.i, self.k
        a = k[i]
        if a == "i":
            if k[i + 1] == "->":
                self.i += 2
                return self.lambda_body()
            if k[i + 1] in ("[", "<"):
                j = self.type_end(i)
                if j > 0 and k[j] == "::":
                    self.i = j
                    return
                if k[i + 1] == "[" and k[i + 2] == "]":
                    self.i = j
                    return
            self.i += 1
        elif a in ("n", "s", "this", "super", "null", "true", "false"):
            self.i += 1
        elif a == "(":
            j = self.match.get(i)
            if j is None:
                self.fail("expected )")
            if k[j + 1] == "->":
                self.i += 1
                if k[self.i] == "i" and k[self.i + 1] in (",", ")"):
                    self.items(")", self.name, trailing=False)
                else:
                    self.items(")", self.parameter, trailing=False)
                self.need("->")
                return self.lambda_body()
            e = self.type_end(i + 1)
            while e > 0 and k[e] == "&":
                e = self.type_end(e + 1)
            if e == j and (k[i + 1] in self.PRIMITIVES or k[j + 1] in ("i", "n", "s", "(", "!", "~", "this", "super", "new", "true", "false", "null", "switch")):
                self.i = j + 1
                return self.unary()
            self.i += 1
            self.expr()
            self.need(")")
        elif a == "new":
            self.i += 1
            self.modifiers()
            j = self.i + 1 if k[self.i] in self.PRIMITIVES else -1
            if j < 0:
                self.name()
                while True:
                    if k[self.i] == "<":
                        if k[self.i + 1] == ">":
                            self.i += 2
                        else:
                            self.angles()
                    if not self.have("."):
                        break
                    self.name()
            else:
                self.i = j
            if k[self.i] == "[":
                while self.have("["):
                    if k[self.i] != "]":
                        self.expr()
                    self.need("]")
                if k[self.i] == "{":
                    self.array()
            else:
                self.arguments()
                if k[self.i] == "{":
                    self.block(self.member)
        elif a == "switch":
            self.switch()
        elif a in self.PRIMITIVES:
            self.type()
            if k[self.i] not in (".", "::"):
                self.fail("expected .class")
        elif a == "@":
            self.modifiers()
            self.primary()
        else:
            self.fail("expected an expression")

    def postfix(self):
        k = self.k
        while True:
            a = k[self.i]
            if a == ".":
                self.i += 1
                if k[self.i] == "<":
                    self.angles()
                if k[self.i] in ("class", "this", "super", "new"):
                    if k[self.i] == "new":
                        self.primary()
                    else:
                        self.i += 1
                else:
                    self.name()
            elif a == "(":
                self.arguments()
            elif a == "[":
                self.i += 1
                self.expr()
                self.need("]")
            elif a in ("++", "--"):
                self.i += 1
            elif a == "::":
                self.i += 1
                if not self.have("new"):
                    self.name()
            else:
                return


Java.TABLE = {
    "{": lambda p: p.block(), ";": Java.empty, "if": Java.if_, "while": Java.while_, "do": Java.do, "for": Java.for_, "return": Java.return_, "break": Java.jump,
    "continue": Java.jump, "try": Java.try_, "switch": lambda p: p.switch(), "throw": Java.throw, "assert": Java.assert_,
}

CS_WORDS = (
    "abstract as base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit extern "
    "false finally fixed float for foreach goto if implicit in int interface internal is lock long namespace new null object operator out override "
    "params private protected public readonly ref return sbyte sealed short sizeof stackalloc static string struct switch this throw true try typeof "
    "uint ulong unchecked unsafe ushort using virtual void volatile while"
)


class CSharp(Typed):
    NAME = "c#"
    LEX = lexer(
        rf'@?{NAMES_ONLY}|{NUMBER}|\$*"""[\s\S]*?"""|\$@"(?:[^"]|"")*"|@\$?"(?:[^"]|"")*"|\$"(?:[^"\\\n{{]|\\.|\{{\{{|\{{[^{{}}\n]*\}})*"|{STRING}|{CHAR}|\?\?=|=>|\?\?|\?\.|\?(?=\[)|\.\.|->|::|<<=|==|!=|<=|>=|&&|\|\||\+\+|--|[-+*/%&|^]=|<<',
        SKIP + r"|(?<![^\n])[ \t]*#[^\n]*",
    )
    KINDS = Kinds(CS_WORDS, "_@")
    PRIMITIVES = frozenset("bool byte char decimal double float int long object sbyte short string uint ulong ushort void".split())
    MODIFIERS = frozenset("public protected private internal static abstract sealed override virtual readonly const new extern unsafe volatile".split())
    SOFT_MODIFIERS = frozenset("async partial required file scoped".split())
    BINARY = levels("= += -= *= /= %= &= |= ^= <<= ??=", "? ", "??", "||", "&&", "|", "^", "&", "== !=", "< > <= >= is as", "<<", "+ -", "* / %", "..")
    PREFIX = frozenset("+ - ! ~ ++ -- & * ^ ..".split())
    ANGLE = frozenset("i , . ? in out :: *".split())
    CALLS_ONLY = True

    def file(self):
        self.statements("", self.top)

    def attributes(self):
        while self.k[self.i] == "[" and self.i in self.match:
            self.i += 1
            if self.k[self.i + 1] == ":":
                self.i += 2
            self.items("]", self.attribute)

    def attribute(self):
        self.type()
        if self.have("("):
            self.items(")", self.argument)

    def top(self):
        k, a = self.k, self.k[self.i]
        if a == ";":
            self.i += 1
        elif a == "using" or (a == "i" and self.t[self.i] == "global" and k[self.i + 1] == "using"):
            if k[self.i + 1] in ("(",) or (k[self.i + 1] == "i" and k[self.i + 2] == "i"):
                return self.statement()
            self.i += 1 + (a != "using")
            self.have("static")
            if k[self.i + 1] == "=":
                self.i += 2
            self.type()
            self.need(";")
        elif a == "namespace":
            self.i += 1
            self.type()
            if not self.have(";"):
                self.block(self.top)
        elif a == "extern" and self.t[self.i + 1] == "alias":
            self.i += 3
            self.need(";")
        else:
            start = self.i
            self.attributes()
            self.modifiers()
            if not self.kind():
                if self.i != start and k[start] not in ("i", "static"):
                    self.fail("expected a type")
                self.i = start
                self.statement()

    def modifiers(self):
        k = self.k
        while k[self.i] in self.MODIFIERS or (k[self.i] == "i" and self.t[self.i] in self.SOFT_MODIFIERS and (k[self.i + 1] in ("i", "class", "struct", "interface", "(") or k[self.i + 1] in self.MODIFIERS or k[self.i + 1] in self.PRIMITIVES)) or (k[self.i] == "ref" and k[self.i + 1] in ("struct", "readonly", "i")):
            if k[self.i] == "i" and k[self.i + 1] == "(":
                return
            self.i += 1

    def kind(self) -> bool:
        k, a = self.k, self.k[self.i]
        if a == "delegate" and k[self.i + 1] not in ("(", "{"):
            self.i += 1
            self.type()
            self.name()
            self.generic_parameters()
            self.parameters()
            self.constraints()
            self.need(";")
            return True
        record = a == "i" and self.t[self.i] == "record" and k[self.i + 1] in ("i", "class", "struct") and k[self.i + 2] in ("(", "{", "<", ":", ";", "i")
        if a not in ("class", "struct", "interface", "enum") and not record:
            return False
        self.i += 1
        if record and k[self.i] in ("class", "struct"):
            self.i += 1
        self.name()
        self.generic_parameters()
        if k[self.i] == "(":
            self.parameters()
        if self.have(":"):
            while True:
                self.type()
                if k[self.i] == "(":
                    self.arguments()
                if not self.have(","):
                    break
        self.constraints()
        if a == "enum":
            self.need("{")
            self.items("}", self.enum_member)
        elif k[self.i] == "{":
            self.block(self.member)
        elif record or a != "enum":
            return self.need(";") or True
        self.have(";")
        return True

    def enum_member(self):
        self.attributes()
        self.name()
        if self.have("="):
            self.expr()

    def generic_parameters(self):
        if self.k[self.i] == "<":
            j = self.angle_end(self.i)
            if j < 0:
                self.fail("expected type parameters")
            self.i = j

    def constraints(self):
        while self.t[self.i] == "where" and self.k[self.i + 1] == "i":
            self.i += 2
            self.need(":")
            while True:
                if self.k[self.i] in ("class", "struct", "default"):
                    self.i += 1
                    self.have("?")
                elif self.have("new"):
                    self.arguments()
                else:
                    self.type()
                if not self.have(","):
                    break

    def parameters(self):
        self.need("(")
        self.items(")", self.parameter, trailing=False)

    def parameter(self):
        self.attributes()
        while self.k[self.i] in ("ref", "out", "in", "params", "this", "readonly") or self.t[self.i] == "scoped":
            self.i += 1
        self.type()
        self.name()
        if self.have("="):
            self.expr()

    def type_tail(self, i):
        k = self.k
        while True:
            if k[i] == "[" and k[i + 1] in ("]", ","):
                j = self.match.get(i)
                if j is None or any(x != "," for x in k[i + 1 : j]):
                    return i
                i = j + 1
            elif k[i] == "?" and k[i + 1] in ("i", ">", ")", ",", "[", "this"):
                i += 1
            elif k[i] == "*" and k[i + 1] in ("i", ")", "*", ">", ","):
                i += 1
            else:
                return i

    def member(self):
        if self.have(";"):
            return
        k = self.k
        self.attributes()
        self.modifiers()
        if self.kind():
            return
        if k[self.i] == "~":
            self.i += 1
        if k[self.i] == "event":
            self.i += 1
        if k[self.i] in ("implicit", "explicit"):
            self.i += 1
            self.need("operator")
            self.type()
            self.parameters()
            return self.body()
        if k[self.i] == "i" and k[self.i + 1] == "(":  # constructor
            self.i += 1
            self.parameters()
            if self.have(":"):
                if k[self.i] not in ("base", "this"):
                    self.fail("expected base or this")
                self.i += 1
                self.arguments()
            return self.body()
        self.have("ref")
        self.type()
        if self.have("operator"):
            self.i += 1
            while k[self.i] in (">", "="):
                self.i += 1
            self.parameters()
            return self.body()
        if k[self.i] == "this":
            self.i += 1
            self.need("[")
            self.items("]", self.parameter)
            return self.accessors()
        self.name()
        while k[self.i] in (".", "<"):
            if k[self.i] == "<":
                self.generic_parameters()
            else:
                self.i += 1
                if k[self.i] == "this":
                    self.i += 1
                else:
                    self.name()
        if k[self.i] == "(":
            self.parameters()
            self.constraints()
            return self.body()
        if k[self.i] == "{":
            return self.accessors()
        if self.have("=>"):
            self.expr()
            return self.need(";")
        if self.have("="):
            self.value()
        if self.have(","):
            self.declarators()
        self.need(";")

    def body(self):
        if self.have(";"):
            return
        if self.have("=>"):
            self.expr()
            return self.need(";")
        self.block()

    def accessors(self):
        if self.have("=>"):
            self.expr()
            return self.need(";")
        self.need("{")
        while self.k[self.i] != "}":
            self.attributes()
            self.modifiers()
            if self.t[self.i] not in ("get", "set", "init", "add", "remove"):
                self.fail("expected an accessor")
            self.i += 1
            self.body()
        self.i += 1
        if self.have("="):
            self.value()
            self.need(";")

    def statement(self):
        i, k = self.i, self.k
        a = k[i]
        f = self.TABLE.get(a)
        if f:
            return f(self)
        if a == "i":
            if k[i + 1] == ":" and k[i + 2] != ":":
                self.i += 2
                return self.statement()
            t = self.t[i]
            if t == "yield" and k[i + 1] in ("return", "break"):
                self.i += 1
                return self.statement()
            if t == "await" and k[i + 1] in ("foreach", "using"):
                self.i += 1
                return self.statement()
        if a in ("static", "const", "unsafe", "extern", "readonly", "ref") or (a == "i" and self.t[i] in ("async", "scoped") and k[i + 1] != "("):
            self.modifiers()
            self.have("ref")
        if a == "[" and i in self.match:
            self.attributes()
        if self.declaration():
            return
        self.expression_statement()

    def declaration(self):
        j = self.type_end(self.i)
        k = self.k
        if j > 0 and k[j] == "i" and (self.t[self.i] not in ("await", "throw") or k[self.i] != "i"):
            b = k[j + 1]
            if b in ("(", "<"):  # local function
                self.i = j + 1
                self.generic_parameters()
                self.parameters()
                self.constraints()
                self.body()
                return True
            if b in ("=", ";", ",", "i", "n", "s", "}", "", "in") and self.t[j] not in ("is", "as", "switch", "with"):
                self.i = j
                self.declarators()
                self.need(";")
                return True
        if k[self.i] == "i" and self.t[self.i] == "var" and k[self.i + 1] == "(":
            self.i = self.match.get(self.i + 1, self.i) + 1
            self.need("=")
            self.expr()
            self.need(";")
            return True
        return False

    def for_(self):
        self.i += 1
        self.need("(")
        k = self.k
        if k[self.i] != ";":
            j = self.type_end(self.i)
            if j > 0 and k[j] == "i":
                self.i = j
                self.declarators()
            else:
                self.expr()
                while self.have(","):
                    self.expr()
        self.need(";")
        if k[self.i] != ";":
            self.expr()
        self.need(";")
        self.items(")", self.expr, trailing=False)
        self.statement()

    def foreach(self):
        self.i += 1
        self.need("(")
        self.have("ref")
        if self.t[self.i] == "var" and self.k[self.i + 1] == "(":
            self.i = self.match.get(self.i + 1, self.i) + 1
        elif self.k[self.i] == "(" and self.k[self.match.get(self.i, self.i) + 1] == "in":
            self.i = self.match[self.i] + 1
        else:
            self.type()
            self.name()
        self.need("in")
        self.expr()
        self.need(")")
        self.statement()

    def using(self):
        self.i += 1
        if self.have("("):
            j = self.type_end(self.i)
            if j > 0 and self.k[j] == "i":
                self.i = j
                self.declarators()
            else:
                self.expr()
            self.need(")")
            return self.statement()
        self.type()
        self.declarators()
        self.need(";")

    def paren_block(self):
        self.i += 1
        if self.k[self.i] == "(":
            self.need("(")
            if self.k[self.i - 2] == "fixed":
                self.type()
                self.declarators()
            else:
                self.expr()
            self.need(")")
        self.statement()

    def checked(self):
        if self.k[self.i + 1] == "{":
            self.i += 1
            return self.block()
        self.expression_statement()

    def try_(self):
        self.i += 1
        self.block()
        ok = False
        while self.have("catch"):
            ok = True
            if self.have("("):
                self.type()
                self.have("i")
                self.need(")")
            if self.t[self.i] == "when":
                self.i += 1
                self.paren()
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
        if not self.have("default"):
            self.need("case")
            self.pattern()
            if self.t[self.i] == "when":
                self.i += 1
                self.expr()
        self.need(":")
        while self.k[self.i] not in ("case", "default", "}", ""):
            self.statement()
        if self.k[self.i] == "default" and self.k[self.i + 1] != ":":
            self.statement()

    def pattern(self):
        while self.t[self.i] == "not":
            self.i += 1
        k = self.k
        if k[self.i] in ("<", ">", "<=", ">="):
            self.i += 1
            self.expr(11)
        elif k[self.i] in ("{", "[") or (k[self.i] == "(" and self.i in self.match):
            self.i = self.match.get(self.i, self.i) + 1
            self.have("i")
        else:
            j = self.type_end(self.i)
            if j > 0 and (k[j] == "i" and self.t[j] not in ("and", "or", "when")):
                self.i = j + 1
            elif j > 0 and k[j] in ("{", "("):
                self.i = self.match.get(j, j) + 1
                if k[self.i] == "{":
                    self.i = self.match.get(self.i, self.i) + 1
                if k[self.i] == "i" and self.t[self.i] not in ("and", "or", "when"):
                    self.i += 1
            elif j > 0 and k[j] not in (".", "(", "+", "-", "*", "/"):
                self.i = j
            else:
                self.expr(11)
        if self.t[self.i] in ("and", "or"):
            self.i += 1
            self.pattern()

    def throw(self):
        self.i += 1
        if self.k[self.i] != ";":
            self.expr()
        self.need(";")

    def goto(self):
        self.i += 1
        if self.have("case"):
            self.expr()
        elif not self.have("default"):
            self.name()
        self.need(";")

    def binary(self, op):
        k = self.k
        if op in ("is",):
            self.i += 1
            self.pattern()
            return True
        if op == "as":
            self.i += 1
            self.type()
            return True
        if op == ">":
            self.i += 1
            while k[self.i] in (">", ">="):
                self.i += 1
            self.have("=")
            self.expr(11)
            return True
        if op == "..":
            self.i += 1
            if k[self.i] not in ("]", ")", ",", ";"):
                self.expr(14)
            return True
        return super().binary(op)

    def argument(self):
        k = self.k
        if k[self.i] == "i" and k[self.i + 1] == ":" and k[self.i + 2] != ":":
            self.i += 2
        if k[self.i] in ("ref", "out", "in"):
            self.i += 1
            j = self.type_end(self.i)
            if j > 0 and k[j] == "i":
                self.i = j + 1
                return
        self.expr()

    def unary(self):
        k = self.k
        while k[self.i] in self.PREFIX or (k[self.i] == "i" and self.t[self.i] == "await" and k[self.i + 1] in ("i", "this", "base", "(", "new", "s")) or k[self.i] == "throw" or k[self.i] == "ref":
            self.i += 1
        self.primary()
        self.postfix()

    def lambda_body(self):
        if self.k[self.i] == "{":
            self.block()
        else:
            self.expr()

    def initializer(self):
        self.need("{")
        self.items("}", self.initial)

    def initial(self):
        k = self.k
        if k[self.i] == "{":
            return self.initializer()
        if k[self.i] == "[" and self.i in self.match and k[self.match[self.i] + 1] == "=":
            self.i = self.match[self.i] + 2
            return self.value()
        if k[self.i] == "i" and k[self.i + 1] == "=" :
            self.i += 2
            return self.value()
        self.expr()

    def value(self):
        if self.k[self.i] == "{":
            self.initializer()
        else:
            self.expr()

    def primary(self):
        i, k = self.i, self.k
        a = k[i]
        if a == "i":
            t = self.t[i]
            if k[i + 1] == "=>":
                self.i += 2
                return self.lambda_body()
            if t in ("async", "static") and k[i + 1] == "(" or t == "async" and k[i + 1] == "i" and k[i + 2] == "=>":
                if k[i + 1] == "i" or k[self.match.get(i + 1, i) + 1] == "=>":
                    self.i += 1
                    return self.primary()
            if t == "from" and k[i + 1] == "i" and k[i + 2] == "in":
                return self.query()
            if k[i + 1] == "<":
                j = self.angle_end(i + 1)
                if j > 0 and k[j] in ("(", ")", ".", ",", ";", "]", "}", "::", "?.", ":"):
                    self.i = j
                    return
            self.i += 1
            if k[self.i] == "::":
                self.i += 1
                self.name()
        elif a in ("n", "s", "this", "base", "null", "true", "false"):
            self.i += 1
        elif a == "(":
            j = self.match.get(i)
            if j is None:
                self.fail("expected )")
            if k[j + 1] == "=>":
                self.i += 1
                self.items(")", self.lambda_parameter, trailing=False)
                self.need("=>")
                return self.lambda_body()
            e = self.type_end(i + 1)
            if e == j and (k[i + 1] in self.PRIMITIVES or k[j + 1] in ("i", "n", "s", "(", "!", "~", "this", "base", "new", "true", "false", "null", "typeof", "default")) and self.t[j + 1] not in ("is", "as", "switch", "with", "and", "or"):
                self.i = j + 1
                return self.unary()
            self.i += 1
            self.items(")", self.tuple_item, trailing=False)
        elif a == "new":
            self.i += 1
            if k[self.i] == "{":
                return self.initializer()
            if k[self.i] == "[":
                self.i = self.match.get(self.i, self.i) + 1
                return self.initializer()
            if k[self.i] != "(":
                e = self.type_end(self.i)
                if e < 0:
                    self.fail("expected a type")
                self.i = e
            if k[self.i] == "[":
                self.i += 1
                self.items("]", self.expr)
                self.i = self.type_tail(self.i)
            elif k[self.i] == "(":
                self.arguments()
            elif k[self.i] != "{":
                self.fail("expected ( or {")
            if k[self.i] == "{":
                self.initializer()
        elif a in ("typeof", "sizeof", "default", "checked", "unchecked"):
            self.i += 1
            if k[self.i] == "(":
                if a in ("checked", "unchecked"):
                    self.arguments()
                else:
                    self.i = self.match.get(self.i, self.i) + 1
            elif a != "default":
                self.fail("expected (")
        elif a == "delegate":
            self.i += 1
            if k[self.i] == "(":
                self.parameters()
            self.block()
        elif a == "stackalloc":
            self.i += 1
            self.type()
            self.postfix()
        elif a in self.PRIMITIVES and k[i + 1] in (".", "?", "["):
            self.i += 1
        elif a == "static" and k[i + 1] in ("(", "i"):
            self.i += 1
            self.primary()
        elif a == "[":
            self.i += 1
            self.items("]", self.expr)
        else:
            self.fail("expected an expression")

    def tuple_item(self):
        k = self.k
        if k[self.i] == "i" and k[self.i + 1] == ":" and k[self.i + 2] != ":":
            self.i += 2
        j = self.type_end(self.i)
        if j > 0 and k[j] == "i" and k[j + 1] in (",", ")"):
            self.i = j + 1
            return
        self.expr()

    def lambda_parameter(self):
        if self.k[self.i] == "i" and self.k[self.i + 1] in (",", ")"):
            self.i += 1
        else:
            self.parameter()

    def query(self):
        while self.t[self.i] in ("from", "where", "select", "let", "join", "orderby", "group", "into") or self.k[self.i] == ",":
            w = self.t[self.i]
            self.i += 1
            if w in ("from", "join"):
                j = self.type_end(self.i)
                if j > 0 and self.k[j] == "i":
                    self.i = j
                self.name()
                self.need("in")
                self.expr()
                if w == "join":
                    for x in ("on", "equals"):
                        if self.t[self.i] != x:
                            self.fail(f"expected {x}")
                        self.i += 1
                        self.expr()
            elif w == "into":
                self.name()
            elif w == "let":
                self.name()
                self.need("=")
                self.expr()
            else:
                self.expr()
                if self.t[self.i] in ("ascending", "descending"):
                    self.i += 1
                if w == "group":
                    if self.t[self.i] != "by":
                        self.fail("expected by")
                    self.i += 1
                    self.expr()

    def postfix(self):
        k = self.k
        while True:
            a = k[self.i]
            if a in (".", "?.", "->"):
                self.i += 1
                self.name()
                if k[self.i] == "<":
                    j = self.angle_end(self.i)
                    if j > 0 and k[j] in ("(", ")", ".", ",", ";", "]", "}"):
                        self.i = j
            elif a == "(":
                self.arguments()
            elif a == "[" or (a == "?" and k[self.i + 1] == "[" and self.i + 1 in self.match and k[self.match[self.i + 1] + 1] != ":"):
                self.i += 1 + (a == "?")
                self.items("]", self.argument)
            elif a in ("++", "--"):
                self.i += 1
            elif a == "!" and k[self.i + 1] not in ("i", "(", "n", "s"):
                self.i += 1
            elif a == "switch" and k[self.i + 1] == "{":
                self.i += 1
                self.need("{")
                self.items("}", self.arm)
            elif a == "i" and self.t[self.i] == "with" and k[self.i + 1] == "{":
                self.i += 1
                self.initializer()
            else:
                return

    def arm(self):
        self.pattern()
        if self.t[self.i] == "when":
            self.i += 1
            self.expr()
        self.need("=>")
        self.expr()


CSharp.BINARY["?"] = 2
CSharp.TABLE = {
    "{": lambda p: p.block(), ";": CSharp.empty, "if": CSharp.if_, "while": CSharp.while_, "do": CSharp.do, "for": CSharp.for_, "foreach": CSharp.foreach, "return": CSharp.return_,
    "break": CSharp.jump, "continue": CSharp.jump, "try": CSharp.try_, "switch": CSharp.switch, "throw": CSharp.throw, "using": CSharp.using, "lock": CSharp.paren_block,
    "fixed": CSharp.paren_block, "unsafe": CSharp.paren_block, "checked": CSharp.checked, "unchecked": CSharp.checked, "goto": CSharp.goto,
}

C_WORDS = (
    "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed "
    "sizeof static struct switch typedef union unsigned void volatile while _Bool _Complex _Atomic _Alignas _Alignof _Noreturn _Static_assert "
    "_Thread_local _Generic __attribute__ __extension__ __inline __inline__ __restrict asm __asm__"
)
DIRECTIVE = re.compile(r"(?m)^[ \t]*#(?:[^\n\\]|\\\r?\n|\\.)*")


class C(Typed):
    NAME = "c"
    LEX = lexer(rf"[A-Za-z_$\u0080-￿][\w$]*+(?![\"'])|{NUMBER}|(?:u8|[uUL])?{STRING}|(?:[uUL])?'(?:[^'\\\n]|\\[^\n])+'|{NAMES}|{NUMBER}|\.\.\.|<<=|>>=|->|==|!=|<=|>=|&&|\|\||\+\+|--|[-+*/%&|^]=|<<|>>", SKIP + r"|\\\r?\n")
    KINDS = Kinds(C_WORDS, "_$")
    SPECS = frozenset("auto char const double extern float inline int long register restrict short signed static typedef unsigned void volatile _Bool _Complex _Atomic _Noreturn _Thread_local __extension__ __inline __inline__ __restrict".split())
    PRIMITIVES = frozenset("char double float int long short signed unsigned void _Bool const volatile struct union enum".split())
    BINARY = levels("= += -= *= /= %= &= |= ^= <<= >>=", "?", "||", "&&", "|", "^", "&", "== !=", "< > <= >=", "<< >>", "+ -", "* / %")
    PREFIX = frozenset("+ - ! ~ ++ -- & * __extension__".split())
    CALLS_ONLY = False

    def read(self, src):
        return super().read(DIRECTIVE.sub(lambda m: "\n" * m.group().count("\n"), src) if "#" in src else src)

    def file(self):
        self.statements("", self.external)

    def attributes(self):
        while self.k[self.i] in ("__attribute__", "_Alignas", "asm", "__asm__"):
            self.i += 1
            if self.k[self.i] != "(":
                self.fail("expected (")
            self.i = self.match.get(self.i, self.i) + 1

    def specifiers(self) -> bool:
        """Declaration specifiers; a lone identifier counts as a type if a declarator can follow."""
        k, got, base = self.k, False, False
        while True:
            a = k[self.i]
            if a in self.SPECS:
                self.i += 1
                base = base or a not in ("const", "static", "extern", "typedef", "inline", "volatile", "register", "restrict", "_Noreturn", "_Thread_local", "__extension__", "__inline", "__inline__", "__restrict")
            elif a in ("struct", "union", "enum"):
                self.i += 1
                self.attributes()
                named = self.have("i")
                if k[self.i] == "{":
                    self.i += 1
                    if a == "enum":
                        self.items("}", self.enumerator)
                    else:
                        while k[self.i] != "}":
                            self.field()
                        self.i += 1
                elif not named:
                    self.fail("expected a name or {")
                base = True
            elif a in ("__attribute__", "_Alignas"):
                self.attributes()
            elif a == "i" and not base and (k[self.i + 1] in ("i", "*", "const") or k[self.i + 1] in self.SPECS or (got and k[self.i + 1] in ("(", ")", ",", "["))):
                self.i += 1
                base = True
            else:
                return got
            got = True

    def enumerator(self):
        self.name()
        if self.have("="):
            self.expr(2)

    def field(self):
        if self.have(";"):
            return
        if not self.specifiers():
            self.fail("expected a field")
        if self.k[self.i] != ";":
            while True:
                if self.k[self.i] != ":":
                    self.declarator()
                if self.have(":"):
                    self.expr(2)
                self.attributes()
                if not self.have(","):
                    break
        self.need(";")

    def declarator(self, abstract=False):
        k = self.k
        while k[self.i] in ("*", "const", "volatile", "restrict", "__restrict", "_Atomic"):
            self.i += 1
        self.attributes()
        if k[self.i] == "(" and k[self.i + 1] in ("*", "(", "i") and not (abstract and k[self.i + 1] == "i"):
            self.i += 1
            self.declarator(abstract)
            self.need(")")
        elif k[self.i] == "i":
            self.i += 1
        elif not abstract:
            self.fail("expected a declarator")
        while True:
            if k[self.i] == "[":
                self.i += 1
                while k[self.i] in ("static", "const", "restrict", "volatile"):
                    self.i += 1
                if k[self.i] == "*" and k[self.i + 1] == "]":
                    self.i += 1
                if k[self.i] != "]":
                    self.expr()
                self.need("]")
            elif k[self.i] == "(":
                self.i += 1
                self.items(")", self.parameter, trailing=False)
            else:
                break
        self.attributes()

    def parameter(self):
        if self.have("..."):
            return
        if not self.specifiers():
            self.name()
            return
        if self.k[self.i] not in (",", ")"):
            self.declarator(True)

    def external(self):
        k = self.k
        if self.have(";"):
            return
        if k[self.i] == "i" and k[self.i + 1] == "(" and (j := self.match.get(self.i + 1)) and (k[j + 1] in ("", ";") or self.nl[j + 1]) and k[j + 1] != "{":
            self.i = j + 1  # a macro used as a declaration
            self.have(";")
            return
        if k[self.i] == "_Static_assert":
            return self.expression_statement()
        if k[self.i] == "extern" and k[self.i + 1] == "s":
            self.i += 2
            if k[self.i] == "{":
                return self.block(self.external)
        if not self.specifiers():
            self.fail("expected a declaration")
        if self.have(";"):
            return
        self.declarator()
        if k[self.i] == "{":
            return self.block()
        if k[self.i] not in ("=", ",", ";"):
            while self.specifiers():  # parameters declared the old way
                self.declarator()
                self.need(";")
            if k[self.i] == "{":
                return self.block()
        self.rest()

    def rest(self):
        while True:
            if self.have("="):
                self.value()
            if not self.have(","):
                break
            self.declarator()
        self.need(";")

    def value(self):
        if self.k[self.i] == "{":
            self.i += 1
            self.items("}", self.member_value)
        else:
            self.expr()

    def member_value(self):
        k = self.k
        start = self.i
        while k[self.i] in (".", "["):
            if self.have("."):
                self.name()
            else:
                self.i += 1
                self.expr()
                if self.have("..."):
                    self.expr()
                self.need("]")
        if self.i > start:
            self.need("=")
        self.value()

    def sequence(self):
        self.expr()
        while self.have(","):
            self.expr()

    def paren(self):
        self.need("(")
        self.sequence()
        self.need(")")

    def statement(self):
        i, k = self.i, self.k
        a = k[i]
        f = self.TABLE.get(a)
        if f:
            return f(self)
        if a == "i":
            b = k[i + 1]
            if b == ":":
                self.i += 2
                return self.statement() if k[self.i] != "}" else None
            if b == "i" or (b == "*" and (k[i + 2] == "*" or (k[i + 2] == "i" and k[i + 3] in ("=", ";", ",", "[")))):
                self.specifiers()
                self.declarator()
                return self.rest()
        elif a in self.SPECS or a in ("struct", "union", "enum", "__attribute__"):
            self.specifiers()
            if self.have(";"):
                return
            self.declarator()
            return self.rest()
        self.sequence()
        self.need(";")

    def case(self):
        if self.k[self.i] == "case":
            self.i += 1
            self.expr(2)
            if self.have("..."):
                self.expr(2)
        else:
            self.i += 1
        self.need(":")

    def switch(self):
        self.i += 1
        self.paren()
        self.statement()

    def return_(self):
        self.i += 1
        if self.k[self.i] != ";":
            self.sequence()
        self.need(";")

    def goto(self):
        self.i += 1
        self.name()
        self.need(";")

    def asm(self):
        self.i += 1
        while self.k[self.i] in ("volatile", "goto", "i"):
            self.i += 1
        self.i = self.match.get(self.i, self.i) + 1
        self.need(";")

    def for_(self):
        self.i += 1
        self.need("(")
        if not self.have(";"):
            if self.k[self.i] in self.SPECS or self.k[self.i] == "struct" or (self.k[self.i] == "i" and self.k[self.i + 1] in ("i",)):
                self.specifiers()
                self.declarator()
                self.rest()
            else:
                self.sequence()
                self.need(";")
        if self.k[self.i] != ";":
            self.sequence()
        self.need(";")
        if self.k[self.i] != ")":
            self.sequence()
        self.need(")")
        self.statement()

    def is_type(self, i):
        k = self.k
        if k[i] in self.SPECS or k[i] in ("struct", "union", "enum"):
            return True
        if k[i] != "i":
            return False
        j = i + 1
        while k[j] in ("*", "const"):
            j += 1
        return k[j] == ")" and (j > i + 1 or k[j + 1] in ("i", "n", "s", "(", "{", "!", "~", "sizeof"))

    def primary(self):
        i, k = self.i, self.k
        a = k[i]
        if a == "s":
            while k[self.i] == "s" or (k[self.i] == "i" and (k[self.i + 1] == "s" or self.t[self.i].startswith(("PRI", "SCN")))):
                self.i += 1
        elif a in ("i", "n"):
            self.i += 1
        elif a == "(":
            if k[i + 1] == "{":
                self.i += 1
                self.block()
                return self.need(")")
            if self.is_type(i + 1):
                self.i += 1
                self.specifiers() or self.name()
                if k[self.i] != ")":
                    self.declarator(True)
                self.need(")")
                if k[self.i] == "{":
                    return self.value()
                return self.unary()
            self.i += 1
            self.sequence()
            self.need(")")
        elif a in ("sizeof", "_Alignof", "_Generic"):
            self.i += 1
            if k[self.i] == "(":
                self.i = self.match.get(self.i, self.i) + 1
            else:
                self.unary()
        else:
            self.fail("expected an expression")

    def argument(self):
        if self.is_type(self.i) and self.k[self.i] != "i":
            self.specifiers()
            if self.k[self.i] not in (",", ")"):
                self.declarator(True)
        else:
            self.expr()

    def postfix(self):
        k = self.k
        while True:
            a = k[self.i]
            if a in (".", "->"):
                self.i += 1
                self.name()
            elif a == "(":
                self.arguments()
            elif a == "[":
                self.i += 1
                self.sequence()
                self.need("]")
            elif a in ("++", "--"):
                self.i += 1
            else:
                return

    def if_(self):
        self.i += 1
        self.paren()
        self.statement()
        if self.have("else"):
            self.statement()


C.TABLE = {
    "{": lambda p: p.block(), ";": C.empty, "if": C.if_, "while": C.while_, "do": C.do, "for": C.for_, "return": C.return_, "break": C.jump, "continue": C.jump,
    "switch": C.switch, "case": C.case, "default": C.case, "goto": C.goto, "asm": C.asm, "__asm__": C.asm,
}

GO_WORDS = "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var"


class Go(Typed):
    NAME = "go"
    LEX = lexer(rf"[A-Za-z_\u0080-￿]\w*|{NUMBER}|`[^`]*`|{STRING}|{CHAR}|\.\.\.|<<=|>>=|&\^=|&\^|<-|:=|==|!=|<=|>=|&&|\|\||\+\+|--|[-+*/%&|^]=|<<|>>", r"[ \t\r\f\v\xa0﻿]+|//[^\n]*|/\*[^\n]*?\*/")
    KINDS = Kinds(GO_WORDS, "_")
    BINARY = levels("||", "&&", "== != < > <= >=", "+ - | ^", "* / % << >> & &^")
    RIGHT = 0
    PREFIX = frozenset("+ - ! ^ * & <- ~".split())
    ASSIGN = frozenset("= := += -= *= /= %= &= |= ^= <<= >>= &^=".split())
    LINE_ENDS = frozenset(["i", "n", "s", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"])

    def read(self, src):
        tokens, lines, kinds, ends = [], [], self.KINDS, self.LINE_ENDS
        if "/*" in src:  # a comment over lines counts as a line end
            src = re.sub(r"(`[^`]*`|\"(?:[^\"\\\n]|\\.)*\"|//[^\n]*)|/\*[\s\S]*?\*/", lambda m: m.group(1) or "\n" * m.group().count("\n") or " ", src)
        for x in self.LEX.findall(src):
            if x == "\n":
                if tokens and kinds[tokens[-1]] in ends:
                    tokens.append(";")
                    lines.append(False)
            elif x:
                tokens.append(x)
                lines.append(False)
        if tokens and kinds[tokens[-1]] in ends:
            tokens.append(";")
            lines.append(False)
        self.bare = 0
        return tokens, lines

    def token_lines(self):
        n, out, last = 1, [], None
        for x in self.LEX.findall(self.src):
            if x == "\n":
                if last and self.KINDS[last] in self.LINE_ENDS:
                    last = ";"
                    out.append(n)
                n += 1
            elif x:
                out.append(n)
                n += x.count("\n")
                last = x
        return [*out, n]

    def end(self):
        if self.k[self.i] not in ("}", ")"):
            self.need(";")

    def file(self):
        try:
            self.need("package")
            self.name()
            self.end()
        except Bad as e:
            self.note(e)
            self.recover(self.i)
        self.statements("", self.top)

    def top(self):
        k = self.k[self.i]
        if k == "import":
            self.i += 1
            self.group(self.import_spec)
        elif k in ("const", "var", "type"):
            return self.declare()
        elif k == "func":
            self.i += 1
            if self.k[self.i] == "(":
                self.parameters()
            self.name()
            self.generics()
            self.parameters()
            self.result()
            if self.k[self.i] == "{":
                self.block()
        else:
            self.fail("expected a declaration")
        self.end()

    def generics(self):
        if self.k[self.i] == "[" and self.i in self.match and self.k[self.i + 1] == "i" and self.k[self.i + 2] != "]":
            self.i = self.match[self.i] + 1

    def group(self, one):
        if self.have("("):
            while self.k[self.i] != ")":
                one()
                self.end()
            self.i += 1
        else:
            one()

    def import_spec(self):
        if self.k[self.i] in ("i", "."):
            self.i += 1
        self.need("s")

    def declare(self):
        k = self.k[self.i]
        self.i += 1
        self.group({"const": self.const_spec, "var": self.var_spec, "type": self.type_spec}[k])
        self.end()

    def const_spec(self):
        self.names()
        if self.k[self.i] not in ("=", ";", ")"):
            self.type()
        if self.have("="):
            self.exprs()

    def var_spec(self):
        self.names()
        if self.k[self.i] != "=":
            self.type()
        if self.have("="):
            self.exprs()

    def type_spec(self):
        self.name()
        if self.k[self.i] == "[" and self.k[self.i + 1] == "i" and self.k[self.i + 2] not in ("]",):
            self.generics()
        self.have("=")
        self.type()

    def names(self):
        self.name()
        while self.have(","):
            self.name()

    def exprs(self):
        self.expr()
        while self.have(","):
            self.expr()

    def parameters(self):
        self.need("(")
        self.items(")", self.parameter)

    def parameter(self):
        if self.have("..."):
            return self.type()
        self.type()
        k = self.k[self.i]
        if k == "...":
            self.i += 1
            self.type()
        elif k not in (",", ")"):
            self.type()

    def result(self):
        k = self.k[self.i]
        if k == "(":
            self.parameters()
        elif k in ("i", "*", "[", "map", "chan", "func", "interface", "struct", "<-"):
            self.type()

    def type(self):
        k = self.k
        a = k[self.i]
        if a == "i":
            self.i += 1
            if k[self.i] == ".":
                self.i += 1
                self.name()
            if k[self.i] == "[" and k[self.i + 1] not in ("]", "n") and self.i in self.match:
                self.i = self.match[self.i] + 1
        elif a in ("*", "~"):
            self.i += 1
            self.type()
        elif a == "[":
            self.i += 1
            if self.have("..."):
                pass
            elif k[self.i] != "]":
                self.expr()
            self.need("]")
            self.type()
        elif a == "map":
            self.i += 1
            self.need("[")
            self.type()
            self.need("]")
            self.type()
        elif a in ("chan", "<-"):
            self.i += 1
            self.have("chan")
            self.have("<-")
            self.type()
        elif a == "func":
            self.i += 1
            self.parameters()
            self.result()
        elif a == "struct":
            self.i += 1
            self.need("{")
            while k[self.i] != "}":
                self.have("*")
                self.names()
                if self.have("."):
                    self.name()
                elif k[self.i] not in (";", "s", "}"):
                    self.type()
                self.have("s")
                self.end()
            self.i += 1
        elif a == "interface":
            self.i += 1
            self.need("{")
            while k[self.i] != "}":
                if k[self.i] == "i" and k[self.i + 1] == "(":
                    self.i += 1
                    self.parameters()
                    self.result()
                else:
                    self.type()
                    while self.have("|"):
                        self.type()
                self.end()
            self.i += 1
        elif a == "(":
            self.i += 1
            self.type()
            self.need(")")
        else:
            self.fail("expected a type")
        while k[self.i] == "|" and k[self.i + 1] in ("~", "i") and self.k[self.i - 1] == "i" and False:
            self.i += 1
            self.type()

    def block(self, one=None):
        save, self.bare = self.bare, 0
        self.need("{")
        self.statements("}", one)
        self.bare = save
        self.need("}")

    def statement(self):
        a = self.k[self.i]
        f = self.TABLE.get(a)
        if f:
            return f(self)
        if a == "i" and self.k[self.i + 1] == ":":
            self.i += 2
            self.have(";")
            return
        self.simple()
        self.end()

    def simple(self):
        k = self.k
        self.exprs()
        a = k[self.i]
        if a in self.ASSIGN:
            self.i += 1
            if k[self.i] == "range":
                self.i += 1
            self.exprs()
        elif a in ("++", "--"):
            self.i += 1
        elif a == "<-":
            self.i += 1
            self.expr()

    def header(self):
        """What stands between if, for or switch and the block; no composite literals there."""
        self.bare += 1
        if self.k[self.i] not in ("{", ";"):
            self.simple()
        while self.have(";"):
            if self.k[self.i] not in ("{", ";"):
                self.simple()
        self.bare -= 1

    def if_(self):
        self.i += 1
        if self.k[self.i] == "{":
            self.fail("expected a condition")
        self.header()
        self.block()
        if self.have("else"):
            if self.k[self.i] == "if":
                return self.if_()
            self.block()
        self.end()

    def for_(self):
        self.i += 1
        if self.k[self.i] == "range":
            self.i += 1
        self.header()
        self.block()
        self.end()

    def switch(self):
        self.i += 1
        if self.k[self.i] != "{":
            self.header()
        self.block(self.case)
        self.end()

    def case(self):
        if self.have("case"):
            save, self.bare = self.bare, 0
            while True:
                if self.k[self.i] in ("[", "map", "chan", "func", "interface", "struct") and self.k[self.i + 1] != "(":
                    self.type()
                    if self.k[self.i] == "{":
                        self.literal()
                else:
                    self.expr()
                if not self.have(","):
                    break
            if self.k[self.i] in self.ASSIGN or self.k[self.i] == "<-":
                self.i += 1
                self.exprs()
            self.bare = save
        else:
            self.need("default")
        self.need(":")
        while self.k[self.i] not in ("case", "default", "}", ""):
            self.statement()

    def return_(self):
        self.i += 1
        if self.k[self.i] not in (";", "}"):
            self.exprs()
        self.end()

    def jump(self):
        self.i += 1
        self.have("i")
        self.end()

    def go(self):
        self.i += 1
        self.expr()
        if self.k[self.i - 1] != ")":
            self.fail("expected a call")
        self.end()

    def inner_block(self):
        self.block()
        self.end()

    def literal(self):
        save, self.bare = self.bare, 0
        self.need("{")
        self.items("}", self.element)
        self.bare = save

    def element(self):
        for _ in range(2):
            if self.k[self.i] == "{":
                self.literal()
            else:
                self.expr()
            if not self.have(":"):
                return

    def primary(self):
        i, k = self.i, self.k
        a = k[i]
        if a == "i":
            self.i += 1
        elif a in ("n", "s"):
            self.i += 1
        elif a == "(":
            save, self.bare = self.bare, 0
            self.i += 1
            if k[self.i] in ("*", "[", "map", "chan", "func", "interface", "struct", "<-") and (k[self.i] not in ("*", "<-", "func")):
                self.type()
                if k[self.i] == "{":
                    self.literal()
                    self.postfix()
            else:
                self.expr()
            self.need(")")
            self.bare = save
        elif a == "func":
            self.i += 1
            self.parameters()
            self.result()
            if k[self.i] == "{":
                self.block()
        elif a in ("[", "map", "struct", "chan", "interface"):
            self.type()
            if k[self.i] == "{":
                self.literal()
            elif k[self.i] not in ("(", ",", ")"):
                self.fail("expected a literal")
        else:
            self.fail("expected an expression")

    def argument(self):
        self.expr()
        self.have("...")

    def postfix(self):
        k = self.k
        while True:
            a = k[self.i]
            if a == ".":
                self.i += 1
                if self.have("("):
                    if not self.have("type"):
                        self.type()
                    self.need(")")
                else:
                    self.name()
            elif a == "(":
                save, self.bare = self.bare, 0
                self.i += 1
                self.items(")", self.argument)
                self.bare = save
            elif a == "[":
                save, self.bare = self.bare, 0
                self.i += 1
                if k[self.i] == "]":
                    self.fail("expected an index")
                while k[self.i] != "]":
                    if k[self.i] in (":", ","):
                        self.i += 1
                    elif k[self.i] in ("[", "map", "*", "func", "chan"):
                        self.type()
                    else:
                        self.expr()
                        if k[self.i] not in (":", ",", "]"):
                            self.fail("expected ]")
                self.i += 1
                self.bare = save
            elif a == "{" and not self.bare and k[self.i - 1] in ("i", "]") and self.literal_ahead():
                self.literal()
            else:
                return

    def literal_ahead(self):
        j = self.i - 1
        return self.k[j] == "]" or self.k[j] == "i"


Go.TABLE = {
    "{": Go.inner_block, ";": Go.empty, "if": Go.if_, "for": Go.for_, "switch": Go.switch, "select": Go.switch, "return": Go.return_, "break": Go.jump, "continue": Go.jump,
    "goto": Go.jump, "fallthrough": Go.jump, "go": Go.go, "defer": Go.go, "const": Go.declare, "var": Go.declare, "type": Go.declare,
}
