"""Ruby: blocks that end with a keyword, statements that end with a line."""

from __future__ import annotations

import re

from shelfmark.llm.syntax.base import Bad, DEEPEST, Kinds, levels, lexer, Parser, TooDeep

STRING = r'"(?:[^"\\#]|\\[\s\S]|#(?!\{)|#\{(?:[^{}"]|"(?:[^"\\]|\\.)*"|\{[^{}]*\})*\})*"|' + r"'(?:[^'\\]|\\[\s\S])*'|`(?:[^`\\]|\\[\s\S])*`"
PERCENT = r"%[wWiIqQrsx]?(?:\((?:[^()\\]|\\.|\([^()]*\))*\)|\[(?:[^\[\]\\]|\\.)*\]|\{(?:[^{}\\]|\\.|\{[^{}]*\})*\}|<[^<>]*>|(?<=[wWiIqQrsx])([|!/])[^|!/\n]*[|!/])[a-z]*"
NUMBER = r"0[xXbBoO][\da-fA-F_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?[ri]*"
SYMBOL = r':"(?:[^"\\]|\\.)*"|:(?!:)(?:[A-Za-z_@$\u0080-￿][\w$@]*[?!=]?(?![=~>])|[A-Za-z_]\w*[?!]?|\[\]=?|<=>|===?|=~|[-+*/%<>!~^&|]{1,2})'
LABEL = r"[A-Za-z_]\w*[?!]?:(?![:\w])"
SKIP = r"[ \t\r\f\v\xa0﻿]+|#[^\n]*|\\\r?\n|^=begin[\s\S]*?^=end[^\n]*"
WORDS = (
    "alias and begin BEGIN break case class def defined? do else elsif end END ensure false for if in module next nil not or redo rescue retry return "
    "self super then true undef unless until when while yield __FILE__ __LINE__ __method__"
)
HEREDOC = re.compile(r"<<[~-]?(['\"`]?)([A-Z_]\w*)\1")
REGEX = re.compile(r"/(?:[^/\\\n]|\\.)+/[a-z]*")


def without_heredocs(src: str) -> str:
    lines, out, wait = src.split("\n"), [], []
    for line in lines:
        if wait:
            if line.strip() == wait[0]:
                wait.pop(0)
            out.append("")
            continue
        code = line.split("#", 1)[0] if '"' not in line and "'" not in line else line
        found = [m.group(2) for m in HEREDOC.finditer(code)]
        if found:
            line = HEREDOC.sub('""', line)
            wait = found
        out.append(line)
    if wait:
        out.append("<<")  # a heredoc without its end
    return "\n".join(out)


class Ruby(Parser):
    NAME = "ruby"
    LEX = re.compile(lexer(rf"{STRING}|{PERCENT.replace('([|!/])', '[|!/]')}|{LABEL}|[A-Za-z_\u0080-￿]\w*[?!]?(?!=[^=~>])|[A-Za-z_\u0080-￿]\w*|@@?[A-Za-z_]\w*|\$(?:\w+|[!@&~0-9_./<>:?$,;\"'\\-])|{SYMBOL}|\?[A-Za-z](?!\w)|{NUMBER}|\*\*=|<=>|===|\.\.\.|<<=|>>=|&&=|\|\|=|\*\*|==|!=|<=|>=|&&|\|\||=~|!~|\.\.|::|<<|>>|->|=>|&\.|[-+*/%&|^]=", SKIP).pattern, re.M)
    KINDS = Kinds(WORDS, "_@$")
    BINARY = levels("and or", "= += -= *= /= %= **= ||= &&= |= &= ^= <<= >>=", "rescue", "?", ".. ...", "||", "&&", "not", "<=> == === != =~ !~", "< <= > >=", "| ^", "&", "<< >>", "+ -", "* / %", "**")
    PREFIX = frozenset("! - + ~ not & * ** defined?".split())
    RIGHT = 4
    STARTS = frozenset(["i", "n", "s", "sym", "label", "self", "nil", "true", "false", "->", "!", "not", "defined?", "lambda", "case", "if", "__method__", "__FILE__", "yield", "super", "::", "def", "[", "{", "begin"])

    def read(self, src):
        if "<<" in src:
            src = without_heredocs(src)
        if "__END__" in src:
            src = re.split(r"(?m)^__END__\s*$", src)[0]
        tokens, lines = [], []
        found = self.LEX.findall(src)
        if "/" in found or "/=" in found:  # a division, or a regular expression
            found = self.slow(src)
        for x in found:
            if x == "\n":
                if tokens and tokens[-1] != "\n":
                    tokens.append("\n")
                    lines.append(False)
            elif x:
                if x in (".", "&.") and tokens and tokens[-1] == "\n":
                    tokens.pop()
                    lines.pop()
                tokens.append(x)
                lines.append(False)
        self.src = src
        return tokens, lines

    def slow(self, src):
        at, out = 0, []
        while at <= len(src):
            m = self.LEX.match(src, at)
            x, end = m.group(1), m.end()
            if not x:
                break
            if x in ("/", "/="):
                b = out[-1] if out else "\n"
                before_value = b[-1] in ")]}\"'`" or (b[-1].isalnum() or b[-1] in "_?!") and b not in self.KINDS.words
                gap = src[m.start(1) - 1 : m.start(1)].isspace() and not src[m.start(1) + 1 : m.start(1) + 2].isspace()
                if not before_value or (gap and b[-1] not in ")]}"):
                    r = REGEX.match(src, m.start(1))
                    if r:
                        x, end = "%r'", r.end()
            out.append(x)
            at = end
        return out

    OWN = ("\n", "")

    def recover(self, start):
        k, i = self.k, max(self.i, start)
        while k[i] and k[i] != "\n":
            i += 1
        self.i = max(i, start + 1)

    def skip(self):
        while self.k[self.i] in ("\n", ";"):
            self.i += 1

    def file(self):
        self.body(())
        while self.k[self.i]:
            self.errors.append((self.i, f"at {self.t[self.i]!r}: unexpected"))
            self.i += 1
            self.body(())

    def body(self, ends):
        """Statements up to one of ``ends``, which is left to the caller."""
        self.deep += 1
        if self.deep > DEEPEST:
            raise TooDeep
        while True:
            self.skip()
            k = self.k[self.i]
            if k in ends or not k or k in ("end", "}") or (k in ("else", "elsif", "when", "rescue", "ensure", "in") and ends):
                break
            start, deep = self.i, self.deep
            try:
                self.statement()
                if self.k[self.i] not in ("\n", ";", "") and self.k[self.i] not in ends:
                    self.fail("expected a new line")
            except Bad as e:
                if not self.k[e.at]:
                    raise
                self.deep = deep
                self.note(e)
                self.recover(start)
        self.deep -= 1
        if ends and self.k[self.i] not in ends:
            self.fail("expected " + " or ".join(ends))

    def statement(self):
        k = self.k
        if k[self.i] in ("alias", "undef"):
            self.i += 1
            while k[self.i] not in ("\n", ";", ""):
                self.i += 1
            return
        self.multiple()
        while k[self.i] in ("if", "unless", "while", "until", "rescue"):
            self.i += 1
            self.expr()

    def multiple(self):
        """An expression, or a list of targets with their values."""
        self.expr()
        k = self.k
        if k[self.i] == ",":
            while self.have(","):
                if k[self.i] == "=":
                    break
                self.expr(3)
            if self.have("="):
                self.expr()
                while self.have(","):
                    self.expr()
            elif "=" not in k[max(0, self.i - 40) : self.i]:
                self.fail("unexpected ,")

    def then(self):
        if self.k[self.i] in ("\n", ";"):
            self.i += 1
        self.have("then")

    def expr(self, least=0):
        super().expr(least)

    def binary(self, op):
        k = self.k
        if op == "?":
            self.i += 1
            self.skip()
            self.expr(4)
            self.skip()
            if k[self.i] == "label":
                self.fail("expected :")
            if not self.have(":"):
                if k[self.i] == "sym":
                    self.i += 1
                    self.postfix()
                    return True
                self.fail("expected :")
            self.skip()
            self.expr(4)
            return True
        if op in ("..", "..."):
            self.i += 1
            if k[self.i] not in (")", "]", "\n", "then", ";", ""):
                self.expr(6)
            return True
        if op == "not":
            self.fail("unexpected not")
        if op == "rescue" and self.in_begin:
            return False
        self.i += 1
        while k[self.i] == "\n":
            self.i += 1
        p = self.BINARY[op]
        self.expr(p if p <= self.RIGHT else p + 1)
        if op == "=" and k[self.i] == ",":
            while self.have(","):
                self.skip_lines()
                self.have("*")
                self.expr(3)
        return True

    def skip_lines(self):
        while self.k[self.i] == "\n":
            self.i += 1

    in_begin = 0
    no_do = False

    def lines_items(self, end, one):
        self.skip_lines()
        while self.k[self.i] != end:
            one()
            self.skip_lines()
            if not self.have(","):
                break
            self.skip_lines()
        self.need(end)

    def argument(self):
        k = self.k
        if k[self.i] in ("*", "**", "&"):
            self.i += 1
            if k[self.i] in (")", ","):
                return
        if k[self.i] == "label":
            self.i += 1
            if k[self.i] in (",", ")", "]", "}", "\n"):
                return
            self.skip_lines()
            return self.expr(2)
        self.expr(2)
        if k[self.i] == ":" and k[self.i - 1] == "s":
            self.i += 1
            self.skip_lines()
            self.expr(2)
        elif self.have("=>"):
            self.skip_lines()
            self.expr(2)

    def grouped(self):
        save, self.no_do = self.no_do, False
        return save

    def primary(self):
        k, i = self.k, self.i
        a = k[i]
        f = self.TABLE.get(a)
        if f:
            return f(self)
        if a == "i":
            self.i += 1
            if self.t[i] in ("lambda", "proc", "loop"):
                return
            self.command()
        elif a == "s":
            while k[self.i] == "s":
                self.i += 1
        elif a in ("n", "sym", "self", "nil", "true", "false", "__FILE__", "__LINE__", "__method__", "redo", "retry"):
            self.i += 1
        elif a == "(":
            save = self.grouped()
            self.i += 1
            self.body((")",))
            self.need(")")
            self.no_do = save
        elif a == "[":
            save = self.grouped()
            self.i += 1
            self.lines_items("]", self.argument)
            self.no_do = save
        elif a == "{":
            save = self.grouped()
            self.i += 1
            self.lines_items("}", self.argument)
            self.no_do = save
        elif a == "->":
            self.i += 1
            if k[self.i] == "(":
                self.i = self.match.get(self.i, self.i) + 1
            else:
                while k[self.i] in ("i", ",", "*", "&"):
                    self.i += 1
            if not self.block_ahead(True):
                self.fail("expected a block")
        elif a == "::":
            self.i += 1
            self.name()
        elif a in ("..", "..."):
            self.i += 1
            self.expr(6)
        else:
            self.fail("expected an expression")

    def command(self):
        """Arguments without parentheses on the same line, if any."""
        k = self.k
        a = k[self.i]
        if a in self.STARTS and a not in ("[", "{", "if", "!", "!=") or (a in ("*", "&", "**") and k[self.i + 1] in ("i", "self", "sym") and self.tight(self.i)) or (a == "[" and self.gap(self.i)):
            if a in ("not",):
                return
            while True:
                self.argument()
                if not self.have(","):
                    break
                self.skip_lines()

    def gap(self, j):
        return self.t[j - 1][0].islower() and self.t[j - 1] in ("puts", "p", "raise", "yield", "return", "expect", "attr_accessor", "validates")

    def tight(self, j):
        return k_is(self.k[j - 1], "i") and self.t[j - 1] in ("puts", "p", "raise", "send", "yield", "super", "call", "print", "delegate")

    def block_ahead(self, lam=False):
        k = self.k
        if k[self.i] == "{":
            save = self.grouped()
            self.i += 1
            self.block_parameters()
            self.body(("}",))
            self.need("}")
            self.no_do = save
            return True
        if k[self.i] == "do" and not self.no_do:
            save = self.grouped()
            self.i += 1
            self.block_parameters()
            self.section()
            self.need("end")
            self.no_do = save
            return True
        return False

    def block_parameters(self):
        self.skip_lines()
        if self.k[self.i] == "||":
            self.i += 1
        elif self.have("|"):
            while self.k[self.i] not in ("|", "\n", ""):
                self.i += 1
            self.need("|")

    def section(self):
        """A body with rescue, else and ensure."""
        save, self.in_begin = self.in_begin, 1
        self.body(("rescue", "else", "ensure", "end"))
        while self.have("rescue"):
            while self.k[self.i] not in ("\n", ";", "then", ""):
                self.i += 1
            self.then()
            self.body(("rescue", "else", "ensure", "end"))
        if self.have("else"):
            self.body(("ensure", "end"))
        if self.have("ensure"):
            self.body(("end",))
        self.in_begin = save

    def condition(self):
        save, self.no_do = self.no_do, True
        self.expr()
        self.no_do = save

    def if_(self):
        self.i += 1
        self.condition()
        if self.k[self.i] not in ("\n", ";", "then"):
            self.fail("expected then or a new line")
        self.then()
        self.body(("elsif", "else", "end"))
        while self.have("elsif"):
            self.condition()
            self.then()
            self.body(("elsif", "else", "end"))
        if self.have("else"):
            self.body(("end",))
        self.need("end")

    def while_(self):
        self.i += 1
        self.condition()
        if not self.have("do") and self.k[self.i] not in ("\n", ";"):
            self.fail("expected do or a new line")
        self.body(("end",))
        self.need("end")

    def for_(self):
        self.i += 1
        while self.k[self.i] in ("i", ",", "(", ")"):
            self.i += 1
        self.need("in")
        self.condition()
        self.have("do")
        self.body(("end",))
        self.need("end")

    def case(self):
        self.i += 1
        if self.k[self.i] not in ("\n", ";"):
            self.expr()
        self.skip()
        if self.k[self.i] not in ("when", "in"):
            self.fail("expected when")
        while self.k[self.i] in ("when", "in"):
            pattern = self.k[self.i] == "in"
            self.i += 1
            if pattern:
                while self.k[self.i] not in ("\n", ";", "then", ""):
                    self.i = self.match.get(self.i, self.i) + 1
            else:
                self.argument()
                while self.have(","):
                    self.skip_lines()
                    self.argument()
                if self.k[self.i] not in ("\n", ";", "then"):
                    self.fail("expected then or a new line")
            self.then()
            self.body(("when", "in", "else", "end"))
        if self.have("else"):
            self.body(("end",))
        self.need("end")

    def begin(self):
        self.i += 1
        self.section()
        self.need("end")

    def def_(self):
        k = self.k
        self.i += 1
        if k[self.i + 1] == "." :
            self.i += 2
        if k[self.i] in ("\n", ";", "", "(", ")"):
            self.fail("expected a method name")
        self.i += 1
        if k[self.i - 1] in ("[",):
            self.need("]")
        if k[self.i - 1] in ("+", "-", "!", "~") and self.t[self.i] == "@":
            self.i += 1
        if k[self.i] == "=" and k[self.i + 1] == "(":
            self.i += 1
        if self.have("("):
            self.lines_items(")", self.parameter)
        elif k[self.i] in ("i", "*", "&", "label", "**"):
            self.parameter()
            while self.have(","):
                self.parameter()
        if self.have("="):
            self.skip_lines()
            return self.statement()
        if k[self.i] not in ("\n", ";") and k[self.i] != "":
            self.fail("expected a new line")
        self.section()
        self.need("end")

    def parameter(self):
        k = self.k
        if k[self.i] in ("*", "**", "&", "..."):
            self.i += 1
            self.have("i") or self.have("nil")
            return
        if k[self.i] == "label":
            self.i += 1
            if k[self.i] not in (",", ")", "\n"):
                self.expr(3)
            return
        if k[self.i] == "(":
            self.i = self.match.get(self.i, self.i) + 1
            return
        self.name()
        if self.have("="):
            self.expr(3)

    def class_(self):
        self.i += 1
        if self.have("<<"):
            self.expr()
        else:
            self.path()
            if self.have("<"):
                self.expr()
        self.section()
        self.need("end")

    def path(self):
        self.have("::")
        self.name()
        while self.have("::"):
            self.name()

    def module(self):
        self.i += 1
        self.path()
        self.body(("end",))
        self.need("end")

    def jump(self):
        self.i += 1
        if self.k[self.i] not in ("\n", ";", "", "if", "unless", "}", "end", ")", "while", "until", "and", "or", ":"):
            self.argument()
            while self.have(","):
                self.argument()

    def yield_(self):
        self.i += 1
        if self.k[self.i] not in ("(", "[", ".") and self.k[self.i] in self.STARTS - {"if", "[", "{"}:
            self.argument()
            while self.have(","):
                self.argument()

    def begin_block(self):
        self.i += 1
        self.need("{")
        self.body(("}",))
        self.need("}")

    def postfix(self):
        k = self.k
        while True:
            a = k[self.i]
            if a in (".", "&.", "::"):
                self.i += 1
                self.skip_lines()
                b = k[self.i]
                if b == "(":
                    continue
                if b == "label" and k[self.i + 1] != "label":
                    # a method name right before the : of a ternary
                    self.fail("unexpected label")
                if b in ("\n", "", ")", "]", "}", ",", ";", "n", "s"):
                    self.fail("expected a method name")
                self.i += 1
                if k[self.i] != "(":
                    self.command()
            elif a == "(":
                save = self.grouped()
                self.i += 1
                self.lines_items(")", self.argument)
                self.no_do = save
            elif a == "[":
                save = self.grouped()
                self.i += 1
                self.lines_items("]", self.argument)
                self.no_do = save
            elif a in ("{", "do"):
                if k[self.i - 1] in ("n", "s", "sym", "nil", "true", "false", "self") and a == "{":
                    return
                if not self.block_ahead():
                    return
            else:
                return


def k_is(a, b):
    return a == b


class _RubyKinds(Kinds):
    def __missing__(self, t):
        c = t[0]
        if c == "\n":
            k = "\n"
        elif c == ":" and len(t) > 1 and t != "::":
            k = "sym"
        elif t[-1] == ":" and len(t) > 1 and (c.isalpha() or c == "_"):
            k = "label"
        elif c == "%" and len(t) > 2:
            k = "s"
        elif c == "?" and len(t) == 2:
            k = "s"
        else:
            return super().__missing__(t)
        self[t] = k
        return k


Ruby.KINDS = _RubyKinds(WORDS, "_@$")
Ruby.TABLE = {
    "if": Ruby.if_, "unless": Ruby.if_, "while": Ruby.while_, "until": Ruby.while_, "for": Ruby.for_, "case": Ruby.case, "begin": Ruby.begin, "def": Ruby.def_,
    "class": Ruby.class_, "module": Ruby.module, "return": Ruby.jump, "break": Ruby.jump, "next": Ruby.jump, "yield": Ruby.yield_, "super": Ruby.yield_, "BEGIN": Ruby.begin_block, "END": Ruby.begin_block,
}
