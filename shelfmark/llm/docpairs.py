"""Functions and methods with their documentation (problem 4).

Strings and comments are blanked first, so nothing inside them counts. Signatures are found by
regular expressions, bodies are delimited by indentation (Python), by a stack of end keywords
(Ruby) or of braces, and a comment belongs to a function if it ends on the line above it,
annotations in between left out. In Python the docstring is the documentation.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import language_column
from shelfmark.llm.syntax import errors_of
from shelfmark.llm.syntax.ruby import HEREDOC, REGEX

LANGUAGES = ("python", "javascript", "typescript", "java", "go", "c", "c#", "ruby")

D, S = r'"(?:[^"\\\n]|\\[\s\S])*"', r"'(?:[^'\\\n]|\\[\s\S])*'"
SLASH = r"//[^\n]*|/\*[\s\S]*?\*/"
# One pattern for each language whose first group is a comment; other matches are strings.
PARTS = {
    "python": re.compile(r"(#[^\n]*)|" + r'"""(?:[^"\\]|\\[\s\S]|"(?!""))*"""' + r"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''|" + f"{D}|{S}"),
    "javascript": re.compile(rf"({SLASH})|{D}|{S}|`(?:[^`\\]|\\[\s\S])*`"),
    "java": re.compile(rf'({SLASH})|"""(?:[^\\"]|\\[\s\S]|"(?!""))*"""|{D}|{S}'),
    "go": re.compile(rf"({SLASH})|`[^`]*`|{D}|'(?:[^'\\\n]|\\[^\n]{{1,9}}?)'"),
    "c": re.compile(rf"({SLASH})|{D}|{S}"),
    "c#": re.compile(rf'({SLASH})|\$*"""[\s\S]*?"""|\$?@\$?"(?:[^"]|"")*"|{D}|{S}'),
    "ruby": re.compile(rf"(?m:(#(?!\{{)[^\n]*|^=begin[\s\S]*?^=end[^\n]*))|{D}|'(?:[^'\\]|\\[\s\S])*'|`[^`\n]*`|%[wWiIqQ]?\([^()]*\)|%[wWiIqQ]?\[[^\[\]]*\]"),
}
PARTS["typescript"] = PARTS["javascript"]

# Words that begin statements or calls, never a signature.
NO_NAMES = frozenset("if for while switch catch return function new throw else do case await yield using lock foreach goto typeof sizeof super with in of delete assert synchronized when unless until elsif fixed checked unchecked".split())
JS_MODS = r"(?:(?:public|private|protected|static|async|readonly|override|abstract|get|set|declare)[ \t]+)*"
SIGNATURES = {
    "python": re.compile(r"(?m)^[ \t]*+(?=\S)(?:async[ \t]+)?def[ \t]+(\w+)[ \t]*(?:\[[^\]]*\])?\("),
    "javascript": re.compile(
        rf"(?m)^[ \t]*+(?=\S)(?:(?:export[ \t]+)?(?:default[ \t]+)?(?:declare[ \t]+)?(?:async[ \t]+)?function\b[ \t]*\*?[ \t]*([\w$]+)[ \t]*(?:<[^(\n]*>)?\("
        rf"|(?:export[ \t]+)?(?:const|let|var)[ \t]+([\w$]+)[ \t]*(?::[^=\n]*(?:=>[^=\n]*)?)?=[ \t]*(?=async\b|function\b|\(|<|[\w$]+[ \t]*=>)"
        rf"|(?:[\w$]++\.)+([\w$]++)[ \t]*+=[ \t]*(?=async\b|function\b|\(|[\w$]+[ \t]*=>)"
        rf"|([\w$]+)[ \t]*:[ \t]*(?=async\b|function\b|\([^()\n]*\)[ \t]*=>)"
        rf"|{JS_MODS}\*?[ \t]*([\w$#]+)[ \t]*(?:<[^(\n]*>)?\()"
    ),
    "java": re.compile(r"(?m)^[ \t]*+(?=\S)((?:[\w@.$<>\[\],?&]+[ \t]+)+)(\w+)[ \t]*\("),
    "c#": re.compile(r"(?m)^[ \t]*+(?=\S)((?:[\w@.$<>\[\],?&]+[ \t]+)+)([\w.]+)[ \t]*(?:<[\w, \t]+>[ \t]*)?\("),
    "c": re.compile(r"(?m)^((?:[\w*]+[ \t*]+|[\w*]+[ \t]*\n)+\**)(\w+)[ \t]*\("),
    "go": re.compile(r"(?m)^func[ \t]+(?:\([^)\n]*\)[ \t]*)?(\w+)[ \t]*(?=[\[(])"),
    "ruby": re.compile(r"(?m)^[ \t]*+(?=\S)(?:(?:private|public|protected|private_class_method|module_function)[ \t]+)?def[ \t]+(?:[\w:]+\.)?(\w+[?!=]?(?![\w])|[^\w\s(.]+)"),
}
SIGNATURES["typescript"] = SIGNATURES["javascript"]
AFTER = {
    "java": re.compile(r"(?:\s*\[\])*\s*(?:throws\s[\w\s.,<>]+)?([{;])"),
    "c#": re.compile(r"\s*(?:where\s[^{;]+|:\s*(?:base|this)\s*\([^{;]*\)\s*)?(\{|=>|;)"),
    "c": re.compile(r"\s*(?:__attribute__\s*\(\([^{;]*\)\)\s*)?(\{)"),
    "javascript": re.compile(r"\s*(?::\s*(?:[^{;=()]|\([^()]*\)|=>|\{[^{}]*\}(?=\s*[\[|&]|\s*\{))+)?(\{)"),
}
AFTER["typescript"] = AFTER["javascript"]
ARROW = re.compile(r"\s*(?::\s*[^={;]+?)?=>\s*")
# Ruby: labels, symbols, variables and called names are whole tokens, so no keyword is seen in them.
RUBY_TOKEN = re.compile(r"\\\n|&?\.\s*(?!\d)\w+[?!]?|::?\w+[?!]?|[@$]+\w+|\w+[?!]?:(?!:)|\w+[?!]?|[^\S\n]*\n|\S")
RUBY_DEF = re.compile(r"[ \t]*(?:[\w:]+\.)?(?:\w+[?!]?(?:=(?=[ \t]*\())?|[^\w\s(.]+)")
# Words behind which an if or while is no modifier.
RUBY_BEFORE = frozenset("then else do begin ensure and or not if unless while until elsif when in case".split())
NOTE = re.compile(r"[ \t]*(?:@[\w.]+|\[[A-Za-z][^\n]*\][ \t]*(?=\n|\Z)|#\[)")

# Description of a documentation text -------------------------------------------------------
MARKS = re.compile(r"^[ \t]*(?:/\*[*!]*|\*+/?|///?[/!]?|#+[!']?|=begin|=end)?[ \t]?")
TAG = re.compile(r"^\s*(?:[@\\](?!description\b|brief\b|summary\b|desc\b)[a-zA-Z]+\b|:(?:param|parameter|arg|argument|key|type|returns?|rtype|raises?|raise|except|yields?|var|ivar|cvar|meta)\b[^:]*:)")
LEAD = re.compile(r"^\s*[@\\](?:description|brief|summary|desc)\b")
SECTION = re.compile(r"^\s*(?:args|arguments|parameters?|params?|returns?|return value|yields?|raises?|throws|examples?|keyword args|other parameters|attributes|see also|notes?|errors|usage|inputs?|outputs?)\s*:?\s*$", re.IGNORECASE)
RULE = re.compile(r"^\s*[-=~*_#]{3,}\s*$")
XML_PART = re.compile(r"<(param|typeparam|returns|exception|value|example|seealso|permission)\b[^>]*?(?:/>|>[\s\S]*?(?:</\1>|\Z))")
XML_TAG = re.compile(r"</?[A-Za-z][^<>\n]*>")
WORD = re.compile(r"[^\W_][\w'’-]*")
LATER = re.compile(
    r"\b(?:todo|fixme|tbd|xxx|hack|wip)\b|\b(?:docs?|documentation|description|doc ?string|comments?|details|explanation|text)\b.{0,25}\b(?:pending|missing|to follow|follows? later|to come|coming|goes here|go here|here|needed|tba|later|not yet|to be)\b"
    r"|\b(?:to be|not yet|needs? to be|must be|will be|still to be|should be)\s+(?:\w+\s+)?(?:documented|written|described|explained|added|filled)\b|\b(?:add|write|fill in|insert|provide|put)\b.{0,30}\b(?:docs?|documentation|description|doc ?string|explanation|comment)\b"
    r"|\bexplain what (?:this|it) (?:does|is)\b|\bdocument (?:this|me|it)\b|\bsee (?:above|below)\b|\bn/a\b|\bplaceholder\b|\bundocumented\b|\bno (?:docs?|documentation|description)\b|\bdescribe (?:this|the|what)\b.{0,40}\b(?:later|here|function|method)\b|\blorem ipsum\b",
    re.IGNORECASE,
)
CODE_LINE = re.compile(r"^\s*(?:[\w.$\[\]]+\s*\(.*\)\s*;?|(?:const|let|var|int|auto|return|if|for|while|import|from|def|func|function|class|public|private|end|else)\b.*[;{(=:]\s*.*|[\w.$\[\]]+\s*(?:[-+*/|&]?=|:=)\s*\S.*|.*[;{}]|\}.*)\s*$")
FILLER = frozenset("the a an this that function method of for to and is does it its in on with".split())
SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")


@lru_cache(maxsize=100_000)
def stem(w: str) -> str:
    w = w.lower()
    for end in ("ies", "es", "s", "ing", "ed"):
        if w.endswith(end) and len(w) > len(end) + 2:
            return w[: -len(end)].rstrip("e") + ("y" if end == "ies" else "")
    return w.rstrip("e")


STEMMED = FILLER | {stem(x) for x in FILLER}


def description(raw: str, marks: bool) -> str:
    """What a documentation text says, without comment marks, tags and sections."""
    if "<" in raw and marks:
        plain = "\n".join(MARKS.sub("", x, count=1) for x in raw.split("\n"))
        lines = XML_TAG.sub(" ", XML_PART.sub(" ", plain)).split("\n")
    elif marks:
        lines = [MARKS.sub("", x, count=1) for x in raw.split("\n")]
    else:
        lines = raw.split("\n")
    out = []
    for k, x in enumerate(lines):
        x = x.removesuffix("*/") if marks else x
        if TAG.match(x) or (SECTION.match(x) and (x.rstrip().endswith(":") or k + 1 >= len(lines) or RULE.match(lines[k + 1]) or not x.strip().islower())):
            break
        if RULE.match(x) or CODE_LINE.match(x) and marks:
            continue
        out.append(LEAD.sub("", x, count=1).strip())
    return "\n".join(out).strip()


def is_real(text: str, name: str) -> bool:
    """At least six words that neither repeat the name nor put the documentation off."""
    if len(WORD.findall(text)) < 6:
        return False
    if LATER.search(text):
        text = " ".join(x for x in re.split(r"(?<=[.!?])\s+|\n\s*\n", text) if not LATER.search(x))
    words = WORD.findall(text)
    if len(words) < 6:
        return False
    own = {stem(x) for x in SPLIT.split(name) if x}
    said = {stem(p) for w in words for p in SPLIT.split(w) if p} - STEMMED
    return bool(said - own - {stem(name)})


def closing(text: str, at: int) -> int:
    """Index of the ) for the ( at ``at``, or -1."""
    depth = 0
    for m in re.compile(r"[()]").finditer(text, at):
        depth += 1 if m.group() == "(" else -1
        if not depth:
            return m.start()
    return -1


def blanked_heredocs(src: str) -> str:
    """Ruby text whose heredocs are blanked in place: every other character stays where it is."""
    out, wait = [], []
    for line in src.split("\n"):
        if wait:
            if line.strip() == wait[0]:
                wait.pop(0)
            out.append(" " * len(line))
            continue
        code = line.split("#", 1)[0] if '"' not in line and "'" not in line else line
        wait = [m.group(2) for m in HEREDOC.finditer(code)]
        out.append(HEREDOC.sub(lambda m: '""'.ljust(len(m.group())), line) if wait else line)
    return "\n".join(out)


class Source:
    """A text with its strings and comments blanked; ``whole`` is the text that pairs are cut from."""

    def __init__(self, language: str, text: str):
        self.whole = text
        if language == "ruby" and "<<" in text:
            text = blanked_heredocs(text)
        self.language, self.text = language, text
        self.comments: list[tuple[int, int]] = []
        self.strings: dict[int, int] = {}
        out, at = [], 0
        for m in PARTS[language].finditer(text):
            a, b = m.span()
            if m.group(1) is not None:
                self.comments.append((a, b))
            else:
                self.strings[a] = b
            out.append(text[at:a])
            x = text[a:b]
            out.append(" " * (b - a) if "\n" not in x else "\n".join([" " * len(y) for y in x.split("\n")]))
            at = b
        out.append(text[at:])
        self.code = "".join(out)
        self.by_line: dict[int, int] | None = None

    def above(self, start: int) -> str | None:
        """The comment that ends on the line above the one of ``start``."""
        text, code = self.text, self.code
        if self.by_line is None:
            self.by_line = {}
            for n, (_, b) in enumerate(self.comments):
                e = text.find("\n", b) if b and text[b - 1] != "\n" else b - 1
                if e >= 0 and not text[b:e].strip():
                    self.by_line[e] = n
        line = text.rfind("\n", 0, start) + 1
        while line > 0:
            n = self.by_line.get(line - 1)
            if n is not None:
                break
            before = text.rfind("\n", 0, line - 1) + 1
            if not NOTE.match(code, before) or before == line:
                return None
            line = before
        else:
            return None
        first = last = n
        a = self.comments[n][0]
        begin = text.rfind("\n", 0, a) + 1
        if code[begin:a].strip():
            return None
        if not text.startswith(("/*", "=begin"), a):  # a run of line comments
            while begin > 0:
                k = self.by_line.get(begin - 1)
                if k is None or text.startswith(("/*", "=begin"), self.comments[k][0]):
                    break
                up = text.rfind("\n", 0, self.comments[k][0]) + 1
                if code[up : self.comments[k][0]].strip():
                    break
                first, begin = k, up
        return text[self.comments[first][0] : self.comments[last][1]]

    def functions(self) -> Iterator[tuple[str, int, int]]:
        """(name, start of the signature, index after its parameters)."""
        language, code = self.language, self.code
        for m in SIGNATURES[language].finditer(code):
            name = next((g for g in reversed(m.groups()) if g), None)
            if language in ("java", "c#", "c"):
                name = m.group(2).rsplit(".", 1)[-1]
                first = m.group(1).split(None, 1)[0]
                if first in NO_NAMES or name in NO_NAMES or m.group(1).strip() in ("else", "new") or " new " in m.group(1):
                    continue
                end = closing(code, m.end() - 1)
                if end < 0 or not AFTER[language].match(code, end + 1):
                    continue
                yield name, m.start(), end + 1
            elif language in ("javascript", "typescript"):
                if name in NO_NAMES or name == "constructor" and False:
                    continue
                if m.group(2) or m.group(3) or m.group(4):
                    at = m.end()
                    w = re.compile(r"(?:async\b\s*)?(function\b\s*\*?\s*[\w$]*\s*)?(?:<[^(\n]*>)?").match(code, at)
                    at = w.end()
                    if code[at : at + 1] == "(":
                        end = closing(code, at)
                        if end < 0 or not (w.group(1) or ARROW.match(code, end + 1)):
                            continue
                        yield name, m.start(), end + 1
                    elif x := re.compile(r"[\w$]+\s*=>").match(code, at):
                        yield name, m.start(), x.end()
                    continue
                end = closing(code, m.end() - 1)
                if end < 0 or not AFTER[language].match(code, end + 1):
                    continue
                yield name.lstrip("#"), m.start(), end + 1
            elif language == "python":
                end = closing(code, m.end() - 1)
                if end >= 0:
                    yield name, m.start(), end + 1
            elif language == "go":
                at = m.end()
                if code[at] == "[":
                    at = code.find("(", at)
                end = closing(code, at) if at >= 0 else -1
                if end >= 0:
                    yield name, m.start(), end + 1
            else:
                yield name, m.start(), m.end()

    def docstring(self, after: int) -> str | None:
        code = self.code
        m = re.compile(r"[^:\n]*?:|[^:]*?:").match(code, after)
        if not m:
            return None
        rest = re.compile(r"[\s\\]*").match(code, m.end()).end()
        # blanked comments and the blanked string itself look like blanks: look for the first string
        for a in self.starts[bisect_right(self.starts, m.end() - 1) :]:
            if a > rest:
                # a prefix such as r stands before the quote
                if code[rest:a].lower() in ("r", "u") and a == rest + len(code[rest:a]):
                    return self.string(a)
                return None
            gap = self.text[m.end() : a]
            if re.fullmatch(r"(?:[ \t]*(?:#[^\n]*)?\n)*[ \t]*[rRuU]?", gap):
                b = self.strings[a]
                if "\n" not in gap and re.match(r"[ \t]*[^\s;#]", self.text[b : b + 40]):
                    return None
                tail = re.compile(r"[ \t]*(?:#[^\n]*|;[^\n]*)?(?:\n|$)").match(self.text, b)
                return self.string(a) if tail else None
            return None
        return None

    def string(self, a: int) -> str:
        x = self.text[a : self.strings[a]]
        return x[3:-3] if x[:3] in ('"""', "'''") else x[1:-1]

    def body_end(self, start: int, after: int) -> int:
        """Where the function's body ends."""
        code, language = self.code, self.language
        if language == "ruby":
            return self.ruby_end(after)
        if language == "python":
            line = code.rfind("\n", 0, start + 1) + 1 if code[start : start + 1] != "\n" else start + 1
            indent = len(code[line:]) - len(code[line:].lstrip(" \t"))
            at = code.find("\n", after)
            end = len(code)
            while at >= 0:
                nxt = code.find("\n", at + 1)
                row = code[at + 1 : nxt if nxt >= 0 else len(code)]
                if row.strip():
                    deep = len(row) - len(row.lstrip(" \t"))
                    if deep <= indent:
                        return at + 1
                if nxt < 0:
                    break
                at = nxt
            return end
        brace = code.find("{", after)
        stop = code.find(";", after)
        if brace < 0 or 0 <= stop < brace:
            return stop + 1 if stop >= 0 else len(code)
        depth = 0
        for m in re.compile(r"[{}]").finditer(code, brace):
            depth += 1 if m.group() == "{" else -1
            if not depth:
                return m.end()
        return len(code)

    def ruby_end(self, after: int) -> int:
        """Where a Ruby method ends whose name ends at ``after``: a stack of opening keywords and end."""
        code = list(self.code)
        for a in self.strings:
            code[a] = '"'  # a string is a value
        code = "".join(code)

        def endless(at: int) -> int:
            """Index after the = of a method without end, or -1."""
            if code[at - 1] == "=":
                return -1
            gap = re.compile(r"[ \t]*(?=\()").match(code, at)
            if gap:
                at = closing(code, gap.end()) + 1
                if not at:
                    return -1
            m = re.compile(r"[ \t]*=(?![=~>])" if gap else r"[ \t]+=(?![=~>])").match(code, at)
            return m.end() if m else -1

        at = endless(after)
        short = at >= 0
        stack, loop, brackets, before = [] if short else ["def"], False, 0, "=" if short else "\n"
        at = at if short else after
        while m := RUBY_TOKEN.search(code, at):
            x, at = m.group(), m.end()
            if x == "\\\n":
                continue
            value = before[-1] in ")]}\"" or (before[-1].isalnum() or before[-1] in "_?!" and len(before) > 1) and before not in RUBY_BEFORE
            line = x.endswith("\n")
            if line or x == ";":
                if (value or x == ";" or before in ("end", "\n")) and not brackets:
                    loop = False
                    if short and not stack and not (line and re.compile(r"\s*&?\.\w").match(code, at)):
                        return m.start()
                before = before if line and not value and before not in ("end", ";") else "\n"
                continue
            if x == "/" and (not value or code[m.start() - 1].isspace() and not code[at : at + 1].isspace() and before[-1] not in ')]}"'):
                r = REGEX.match(code, m.start())
                if r:
                    at, x = r.end(), '"'
            elif x in "([{":
                brackets += 1
            elif x in ")]}":
                brackets -= 1
                if short and brackets < 0 and not stack:
                    return m.start()
            elif x in ("if", "unless", "while", "until", "for"):
                if not value:
                    stack.append(x)
                    loop = x not in ("if", "unless")
            elif x in ("class", "module", "begin", "case"):
                stack.append(x)
            elif x == "do":
                if not loop:
                    stack.append(x)
                loop = False
            elif x == "def":
                d = RUBY_DEF.match(code, at)
                at, x = d.end() if d else at, '"'
                e = endless(at)
                if e >= 0:
                    at, x = e, "="
                else:
                    stack.append("def")
                    x = "\n"
            elif x == "end":
                if short and not stack:
                    return m.start()
                stack.pop()
                if not stack and not short:
                    return at
            before = x
        return len(code)

    def pairs(self) -> list[tuple[str, int, str, str]]:
        """(name, line, description, code) of functions with real documentation."""
        out = []
        self.starts = sorted(self.strings)
        python = self.language == "python"
        for name, start, after in self.functions():
            doc = self.docstring(after) if python else self.above(start)
            if doc is None:
                continue
            text = description(doc, not python)
            if is_real(text, name):
                out.append((name, self.text.count("\n", 0, start) + 1, text, self.whole[start : self.body_end(start, after)]))
        return out


def pairs_of(language: str, text: str) -> list[tuple[str, int, str, str]]:
    """Pairs of one valid text; nothing for blank or invalid ones."""
    if language not in PARTS or not text or not text.strip():
        return []
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    text = text.removeprefix("﻿")
    found = Source(language, text).pairs()
    return found if found and not errors_of(language, text) else []


SCHEMA = "file_id long, language string, func_name string, line int, description string, code string"


def documented(files: DataFrame) -> DataFrame:
    """(file_id, language, func_name, line, description, code) of documented functions.

    Rows in other languages, with null or blank content, or that do not parse give nothing. Two
    functions of one name in a file are two rows. Other columns than file_id, content, language
    and path are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, x, t in zip(*(batch.column(k).to_pylist() for k in range(3))):
                rows.extend((i, x, *p) for p in pairs_of(x, t))
            cols = list(zip(*rows)) or [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["file_id", "language", "func_name", "line", "description", "code"])

    rows = files.select("file_id", language_column().alias("language"), "content")
    return rows.where(F.col("language").isin(*LANGUAGES) & F.col("content").rlike(r"\S")).mapInArrow(run, SCHEMA)
