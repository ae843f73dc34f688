"""JSON."""

from __future__ import annotations

import json
import re

from shelfmark.llm.syntax.base import DEEPEST, Bad, Kinds, Parser, TooDeep

STRING = r'"(?:[^"\\\x00-\x1f]|\\["\\/bfnrt]|\\u[\da-fA-F]{4})*"'


def _no_constant(x: str):
    raise ValueError(f"{x} is no JSON value")


class Json(Parser):
    NAME = "json"
    LEX = re.compile(rf"(?:[ \t\r﻿]+)*({STRING}|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])|[A-Za-z_]\w*|\n|[\s\S]|\Z)")
    KINDS = Kinds("true false null", "_")

    def file(self):
        self.value()
        if self.k[self.i]:
            self.fail("expected the end")

    def value(self):
        k = self.k[self.i]
        self.deep += 1
        if self.deep > 4 * DEEPEST:
            raise TooDeep
        if k == "{":
            self.i += 1
            self.members("}", self.pair)
        elif k == "[":
            self.i += 1
            self.members("]", self.value)
        elif k in ("s", "n", "true", "false", "null"):
            self.i += 1
        elif k == "-" and len(self.t[self.i]) > 1:
            self.i += 1
        else:
            self.fail("expected a value")
        self.deep -= 1

    def pair(self):
        self.need("s")
        self.need(":")
        self.value()

    def members(self, end, one):
        if self.have(end):
            return
        while True:
            start, deep = self.i, self.deep
            try:
                one()
                if self.k[self.i] not in (",", end):
                    self.fail(f"expected , or {end}")
            except Bad as e:
                if not self.k[e.at]:
                    raise
                self.deep = deep
                self.note(e)
                i = max(self.i, start + 1)
                while self.k[i] not in (",", end, ""):
                    i = self.match.get(i, i) + 1
                self.i = i
            if not self.have(","):
                break
            if self.k[self.i] == end:
                self.errors.append((self.i, f"at {end!r}: unexpected after ,"))
                break
        self.need(end)

    def run(self):
        """Errors of this parser; the exact reader has the last word on acceptance."""
        try:
            json.loads(self.src.lstrip("﻿"), parse_constant=_no_constant)
            return []
        except RecursionError:
            return super().run()
        except ValueError as e:
            return super().run() or [(1, f"grammar: {e}")]
