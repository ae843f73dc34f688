"""Keyword analysis as column expressions: identifiers, stems, camelCase and snake_case pieces.

All of them run in the JVM. Nulls give null (scalar functions) or an empty array.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes of identifiers and of terms.
IDENTIFIER = r"([_a-zA-Z\u0080-￿]+[0-9]*)"
TERM = r"([\p{L}\p{N}_]{2,})"
WORD_TOKEN = r"([_a-zA-Z0-9]+)"
# Fixed value: a capital that begins a piece of a camelCase word.
CAMEL_START = r"((?<=[a-z])[A-Z]|(?<!^)[A-Z](?=[a-z]))"
BLANKS = r"[\s\x0B\x1C-\x1F\u0085   -     　]+"

# Language -> analyzer; in the second set a file's words count once.
ANALYZERS = {
    "Python": "Python", "Jupyter Notebook": "Jupyter Notebook", "Java": "Java", "JavaScript": "JavaScript", "C": "C", "C++": "C++", "C#": "C#",
    "PHP": "PHP", "XML": "XML", "HTML": "HTML", "JSON": "JSON", "YAML": "YAML", "Markdown": "Text", "Text": "Text",
}
ONCE = ["XML", "HTML", "JSON", "YAML", "Text"]
# The stop lists that an analyzer joins.
STOP_LISTS = {
    "Jupyter Notebook": ("Jupyter Notebook", "Python", "Text"), "HTML": ("HTML", "Text"), "JSON": ("default", "Text"), "YAML": ("default",),
}
MIN_LENGTH = 2


def register(language: str, analyzer: str | None = None, lists: tuple[str, ...] | None = None, once: bool = False) -> None:
    """An analyzer of one's own for a language, from now on in this session's plans.

    ``lists`` are the stop lists that it joins (the one of its name by default); with ``once`` a
    file's words count once.
    """
    name = analyzer or language
    ANALYZERS[language] = name
    if lists is not None:
        STOP_LISTS[name] = tuple(lists)
    if once and name not in ONCE:
        ONCE.append(name)


def normal_path(path: str = "path") -> Column:
    """The path with a leading slash."""
    p = F.col(path)
    return F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))


def document_text(path: str = "path", content: str = "content") -> Column:
    """Path and content; the words of the path count as content."""
    return F.concat(F.col(path), F.lit("\n"), F.col(content))


def analyzer(language: str = "language") -> Column:
    """Case-sensitive dispatch; any other language, and null, has the default analyzer."""
    table = F.create_map(*[F.lit(x) for kv in ANALYZERS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.col(language)), F.lit("default"))


def identifiers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(1))


def word_tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(WORD_TOKEN), F.lit(1)))


def counted(words: Column) -> Column:
    """(word, n) of an array of words, counted inside the row, so that no count crosses a shuffle."""

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(s)), lambda k: (k == 1) | (F.get(s, k - 1) != F.get(s, k - 2)))
        return let(starts, lambda at: F.transform(at, lambda k, j: F.struct(F.get(s, k - 1).alias("word"), (F.coalesce(F.get(at, j + 1), F.size(s) + 1) - k).cast("long").alias("n"))))

    none = F.array().cast("array<struct<word:string,n:bigint>>")
    return let(F.sort_array(words), lambda s: F.when(F.size(s) > 0, runs(s)).otherwise(none))


def singular(w: Column) -> Column:
    """Case-sensitive plural stem: ies -> y, es and s dropped, with their exceptions."""
    n = F.length(w)
    ies = F.when(w.endswith("eies") | w.endswith("aies"), w).otherwise(F.concat(F.left(w, n - 3), F.lit("y")))
    es = F.when(w.endswith("ses"), w).otherwise(F.left(w, n - 2))
    s = F.when(w.endswith("ss"), w).otherwise(F.left(w, n - 1))
    return F.when(w.endswith("ies"), ies).when(w.endswith("es"), es).when(w.endswith("s"), s).otherwise(w)


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once; inside lambdas an expression would else be
    computed anew for every element."""
    return F.transform(F.array(value), use)[0]


def camel_pieces(w: Column) -> Column:
    """Pieces of a camelCase word; an empty array if there are not at least two."""
    none = F.array().cast("array<string>")
    spaced = F.regexp_replace(w, CAMEL_START, " $1")
    pieces = F.filter(F.split(F.regexp_replace(spaced, BLANKS, " "), " "), lambda x: x != "")
    return F.when(w.rlike("[A-Z]"), let(pieces, lambda p: F.when(F.size(p) > 1, p).otherwise(none))).otherwise(none)


def snake_pieces(w: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.when(w.contains("_"), F.split(w, "_", -1)).otherwise(none)


def tail(pieces: Column) -> Column:
    """All pieces but the first, joined with nothing; null for an empty array."""
    return F.when(F.size(pieces) > 1, F.array_join(F.slice(pieces, 2, F.size(pieces)), ""))


def bag(w: Column) -> Column:
    """The tokens of a stemmed and filtered word: itself, its pieces longer than two, and all in lower case."""

    def tokens(both: Column) -> Column:
        c, s = both[0], both[1]
        pieces = F.filter(F.array_compact(F.concat(c, F.array(tail(c)), s, F.array(tail(s)))), lambda x: F.length(x) > MIN_LENGTH)
        return let(F.concat(F.array(w), pieces), lambda b: F.concat(b, F.transform(b, F.lower)))

    return let(F.array(camel_pieces(w), snake_pieces(w)), tokens)


def terms(tokens: Column) -> Column:
    """Tokens cut again at what is no letter, digit or underscore; one-character terms go."""
    return F.flatten(F.transform(tokens, lambda x: F.regexp_extract_all(x, F.lit(TERM), F.lit(1))))


def weighted_terms(w: Column) -> Column:
    """(term, m): the terms of a word's bag with how often each is in it; a term may come twice.

    A word of small letters and digits behind at most one capital has no pieces: it is its own
    term twice over, and no lambda runs for it.
    """
    pair = lambda t, m: F.struct(t.alias("term"), F.lit(m).alias("m"))
    whole = F.length(w) > MIN_LENGTH
    return (
        F.when(whole & w.rlike("^[a-z0-9]+\\z"), F.array(pair(w, 2)))
        .when(whole & w.rlike("^[A-Z][a-z0-9]+\\z"), F.array(pair(w, 1), pair(F.lower(w), 1)))
        .otherwise(F.transform(terms(bag(w)), lambda t: pair(t, 1)))
    )


def strip_accents(c: Column, form: str = "unicode") -> Column:
    """Text without its marks: compatibility decomposition (NFKD), then combining marks go.

    ``form="ascii"`` also drops what is no ASCII character afterwards. The JVM has no such
    function in SQL, so texts pass through one Arrow batch; ASCII texts come back as they are.
    """
    if form not in ("unicode", "ascii"):
        raise ValueError("form is unicode or ascii")

    @F.pandas_udf("string")
    def plain(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None or t.isascii() else without_marks(t, form))

    return plain(c)


def without_marks(text: str, form: str = "unicode") -> str:
    apart = unicodedata.normalize("NFKD", text)
    if form == "ascii":
        return apart.encode("ascii", "ignore").decode("ascii")
    return "".join(x for x in apart if not unicodedata.combining(x))


def _starts(size: Column, n: int) -> Column:
    return F.when(size >= n, F.sequence(F.lit(1), size - n + 1)).otherwise(F.array().cast("array<int>"))


def ngrams(tokens: Column, low: int, high: int) -> Column:
    """Word n-grams of all sizes from ``low`` to ``high``, joined with a blank."""

    def all_of(t: Column) -> Column:
        return F.flatten(F.array(*[_of(t, n) for n in range(low, high + 1)]))

    def _of(t: Column, n: int) -> Column:
        return F.transform(_starts(F.size(t), n), lambda k: F.array_join(F.slice(t, k, n), " "))

    return let(tokens, all_of)


def char_ngrams(text: Column, low: int, high: int) -> Column:
    """Character n-grams of all sizes from ``low`` to ``high``."""

    def all_of(t: Column) -> Column:
        return F.flatten(F.array(*[_of(t, n) for n in range(low, high + 1)]))

    def _of(t: Column, n: int) -> Column:
        return F.transform(_starts(F.size(t), n), lambda k: F.array_join(F.slice(t, k, n), ""))

    return let(F.regexp_extract_all(text, F.lit(r"(?s)(.)"), F.lit(1)), all_of)
