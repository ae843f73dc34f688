"""Which files are syntactically valid in their language (problem 6).

``errors_of`` reads one text; :func:`check` gives every error of every file of a table,
:func:`verdicts` one row for each file, :func:`rates` the shares per repository and language.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import language_column
from shelfmark.llm.syntax.base import FRAMES, Parser, TooDeep
from shelfmark.llm.syntax.braces import C, CSharp, Go, Java
from shelfmark.llm.syntax.data import Json
from shelfmark.llm.syntax.indent import Python
from shelfmark.llm.syntax.ruby import Ruby
from shelfmark.llm.syntax.script import JavaScript, TypeScript

PARSERS: dict[str, type[Parser]] = {p.NAME: p for p in (Python, JavaScript, TypeScript, Java, Go, C, CSharp, Ruby, Json)}
CHECKED = tuple(PARSERS)


def errors_of(language: str, text: str) -> list[tuple[int, str]] | None:
    """Errors (line, message) of a text in file order, the first cause first; empty if it is valid.

    None if there is no verdict: the text nests more than ``DEEPEST`` levels deep. Blank text has
    no errors (it is no case); a language without a parser accepts everything.
    """
    parser = PARSERS.get(language)
    if parser is None or not text or not text.strip():
        return []
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    text = text.removeprefix("﻿")
    if sys.getrecursionlimit() < FRAMES:
        sys.setrecursionlimit(FRAMES)
    try:
        return parser(text).run()
    except (TooDeep, RecursionError):
        return None


SCHEMA = "file_id long, language string, n_errors int, first_line int, first_cause string, errors array<string>"


def verdicts(files: DataFrame) -> DataFrame:
    """(file_id, language, n_errors, first_line, first_cause, errors) of rows in a checked language.

    Null or blank content and other languages do not come out. A text without a verdict has a
    null ``n_errors``. Rows with the same language and
    content are each read; a row is never split, and only its own task sees it. Columns other
    than file_id, content, language and path are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, langs, texts = (batch.column(k).to_pylist() for k in range(3))
            found = [errors_of(x, t) for x, t in zip(langs, texts)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array([None if e is None else len(e) for e in found], pa.int32()),
                    pa.array([e[0][0] if e else None for e in found], pa.int32()), pa.array([cause(e[0][1]) if e else None for e in found], pa.string()),
                    pa.array([[f"{n}: {why}" for n, why in e or ()] for e in found], pa.list_(pa.string())),
                ],
                names=["file_id", "language", "n_errors", "first_line", "first_cause", "errors"],
            )

    rows = files.select("file_id", language_column().alias("language"), "content")
    rows = rows.where(F.col("language").isin(*CHECKED) & F.col("content").rlike(r"\S"))
    return rows.mapInArrow(run, SCHEMA)


def cause(message: str) -> str:
    """The kind of an error message, without the token it stands at."""
    return re.sub(r"^at .*?: (?=[a-z])", "", message)


def invalid(files: DataFrame) -> DataFrame:
    return verdicts(files).where("n_errors > 0").select("file_id")


def rates(files: DataFrame) -> DataFrame:
    """Files, invalid ones, those without a verdict, and acceptance of the others, per repository and language."""
    v = verdicts(files).select("file_id", F.col("language").alias("lang"), "n_errors")
    joined = files.select("file_id", "repo_id").join(v, "file_id")
    return joined.groupBy("repo_id", "lang").agg(
        F.count("*").alias("files"), F.count(F.when(F.col("n_errors") > 0, 1)).alias("invalid"), F.count(F.when(F.col("n_errors").isNull(), 1)).alias("unknown"),
        F.round(F.avg((F.col("n_errors") == 0).cast("double")), 6).alias("accepted"),
    )
