"""Stop words: tables of (language, word), own lists, and lists of one word per line."""

from __future__ import annotations

import builtins
import keyword

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.text import ANALYZERS, STOP_LISTS

# Reserved words of public language specifications, and frequent English words.
RESERVED = {
    "Java": "abstract assert boolean break byte case catch char class const continue default double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null String Object Override",
    "JavaScript": "async await break case catch class const continue debugger default delete else enum export extends false finally for function import instanceof let new null return static super switch this throw true try typeof undefined var void while with yield console document window",
    "C": "auto break case char const continue default double else enum extern float for goto inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while define include ifdef ifndef endif printf NULL",
    "C++": "alignas alignof and asm auto bool break case catch char class const constexpr continue decltype default delete double else enum explicit export extern false float for friend goto inline int long mutable namespace new noexcept nullptr operator private protected public register return short signed sizeof static struct switch template this throw true try typedef typeid typename union unsigned using virtual void volatile while std include",
    "C#": "abstract base bool break byte case catch char checked class const continue decimal default delegate double else enum event explicit extern false finally fixed float for foreach goto implicit int interface internal lock long namespace new null object operator out override params private protected public readonly ref return sbyte sealed short sizeof static string struct switch this throw true try typeof uint ulong unchecked unsafe ushort using var virtual void volatile while System",
    "PHP": "abstract and array break callable case catch class clone const continue declare default echo else elseif empty endfor endforeach endif endswitch endwhile exit extends final finally for foreach function global goto implements include instanceof interface isset list namespace new print private protected public require return static switch throw trait try unset use var while xor yield",
    "XML": "xml version encoding xmlns xsi schemaLocation DOCTYPE ELEMENT ATTLIST CDATA",
    "HTML": "html head body div span class style script link meta href src title table img input form label button option select width height type name value content",
    "Jupyter Notebook": "cell cells cell_type code execution_count metadata outputs source markdown nbformat nbformat_minor kernelspec language_info",
    "Text": "the and for are but not you all any can had her was one our out day get has him his how man new now old see two way who did its let put say she too use that with have this will your from they know want been good much some time very when come here just like long make many more only over such take than them well were what about after again could every first found great house large never other place right small sound still their there these thing think three water where which world would write",
    "default": "break case class const continue default else false final for function if import int new null private public return static string switch this true try var void while",
}


def shipped(spark: SparkSession) -> DataFrame:
    """The lists that come with the engine, as (language, word)."""
    lists = {k: v.split() for k, v in RESERVED.items()} | {"Python": [*keyword.kwlist, *keyword.softkwlist, *dir(builtins), "self", "cls"]}
    return spark.createDataFrame([(k, w) for k, v in lists.items() for w in v], "language string, word string")


def read_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Lists of one word per line; the file name without its ending is the language."""
    name = F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.[^.]*$", "")
    lines = spark.read.text(folder).select(F.url_decode(name).alias("language"), F.trim("value").alias("word"))
    return lines.where("word <> ''").distinct()


def by_analyzer(stopwords: DataFrame) -> DataFrame:
    """(analyzer, word): the union of the lists that each analyzer joins, trimmed, without repeats.

    A list under a name that no analyzer has goes unused; null words are dropped.
    """
    spark = stopwords.sparkSession
    wanted = {a: STOP_LISTS.get(a, (a,)) for a in {*ANALYZERS.values(), "default"}}
    pairs = spark.createDataFrame([(a, x) for a, ls in wanted.items() for x in ls], "analyzer string, language string")
    words = stopwords.select("language", F.trim("word").alias("word")).where("word is not null and word <> ''")
    return words.join(pairs, "language").select("analyzer", "word").distinct()
