"""Per-document text quality statistics (problem 9).

Every document gets statistics over its whole text; each statistic goes into a mergeable
quantile sketch (KLL) per language and into one of all documents. From these values become
percentiles and robust z-scores, and the tails are flagged.

A document is no prose if less than half of its non-blank characters belong to running
sentences, or if it lies so far out among the documents of its language, in signs or figures on
the one side and in common words on the other, that what looked like sentences were none (menus,
sparse tables). Languages of fewer than ``enough`` documents, and documents without one, are
compared with all documents.

Which words are common is told by the corpus: per language those whose share of documents is,
with three standard deviations to spare, at least a tenth; the fixed function words below join
them. Documents of no told language have the latter only: what is frequent there is frequent junk.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.runtime import cut

# Function words of common written languages.
FUNCTION_WORDS = frozenset(
    """
    a about after all also an and any are as at be because been before but by can could did do does down each
    else for from had has have he her here him his how i if in into is it its just like many may me more most
    must my need needs no nobody none not nothing now of off on once one only or other our out over own per she
    should so some still such than that the their them then there these they this those though through to too
    under until up us very was we were what when where which while who why will with without would you your
    aber als am an auch auf aus bei bis da dann das dass dem den der des die durch ein eine einem einen einer es
    für hat ich ihr im in ist jede jeder kann man mehr mit nach nicht noch nur oder sein selbst sich sie sind so
    sonst sonst über um und vom von vor vorher war weil wenn wer wie wir wird zu zum zur
    al algo ante aunque cada como con contra cuando de del desde donde el ella en entre era es esta este está
    fue ha hay la las le les lo los más mejor mi muy no nos o para pero por porque que se si sigue sin sobre solo
    son su sus también tan una uno un vez y ya
    à au aux avec avons beaucoup bien car ce cela ces cet cette chaque comme dans de des du elle en encore est et
    été faut il ils je jour la le les leur lui mais même mieux ne nous on ou où par parce pas pas plus pour
    quand que qui sa sans se ses si son sont sous sur tous tout un une vaut vous
    che di e gli il nel non per più sono uma um os não é em do da dos na no com ao het een van niet dat op zijn
    och att det som på är av til og ikke med å jest nie się na i w z do że
    """.split()
)
WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
CODE = re.compile(r"`[^`\n]*`")
BULLET = re.compile(r"^\s*(?:[-*+•‣◦>]|\d{1,3}[.)]|\[[ xX]\])\s+(?:\[[ xX]\]\s+)?")
STRUCTURED = re.compile(
    r"^\s*(?:\|.*\|\s*$|\+[-=+]+\+\s*$|<[^>]+>.*|at\s+[\w.$]+\(|File \"|\d{4}-\d\d-\d\d[T ]\d\d:|[0-9a-f]{6,}\s+(?:[0-9a-f]{2}\s+){4}"
    r"|[\w.\-]+\s*[=:]\s*\S*\s*$|[\w./\\-]+\s*$|[{}\[\]();,]+\s*$|.*\.{4,}\s*\d+\s*$)"
)
TABLE = re.compile(r"\t|\S {3,}\S.* {3,}\S|[^,]*,[^ ,][^,]*,[^ ,]|[^;]*;[^ ;]*;[^ ;]*|^[^;]*;;|,,")
TERMINAL = tuple(".!?:…。！？\"'”’)")
CJK = re.compile(r"[぀-ヿ一-鿿가-힯]")
CJK_END = re.compile(r"[。、，！？]")
STATS = ("n_words", "mean_word_length", "symbol_ratio", "digit_ratio", "end_punctuation", "common_share", "distinct_share", "running_share")


def plain(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


COMMON = frozenset(FUNCTION_WORDS | {plain(w) for w in FUNCTION_WORDS})


def lines_of(text: str) -> list[str]:
    return text.replace("\r\n", "\n").replace("\r", "\n").split("\n")


def verdict(line: str, common: frozenset[str] | set[str]) -> int:
    """1: running sentence, 0: not, -1: too short to tell by itself."""
    body = BULLET.sub("", line, count=1).lstrip("#").strip()
    dense = len(body) - body.count(" ")
    if CJK.search(body):
        n = len(CJK.findall(body))
        if n > 0.5 * dense:
            return 1 if n >= 6 and CJK_END.search(body) else -1
    bare = CODE.sub(" ", body)
    words = WORD.findall(bare)
    letters = sum(map(len, words))
    code = len(body) - len(bare)
    if STRUCTURED.match(body) and not (len(words) >= 4 and body[0] not in "<|+"):
        return 0
    if len(words) < 4:
        return -1
    known = hits = 0
    for w in words:
        w = w.lower()
        if len(w) > 1 or w in "aeioyàéwz":
            known += 1
            hits += w in common or (not w.isascii() and plain(w) in common)
    if letters < 0.6 * max(1, dense - code) or letters < 2.2 * len(words):
        return 0
    need = 0.16 if len(words) >= 8 else 0.24
    if ("\t" in bare or "   " in bare or bare.count(",") > 2 or bare.count(";") > 1) and TABLE.search(bare):
        need = 0.3
    if hits < need * len(words) or known < 0.6 * len(words):
        return 0
    return 1


def running(text: str, common: frozenset[str] | set[str]) -> float:
    """Share of the non-blank characters that lie in running sentences; 0 without any."""
    lines = lines_of(text)
    marks = [verdict(x, common) if x.strip() else None for x in lines]
    inside = total = 0
    before = None
    for k, (line, mark) in enumerate(zip(lines, marks)):
        if mark is None:
            before = None
            continue
        dense = len("".join(line.split()))
        total += dense
        if mark == -1:  # the end or the beginning of a wrapped sentence
            words = WORD.findall(line)
            up = before == 1 and not BULLET.match(line) and (len(words) > 0 or "`" in line)
            down = k + 1 < len(lines) and marks[k + 1] == 1 and not BULLET.match(lines[k + 1]) and len(words) >= 2
            alone = len(words) >= 3 and line.rstrip().endswith((".", "!", "?")) and any(w.lower() in common for w in words)
            mark = 1 if up or down or alone else 0
        inside += dense * (mark == 1)
        before = mark
    if not total:
        return 0.0
    words = [w.lower() for w in WORD.findall(text)]
    if len(words) >= 30 and len(set(words)) < 0.08 * len(words) ** 0.9 and len(set(words)) <= 12:
        return 0.0  # the same few words over and over
    return inside / total


def measure(text: str, common: frozenset[str] | set[str]) -> tuple[float, ...]:
    words = WORD.findall(text)
    dense = "".join(text.split())
    filled = [x.rstrip() for x in lines_of(text) if x.strip()]
    low = [w.lower() for w in words]
    letters = sum(c.isalpha() for c in dense)
    digits = sum(c.isdigit() for c in dense)
    n = max(1, len(words))
    return (
        float(len(words)), sum(map(len, words)) / n, (len(dense) - letters - digits) / max(1, len(dense)), digits / max(1, len(dense)),
        sum(x.endswith(TERMINAL) for x in filled) / max(1, len(filled)), sum(w in common for w in low) / n, len(set(low)) / n, running(text, common),
    )


def language() -> Column:
    """``lang`` without case, blanks and region; und where it is null or blank."""
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(F.trim(F.col("lang")), r"^([A-Za-z]+)", 1)), F.lit("")), F.lit("und"))


def common_words(docs: DataFrame, share: float = 0.1) -> DataFrame:
    """(language, word) of words in at least ``share`` of a language's documents.

    Counted over all documents. Its size is bounded: a document holds few words, so at most
    (mean distinct words of a document) / share words pass per language.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}{2,})"), F.lit(1)))
    docs = docs.where("language <> 'und'")
    n = docs.groupBy("language").agg(F.count("*").alias("n"))
    df = docs.select("language", F.explode(words).alias("word")).groupBy("language", "word").agg(F.count("*").alias("df"))
    return df.join(n, "language").where((F.col("df") - 3 * F.sqrt("df")) >= share * F.col("n")).select("language", "word")


def _measurer(common: dict[str, frozenset[str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, langs, texts = (batch.column(k).to_pylist() for k in range(3))
            rows = [measure(t, common.get(x, COMMON)) for x, t in zip(langs, texts)]
            cols = [pa.array([r[k] for r in rows], pa.float64()) for k in range(len(STATS))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), *cols], names=["doc_id", "language", *STATS])

    return run


def statistics(documents: DataFrame, most_words: int = 50_000) -> DataFrame:
    """(doc_id, language, statistics) of every document whose text is neither null nor blank.

    ``documents`` has doc_id, text, lang; other columns are ignored. The corpus' common words
    reach the tasks by closure; beyond ``most_words`` of them (a bound that holds unless there
    are hundreds of languages) an error is raised rather than the driver filled.
    """
    docs = documents.select("doc_id", language().alias("language"), "text").where(F.col("text").rlike(r"\S"))
    found = common_words(docs).limit(most_words + 1).collect()
    if len(found) > most_words:
        raise ValueError(f"more than {most_words} common words")
    common: dict[str, set] = {}
    for x in found:
        common.setdefault(x["language"], set(COMMON)).add(x["word"])
    frozen = {k: frozenset(v | {plain(w) for w in v}) for k, v in common.items()}
    schema = "doc_id long, language string, " + ", ".join(f"{s} double" for s in STATS)
    # read twice, for the sketches and for the rows
    return cut(docs.mapInArrow(_measurer(frozen), schema))


ALL = "*"


def sketches(stats: DataFrame, k: int = 200) -> DataFrame:
    """(language, n, k_<statistic>): one KLL sketch for each language and statistic, and those of all
    documents under "*"; sketches of parts merge without loss of rank error."""
    both = stats.withColumn("language", F.explode(F.array("language", F.lit(ALL))))
    return both.groupBy("language").agg(F.count("*").alias("n"), *[F.kll_sketch_agg_double(s, k).alias(f"k_{s}") for s in STATS])


def quantiles(stats: DataFrame, points: int = 200) -> DataFrame:
    """(language, n, q_<statistic>): quantiles at 0, 1/points, ... 1, read from the sketches."""
    at = F.array(*[F.lit(k / points) for k in range(points + 1)])
    return sketches(stats).select("language", "n", *[F.kll_sketch_get_quantile_double(f"k_{s}", at).alias(f"q_{s}") for s in STATS])


def _count_below(value: Column):
    return lambda n, x: n + F.when(x < value, 1).otherwise(0)


def graded(stats: DataFrame, tail: float = 0.01, points: int = 200, enough: int = 200) -> DataFrame:
    """Statistics with percentile, robust z-score and tail flag within their language, and ``not_prose``.

    A percentile is the share of the language's quantiles below the value. A z-score is
    (x - median) / (interquartile range / 1.349); where that range is 0 it is taken as 1e-6, so
    a value that differs from a constant is far out.
    """
    q = cut(quantiles(stats, points))
    # (language, peers): whom its documents are compared with
    peers = q.where(F.col("language") != ALL).select("language", F.when((F.col("language") == "und") | (F.col("n") < enough), F.lit(ALL)).otherwise(F.col("language")).alias("peers"))
    joined = stats.join(peers.join(q.withColumnRenamed("language", "peers"), "peers").drop("peers", "n"), "language")
    out = []
    for s in STATS:
        q = F.col(f"q_{s}")
        below = F.aggregate(q, F.lit(0), _count_below(F.col(s)))
        out.append(F.round(below / F.lit(points + 1.0), 6).alias(f"p_{s}"))
        out.append(F.round((F.col(s) - q[points // 2]) / F.greatest((q[3 * points // 4] - q[points // 4]) / 1.349, F.lit(1e-6)), 6).alias(f"z_{s}"))
    graded_ = joined.select("doc_id", "language", *STATS, *out)
    tails = [F.when((F.col(f"p_{s}") <= tail) | (F.col(f"p_{s}") > 1 - tail), F.lit(s)) for s in STATS]
    return graded_.select("*", F.array_compact(F.array(*tails)).alias("tails"), not_prose().alias("not_prose"))


def not_prose(far: float = 14.0) -> Column:
    """Too few running sentences, or far out in signs or figures and in a lack of common words together."""
    out = F.greatest("z_symbol_ratio", "z_digit_ratio") - F.col("z_common_share")
    return (F.col("running_share") < 0.5) | ((out >= far) & (F.col("z_common_share") < 0))
