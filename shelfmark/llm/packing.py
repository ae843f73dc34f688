"""Filling containers of fixed capacity with texts (problem 7).

Items go to chunks of about ``chunk_items`` by a hash of their id, so no task ever holds more
than one chunk. Within a chunk, Karmarkar-Karp multiway differencing builds ``m`` windows:
every item starts as a partial partition with one filled slot, the two partial partitions
with the largest differences are merged with opposing order (largest slot on smallest), and
the last one left is a near-equal division. ``m`` starts at the least number that could hold
the chunk and rises whenever a window exceeds the capacity. An item is split only if it is
larger than the capacity: into full windows of its own and a rest that is packed like any item.
"""

from __future__ import annotations

import heapq
import math
import os
from bisect import insort
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.runtime import cut

# Fixed value: one token is a maximal run of ASCII letters, digits and _, or one other non-blank character.
# The blanks are those of Unicode; Java's \s knows ASCII only.
BLANKS = r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
TOKEN = rf"[A-Za-z0-9_]+|[^A-Za-z0-9_{BLANKS}]"
TOKENIZERS = os.environ.get("SHELFMARK_TOKENIZERS", "/opt/tokenizers")


def token_count(text: str) -> Column:
    """Tokens of a column as TESTDATA.md counts them; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(TOKEN)), F.lit(0)).cast("long")


def bpe_counter(name: str = "byte_bpe_50k.tiktoken", folder: str = TOKENIZERS) -> Callable[[Iterator[pd.Series]], Iterator[pd.Series]]:
    """A pandas UDF body that counts the tokens of a public byte-level BPE vocabulary."""

    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import base64

        import tiktoken

        with open(os.path.join(folder, name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        enc = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for texts in parts:
            yield pd.Series([0 if t is None else len(enc.encode_ordinary(t)) for t in texts], dtype="int64")

    return count


def difference(sizes: list[int], windows: int) -> list[tuple[int, object]]:
    """Karmarkar-Karp multiway differencing of item indices into at most ``windows`` slots.

    A partial partition is a list of (sum, number, members) in ascending order; members form a
    tree of pairs, so merging never copies them.
    """
    heap: list[tuple[int, int, list]] = [(-s, i, [(s, i, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    n = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(b) > len(a):
            a, b = b, a
        over = len(a) + len(b) - windows  # slots of both that must share
        if len(b) == 1:
            item = b[0]
            if over > 0:
                low = a.pop(0)
                n += 1
                item = (low[0] + item[0], n, (low[2], item[2]))
            insort(a, item)
            merged = a
        elif over <= 0:
            merged = sorted(a + b)
        else:  # the smallest slots of a, ascending, on the largest of b, descending
            k, together = len(b), []
            lone = over - k  # < 0: slots of b that find an empty one
            take = k + min(0, lone)
            top = sorted(b, reverse=True)
            # those of b that meet nothing are its largest
            free, meet = top[: k - take], top[k - take :]
            for x, y in zip(a[:take], meet):
                n += 1
                together.append((x[0] + y[0], n, (x[2], y[2])))
            merged = sorted(a[take:] + free + together)
        n += 1
        low = merged[0][0] if len(merged) == windows else 0
        heapq.heappush(heap, (low - merged[-1][0], n, merged))
    return [(s, m) for s, _, m in heap[0][2]] if heap else []


def leaves(tree: object) -> Iterator[int]:
    stack = [tree]
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):
            stack.extend(x)
        else:
            yield x


def fill(sizes: list[int], capacity: int) -> list[int]:
    """Window of each item; every size must be <= capacity."""
    windows = max(1, math.ceil(sum(sizes) / capacity))
    while True:
        slots = difference(sizes, windows)
        excess = sum(max(0, s - capacity) for s, _ in slots)
        if not excess:
            break
        windows += max(1, excess // capacity)
    at = [0] * len(sizes)
    for w, (_, members) in enumerate(slots):
        for i in leaves(members):
            at[i] = w
    return at


def pack(df: DataFrame, id: str, size: str, capacity: int, chunk_items: int = 2000) -> DataFrame:
    """Assign items to windows of ``capacity``: (id, piece, n_pieces, tokens, window).

    ``window`` is unique over the result; windows of a split item's full pieces hold nothing
    else. Rows with null id or size and items of size 0 need no window and do not come out;
    repeated ids are separate items. An empty table gives an empty result. Other columns are
    ignored.
    """
    items = cut(df.select(F.col(id).alias("id"), F.col(size).cast("long").alias("size")).where("id is not null and size > 0"))
    chunks = max(1, math.ceil(items.count() / chunk_items))
    # a fixed number of tasks, each with at most a few hundred chunks, however few bytes they are
    tasks = max(min(chunks, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), math.ceil(chunks / 200))
    items = items.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks))).repartition(tasks, "chunk")

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "id"], ascending=[False, True], kind="stable")
        base, alone = int(pdf["chunk"].iloc[0]) << 32, 0
        rest, owners, out = [], [], []
        for i, s in zip(pdf["id"], pdf["size"]):
            whole, left = divmod(int(s), capacity)
            pieces = whole + (left > 0)
            if pieces == 1:
                rest.append(int(s))
                owners.append((i, 0, 1))
                continue
            for p in range(whole):
                out.append((i, p, pieces, capacity, base + (1 << 31) + alone))
                alone += 1
            if left:
                rest.append(left)
                owners.append((i, whole, pieces))
        for (i, p, n), s, w in zip(owners, rest, fill(rest, capacity) if rest else []):
            out.append((i, p, n, s, base + w))
        return pd.DataFrame(out, columns=["id", "piece", "n_pieces", "tokens", "window"])

    kind = dict(items.dtypes)["id"]
    return items.groupBy("chunk").applyInPandas(place, f"id {kind}, piece long, n_pieces long, tokens long, window long")


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """Windows, tokens and share of room used of a packing."""
    w = packed.groupBy("window").agg(F.sum("tokens").alias("t"))
    return w.agg(
        F.count("*").alias("windows"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"),
        F.round(F.sum("t") / (F.count("*") * F.lit(capacity)), 6).alias("used"),
    )
