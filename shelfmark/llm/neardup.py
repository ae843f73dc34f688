"""Groups and pairs of files whose contents are nearly the same (problem 1).

Each content gets a MinHash fingerprint of its word shingles: ``blocks * rows`` slots.
Two contents of similarity J differ in about (1 - J) of the slots, which is the Hamming
distance of their fingerprints. The fingerprint is split into ``blocks`` blocks of ``rows``
slots; a pair that differs in fewer slots than there are blocks must agree on one block
(pigeonhole), and beyond that bound a pair of J >= 0.7 shares none of 50 blocks of 5 with a
probability of at most 1e-4 (at exactly 0.7; 1e-6 at 0.75, 2e-9 at 0.8). Blocks are joined by key,
the Hamming distance of a 128-bit sketch of the fingerprint is tested inside the join, and
what remains is verified on the shingle sets themselves.

Rows of the same word sequence form one class before any block is joined, so copies never
meet in pairs until the result asks for them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import components
from shelfmark.runtime import cut

WORDS = re.compile(r"[a-z0-9_]+")
FINGERPRINT = "id long, c1 long, c2 long, s1 long, s2 long, blocks array<long>"


def _arguments(n: int, seed: int = 20240601) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.RandomState(seed)
    a = r.randint(0, 2**31, n).astype(np.uint32) * np.uint32(2) + np.uint32(1)
    return a, r.randint(0, 2**31, n).astype(np.uint32) * np.uint32(2)


class _Hashes(dict):
    """Word to a 64-bit hash; forgets everything when it grows too large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def fingerprinter(shingle: int, min_words: int, blocks: int, rows: int):
    slots = max(blocks * rows, 128)
    a, b = _arguments(slots)
    mix = np.random.RandomState(7).randint(1, 2**62, (rows, 2)).astype(np.uint64) * np.uint64(2) + np.uint64(1)

    def chunk(ids: list[int], texts: list[str], known: _Hashes) -> Iterator[pa.RecordBatch]:
        few, keep, flat, ends, keys = [], [], [], [], []
        for i, text in zip(ids, texts):
            words = WORDS.findall(text.lower())
            if len(words) < max(min_words, shingle):
                if len(words) >= min_words:
                    # no shingles: a class of the words, or of the text itself if it has none
                    few.append((i, xxhash.xxh3_128_digest(" ".join(words) if words else f"\0{text}")))
                continue
            keep.append(i)
            flat.extend([known[w] for w in words])
            ends.append(len(flat))
            keys.append(xxhash.xxh3_128_digest(" ".join(words)))
        if few:
            cls = np.frombuffer(b"".join(k for _, k in few), dtype=np.int64).reshape(-1, 2)
            zero = pa.array(np.zeros(len(few), dtype=np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in few], pa.int64()), pa.array(cls[:, 0].copy()), pa.array(cls[:, 1].copy()), zero, zero, pa.array([[]] * len(few), pa.list_(pa.int64()))],
                names=["id", "c1", "c2", "s1", "s2", "blocks"],
            )
        if not keep:
            return
        h = np.array(flat, dtype=np.uint64)
        ends = np.array(ends)
        starts = np.concatenate(([0], ends[:-1]))
        n = len(h) - shingle + 1
        s = np.zeros(n, dtype=np.uint64)
        for k in range(shingle):
            s = (s ^ (s >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[k : k + n]
        s = (s ^ (s >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        x = (s >> np.uint64(32)).astype(np.uint32)
        inside = np.ones(n, dtype=bool)
        for k in range(1, shingle):  # runs that reach into the next text
            over = ends[:-1] - k
            inside[over] = False
        x = x[inside]
        sizes = (ends - starts) - shingle + 1
        first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        sig = np.empty((slots, len(keep)), dtype=np.uint32)
        for k in range(slots):
            sig[k] = np.minimum.reduceat(x * a[k] + b[k], first)
        bits = ((sig[:128] * np.uint32(0x9E3779B1)) >> np.uint32(31)).astype(np.uint64)
        powers = np.uint64(1) << np.arange(64, dtype=np.uint64)
        s1 = (bits[:64] * powers[:, None]).sum(axis=0, dtype=np.uint64).view(np.int64)
        s2 = (bits[64:] * powers[:, None]).sum(axis=0, dtype=np.uint64).view(np.int64)
        cut_ = sig[: blocks * rows].reshape(blocks, rows, -1).astype(np.uint64)
        key = np.zeros((blocks, len(keep)), dtype=np.uint64)
        for r in range(rows):
            key = (key ^ (key >> np.uint64(31))) * mix[r, 0] + cut_[:, r] * mix[r, 1]
        key = key ^ (key >> np.uint64(33))
        key = key * np.uint64(0xFF51AFD7ED558CCD) + np.arange(blocks, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
        cls = np.frombuffer(b"".join(keys), dtype=np.int64).reshape(-1, 2)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(keep) * blocks + 1, blocks, dtype=np.int32)), pa.array(np.ascontiguousarray(key.T).ravel().view(np.int64)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(keep, pa.int64()), pa.array(cls[:, 0].copy()), pa.array(cls[:, 1].copy()), pa.array(s1), pa.array(s2), lists],
            names=["id", "c1", "c2", "s1", "s2", "blocks"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at, start, size = 0, 0, 0
            while at < len(ids):  # chunks of bounded size, so that long texts do not add up
                size += len(texts[at] or "")
                at += 1
                if size > 1_000_000 or at == len(ids):
                    rows_ = [(i, t) for i, t in zip(ids[start:at], texts[start:at]) if i is not None and t is not None]
                    yield from chunk([i for i, _ in rows_], [t for _, t in rows_], known)
                    start, size = at, 0

    return run


def _checker(shingle: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, set] = {}

        def shingles(i: int, text: str) -> set:
            s = known.get(i)
            if s is None:
                if len(known) > 2000:
                    known.clear()
                w = WORDS.findall(text.lower())
                s = known[i] = set(zip(*[w[k:] for k in range(shingle)]))
            return s

        for batch in batches:
            a, b, ta, tb = (batch.column(k).to_pylist() for k in range(4))
            out = []
            for i, (x, y) in enumerate(zip(a, b)):
                p, q = shingles(x, ta[i]), shingles(y, tb[i])
                both = len(p & q)
                if both >= threshold * (len(p) + len(q) - both) - 1e-9:
                    out.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in out], pa.int64()), pa.array([b[i] for i in out], pa.int64())], names=["a", "b"])

    return run


class NearDuplicates:
    """Near-duplicate classes of a text column.

    ``id`` must be unique and not null; rows with null text, or fewer than ``min_words``
    words, belong to no class; rows of fewer than ``shingle`` words are only compared for
    equal words (for equal texts without any word). Other columns are ignored, whatever their names.

    * :meth:`members` - (id, rep): each row and the smallest id of its word sequence
    * :meth:`links`   - (a, b): pairs of representatives with similarity >= threshold, a < b
    * :meth:`pairs`   - (a, b): all pairs of rows, copies expanded
    * :meth:`groups`  - (id, root, n_links): connected components of the links
    """

    def __init__(self, df: DataFrame, id: str, text: str, shingle: int = 5, threshold: float = 0.8, min_words: int = 40, blocks: int = 50, rows: int = 5, max_bits: int | None = None):
        self.shingle, self.threshold = shingle, threshold
        self.source = df.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
        # five standard deviations beyond the distance expected at the threshold
        p = (1 - threshold) / 2
        self.max_bits = max_bits or int(128 * p + 5.2 * (128 * p * (1 - p)) ** 0.5)
        self.prints = cut(self.source.mapInArrow(fingerprinter(shingle, min_words, blocks, rows), FINGERPRINT))
        self._links: DataFrame | None = None
        self._members: DataFrame | None = None

    def members(self) -> DataFrame:
        if self._members is None:
            keys = self.prints.select("id", "c1", "c2")
            reps = keys.groupBy("c1", "c2").agg(F.min("id").alias("rep"))
            self._members = cut(keys.join(reps, ["c1", "c2"]).select("id", "rep"))
        return self._members

    def candidates(self) -> DataFrame:
        """Pairs of representatives that share a block within the Hamming bound."""
        reps = self.members().where("id = rep").select("id")
        rows = self.prints.join(reps, "id", "left_semi").select(F.explode("blocks").alias("key"), "id", "s1", "s2")
        a, b = rows.alias("a"), rows.alias("b")
        bits = F.bit_count(F.col("a.s1").bitwiseXOR(F.col("b.s1"))) + F.bit_count(F.col("a.s2").bitwiseXOR(F.col("b.s2")))
        near = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id")) & (bits <= self.max_bits))
        return near.select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()

    def links(self) -> DataFrame:
        if self._links is None:
            texts = self.source.where(F.col("text").isNotNull())
            found = (
                self.candidates()
                .join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
                .join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
                .select("a", "b", "ta", "tb")
                .mapInArrow(_checker(self.shingle, self.threshold), "a long, b long")
            )
            self._links = cut(found)
        return self._links

    def pairs(self) -> DataFrame:
        m = self.members()
        left, right = m.select(F.col("rep").alias("a"), F.col("id").alias("x")), m.select(F.col("rep").alias("b"), F.col("id").alias("y"))
        across = self.links().join(left, "a").join(right, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        multiple = m.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1").select("rep")
        copies = m.join(multiple, "rep", "left_semi")
        same = copies.alias("p").join(copies.alias("q"), (F.col("p.rep") == F.col("q.rep")) & (F.col("p.id") < F.col("q.id")))
        return across.union(same.select(F.col("p.id"), F.col("q.id")))

    def groups(self) -> DataFrame:
        roots = components(self.links())
        links = self.links()
        n = links.select(F.col("a").alias("rep")).union(links.select("b")).groupBy("rep").agg(F.count("*").alias("n_links"))
        m = self.members().join(roots.withColumnRenamed("id", "rep"), "rep", "left").join(n, "rep", "left")
        return m.select("id", F.coalesce("root", "rep").alias("root"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
