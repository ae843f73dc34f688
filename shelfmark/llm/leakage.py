"""Evaluation texts inside training documents (problem 8).

Latent semantic retrieval. Passages are windows of ``run`` words that start at every word, of
items and documents alike. They become TF-IDF vectors; a distributed randomised SVD (each task
adds up its part of A'AQ, two power steps) gives a latent space. The items' windows are
clustered there, and a passage meets the windows of its ``probes`` nearest clusters by cosine.
Candidates are verified on the words.

* :meth:`LeakSearch.leaks`: the two windows must be equal. A window that is equal to one of an
  item has the same vector, so it lies in the cluster it is looked for, with cosine 1. No equal
  window holds a word that no item has, so only runs of known words are searched.
* :meth:`LeakSearch.matches`: paraphrases too. Windows run over the whole text; a word that no
  item has points nowhere in the latent space and counts in the length of its window, so every
  change lowers the cosine. The longest common run, the longest common subsequence and the
  item's answer are looked for in the words around the best window.

The items are a bounded query set: beyond ``max_windows`` windows an error is raised. What
reaches the driver or the tasks' closures is bounded by them, never by the documents.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.runtime import cut

WORD = re.compile(r"[a-z0-9]+")
# Characters that are removed before words are read.
INVISIBLE = {c: None for c in (0x200B, 0x200C, 0x00AD, 0x2060, 0xFEFF)}
ANSWER = re.compile(r"(?:\banswer\s*:\s*|\breturn\s+|=>\s*)(.{3,80})$", re.IGNORECASE | re.DOTALL)


def words_of(text: str) -> list[str]:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    if not text.isascii():
        text = text.translate(INVISIBLE)
    return WORD.findall(text)


def windows_of(words: np.ndarray, size: int) -> np.ndarray:
    """All windows of a run of words, one row each."""
    if len(words) < size:
        return np.zeros((0, size), dtype=np.int64)
    return np.lib.stride_tricks.sliding_window_view(words, size)


class ItemIndex:
    """The items' words and windows; small enough for a closure."""

    def __init__(self, items: list[tuple[int, str]], run: int = 13):
        self.run = run
        self.words: dict[str, int] = {}
        self.ids = [i for i, _ in items]
        self.texts = [np.array([self.words.setdefault(w, len(self.words)) for w in words_of(t)], dtype=np.int64) for _, t in items]
        self.answers = []
        for _, t in items:
            m = ANSWER.search(t)
            self.answers.append([self.words[w] for w in words_of(m.group(1))] if m else [])
        parts = [windows_of(t, run) for t in self.texts]
        self.windows = np.concatenate([*parts, np.zeros((0, run), dtype=np.int64)])
        self.owner = np.repeat(np.arange(len(parts)), [len(x) for x in parts])

    def known(self, text: str) -> np.ndarray:
        """Numbers of a text's words; -1 for those that no item has."""
        get = self.words.get
        return np.array([get(w, -1) for w in words_of(text)], dtype=np.int64)


def passages(documents: DataFrame, index: ItemIndex) -> DataFrame:
    """(doc_id, words): maximal runs of at least ``run`` words that all occur in items."""
    run = index.run

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, runs = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = index.known(text)
                ends = np.concatenate(([-1], np.flatnonzero(ids < 0), [len(ids)]))
                for k in np.flatnonzero(np.diff(ends) > run):
                    docs.append(i)
                    runs.append(ids[ends[k] + 1 : ends[k + 1]])
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(runs, pa.list_(pa.int32()))], names=["doc_id", "words"])

    return documents.select("doc_id", "text").where("doc_id is not null and text is not null").mapInArrow(split, "doc_id long, words array<int>")


def _project(words: np.ndarray, basis: np.ndarray, size: int) -> np.ndarray:
    """Rows of A @ Q for all windows of a run of words: differences of running sums of weighted rows of Q."""
    sums = np.concatenate((np.zeros((1, basis.shape[1])), np.cumsum(basis[words], axis=0)))
    return sums[size:] - sums[:-size]


def _back(rows: np.ndarray, size: int) -> np.ndarray:
    """For each word of a run the sum of the rows of the windows that hold it."""
    n = len(rows) + size - 1
    sums = np.concatenate((np.zeros((1, rows.shape[1])), np.cumsum(rows, axis=0)))
    at = np.arange(n)
    return sums[np.minimum(at + 1, len(rows))] - sums[np.maximum(at - size + 1, 0)]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _power(runs: DataFrame, weight: np.ndarray, basis: np.ndarray, size: int, block: int = 64, ways: int = 64) -> np.ndarray:
    """A'A @ Q over all windows of the documents.

    Each task adds up its own windows; the sums are added by blocks of words, and in two steps,
    so that no task holds more than the blocks of a ``ways``-th of all tasks.
    """
    v, k = basis.shape
    weighted = basis * weight[:, None]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((v, k)), False
        for batch in batches:
            lists = batch.column(0)
            for r in range(len(lists)):
                words = lists[r].values.to_numpy()
                np.add.at(total, words, _back(_project(words, weighted, size), size))
                seen = True
        if seen:
            way = TaskContext.get().partitionId() % ways
            blocks = list(range(0, v, block))
            cols = [pa.array([b // block for b in blocks], pa.int32()), pa.array([way] * len(blocks), pa.int32()), pa.array([total[b : b + block].tobytes() for b in blocks], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["b", "way", "m"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"b": pdf["b"].iloc[:1], "way": pdf["way"].iloc[:1], "m": [sum(np.frombuffer(m) for m in pdf["m"]).tobytes()]})

    schema = "b int, way int, m binary"
    parts = runs.select("words").mapInArrow(part, schema).groupBy("b", "way").applyInPandas(add, schema).groupBy("b").applyInPandas(add, schema).collect()
    out = np.zeros((v, k))
    for r in parts:
        out[r["b"] * block : (r["b"] + 1) * block] += np.frombuffer(r["m"]).reshape(-1, k)
    return out * weight[:, None]


def latent_space(runs: DataFrame, index: ItemIndex, rank: int, steps: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """IDF weights and an orthonormal latent basis (vocabulary x rank) by randomised SVD."""
    v = len(index.words)
    if not len(index.windows):
        return np.ones(v), np.zeros((v, 1))
    counted = runs.select(F.explode(F.array_distinct("words")).alias("w")).groupBy("w").agg(F.count("*").alias("df")).collect()
    df = np.zeros(v)
    for r in counted:
        df[r["w"]] = r["df"]
    for t in index.texts:
        df[np.unique(t)] += 1
    weight = np.log1p(df.max() / np.maximum(df, 1)) + 0.1
    rank = min(rank, v)
    q = np.linalg.qr(np.random.RandomState(11).standard_normal((v, rank)))[0]
    for _ in range(steps):
        y = _power(runs, weight, q, index.run)
        # the items' own windows belong to the collection, so words of few documents have a direction
        back = np.zeros_like(y)
        for t in index.texts:
            if len(t) >= index.run:
                np.add.at(back, t, _back(_project(t, q * weight[:, None], index.run), index.run))
        q = np.linalg.qr(y + back * weight[:, None])[0]
    return weight, q


class Clusters:
    """The items' windows by direction: spherical k-means over all of them, fitted on at most ``sample``."""

    def __init__(self, vectors: np.ndarray, probes: int = 4, sample: int = 20_000, rounds: int = 8):
        self.vectors, self.probes = vectors, probes
        n = len(vectors)
        r = np.random.RandomState(5)
        some = vectors if n <= sample else vectors[r.choice(n, sample, replace=False)]
        count = max(1, int(len(some) ** 0.5))
        c = some[r.choice(len(some), count, replace=False)] if n else vectors
        for _ in range(rounds if n else 0):
            own = (some @ c.T).argmax(axis=1)
            sums = np.zeros_like(c)
            np.add.at(sums, own, some)
            c = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, _unit(sums), c).astype(np.float32)
        self.centres = c
        own = np.concatenate([(vectors[k : k + 8192] @ c.T).argmax(axis=1) for k in range(0, n, 8192)]) if n else np.zeros(0, dtype=int)
        order = np.argsort(own, kind="stable")
        self.members = np.split(order, np.searchsorted(own[order], np.arange(1, len(c))))

    def near(self, rows: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, window, cosine) of the pairs of at least ``least`` in the clusters probed."""
        k = min(self.probes, len(self.centres))
        probed = np.argpartition(-(rows @ self.centres.T), k - 1, axis=1)[:, :k] if k else np.zeros((len(rows), 0), dtype=int)
        flat = probed.ravel()
        by = np.argsort(flat, kind="stable")
        edges = np.searchsorted(flat[by], np.arange(len(self.centres) + 1))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for c in range(len(self.centres)):
            own = by[edges[c] : edges[c + 1]] // k if k else by
            if len(own) and len(self.members[c]):
                cosines = rows[own] @ self.vectors[self.members[c]].T
                x, y = np.nonzero(cosines >= least)
                if len(x):
                    out.append((own[x], self.members[c][y], cosines[x, y]))
        none = np.zeros(0, dtype=int)
        return tuple(np.concatenate(p) for p in zip(*out)) if out else (none, none, none.astype(np.float32))


def longest_run(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest run of words that both have."""
    best, row = 0, np.zeros(len(b) + 1, dtype=np.int64)
    for w in a:
        row[1:] = np.where(b == w, row[:-1] + 1, 0)
        best = max(best, int(row.max()))
    return best


def longest_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    row = np.zeros(len(b) + 1, dtype=np.int64)
    for w in a:
        step = np.where(b == w, row[:-1] + 1, 0)
        row[1:] = np.maximum.accumulate(np.maximum(step, row[1:]))
    return int(row[-1])


class LeakSearch:
    """Leaks of ``items`` (item_id, text) in ``documents`` (doc_id, text).

    Null texts and items of fewer than ``run`` words match nothing; documents with equal
    texts are each reported; other columns are ignored. An empty table on either side gives
    an empty result.
    """

    def __init__(self, documents: DataFrame, items: DataFrame, run: int = 13, rank: int = 192, cosine: float = 0.8, probes: int = 4, max_windows: int = 500_000):
        self.run, self.cosine = run, cosine
        self.documents = documents.select("doc_id", "text").where("doc_id is not null and text is not null")
        rows = items.select("item_id", "text").where("item_id is not null and text is not null").orderBy("item_id").limit(max_windows + 1).collect()
        self.index = ItemIndex([(r["item_id"], r["text"]) for r in rows], run)
        if max(len(rows), len(self.index.windows)) > max_windows:
            raise ValueError(f"more than {max_windows} windows of items: search the items in parts")
        self.runs = cut(passages(self.documents, self.index))
        self.weight, basis = latent_space(self.runs, self.index, rank)
        self.basis = basis * self.weight[:, None]
        parts = [_project(t, self.basis, run) for t in self.index.texts if len(t) >= run]
        self.vectors = np.concatenate([*parts, np.zeros((0, self.basis.shape[1]))])
        self.clusters = Clusters(_unit(self.vectors).astype(np.float32), probes)

    def leaks(self) -> DataFrame:
        """(doc_id, item_id) of pairs that share a run of at least ``run`` words."""
        index, least, run, basis, clusters = self.index, self.cosine, self.run, self.basis, self.clusters

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                docs, lists = batch.column(0).to_numpy(), batch.column(1)
                found: set[tuple[int, int]] = set()
                at = 0
                while at < len(docs):  # some thousand windows at once
                    rows, windows, owners, n = [], [], [], 0
                    while at < len(docs) and n < 8192:
                        words = lists[at].values.to_numpy()
                        rows.append(_project(words, basis, run))
                        windows.append(windows_of(words, run))
                        owners.append(np.full(len(rows[-1]), docs[at]))
                        n += len(rows[-1])
                        at += 1
                    x, y, _ = clusters.near(_unit(np.concatenate(rows)).astype(np.float32), least)
                    same = (np.concatenate(windows)[x] == index.windows[y]).all(axis=1)
                    found.update(zip(np.concatenate(owners)[x[same]].tolist(), index.owner[y[same]].tolist()))
                cols = [[d for d, _ in found], [index.ids[k] for _, k in found]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id"])

        return self.runs.mapInArrow(search, "doc_id long, item_id long").distinct()

    def matches(self, step: int = 3, cosine: float = 0.7) -> DataFrame:
        """(doc_id, item_id, cosine, run_words, item_share, answer): candidates and what the words say.

        One row for each pair that the cosine search proposes, from windows at every ``step``-th
        word of the whole text; 0.7 leaves room for two new words in thirteen. ``run_words`` is the longest common run, ``item_share`` the longest
        common subsequence as a share of the item, ``answer`` whether the item's answer stands there
        too; all three of the words around the best window, as many as the item has to both sides.
        """
        index, least, run, basis, clusters = self.index, cosine, self.run, self.basis, self.clusters
        full = (self.weight[index.windows] ** 2).sum() if len(index.windows) else 1.0
        kept = float((self.vectors**2).sum() / full)  # of a window's length in the latent space
        strange = kept * float(self.weight.max() if len(self.weight) else 1.0) ** 2

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            padded = np.concatenate((basis, np.zeros((1, basis.shape[1]))))
            for batch in batches:
                texts = [index.known(t) for t in batch.column(1).to_pylist()]
                docs = batch.column(0).to_pylist()
                best: dict[tuple[int, int], tuple[float, int]] = {}
                at = 0
                while at < len(docs):
                    rows, of, n = [], [], 0
                    while at < len(docs) and n < 8192:
                        words = texts[at]
                        if len(words) >= run:
                            start = np.arange(0, len(words) - run + 1, step)
                            unknown = np.concatenate(([0], np.cumsum(words < 0)))
                            unknown = (unknown[run:] - unknown[:-run])[start]
                            some = unknown <= run // 2
                            if some.any():
                                own = _project(words, padded, run)[start[some]]
                                size = np.sqrt((own**2).sum(axis=1) + strange * unknown[some])
                                rows.append(own / np.maximum(size, 1e-12)[:, None])
                                of += [(at, s) for s in start[some].tolist()]
                                n += len(own)
                        at += 1
                    if not rows:
                        continue
                    x, y, cosines = clusters.near(np.concatenate(rows).astype(np.float32), least)
                    for r, k, c in zip(x.tolist(), index.owner[y].tolist(), cosines.tolist()):
                        d, s = of[r]
                        if c > best.get((d, k), (0.0, 0))[0]:
                            best[d, k] = (c, s)
                out = []
                for (d, k), (c, s) in best.items():
                    text, answer = index.texts[k], index.answers[k]
                    near = texts[d][max(0, s - len(text)) : s + run + len(text)]
                    m = len(answer)
                    has = bool(m) and bool((windows_of(near, m) == np.array(answer)).all(axis=1).any())
                    out.append((docs[d], index.ids[k], c, longest_run(near, text), longest_subsequence(near, text) / len(text), has))
                cols = list(zip(*out)) or [[]] * 6
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "item_id", "cosine", "run_words", "item_share", "answer"])

        found = self.documents.mapInArrow(search, "doc_id long, item_id long, cosine double, run_words long, item_share double, answer boolean")
        return found.groupBy("doc_id", "item_id").agg(F.round(F.max("cosine"), 4).alias("cosine"), F.max("run_words").alias("run_words"), F.round(F.max("item_share"), 6).alias("item_share"), F.bool_or("answer").alias("answer"))
