"""Evaluation texts that leaked into a corpus, by latent semantic retrieval.

Texts are cut into short word windows, weighted by TF-IDF with document frequencies of the whole
corpus, and projected by a randomised SVD that is computed over all windows in distributed passes. The
items' windows are indexed in cells of the latent space; a document window asks only the cells that can
hold a neighbour within the cosine. Every such pair is a candidate, whatever its words; the longest
common run of words along the pair decides.

A shared run of ``RUN`` words holds a whole window of ``WINDOW`` words of the document, as windows
start every ``WINDOW`` words of a stretch; items have windows at every word. Equal windows have cosine
1, so no leak is missed by the search. Words that no item uses part a document into stretches, and
stretches shorter than a window's guarantee are dropped: they can't hold a run.

Neither holds for paraphrases: words that no item uses stand anywhere in them, and no cosine bounds
their windows. There the item words that a document holds are counted instead. The count is never
below the longest common subsequence, so every pair that the exact check of the subsequence and the
item's answer tokens would take is checked.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.session import map_arrow, materialise

RUN, WINDOW = 15, 8
#: Rank of the latent space, with its oversampling; power rounds.
RANK, OVER, POWER = 24, 8, 1
#: Least cosine of candidates for verbatim passages.
COSINE = 0.985
#: Words of items handled at once; more items are handled in several rounds.
ITEM_WORDS = 100_000
#: Sketches that one task sums, and that meet on the driver at most.
FAN_IN = 8
#: Items' windows of one cell of the index, on average.
CELL = 64
#: A paraphrase holds this share of an item's words in order, and its answer tokens.
SUBSEQUENCE = 0.8

_WORD = re.compile(r"[^\W_]+")


class Items:
    """Words of the items as term numbers, with a window at every word."""

    def __init__(self, rows: list[tuple[int, str]], least: int = RUN):
        import numpy as np

        self.ids, self.words = [], []
        vocab: dict[str, int] = {}
        for i, t in rows:
            ws = _WORD.findall((t or "").lower())
            if len(ws) >= least:
                self.ids.append(i)
                self.words.append(np.array([vocab.setdefault(w, len(vocab)) for w in ws], dtype=np.int32))
        self.vocab = vocab
        self.answers = [{int(x) for x in set(w.tolist()) if self._answer(x)} for w in self.words]

    def _answer(self, term: int) -> bool:
        if not hasattr(self, "_numeric"):
            self._numeric = {v for k, v in self.vocab.items() if any(c.isdigit() for c in k)}
        return term in self._numeric


def _stretches(items: Items):
    vocab = items.vocab

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        names = ["doc_id", "terms", "df"]
        schema = pa.schema([("doc_id", pa.int64()), ("terms", pa.list_(pa.int32())), ("df", pa.list_(pa.int64()))])
        df = np.zeros(len(vocab) + 1, dtype=np.int64)
        get = vocab.get
        for b in batches:
            ids, terms = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                df[-1] += 1
                if not t or i is None:
                    continue
                x = np.array([get(w, -1) for w in _WORD.findall(t.lower())], dtype=np.int32)
                if not len(x):
                    continue
                df[np.unique(x[x >= 0])] += 1
                gap = np.flatnonzero(x < 0)
                start = np.concatenate(([0], gap + 1))
                end = np.concatenate((gap, [len(x)]))
                for a, z in zip(start[end - start >= RUN], end[end - start >= RUN]):
                    ids.append(i)
                    terms.append(x[a:z])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.nulls(len(ids), pa.list_(pa.int64()))], schema=schema)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.list_(pa.int32())), pa.array([df], pa.list_(pa.int64()))], schema=schema)

    return run


def _windows(terms: list, step: int):
    """``(window terms, stretch number, offset)`` of all windows that start every ``step`` words."""
    import numpy as np

    out, of, at = [], [], []
    for k, x in enumerate(terms):
        x = np.asarray(x, dtype=np.int32)
        s = np.arange(0, len(x) - WINDOW + 1, step)
        if len(s):
            out.append(x[s[:, None] + np.arange(WINDOW)[None, :]])
            of.append(np.full(len(s), k))
            at.append(s)
    if not out:
        return np.zeros((0, WINDOW), np.int32), np.zeros(0, int), np.zeros(0, int)
    return np.concatenate(out), np.concatenate(of), np.concatenate(at)


def _weights(win, weight):
    """TF-IDF of the windows' words, such that each window's row of the term space has length 1; a word twice counts twice."""
    import numpy as np

    w = weight[win]
    same = win[:, :, None] == win[:, None, :]
    norm = np.sqrt(np.einsum("ij,ik,ijk->i", w, w, same))
    return w / np.maximum(norm, 1e-12)[:, None]


def _project(win, weight, basis):
    """Latent vectors of length 1."""
    import numpy as np

    e = np.zeros((len(win), basis.shape[1]), dtype=np.float32)
    for j in range(WINDOW):
        e += basis[win[:, j]] * weight[win[:, j]][:, None]
    return e / np.maximum(np.sqrt((e * e).sum(axis=1, keepdims=True)), 1e-12)


def _gram(win, weight, q):
    """The sum over the windows' rows a of a'(a q); only the words of the windows are touched."""
    import numpy as np

    acc = np.zeros(q.shape)
    for lo in range(0, len(win), 8192):
        some = win[lo : lo + 8192]
        w = _weights(some, weight)
        aq = np.einsum("ij,ijk->ik", w, q[some])
        terms = some.ravel()
        order = np.argsort(terms, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], np.diff(terms[order]) > 0)))
        rows = (w[:, :, None] * aq[:, None, :]).reshape(len(terms), -1)[order]
        acc[terms[order][first]] += np.add.reduceat(rows, first, axis=0)
    return acc


def _sketch(weight, q):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        acc = np.zeros(q.shape)
        for b in batches:
            acc += _gram(_windows(b.column("terms").to_pylist(), WINDOW)[0], weight, q)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([acc.astype("<f8").tobytes()], pa.binary())], names=["g", "m"])

    return run


def _sum_blobs(key, part):
    import numpy as np
    import pyarrow as pa

    total = None
    for m in part.column("m"):
        x = np.frombuffer(m.as_py(), "<f8")
        total = x.copy() if total is None else total + x
    return pa.table({"g": pa.array([key[0].as_py()], pa.int32()), "m": pa.array([total.tobytes()], pa.binary())})


def _basis(stretches: DataFrame, items: Items, weight):
    """Right singular vectors of the TF-IDF windows of all documents: randomised range, power rounds, small SVD.

    Sketches have ITEM_WORDS rows at most, whatever the corpus; FAN_IN of them meet in a task or on the driver.
    """
    import numpy as np

    f = max(1, len(items.vocab))
    width = min(f, RANK + OVER)
    own = _windows(items.words, 1)[0]
    n_parts = stretches.rdd.getNumPartitions()

    def apply(q):
        parts = map_arrow(stretches, _sketch(weight, q.astype(np.float32)), "g int, m binary")
        left = n_parts
        while True:
            parts = parts.withColumn("g", (F.col("g") / FAN_IN).cast("int")).groupBy("g").applyInArrow(_sum_blobs, "g int, m binary")
            left = -(-left // FAN_IN)
            if left <= FAN_IN:
                break
        out = _gram(own, weight, q)  # the items' windows belong to the passages
        for r in parts.collect():  # FAN_IN matrices at most
            out += np.frombuffer(r["m"], "<f8").reshape(q.shape)
        return out

    q = np.linalg.qr(np.random.default_rng(5).standard_normal((f, width)))[0]
    for _ in range(POWER):
        q = np.linalg.qr(apply(q))[0]
    small = q.T @ apply(q)
    val, vec = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-val)[: min(RANK, width)]
    return (q @ vec[:, order]).astype(np.float32)


class Cells:
    """An index of unit vectors: cells around some of them, each with its radius.

    By the triangle inequality of angles a cell farther from a query than the asked angle and its radius
    holds no neighbour, so pruning loses nothing.
    """

    def __init__(self, vec, cosine: float):
        import numpy as np

        self.cosine = cosine
        n = -(-len(vec) // CELL)
        centre = vec[np.random.default_rng(3).permutation(len(vec))[:n]]
        for _ in range(3):
            own = (vec @ centre.T).argmax(axis=1) if n else np.zeros(0, int)
            total = np.zeros_like(centre)
            np.add.at(total, own, vec)
            norm = np.sqrt((total * total).sum(axis=1, keepdims=True))
            centre = np.where(norm > 1e-9, total / np.maximum(norm, 1e-9), centre)
        near = vec @ centre.T
        own = near.argmax(axis=1) if n else np.zeros(0, int)
        order = np.argsort(own, kind="stable")
        first = np.searchsorted(own[order], np.arange(n + 1))
        self.members = [order[first[k] : first[k + 1]] for k in range(n)]
        angle = np.arccos(np.clip(near[np.arange(len(vec)), own], -1, 1)) if len(vec) else np.zeros(0)
        radius = np.array([angle[m].max() if len(m) else -10.0 for m in self.members])
        self.centre = centre.T
        self.least = np.cos(np.minimum(np.pi, np.arccos(cosine) + np.maximum(radius, 0) + 1e-3))
        self.least[radius < 0] = 2.0
        self.vec = [np.ascontiguousarray(vec[m].T) for m in self.members]

    def near(self, queries):
        """``(query, vector)`` of all pairs within the cosine."""
        import numpy as np

        out_q, out_v = [], []
        for lo in range(0, len(queries), 16384):
            some = queries[lo : lo + 16384]
            ask = some @ self.centre >= self.least
            for k in np.flatnonzero(ask.any(axis=0)):
                at = np.flatnonzero(ask[:, k])
                u, v = np.nonzero(some[at] @ self.vec[k] >= self.cosine)
                out_q.append(at[u] + lo)
                out_v.append(self.members[k][v])
        none = np.zeros(0, np.int64)
        return np.concatenate(out_q or [none]), np.concatenate(out_v or [none])


def _longest_runs(x, i, y, j):
    """Length of the longest common run through each pair of places, as far as RUN words from the windows.

    ``x[i]`` faces ``y[j]``; both texts are padded so that no place is near an end.
    """
    import numpy as np

    span = np.arange(-RUN, WINDOW + RUN)
    eq = x[i[:, None] + span] == y[j[:, None] + span]
    best, run = np.zeros(len(i), np.int32), np.zeros(len(i), np.int32)
    for k in range(eq.shape[1]):
        run = np.where(eq[:, k], run + 1, 0)
        best = np.maximum(best, run)
    return best


def _joined(texts: list, pad: int):
    """Texts in one array, with padding between and around them, and where each starts."""
    import numpy as np

    gap = np.full(RUN + WINDOW, pad, np.int32)
    parts, start, at = [gap], [], len(gap)
    for t in texts:
        start.append(at)
        parts += [np.asarray(t, np.int32), gap]
        at += len(t) + len(gap)
    return np.concatenate(parts), np.array(start, np.int64)


def _verbatim(items: Items, weight, basis):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        own, own_of, own_at = _windows(items.words, 1)
        own_u, own_back = np.unique(own, axis=0, return_inverse=True)
        own_back = own_back.ravel()
        own_order = np.argsort(own_back, kind="stable")
        own_first = np.searchsorted(own_back[own_order], np.arange(len(own_u) + 1))
        cells = Cells(_project(own_u, weight, basis), COSINE)
        text, start = _joined(items.words, -2)
        item_ids = np.array(items.ids, np.int64)
        for b in batches:
            ids, terms = np.asarray(b.column("doc_id"), np.int64), [np.asarray(t, np.int32) for t in b.column("terms").to_pylist()]
            found: list = []
            win, of, at = _windows(terms, WINDOW)
            if len(win):
                uniq, back = np.unique(win, axis=0, return_inverse=True)
                back = back.ravel()
                order = np.argsort(back, kind="stable")
                first = np.searchsorted(back[order], np.arange(len(uniq) + 1))
                doc, doc_start = _joined(terms, -1)
                q, v = cells.near(_project(uniq, weight, basis))
                # a pair of windows stands for all places of both
                n_q, n_v = first[q + 1] - first[q], own_first[v + 1] - own_first[v]
                for lo, hi in _parts(n_q * n_v, 200_000):
                    nq, nv, qq, vv = n_q[lo:hi], n_v[lo:hi], q[lo:hi], v[lo:hi]
                    k = _counted(nq * nv)
                    one = np.repeat(np.arange(len(qq)), nq * nv)
                    w = order[first[qq][one] + k // nv[one]]
                    o = own_order[own_first[vv][one] + k % nv[one]]
                    long = _longest_runs(doc, doc_start[of[w]] + at[w], text, start[own_of[o]] + own_at[o]) >= RUN
                    if long.any():
                        found.append(np.unique(np.stack([ids[of[w[long]]], item_ids[own_of[o[long]]]]), axis=1))
            pairs = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0].copy()), pa.array(pairs[1].copy())], names=["doc_id", "item_id"])

    return run


def _parts(sizes, most: int):
    """Consecutive ranges whose sizes sum to little more than ``most``."""
    import numpy as np

    if not len(sizes):
        return
    part = np.cumsum(sizes) // most
    cut = np.flatnonzero(np.diff(part)) + 1
    yield from zip([0, *cut.tolist()], [*cut.tolist(), len(sizes)])


def subsequence(x: list[int], y: list[int]) -> int:
    """Length of the longest common subsequence, by bit rows."""
    where: dict[int, int] = {}
    for k, t in enumerate(y):
        where[t] = where.get(t, 0) | 1 << k
    full = (1 << len(y)) - 1
    v = full
    for t in x:
        m = where.get(t)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(y) - v.bit_count()


class Bags:
    """The items by their words, a word's k-th occurrence being a term of its own."""

    def __init__(self, items: Items):
        import numpy as np

        self.items, self.vocab = len(items.words), len(items.vocab)
        self.need = np.array([SUBSEQUENCE * len(w) - 1e-9 for w in items.words])
        terms, ranks, of = [], [], []
        for k, w in enumerate(items.words):
            t, r = _occurrences(np.sort(w.astype(np.int64)))
            terms.append(t)
            ranks.append(r)
            of.append(np.full(len(t), k))
        t, r, of = np.concatenate(terms), np.concatenate(ranks), np.concatenate(of)
        self.cap = np.zeros(self.vocab, np.int64)
        np.maximum.at(self.cap, t, r + 1)
        self.offset = np.cumsum(self.cap) - self.cap
        f = self.offset[t] + r
        order = np.argsort(f, kind="stable")
        self.posted = of[order]
        self.first = np.searchsorted(f[order], np.arange(self.cap.sum() + 1))

    def near(self, docs: list):
        """``(document, item)`` of the documents that hold enough of an item's words in any order."""
        import numpy as np

        step = max(1, min(1024, 2_000_000 // self.items))
        for lo in range(0, len(docs), step):
            some = docs[lo : lo + step]
            t = np.concatenate(some).astype(np.int64)
            doc = np.repeat(np.arange(len(some)), [len(x) for x in some])[t >= 0]
            key, r = _occurrences(np.sort(doc * self.vocab + t[t >= 0]))
            doc, t = key // self.vocab, key % self.vocab
            own = r < self.cap[t]
            f = self.offset[t[own]] + r[own]
            n = self.first[f + 1] - self.first[f]
            item = self.posted[np.repeat(self.first[f], n) + _counted(n)]
            held = np.bincount(np.repeat(doc[own], n) * self.items + item, minlength=len(some) * self.items)
            u, k = np.nonzero(held.reshape(len(some), -1) >= self.need)
            yield from zip((u + lo).tolist(), k.tolist())


def _counted(n):
    """0 .. n - 1 for each of the numbers, one after the other."""
    import numpy as np

    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _occurrences(key):
    """Sorted keys, each with how many equal ones stand before it."""
    import numpy as np

    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return key, _counted(np.diff(np.append(first, len(key))))


def _paraphrased(items: Items):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        bags = Bags(items)
        get = items.vocab.get
        for b in batches:
            ids, terms = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t and i is not None:
                    x = [get(w, -1) for w in _WORD.findall(t.lower())]
                    if x:
                        ids.append(i)
                        terms.append(np.array(x, dtype=np.int32))
            docs, found, share = [], [], []
            for k, item in bags.near(terms):
                x, y = terms[k].tolist(), items.words[item].tolist()
                if not items.answers[item] <= set(x):
                    continue
                s = subsequence(x, y) / len(y)
                if s >= SUBSEQUENCE:
                    docs.append(ids[k])
                    found.append(items.ids[item])
                    share.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(found, pa.int64()), pa.array(share, pa.float64())], names=["doc_id", "item_id", "share"])

    return run


def _leaked(documents: DataFrame, items: Items) -> DataFrame:
    import numpy as np

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = materialise(map_arrow(docs, _stretches(items), "doc_id long, terms array<int>, df array<bigint>"))
    counts = rows.where("df IS NOT NULL").select(F.posexplode("df").alias("t", "n")).groupBy("t").agg(F.sum("n").alias("n")).collect()  # one row a term of the items
    df = np.zeros(len(items.vocab) + 1)
    for r in counts:
        df[r["t"]] = r["n"]
    weight = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1).astype(np.float32)
    stretches = rows.where("doc_id IS NOT NULL").select("doc_id", "terms")
    basis = _basis(stretches, items, weight)
    return map_arrow(stretches, _verbatim(items, weight, basis), "doc_id long, item_id long")


def _by_rounds(spark: SparkSession, documents: DataFrame, benchmark: DataFrame, find, schema: str, least: int) -> DataFrame:
    """Items are taken in rounds of a bounded number of words, so what is sent to the workers is bounded."""
    known = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    total = known.agg(F.sum(F.length("text"))).first()[0] or 0
    rounds = max(1, -(-total // (2 * ITEM_WORDS)))  # a word and its blank have two characters at least
    out = spark.createDataFrame([], schema)
    for k in range(rounds):
        part = known.where(F.pmod(F.xxhash64("item_id"), F.lit(rounds)) == k) if rounds > 1 else known
        items = Items([(r["item_id"], r["text"]) for r in part.collect()], least)
        if items.ids:
            out = out.unionByName(find(documents, items))
    return out


def leaked_items(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id)`` of documents with at least RUN consecutive words of an item.

    Null and short texts of either side have no leak; repeated rows are reported once. Empty tables give
    an empty result.
    """
    return _by_rounds(documents.sparkSession, documents, benchmark, _leaked, "doc_id long, item_id long", RUN).distinct()


def paraphrased_items(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id, share)`` of documents with most of an item's words in order, and all its numbers.

    Any other words may stand between and in place of them. Items of any number of words count; ``share`` is
    that of the item's words.
    """
    schema = "doc_id long, item_id long, share double"

    def find(docs: DataFrame, items: Items) -> DataFrame:
        return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _paraphrased(items), schema)

    return _by_rounds(documents.sparkSession, documents, benchmark, find, schema, 1).groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))
