"""Evaluation texts leaking into training text (problem 8).

Latent semantic retrieval. A passage of a document is a maximal run of at least RUN words
that all occur in the evaluation texts: no other place can hold RUN of their words in a row.
Terms are weighted by their inverse document frequency over all documents, and a randomised
SVD of the passages' TF-IDF rows (range finder and power steps as distributed sums of
term x RANK blocks) gives the latent space. Every window of RUN words of a passage is compared by cosine with
the windows of WINDOW words of the evaluation texts that hold its rarest word. The cosine below
which a window can't hold a given run is no guess: it is the smallest that any of the evaluation
window's own runs has with it, so the candidate search loses no leak. Candidates are then
compared word by word for their longest common run.

A paraphrase brings in foreign words, so it is sought in the whole text: a span of WINDOW words
that has PARAPHRASE_SHARE of a window's words in their order. Foreign words count in the span's
length and in its norm. No cosine bounds such a span, as its other words may be any; what does is
the number of rare words it must share, so candidates come from those and lose nothing. The
cosine is reported and cuts nothing.

The texts of the corpus are read once, by the words of all items, and written as word numbers. The
windows of the evaluation set go over these in blocks of BLOCK_ITEMS items, so what the tasks
receive is bounded but for the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WORD, cut, keyed

RUN, WINDOW, RANK, EXTRA, POWER_STEPS = 12, 24, 48, 8, 1
#: Items of a block; with ITEM_WORDS words of an item at most, a block's tables stay small.
BLOCK_ITEMS, ITEM_WORDS = 4000, 5000
#: Documents that one task compares with a block, in the search for paraphrases.
DOCUMENTS_PER_TASK = 10_000
#: Share of a window's words in the common subsequence with a paraphrase.
PARAPHRASE_SHARE = 0.7
#: Words from one window for paraphrases to the next, and how many rare words find one.
ITEM_STEP, KEYS = 1, 10


class Items:
    """The texts of one block of items as word numbers, and their windows."""

    def __init__(self, rows: pd.DataFrame, vocabulary: dict[str, int], more: dict[str, int]):
        """``vocabulary`` numbers the words of windows, ``more`` those of answers; they grow over all blocks."""
        self.ids, self.texts, self.answers = [], [], []
        for item, passage, question, answer in rows[["item_id", "passage", "question", "answer"]].itertuples(index=False):
            for text in (passage, question):
                words = WORD.findall(text.lower()) if isinstance(text, str) else []
                for start in range(0, max(1, len(words) - RUN + 1), ITEM_WORDS):
                    part = words[start : start + ITEM_WORDS + RUN - 1]
                    if len(part) >= RUN:
                        self.ids.append(item)
                        self.texts.append(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in part], np.int32))
                        self.answers.append(" ".join(WORD.findall(answer.lower())) if isinstance(answer, str) else "")
        for w in (w for answer in self.answers for w in answer.split()):
            more.setdefault(w, len(more))
        self.windows, self.of = [], []
        for t, words in enumerate(self.texts):
            for start in range(0, max(1, len(words) - RUN + 1), WINDOW - RUN):
                stop = min(start + WINDOW, len(words))
                if stop - start >= RUN:
                    self.windows.append(words[start:stop])
                    self.of.append(t)

        #: Known words of a span below which it is a paraphrase of no window.
        self.least_common = min((_least_common(min(len(w), WINDOW)) for w in self.texts), default=0)

    def keyed(self, df: np.ndarray) -> None:
        """Windows for paraphrases, the end of the text among them, and the words to find them by. At most
        ``n - common`` words of a window are missing in a span that is its paraphrase, so of that
        many and KEYS more, the rarest, at least KEYS are there."""
        self.windows, self.of, post = [], [], []
        for t, words in enumerate(self.texts):
            last = max(0, len(words) - WINDOW)
            for start in [*range(0, last, ITEM_STEP), last]:
                self.windows.append(words[start : start + WINDOW])
                self.of.append(t)
        self.sizes = np.array([len(w) for w in self.windows])
        self.common = np.array([_least_common(n) for n in self.sizes])
        self.demand = np.minimum(KEYS, self.common)
        for k, w in enumerate(self.windows):
            rare = w[np.lexsort((w, df[w]))][: len(w) - self.common[k] + self.demand[k]]
            post.append(np.unique(rare).astype(np.int64) << 32 | k)
        self._post(post, len(df))
        self.padded = np.stack([np.pad(w, (0, WINDOW - len(w)), constant_values=-1) for w in self.windows])

    def _post(self, post: list[np.ndarray], n_words: int) -> None:
        """The windows by word: ``post`` has word and window in one number."""
        post = np.sort(np.concatenate(post))
        self.keys = (post & 0xFFFFFFFF).astype(np.int32)
        self.key_end = np.searchsorted(post >> 32, np.arange(n_words + 1))

    def cosine(self, windows: np.ndarray, spans: np.ndarray) -> np.ndarray:
        """Cosine in the latent space; a foreign word has a direction of its own."""
        known = spans >= 0
        v = (self.terms[spans] * known[:, :, None]).sum(1)
        norm = np.sqrt((v * v).sum(1) + (~known).sum(1) * self.foreign)
        return (v * self.unit[windows]).sum(1) / np.maximum(norm, 1e-12)

    def latent(self, idf: np.ndarray, basis: np.ndarray) -> None:
        """Unit vectors of the windows."""
        self.terms = (idf[:, None] * basis).astype(np.float32)
        self.foreign = float((self.terms**2).sum(1).mean())  # squared norm of a foreign word: that of a known one
        vectors = np.stack([self.terms[w].sum(0) for w in self.windows])
        self.unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)

    def bounds(self, df: np.ndarray) -> None:
        """The least cosine that a run of each window has with it, and the windows that hold each word."""
        self.rarity = np.argsort(np.lexsort((np.arange(len(df)), df))).astype(np.int32)  # 0 is the rarest
        self._post([np.unique(w).astype(np.int64) << 32 | k for k, w in enumerate(self.windows)], len(df))
        least = []
        for w, u in zip(self.windows, self.unit):
            runs, ok = self.run_vectors(w)
            least.append(-1.0 if not ok.all() else float((runs @ u).min()))
        self.least = np.array(least, np.float32) - np.float32(1e-3)
        size = max(len(w) for w in self.windows)
        self.padded = np.stack([np.pad(w, (0, size - len(w)), constant_values=-1) for w in self.windows])

    def run_vectors(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unit vectors of all runs of a passage; whether they have a direction."""
        rows = np.cumsum(np.vstack([np.zeros((1, self.terms.shape[1])), self.terms[words]]), axis=0, dtype=np.float64)
        runs = rows[RUN:] - rows[:-RUN]
        norm = np.linalg.norm(runs, axis=1, keepdims=True)
        return (runs / np.maximum(norm, 1e-12)).astype(np.float32), norm[:, 0] > 1e-6


def _passages(vocabulary: dict[str, int], size: int, least: int | None = None):
    """Rows of kind 0 (a passage: doc_id and word numbers) and 1 (a word's document count). With
    ``least``, a passage is the whole text, foreign words as -1, if _near finds a stretch in it. Words from number ``size`` on are the answers' own."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = vocabulary.value
        df = np.zeros(size, np.int64)
        for pdf in batches:
            ids, words = [], []
            for doc, text in zip(pdf.doc_id, pdf.text):
                if not isinstance(text, str):
                    continue
                w = [known.get(x, -1) for x in WORD.findall(text.lower())]
                a = np.array(w, np.int32)
                inside = (a >= 0) & (a < size)
                df[np.unique(a[inside])] += 1
                if least is not None:
                    if _near(np.where(inside, a, -1), least):
                        ids.append(doc)
                        words.append(a.tobytes())
                    continue
                if inside.sum() < RUN:
                    continue
                edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
                for s, e in zip(edge[::2], edge[1::2]):
                    if e - s >= RUN:
                        ids.append(doc)
                        words.append(a[s:e].tobytes())
            yield pd.DataFrame({"kind": 0, "id": np.array(ids, np.int64), "n": 0, "words": words})
        (at,) = df.nonzero()
        yield pd.DataFrame({"kind": 1, "id": at, "n": df[at], "words": None})

    return rows


#: Terms of one summand block of the range finder.
_BLOCK = 4096


def _range_step(idf, omega, least=None):
    """Sums of (TF-IDF)^T (TF-IDF) omega over passages (with ``least``, over the stretches of
    whole texts), in blocks of terms."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, o = idf.value, omega.value
        total = np.zeros_like(o)
        for pdf in batches:
            for words in pdf.words:
                a = np.frombuffer(words, np.int32)
                a = np.where(a < len(w), a, -1)
                for part in [a] if least is None else [a[x:y] for x, y in _near(a, least)]:
                    terms, tf = np.unique(part, return_counts=True)
                    row = tf * np.where(terms < 0, w.max(), w[terms])
                    row, terms = (row / max(np.linalg.norm(row), 1e-12))[terms >= 0], terms[terms >= 0]
                    total[terms] += row[:, None] * (row @ o[terms])
        for b in range(0, len(total), _BLOCK):
            yield pd.DataFrame({"b": [b], "m": [total[b : b + _BLOCK].tobytes()]})

    return rows


def _sum_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"b": [pdf.b.iat[0]], "m": [sum(np.frombuffer(m) for m in pdf.m).tobytes()]})


def latent_basis(passages: DataFrame, idf: np.ndarray, least: int | None = None) -> np.ndarray:
    """Orthonormal term directions (terms x RANK) by a randomised range finder over the
    distributed passages and a small SVD of the projected Gram matrix."""
    spark = passages.sparkSession
    width = min(RANK + EXTRA, len(idf))
    basis = np.linalg.qr(np.random.default_rng(7).standard_normal((len(idf), width)))[0]
    weights = spark.sparkContext.broadcast(idf)
    for _ in range(POWER_STEPS + 1):
        step = passages.select("words").mapInPandas(_range_step(weights, spark.sparkContext.broadcast(basis), least), "b int, m binary")
        blocks = step.groupBy("b").applyInPandas(_sum_blocks, "b int, m binary").toPandas().sort_values("b")
        y = np.concatenate([np.frombuffer(m) for m in blocks.m]).reshape(-1, width)
        gram = basis.T @ y
        basis, _ = np.linalg.qr(y)
    u = np.linalg.svd(gram)[0]
    return (basis @ u)[:, :RANK]


def _search(items, paraphrases: bool):
    def hits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        it: Items = items.value
        ids, of = np.array(it.ids), np.array(it.of)
        for pdf in batches:
            out = []
            for doc, blob in zip(pdf.id, pdf.words):
                words = np.frombuffer(blob, np.int32)
                find = _paraphrases if paraphrases else _leaks
                out += [(doc, *x) for x in find(it, ids, of, words)]
            yield pd.DataFrame(out, columns=["doc_id", "item_id", *(["cosine", "lcs_words", "lcs_share", "has_answer"] if paraphrases else [])])

    return hits


#: Runs and windows that are compared at a time.
_PAIRS = 100_000


def _leaks(it: Items, ids, of, words: np.ndarray) -> set:
    found = set()
    runs, ok = it.run_vectors(words)
    grams = np.lib.stride_tricks.sliding_window_view(words, RUN)
    rarest = grams[np.arange(len(grams)), it.rarity[grams].argmin(1)]  # a window that holds the run holds this word
    n = it.key_end[rarest + 1] - it.key_end[rarest]
    bounds = np.searchsorted(np.cumsum(n), np.arange(_PAIRS, n.sum(), _PAIRS), "left")
    for part in np.split(np.arange(len(grams)), np.unique(bounds)):
        m = n[part]
        r = np.repeat(part, m)
        w = it.keys[np.repeat(it.key_end[rarest[part]], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)]
        near = (np.einsum("ij,ij->i", runs[r], it.unit[w]) >= it.least[w]) | ~ok[r]
        g, p, w = grams[r[near]], it.padded[w[near]], w[near]
        hit = np.zeros(len(g), bool)  # longest common run: is the whole of the run there?
        for shift in range(it.padded.shape[1] - RUN + 1):
            (k,) = (p[:, shift] == g[:, 0]).nonzero()
            hit[k] |= (p[k, shift : shift + RUN] == g[k]).all(1)
        found.update((i,) for i in ids[of[w[hit]]])
    return found


def _lcs(a: np.ndarray, b: np.ndarray) -> int:
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        new = np.maximum(row[1:], np.where(b == x, row[:-1] + 1, 0))
        row[1:] = np.maximum.accumulate(new)
    return int(row[-1])


def _least_common(n: int) -> int:
    """Words that a window of n words must have in common with a span."""
    return -int(-n * PARAPHRASE_SHARE // 1)


def _near(words: np.ndarray, least: int) -> list[tuple[int, int]]:
    """The stretches whose every span of WINDOW words has ``least`` known ones; a foreign word is -1.
    No other span can have that many words of the items."""
    known = np.concatenate([[0], np.cumsum(words >= 0)])
    width = min(WINDOW, len(words))
    full = np.concatenate([[0], (known[width:] - known[:-width] >= least).view(np.int8), [0]]) if width else np.zeros(2, np.int8)
    edge = np.flatnonzero(np.diff(full))
    return [(s, e - 1 + width) for s, e in zip(edge[::2], edge[1::2])]


def _lcs_rows(windows: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Longest common subsequences row by row, a window as the bits of a number (Hyyro); -1 in a
    window and a foreign word in a span match nothing."""
    v = np.full(len(spans), (1 << WINDOW) - 1, np.uint64)
    weights = np.uint64(1) << np.arange(0, windows.shape[1], 8, dtype=np.uint64)
    for j in range(spans.shape[1]):
        same = (windows == spans[:, j : j + 1]) & (windows >= 0)
        u = v & (np.packbits(same, axis=1, bitorder="little") @ weights)
        v = ((v + u) | (v - u)) & np.uint64((1 << WINDOW) - 1)
    return WINDOW - np.bitwise_count(v).astype(np.int64)


def _candidates(it: Items, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows and span starts with at least the keys in common that _least_common demands."""
    at = np.flatnonzero(words >= 0)
    n = it.key_end[words[at] + 1] - it.key_end[words[at]]
    p = np.repeat(at, n)
    w = it.keys[np.repeat(it.key_end[words[at]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    order = np.argsort(w, kind="stable")
    p, w = p[order], w[order]
    first = np.arange(len(w))
    last = first + it.demand[w] - 1
    ok = last < len(w)
    first, last = first[ok], last[ok]
    ok = (w[first] == w[last]) & (p[last] - p[first] < WINDOW)
    first, last = first[ok], last[ok]
    low = np.maximum(p[last] - WINDOW + 1, 0)
    n = np.maximum(np.minimum(p[first], max(0, len(words) - WINDOW)) - low + 1, 0)
    found = np.unique(np.repeat(w[first].astype(np.int64) << 32 | low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    return found >> 32, found & 0xFFFFFFFF


def _paraphrases(it: Items, ids, of, words: np.ndarray) -> list:
    """Items a window of which has most of its words, in order, in a span of WINDOW words."""
    best: dict = {}
    text, words = words, np.where(words < len(it.terms), words, -1)
    for a, b in _near(words, it.least_common):
        part = words[a:b]
        spans = np.lib.stride_tricks.sliding_window_view(part, min(WINDOW, len(part)))
        windows, starts = _candidates(it, part)
        for c in range(0, len(windows), 20_000):
            w, s = windows[c : c + 20_000], starts[c : c + 20_000]
            n = _lcs_rows(it.padded[w], spans[s])
            (hit,) = (n >= it.common[w]).nonzero()
            w, s, n = w[hit], s[hit], n[hit]
            share, texts = n / it.sizes[w], of[w]
            top = np.zeros(len(it.texts))
            np.maximum.at(top, texts, share)
            (hit,) = (share == top[texts]).nonzero()
            for t, x, y, z in zip(texts[hit], share[hit], n[hit], it.cosine(w[hit], spans[s[hit]])):
                best[ids[t]] = max(best.get(ids[t], (0.0, 0, 0.0, 0)), (float(x), int(y), float(z), int(t)))
    out = []
    for item, (share, n, cosine, t) in best.items():
        answer = it.answer_words[t]
        at = np.flatnonzero(text[: len(text) - len(answer) + 1] == answer[0]) if 0 < len(answer) <= len(text) else ()
        out.append((item, cosine, n, share, any((text[k : k + len(answer)] == answer).all() for k in at)))
    return out


def _blocks(items: DataFrame) -> Iterator[pd.DataFrame]:
    """The items in blocks that are small by construction; the list of ids decides them."""
    rows = items.select("item_id", "passage", "question", "answer").filter("item_id IS NOT NULL")
    count = rows.count()
    for k in range(blocks := -(-count // BLOCK_ITEMS)):
        part = rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k) if blocks > 1 else rows
        yield part.toPandas()


def _retrieve(docs: DataFrame, items: DataFrame, paraphrases: bool, schema: str) -> DataFrame:
    spark = docs.sparkSession
    found = spark.createDataFrame([], schema)
    vocabulary, more = {}, {}
    blocks = [it for rows in _blocks(items) if (it := Items(rows, vocabulary, more)).windows]
    if not blocks:
        return found
    size = len(vocabulary)
    numbers = vocabulary | {w: size + i for w, i in more.items() if w not in vocabulary} if paraphrases else vocabulary
    least = min(it.least_common for it in blocks) if paraphrases else None
    known = spark.sparkContext.broadcast(numbers)
    words = cut(keyed(docs, "doc_id", "text").mapInPandas(_passages(known, size, least), "kind int, id long, n long, words binary"))
    passages = words.filter("kind = 0").select("id", "words")
    df = np.zeros(size)
    counted = words.filter("kind = 1").groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # at most one row a word of the items
    df[counted.id.to_numpy(int)] = counted.n
    documents = docs.count()
    idf = np.log((1 + documents) / (1 + df)) + 1
    own = spark.createDataFrame(pd.DataFrame({"id": -1, "words": [w.tobytes() for it in blocks for w in it.windows]}), "id long, words binary")
    basis = latent_basis(passages.unionByName(own), idf, least)
    if paraphrases:  # few bytes and much work: tasks are made by documents
        passages = passages.repartition(max(2 * spark.sparkContext.defaultParallelism, documents // DOCUMENTS_PER_TASK))
    for it in blocks:
        if paraphrases:
            it.keyed(df)
            it.answer_words = [np.array([numbers[w] for w in answer.split()], np.int32) for answer in it.answers]
        it.latent(idf, basis)
        if not paraphrases:
            it.bounds(df)
        found = found.unionByName(passages.mapInPandas(_search(spark.sparkContext.broadcast(it), paraphrases), schema))
    return found


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id: the document has at least RUN consecutive words in common with the
    item's passage or with its question. Null or shorter texts and rows without id match
    nothing; a repeated doc_id or item_id counts as one."""
    return _retrieve(docs, items, False, "doc_id long, item_id long").distinct()


def paraphrases(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, lcs_words, lcs_share, has_answer: documents with a span
    of WINDOW words that has at least PARAPHRASE_SHARE of the words of a window of the item in the
    same order; the span's cosine with the window in the latent space (of the best window's best
    span); whether the document holds the item's answer."""
    schema = "doc_id long, item_id long, cosine double, lcs_words long, lcs_share double, has_answer boolean"
    best = _retrieve(docs, items, True, schema)
    row = F.max(F.struct("lcs_share", "lcs_words", "cosine")).alias("b")
    return best.groupBy("doc_id", "item_id").agg(row, F.max("has_answer").alias("has_answer")).select(
        "doc_id", "item_id", "b.cosine", "b.lcs_words", "b.lcs_share", "has_answer"
    )


def leak_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Every item with its dataset and the number of documents it leaked into."""
    n = leaks(docs, items).groupBy("item_id").agg(F.count("*").alias("n_documents"))
    return items.select("item_id", "dataset").dropDuplicates(["item_id"]).join(n, "item_id", "left").select(
        "item_id", "dataset", F.coalesce("n_documents", F.lit(0)).alias("n_documents")
    )
