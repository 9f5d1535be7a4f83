"""Subject areas of documents by class-association rules (problem 9).

Documents are cut into statements. Hand labels belong to documents, so the statements of a
bounded sample of labelled documents are first told apart by how much their words favour one
label of their document; held-out case descriptions serve as statements without a subject.
From these statements frequent-pattern growth mines rules {words} -> subject. Rules that a
shorter rule makes redundant are pruned, the rest weighted by their shrunk log odds, and the
summed evidence calibrated on the same sample. Every statement of every document is then
judged by its matching rules; a document has each subject that holds a quarter of its
statements that have one.

Texts without statement marks are cut into stretches of the usual statement length.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WORD, keyed

#: Bounds of the fitting sample: labelled documents and case descriptions; and how many statements of
#: cases there are at most for one of the documents, lest they outweigh the subjects where labels are few.
FIT_DOCUMENTS, FIT_CASES, CASE_SHARE = 4000, 2000, 0.25
#: Share of the statements that have a subject.
LEAST_SHARE = 0.25
#: Mining: support as a share of the statements and in statements (single words need the latter alone), confidence, words of a rule.
MIN_SUPPORT, MIN_COUNT, MIN_CONFIDENCE, RULE_WORDS = 0.001, 4, 0.5, 4
#: A longer rule is redundant unless it is surer by this much than all shorter ones within it.
GAIN = 0.05
#: Documents in which a word must stand to be an item.
MIN_DOCUMENTS = 2
#: Pseudo-counts that draw a rate towards the class's share.
SHRINK = 4.0
#: Log odds and share of one class from which a word is an item, and statement evidence to be assigned.
ITEM_LIFT, ITEM_SHARE, ASSIGN = 0.7, 0.35, 1.0
#: Calibrated probability from which a statement has the subject.
ACCEPT = 0.5
NONE = ""

MARKS = re.compile(r"(?<=[.?!。？！])\s+|\s*\n\s*|\s\|\s|;\s+(?=[A-ZÀ-Þ0-9])")


def subject_name(col):
    """Spelling of a subject: lower case, words joined by single underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(col), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")


def statements(text: str, usual: int) -> Iterator[list[str]]:
    """Words of each statement; a stretch of over twice the usual length is cut evenly."""
    for part in MARKS.split(text):
        words = WORD.findall(part.lower())
        n = round(len(words) / usual) if len(words) > 2 * usual else 1
        if n <= 1:
            if words:
                yield words
        else:
            for k in range(n):
                yield words[k * len(words) // n : (k + 1) * len(words) // n]


class Model:
    """Pruned rules by word, and the calibration of their evidence."""

    def __init__(self, classes: list[str], rules: list[tuple[frozenset, int, float]], usual: int, items: dict[str, int]):
        self.classes, self.usual = classes, usual
        # a rule of one word stands under it without words to check, a longer one under its rarest word
        self.by_word: dict[str, list[tuple[frozenset | None, int, float]]] = defaultdict(list)
        for words, c, weight in rules:
            rarest = min(words, key=lambda w: (items.get(w, 0), w))
            self.by_word[rarest].append((words if len(words) > 1 else None, c, weight))
        self.by_word = dict(self.by_word)
        self.slope, self.offset, self.least = 1.0, 0.0, float(np.log(ACCEPT / (1 - ACCEPT)))

    def margin(self, words: list[str]) -> tuple[int, float]:
        """The class with most evidence, and how far it stands above half of the next one's."""
        told, evidence, by_word = set(words), {}, self.by_word
        for w in told:
            for rule, c, weight in by_word.get(w, ()):
                if rule is None or rule <= told:
                    evidence[c] = evidence.get(c, 0.0) + weight
        if not evidence:
            return -1, 0.0
        if len(evidence) == 1:
            return next(iter(evidence.items()))
        (best, c), (second, _) = sorted(((v, k) for k, v in evidence.items()), reverse=True)[:2]
        return c, best - 0.5 * second

    def judge(self, words: list[str]) -> int:
        """Number of the statement's subject, -1 for none."""
        c, margin = self.margin(words)
        return c if margin > 0 and self.slope * margin + self.offset >= self.least and self.classes[c] != NONE else -1


def _calibrate(model: Model, margins: np.ndarray, right: np.ndarray) -> None:
    """Logistic fit of being right by Newton steps, with a weak prior."""
    x = np.stack([margins, np.ones_like(margins)], 1)
    start = np.array([1.0, -1.0])
    w = start
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (right - p) - 5.0 * (w - start)
        h = (x * (p * (1 - p))[:, None]).T @ x + 5.0 * np.eye(2)
        step = np.linalg.solve(h, g)
        w = w + step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-6:
            break
    model.slope, model.offset = (float(w[0]), float(w[1])) if w[0] > 0.05 else (1.0, -1.0)


def _sample(docs: DataFrame, labels: DataFrame, areas: DataFrame) -> pd.DataFrame:
    """Texts and label sets of at most FIT_DOCUMENTS labelled documents, picked by hash."""
    known = areas.select(subject_name("subject").alias("subject")).distinct()
    labelled = (
        labels.select("doc_id", subject_name("subject").alias("subject"))
        .join(known, "subject")
        .groupBy("doc_id")
        .agg(F.sort_array(F.collect_set("subject")).alias("subjects"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(FIT_DOCUMENTS)
    )
    one = keyed(docs, "doc_id", "text").filter("text IS NOT NULL")
    return one.join(labelled, "doc_id").dropDuplicates(["doc_id"]).toPandas().sort_values("doc_id", ignore_index=True)


def fit(docs: DataFrame, labels: DataFrame, areas: DataFrame, cases: DataFrame) -> Model | None:
    """None if there is no labelled document or no subject."""
    spark = docs.sparkSession
    sample = _sample(docs, labels, areas)
    classes = [NONE, *sorted(r[0] for r in areas.select(subject_name("subject")).distinct().collect() if r[0])]
    if not len(sample) or len(classes) == 1:
        return None
    number = {c: i for i, c in enumerate(classes)}
    marked = [len(WORD.findall(s)) for t in sample.text for s in MARKS.split(t)]
    usual = int(np.median([n for n in marked if 3 <= n <= 40] or [16]))
    rows = cases.select("passage", "question").orderBy(F.xxhash64("item_id"), "item_id").limit(FIT_CASES).toPandas()
    parts = [(list(statements(t, usual)), [number[s] for s in subjects]) for t, subjects in zip(sample.text, sample.subjects)]
    said_of_none = [s for r in rows.itertuples(index=False) for t in r if isinstance(t, str) for s in statements(t, usual)]
    said_of_none = said_of_none[: max(1, int(CASE_SHARE * sum(len(said) for said, _ in parts)))]
    documents = Counter(w for said, _ in parts for w in {w for s in said for w in s})
    return _learnt(spark, _told_apart(parts, said_of_none, len(classes)), classes, usual, {w for w, n in documents.items() if n < MIN_DOCUMENTS})


def _lifts(counts: dict[str, list[float]], prior: list[float]) -> dict[str, list[float]]:
    """Log of how much commoner a word makes each class."""
    k = len(prior)
    return {w: [math.log((n[c] + SHRINK * p) / (n[k] + SHRINK) / p) for c, p in enumerate(prior)] for w, n in counts.items() if n[k] >= 2}


def _prior(seen: list[float]) -> list[float]:
    return [x / sum(seen) for x in seen]


def _told_apart(parts: list[tuple[list[list[str]], list[int]]], said_of_none: list[list[str]], k: int) -> list[tuple[list[str], int | None]]:
    """The statements of labelled documents, each with the label of its document (or with none of them)
    that its words favour; those of cases have no subject."""
    parts = [*parts, *(([s], [0]) for s in said_of_none)]
    seen, uses = [1.0] * k, {}  # by class, and over all
    for said, own in parts:
        share = 1 / len(own)
        for c in own:
            seen[c] += share
        for w in {w for s in said for w in s}:
            n = uses.setdefault(w, [0.0] * (k + 1))
            n[k] += 1
            for c in own:
                n[c] += share
    prior = _prior(seen)
    lift = _lifts(uses, prior)
    chosen: list[tuple[list[str], int | None]] = []
    for _ in range(2):  # tell the statements of a document apart, then count words by statement
        chosen = []
        for said, own in parts:
            pick = sorted({0, *own})
            for s in said:
                e = [0.0] * len(pick)
                for w in set(s):
                    v = lift.get(w)
                    if v is not None:
                        own_lift = [v[c] for c in pick]
                        if max(own_lift) > 0.3:
                            e = [a + b for a, b in zip(e, own_lift)]
                best = max(range(len(pick)), key=e.__getitem__)
                chosen.append((s, pick[best] if e[best] >= ASSIGN else None))
        lift = _lifts(_uses(chosen, k), prior)
    return chosen


def _uses(chosen: list[tuple[list[str], int | None]], k: int) -> dict[str, list[float]]:
    """Statements with each word, by class and over all."""
    uses: dict[str, list[float]] = {}
    for s, c in chosen:
        for w in set(s):
            n = uses.setdefault(w, [0.0] * (k + 1))
            n[k] += 1
            if c is not None:
                n[c] += 1
    return uses


def _learnt(spark, chosen: list[tuple[list[str], int | None]], classes: list[str], usual: int, single: set[str]) -> Model:
    """Items, rules of them by pattern growth, and the calibration of their evidence. Words in ``single`` stand
    in too few documents to tell a subject from a document."""
    k = len(classes)
    uses, seen = _uses(chosen, k), [1.0] * k
    for _, c in chosen:
        if c is not None:
            seen[c] += 1
    prior = _prior(seen)

    def telling(n: list[float]) -> bool:
        """Whether a word raises the odds of a class that has a good share of it; odds, so that a class of most statements can have words too."""
        return n[k] >= MIN_COUNT and max(n[:k]) >= ITEM_SHARE * n[k] and any(_weight(n[c], n[k], p) >= ITEM_LIFT for c, p in enumerate(prior))

    items = {w: int(n[k]) for w, n in uses.items() if not w.isdigit() and w not in single and telling(n)}
    baskets = []
    for s, c in chosen:
        told = {w for w in s if w in items}
        if told:
            baskets.append((told, c))
    # What growth counts first are the single words; of these, rules need no support but MIN_COUNT.
    alone = {(frozenset([w]), c): (uses[w][c], uses[w][k]) for w in items for c in range(k) if uses[w][c] >= MIN_CONFIDENCE * uses[w][k]}
    rules = _pruned(alone | _mine(spark, baskets, len(chosen)), prior)
    model = Model(classes, rules, usual, items)
    margins, right = [], []
    for s, c in chosen:
        best, m = model.margin(s)
        if m > 0:
            margins.append(m)
            right.append(float(c == best))
    if margins:
        _calibrate(model, np.array(margins), np.array(right))
    return model


#: Parts of the pattern growth: the sample is bounded, and every part repeats the statements it needs.
GROWTH_PARTS = 2


def _mine(spark, baskets: list[tuple[set[str], int | None]], n_statements: int) -> dict[tuple[frozenset, int], tuple[float, float]]:
    """(words, class) -> (statements with both, statements with the words), by frequent-pattern growth
    over all items; only rules for a class leave the executors. Words are numbers there, class c is -1 - c."""
    from pyspark.ml.fpm import FPGrowth

    if not baskets:
        return {}
    words = sorted({w for told, _ in baskets for w in told})
    number = {w: i for i, w in enumerate(words)}
    support = max(MIN_SUPPORT * n_statements, MIN_COUNT) / len(baskets)
    rows = pd.DataFrame({"items": [[*sorted(number[w] for w in told), *([-1 - c] if c is not None else [])] for told, c in baskets]})
    data = spark.createDataFrame(rows, "items array<int>")
    growth = FPGrowth(itemsCol="items", minSupport=min(1.0, support), minConfidence=MIN_CONFIDENCE, numPartitions=GROWTH_PARTS)
    consequent = F.col("consequent")[0]
    of_class = (consequent < 0) & (F.array_min("antecedent") >= 0) & (F.size("antecedent") <= RULE_WORDS)
    out = {}
    for told, c, confidence, share in growth.fit(data).associationRules.filter(of_class).select("antecedent", consequent, "confidence", "support").collect():
        n = share * len(baskets)
        out[frozenset(words[i] for i in told), -1 - c] = (n, n / confidence)
    return out


def _weight(n: float, total: float, prior: float) -> float:
    """Log odds of the class, above those it has anyway."""
    p = (n + SHRINK * prior) / (total + SHRINK)
    return math.log(p / (1 - p + 1e-9)) - math.log(prior / (1 - prior))


def _pruned(found: dict[tuple[frozenset, int], tuple[float, float]], prior: list[float]) -> list[tuple[frozenset, int, float]]:
    """Rules with their weight, without those that a shorter one makes redundant."""
    kept = []
    for (words, c), (n, total) in found.items():
        shorter = (found.get((frozenset(x), c)) for k in range(1, len(words)) for x in combinations(words, k))
        weight = _weight(n, total, prior[c])
        if weight > 0 and not any(x and x[0] / x[1] >= n / total - GAIN for x in shorter):
            kept.append((words, c, weight))
    return kept


def document_subjects(docs: DataFrame, labels: DataFrame, areas: DataFrame, cases: DataFrame) -> DataFrame:
    """doc_id, subject, n_statements, n_with_subject of every subject that holds at least
    LEAST_SHARE of the document's statements with a subject. Documents without such a
    statement (null and empty texts too) and rows without doc_id have no row; without labels
    nobody has one."""
    schema = "doc_id long, subject string, n_statements long, n_with_subject long"
    model = fit(docs, labels, areas, cases)
    if model is None:
        return docs.sparkSession.createDataFrame([], schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            out = []
            for doc, text in zip(pdf.doc_id, pdf.text):
                if not isinstance(text, str):
                    continue
                count = Counter(map(m.judge, statements(text, m.usual)))
                count.pop(-1, None)
                total = sum(count.values())
                out += [(doc, m.classes[c], n, total) for c, n in count.items() if n >= LEAST_SHARE * total]
            yield pd.DataFrame(out, columns=["doc_id", "subject", "n_statements", "n_with_subject"])

    return keyed(docs, "doc_id", "text").mapInPandas(rows, schema)


def composition(docs: DataFrame, labels: DataFrame, areas: DataFrame, cases: DataFrame) -> DataFrame:
    """Every subject area with the documents and statements about it."""
    found = document_subjects(docs, labels, areas, cases)
    n = found.groupBy("subject").agg(F.countDistinct("doc_id").alias("n_documents"), F.sum("n_statements").alias("n_statements"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return areas.select(subject_name("subject").alias("subject")).distinct().join(n, "subject", "left").select(
        "subject", zero("n_documents"), zero("n_statements")
    )
