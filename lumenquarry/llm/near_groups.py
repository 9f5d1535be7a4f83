"""Near-duplicate documents by a multi-index Hamming join of b-bit signatures (problem 6).

Every distinct set of three-word sequences gets a signature of CHUNKS x PARTS min-hash
values of B_BITS bits. Two sets of similarity s agree in a value with probability s, so their
signatures lie a Hamming distance of about (1 - s) x length apart. The signature is split into
chunks; by the pigeonhole principle two signatures at most LIMIT values apart have at least
two chunk hits when each chunk may hold up to one error, and the error is enumerated by
leaving out one value of the chunk at a time. The pairs found are checked exactly.

Sets that are equal are joined as one class first, so copies never meet in a bucket. A key that
very many different classes have (set phrases around a few changed words) is no bucket of
one task: its classes are dealt to blocks, blocks meet two by two, and only the pairs whose
signatures agree far enough come out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WORD, cut, expanded, keyed

SHINGLE_WORDS, THRESHOLD = 3, 0.6
CHUNKS, PARTS, B_BITS = 16, 5, 16
#: A pair is a candidate with this many common keys; a chunk without error gives PARTS of them.
LEAST_KEYS = 2
#: All pairs at this Hamming distance or nearer are candidates: 2 errors in all chunks but one spoil no key pair.
LIMIT = 2 * (CHUNKS - 1) + 1 - 1
#: Agreeing values below which a pair of similarity THRESHOLD is five standard deviations off.
LEAST_AGREE = int(CHUNKS * PARTS * THRESHOLD - 5 * (CHUNKS * PARTS * THRESHOLD * (1 - THRESHOLD)) ** 0.5)

#: Classes with a key from which it is hot, and of a block of it; share of the classes by which hot
#: keys are told (at least, and at least so many classes) and members in that sample. A key that is not
#: told hot is joined as the others are.
HOT, BLOCK, SAMPLE_SHARE, SAMPLE_CLASSES, SAMPLE_LEAST = 2000, 1000, 0.01, 20_000, 20

_M = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Distinct hashed word sequences of texts; remembers the hashes of words it has seen."""

    def __init__(self, n: int = SHINGLE_WORDS):
        self.n, self.words = n, {}

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.words) > 2_000_000:
            self.words.clear()
        known, ids, sizes = self.words, [], []
        for text in texts:
            words = WORD.findall(text.lower()) if isinstance(text, str) else ()
            try:
                ids += [known[w] for w in words]
            except KeyError:
                for w in words:
                    if w not in known:
                        known[w] = xxhash.xxh3_64_intdigest(w)
                ids += [known[w] for w in words]
            sizes.append(len(words))
        a = np.array(ids, np.uint64)
        m = max(0, len(a) - self.n + 1)
        h = a[:m].copy()
        for k in range(1, self.n):  # over the whole batch; what reaches over a text's end is left out below
            h = _mix(h * _M + a[k : m + k])
        end = np.cumsum(sizes)
        return [np.unique(h[e - n : max(e - n, e - self.n + 1)]) for e, n in zip(end, sizes)]


def _seeds(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(1, 2**63, count, np.uint64) | np.uint64(1), rng.integers(0, 2**63, count, np.uint64)


def signature(shingles: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    """The lowest value of each hash function, B_BITS bits of it."""
    best = np.full(len(mul), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 4096):
        h = mul[:, None] * shingles[i : i + 4096]
        h += add[:, None]
        np.minimum(best, h.min(axis=1), out=best)
    return (_mix(best) & np.uint64((1 << B_BITS) - 1)).astype(np.uint16)


#: Texts whose sequences are hashed at a time.
_TEXTS = 200


def _signatures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    shingler, (mul, add) = Shingler(), _seeds(CHUNKS * PARTS)
    for pdf in batches:
        ids, classes, sigs = [], [], []
        for k in range(0, len(pdf), _TEXTS):
            part = pdf.iloc[k : k + _TEXTS]
            for i, s in zip(part.doc_id, shingler(part.text.tolist())):
                if len(s):
                    ids.append(i)
                    classes.append(xxhash.xxh3_128_digest(s.tobytes()))
                    sigs.append(signature(s, mul, add).tobytes())
        yield pd.DataFrame({"doc_id": np.array(ids, np.int64), "class": classes, "sig": sigs})


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each chunk and each value left out of it."""
    for pdf in batches:
        if not len(pdf):
            continue
        sig = np.frombuffer(b"".join(pdf.sig), np.uint16).reshape(len(pdf), CHUNKS, PARTS).astype(np.uint64)
        keys = []
        for c in range(CHUNKS):
            for out in range(PARTS):
                h = np.full(len(pdf), c * PARTS + out + 1, np.uint64)
                for p in range(PARTS):
                    if p != out:
                        h = _mix(h * _M + sig[:, c, p])
                keys.append((h >> np.uint64(16)).astype(np.int64))
        n = len(keys)
        yield pd.DataFrame({"key": np.stack(keys, 1).ravel(), "rep": np.repeat(pdf.rep.to_numpy(), n)})


def _shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    shingler = Shingler()
    for pdf in batches:
        for k in range(0, len(pdf), _TEXTS):
            part = pdf.iloc[k : k + _TEXTS]
            yield pd.DataFrame({"doc_id": part.doc_id, "s": [s.tobytes() for s in shingler(part.text.tolist())]})


def _similar(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        sims = []
        for a, b in zip(pdf.s_lo, pdf.s_hi):
            a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            sims.append(both / max(1, len(a) + len(b) - both))
        yield pd.DataFrame({"lo": pdf.lo, "hi": pdf.hi, "similarity": np.array(sims, np.float64)})


def _agree(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if len(pdf):
            a = np.frombuffer(b"".join(pdf.sig_lo), np.uint16).reshape(len(pdf), -1)
            b = np.frombuffer(b"".join(pdf.sig_hi), np.uint16).reshape(len(pdf), -1)
            yield pdf.loc[(a == b).sum(1) >= LEAST_AGREE, ["lo", "hi"]]


def _hot_keys(reps: DataFrame, hot: int) -> DataFrame:
    """key, blocks of the keys that about ``hot`` classes or more have."""
    share = min(1.0, max(SAMPLE_SHARE, SAMPLE_CLASSES / max(1, reps.count())))
    some = reps if share == 1 else reps.filter(F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(1 << 30)) < int(share * (1 << 30)))
    n = F.col("count") / share
    return some.select("rep", "sig").mapInPandas(_keys, "key long, rep long").groupBy("key").count().filter((n >= hot) & ((F.col("count") >= SAMPLE_LEAST) | F.lit(share == 1))).select(
        "key", F.ceil(n / BLOCK).cast("int").alias("blocks")
    )


def _met(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pairs of two blocks of a key, or within one, whose signatures agree in LEAST_AGREE values or more."""
    i, j = pdf.i.iat[0], pdf.j.iat[0]
    pdf = pdf.drop_duplicates(["rep", "own"])
    a, b = pdf[pdf.own == i], pdf[pdf.own == j]
    sig = lambda rows: np.frombuffer(b"".join(rows.sig), np.uint16).reshape(len(rows), CHUNKS * PARTS)
    out = []
    if len(a) and len(b):
        y, ids = sig(b), b.rep.to_numpy()
        for k in range(0, len(a), 256):
            x, of = sig(a.iloc[k : k + 256]), a.rep.to_numpy()[k : k + 256]
            same = np.zeros((len(x), len(y)), np.uint8)
            for v in range(x.shape[1]):
                same += x[:, v, None] == y[:, v]
            p, q = np.nonzero(same >= LEAST_AGREE)
            out.append(pd.DataFrame({"lo": np.minimum(of[p], ids[q]), "hi": np.maximum(of[p], ids[q])}))
    found = pd.concat(out) if out else pd.DataFrame({"lo": [], "hi": []})
    return found[found.lo < found.hi].astype("int64")


def _hot_pairs(keys: DataFrame, hot: DataFrame, sig: DataFrame) -> DataFrame:
    """lo, hi of the classes that have a hot key in common and agree far enough."""
    members = keys.join(hot, "key").join(sig, "rep").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    other = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = other.select("key", "rep", "sig", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    return met.groupBy("key", "i", "j").applyInPandas(_met, "lo long, hi long").distinct()


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, class) of every document with at least three words, and (class, rep, sig, n)."""
    signed = cut(keyed(docs, "doc_id", "text").mapInPandas(_signatures, "doc_id long, class binary, sig binary"))
    reps = signed.groupBy("class").agg(F.min("doc_id").alias("rep"), F.min("sig").alias("sig"), F.count("*").alias("n"))
    return signed.select("doc_id", "class"), cut(reps)


def class_pairs(docs: DataFrame, reps: DataFrame, hot: int = HOT) -> DataFrame:
    """lo, hi, similarity: representatives of different classes at THRESHOLD or above. Keys of
    ``hot`` classes or more go through blocks, which lose no pair and may find one that has
    no second common key."""
    sig = reps.select("rep", "sig")
    keys = sig.mapInPandas(_keys, "key long, rep long")
    hot_keys = cut(_hot_keys(reps, hot))
    any_hot = not hot_keys.isEmpty()
    of_hot = _hot_pairs(keys, hot_keys, sig) if any_hot else None
    if any_hot:
        keys = keys.join(hot_keys.select("key"), "key", "left_anti")
    a, b = keys.withColumnRenamed("rep", "lo"), keys.withColumnRenamed("rep", "hi")
    found = (
        a.join(b.hint("merge"), "key")
        .filter("lo < hi")
        .groupBy("lo", "hi")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") >= LEAST_KEYS)
        .select("lo", "hi")
    )
    near = (
        found.join(sig.toDF("lo", "sig_lo"), "lo")
        .join(sig.toDF("hi", "sig_hi"), "hi")
        .mapInPandas(_agree, "lo long, hi long")
    )
    near = cut(near.unionByName(of_hot).distinct() if any_hot else near)
    wanted = near.select(F.col("lo").alias("doc_id")).union(near.select("hi")).distinct()
    sets = cut(keyed(docs, "doc_id", "text").join(wanted, "doc_id", "left_semi").mapInPandas(_shingles, "doc_id long, s binary"))
    return (
        near.join(sets.toDF("lo", "s_lo"), "lo")
        .join(sets.toDF("hi", "s_hi"), "hi")
        .select("lo", "hi", "s_lo", "s_hi")
        .mapInPandas(_similar, "lo long, hi long, similarity double")
        .filter(F.col("similarity") >= THRESHOLD)
    )


def document_pairs(docs: DataFrame) -> DataFrame:
    """doc_id_lo, doc_id_hi of all pairs of documents at THRESHOLD or above, those of equal
    sets included. Documents of fewer than three words (null and empty texts too) and rows
    without doc_id have no pair; a repeated doc_id is no pair with itself."""
    members, reps = classes(docs)
    pairs = class_pairs(docs, reps).select("lo", "hi")
    sizes = reps.select("rep", "n")
    same = sizes.filter("n > 1").select(F.col("rep").alias("lo"), F.col("rep").alias("hi"))
    member = members.distinct().join(reps.select("class", "rep"), "class").select("doc_id", "rep")
    all_ = expanded(expanded(pairs.unionByName(same), member.toDF("x", "lo"), "lo", sizes), member.toDF("y", "hi"), "hi", sizes)
    return all_.filter("(lo <> hi AND x <> y) OR x < y").select(F.least("x", "y").alias("doc_id_lo"), F.greatest("x", "y").alias("doc_id_hi"))


def document_groups(docs: DataFrame) -> DataFrame:
    """doc_id, group_id (smallest doc_id reachable over near pairs), n_links (near classes),
    attribute. One row for every document with at least three words."""
    members, reps = classes(docs)
    edges = cut(class_pairs(docs, reps).select("lo", "hi"))
    both = cut(edges.union(edges.select("hi", "lo")).toDF("a", "b"))
    label = cut(both.select(F.col("a").alias("rep")).distinct().withColumn("group_id", F.col("rep")))  # classes without a link need no rounds
    while True:  # each round takes the smallest label around, and that label's own label
        seen = both.join(label.toDF("b", "l"), "b").groupBy("a").agg(F.min("l").alias("l"))
        step = label.join(seen.withColumnRenamed("a", "rep"), "rep", "left").select(
            "rep", F.least("group_id", F.coalesce("l", "group_id")).alias("g"), F.col("group_id").alias("was")
        )
        jump = step.select(F.col("rep").alias("g"), F.col("g").alias("gg"))
        new = cut(step.join(jump, "g", "left").select("rep", F.least("g", F.coalesce("gg", "g")).alias("group_id"), "was"))
        changed = new.filter("group_id <> was").limit(1).count()
        label = new.select("rep", "group_id")
        if not changed:
            break
    links = both.groupBy("a").agg(F.count("*").alias("n_links")).withColumnRenamed("a", "rep")
    return (
        members.join(reps.select("class", "rep"), "class")
        .join(label, "rep", "left")
        .join(links, "rep", "left")
        .join(docs.select("doc_id", F.lower(F.trim("attribute")).alias("attribute")), "doc_id")
        .select("doc_id", F.coalesce("group_id", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "attribute")
    )
