"""Filling containers of fixed capacity (problem 7).

Lengths are counted in tokens of a public tokenizer; from then on only ids and lengths move.
A text longer than a container fills whole containers and leaves one remainder. All other
items are dealt to blocks of about BLOCK_ITEMS items, and each block is divided into windows
by Karmarkar-Karp multiway differencing: of the partial partitions with the largest spread
between their windows, the two largest are merged, the fullest windows of one onto the
emptiest of the other. While a window exceeds the capacity, the number of windows rises.
Blocks are equal in size whatever the corpus, so no task grows with it.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, keyed

CAPACITY, BLOCK_ITEMS, BLOCKS_PER_TASK = 1024, 1000, 8
TOKENIZERS = os.environ.get("LUMENQUARRY_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The published splitting pattern that belongs to the vocabulary (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def token_counts(docs: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens; null and empty texts have 0 tokens, rows without doc_id are left out."""

    docs.sparkSession.sparkContext.addFile(os.path.join(folder, vocabulary))  # no worker needs the folder

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        with open(SparkFiles.get(vocabulary), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for pdf in batches:
            yield pd.DataFrame(
                {"doc_id": pdf.doc_id, "n_tokens": [len(encoding.encode_ordinary(t)) if isinstance(t, str) else 0 for t in pdf.text]}
            )

    return keyed(docs, "doc_id", "text").mapInPandas(rows, "doc_id long, n_tokens long")


def differencing(sizes: np.ndarray, windows: int) -> list[tuple[int, list[int]]]:
    """Karmarkar-Karp: ``windows`` lists of item numbers with near-equal sums; empty ones are left out."""
    heap = [(-int(s), k, [(int(s), [k])]) for k, s in enumerate(sizes)]
    heapq.heapify(heap)
    ties = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(a) < len(b):
            a, b = b, a
        free = windows - len(a)
        # a: fullest first, then `free` empty windows; the fullest of b go to the emptiest of a
        own, over = b[:free], b[free:]
        shift = len(a) - len(over)
        merged = a[:shift] + own + [(a[len(a) - 1 - i][0] + s, a[len(a) - 1 - i][1] + items) for i, (s, items) in enumerate(over)]
        if len(merged) == windows:
            low = min(s for s, _ in merged)
        else:
            low = 0
        merged.sort(key=lambda x: -x[0])
        ties += 1
        heapq.heappush(heap, (-(merged[0][0] - low), ties, merged))
    return heap[0][2] if heap else []


def windows_of(sizes: np.ndarray, capacity: int) -> list[tuple[int, list[int]]]:
    """The first partition, by rising number of windows, with no window over the capacity."""
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        found = differencing(sizes, windows)
        excess = sum(max(0, s - capacity) for s, _ in found)
        if not excess:
            return found
        windows += max(1, excess // (2 * capacity))


def containers(counts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """container_id, doc_id, part, first_token, n_tokens: every token of every text stands in
    exactly one container and no container holds more than ``capacity``. Only a text that
    exceeds the capacity alone has more than one part. Texts without tokens take no room and
    have no row; a doc_id that comes twice is two items of that number."""
    if capacity < 1:
        raise ValueError("capacity must be positive")
    items = counts.filter("n_tokens > 0")
    again = F.row_number().over(Window.partitionBy("doc_id").orderBy("n_tokens")) - 1  # of the long texts alone
    full = items.select("doc_id", "n_tokens", F.floor(F.col("n_tokens") / capacity).cast("long").alias("f")).filter("f > 0").withColumn("again", again)
    full = full.select("doc_id", "again", F.explode(F.sequence(F.lit(0).cast("long"), F.col("f") - 1)).alias("part")).select(
        F.concat_ws("-", F.lit("full"), "doc_id", "part", F.when(F.col("again") > 0, F.col("again"))).alias("container_id"),
        "doc_id",
        "part",
        (F.col("part") * capacity).alias("first_token"),
        F.lit(capacity).cast("long").alias("n_tokens"),
    )
    rest = items.select(
        "doc_id",
        F.floor(F.col("n_tokens") / capacity).cast("long").alias("part"),
        (F.col("n_tokens") % capacity).alias("size"),
    ).filter("size > 0")
    blocks = max(1, -(-items.count() // BLOCK_ITEMS))
    rest = rest.withColumn("block", F.pmod(F.xxhash64("doc_id", "part"), F.lit(blocks)))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc_id", "part"], ascending=[False, True, True], ignore_index=True)
        window = np.empty(len(pdf), np.int64)
        for k, (_, members) in enumerate(windows_of(pdf["size"].to_numpy(), capacity)):
            window[members] = k
        names = [f"mix-{pdf.block.iat[0]}-{k}" for k in window]
        return pd.DataFrame(
            {"container_id": names, "doc_id": pdf.doc_id, "part": pdf.part, "first_token": pdf.part * capacity, "n_tokens": pdf["size"]}
        )

    # The rows are few bytes and much work: tasks are made by blocks, not by bytes.
    mixed = rest.repartition(-(-blocks // BLOCKS_PER_TASK), "block").groupBy("block").applyInPandas(pack, "container_id string, doc_id long, part long, first_token long, n_tokens long")
    return full.unionByName(mixed)


def packed(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    return containers(cut(token_counts(docs)), capacity)


def usage(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: n_containers, n_tokens, least_containers (tokens / capacity, rounded up), fill."""
    one = packed(docs, capacity).groupBy("container_id").agg(F.sum("n_tokens").alias("n"))
    return one.agg(F.count("*").alias("n_containers"), F.sum("n").alias("n_tokens")).select(
        "n_containers",
        "n_tokens",
        F.ceil(F.col("n_tokens") / capacity).alias("least_containers"),
        F.try_divide(F.col("n_tokens"), F.col("n_containers") * capacity).alias("fill"),
    )
