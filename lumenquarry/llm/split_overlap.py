"""Same or near-same records across splits (problem 1).

Evaluation records are indexed, in shards, by a compressed full-text index (an FM-index over
words: the Burrows-Wheeler transform as a wavelet matrix of packed bits, and a sampled suffix
array); training records are streamed through it by backward search.

* A record is its set of question words, written as symbols of (bare answer, word) and put
  in one global order, rare words first. The order comes from a count sketch of fixed size.
* Of two records that agree, the first common word stands among the first 30 % of either,
  and in one of them among the first 3/17 ("shallow"; both "deep" contradicts the threshold).
  Such a word with its depths is a key. A record goes to the shards of its keys, and in the
  text of a shard a word that is a key there has a symbol of its own.
* A filter of fixed size over the evaluation keys drops the training records that have no
  key in common before anything of them is shuffled; it errs to one side only.
* In a shard, backward search of a training record's keys gives the places where a match can
  begin. From the end of each record found there, backward steps through the index spell it out
  from its rarest word on; the stretches that go along with the training record are the
  maximal matches, and their lengths add up to the number of common words. That number
  decides the pair. The index alone holds the evaluation records; nothing is compared outside it.

A pair is reported by the shard of its first common word and by no other. Keys of very many
evaluation records are spread over several shards, and a shard that very many training records go
to is searched by several tasks. Equal records are one class in all of this and expand to their
sample_ids at the end.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WORD, cut, expanded

#: Similarity of the words of two questions, as a fraction.
NUM, DEN = 7, 10
#: Cells of the count sketch as a power of two. The key filter has about FILTER_ROOM bits a key,
#: but never more than 2 ** FILTER_MOST (32 MB); beyond, it lets more through, never less.
SKETCH_BITS, FILTER_ROOM, FILTER_LEAST, FILTER_MOST = 18, 16, 20, 28
#: Entries of an index shard, entries of one key before it is spread over several shards, and
#: training records of a shard before several tasks search it.
SHARD_ENTRIES, KEY_ENTRIES, SHARD_RECORDS = 20_000, 10_000, 50_000
#: Every so many positions of the suffix array are kept.
SAMPLE = 8

_KIND = np.arange(3, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
SPLIT = r"^(.*)_(train|val|test)_[^_]+$"


def split_records(samples: DataFrame) -> DataFrame:
    """sample_id, source, split, question, answer; rows without one of these are left out, as
    they have no bare answer or no words to share."""
    return samples.select(
        "sample_id",
        F.regexp_extract("sample_id", SPLIT, 1).alias("source"),
        F.regexp_extract("sample_id", SPLIT, 2).alias("split"),
        "question",
        "answer",
    ).filter((F.col("split") != "") & F.col("question").isNotNull() & F.col("answer").isNotNull())


def _cell(word_hash: int) -> int:
    return word_hash & ((1 << SKETCH_BITS) - 1)


def word_sketch(records: DataFrame) -> np.ndarray:
    """How many records hold a word, by cell."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, words = np.zeros(1 << SKETCH_BITS, np.int64), Counter()

        def settle() -> None:
            for w, n in words.items():
                total[_cell(xxhash.xxh3_64_intdigest(w))] += n
            words.clear()

        for pdf in batches:
            for text in pdf.question:
                words.update(set(WORD.findall(text.lower())))
            if len(words) > 1_000_000:
                settle()
        settle()
        (at,) = total.nonzero()
        yield pd.DataFrame({"cell": at, "n": total[at]})

    found = records.select("question").mapInPandas(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    sketch = np.zeros(1 << SKETCH_BITS, np.int64)
    sketch[found["cell"].to_numpy()] = found["n"].to_numpy()
    return sketch


def key_positions(n):
    """How many leading words are shallow, and how many can be the first common one at all."""
    return 3 * n // 17 + 1, n * (DEN - NUM) // DEN + 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _keys(symbols, evaluation: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, key, position and kind of all keys of some records. Kind 0: both shallow; 1: only the
    evaluation record shallow; 2: only the training record."""
    n = np.array([len(s) // 8 for s in symbols])
    flat = np.frombuffer(b"".join(symbols), np.uint64)
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    last = np.repeat(key_positions(n)[1], n)
    shallow = np.minimum(np.repeat(key_positions(n)[0], n), last)
    (head,), (deep,) = np.nonzero(at < shallow), np.nonzero((at >= shallow) & (at < last))
    other, own = (1, 2) if evaluation else (2, 1)
    keys = np.concatenate([_mix(flat[head]), _mix(flat[head] + _KIND[other]), _mix(flat[deep] + _KIND[own])])
    place = np.concatenate([head, head, deep])
    return row[place], keys, at[place].astype(np.int32), np.repeat(np.array([0, other, own], np.uint8), [len(head), len(head), len(deep)])


def _mask(keys: np.ndarray) -> np.ndarray:
    """Three of the 64 bits of a filter cell."""
    one = np.uint64(1)
    return (one << (keys & np.uint64(63))) | (one << ((keys >> np.uint64(6)) & np.uint64(63))) | (one << ((keys >> np.uint64(12)) & np.uint64(63)))


def _filter_cell(keys: np.ndarray, cells: int) -> np.ndarray:
    return ((keys >> np.uint64(18)) & np.uint64(cells - 1)).astype(np.int64)


def _inside(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    mask = _mask(keys)
    return bits[_filter_cell(keys, len(bits))] & mask == mask


def key_filter(rows: DataFrame, evaluation: bool, n_keys: int, within: np.ndarray | None = None) -> np.ndarray:
    """Filter of all keys; with ``within`` of those only that are in that filter."""
    size = min(max((n_keys * FILTER_ROOM).bit_length(), FILTER_LEAST), FILTER_MOST)
    cells = 1 << (size - 6)

    def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            h = _keys(pdf.symbols, evaluation)[1]
            if within is not None:
                h = h[_inside(within, h)]
            yield pd.DataFrame({"cell": _filter_cell(h, cells), "b": _mask(h).view(np.int64)})

    found = rows.select("symbols").mapInPandas(bits, "cell long, b long").groupBy("cell").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(cells, np.int64)
    out[found["cell"].to_numpy()] = found["b"].to_numpy()
    return out.view(np.uint64)


class _Hashes(dict):
    """The hash of each word asked for."""

    def __missing__(self, word: str) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


class _Bare(dict):
    """The hash of each answer's bare form; None for an empty one."""

    def __missing__(self, answer: str) -> int | None:
        bare = "".join(WORD.findall(answer.lower()))
        found = self[answer] = xxhash.xxh3_64_intdigest(bare) if bare else None
        return found


def symbol_rows(records: DataFrame, sketch, within, evaluation: bool) -> DataFrame:
    """class, symbols, sample_id; with ``within`` only of records that have a key in it."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, known, answered = sketch.value, _Hashes(), _Bare()
        bits = within.value if within is not None else None
        for pdf in batches:
            ids, sizes, answers, words = [], [], [], []
            for sample_id, question, answer in zip(pdf.sample_id, pdf.question, pdf.answer):
                bare, said = answered[answer], set(WORD.findall(question.lower()))
                if bare is None or not said:
                    continue
                words.extend(map(known.__getitem__, said))
                ids.append(sample_id)
                sizes.append(len(said))
                answers.append(bare)
            for kept in (known, answered):
                if len(kept) > 1_000_000:
                    kept.clear()
            if not ids:
                continue
            n = np.array(sizes)
            record = np.repeat(np.arange(len(n)), n)
            hashes = np.array(words, np.uint64)
            symbol = _mix(hashes ^ np.repeat(np.array(answers, np.uint64), n))
            order = np.lexsort((symbol, counts[_cells(hashes)], record))  # the global order within each record
            symbol = symbol[order]
            start = np.concatenate([[0], np.cumsum(n)])
            keep = np.ones(len(n), bool)
            if bits is not None:
                at = np.arange(len(symbol)) - start[record]
                last = n[record] * (DEN - NUM) // DEN + 1
                shallow = (at < 3 * n[record] // 17 + 1) & (at < last)
                other, own = (1, 2) if evaluation else (2, 1)
                hit = np.zeros(len(symbol), bool)
                for where, kind in ((shallow, 0), (shallow, other), ((at < last) & ~shallow, own)):
                    hit[where] |= _inside(bits, _mix(symbol[where] + _KIND[kind]))
                keep = np.bincount(record[hit], minlength=len(n)) > 0
            out = []
            for k in np.flatnonzero(keep):
                b = symbol[start[k] : start[k + 1]].tobytes()
                out.append((xxhash.xxh3_128_digest(b), b, ids[k]))
            yield pd.DataFrame(out, columns=["class", "symbols", "sample_id"])

    return records.select("sample_id", "question", "answer").mapInPandas(rows, "class binary, symbols binary, sample_id string")


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)


class Bits:
    """A bit vector in 64-bit words with a count in front of each word."""

    def __init__(self, bits: np.ndarray):
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        packed = np.packbits(bits, bitorder="little")
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.uint32)[:-1]]).astype(np.uint32)
        self.ones = int(np.count_nonzero(bits))

    def rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ones before each place, and the bit there."""
        at, bit = i >> 6, (i & 63).astype(np.uint64)
        word = self.words[at]
        ones = self.before[at] + np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
        return ones.astype(np.int64), ((word >> bit) & np.uint64(1)).astype(bool)


class BackwardIndex:
    """FM-index over the words of entries. An entry is a list of words, each with a mark (0..7); it
    is kept back to front, so that backward steps read it forwards."""

    def __init__(self, words: list[np.ndarray], marks: list[np.ndarray]):
        sizes = np.array([len(w) for w in words])
        self.ends, self.n = len(words), int(sizes.sum()) + len(words)
        self.alphabet, base = np.unique(np.concatenate([w[::-1] for w in words]), return_inverse=True)
        self.codes, code = np.unique(base.astype(np.int64) * 8 + np.concatenate([m[::-1] for m in marks]), return_inverse=True)
        self.word_of = np.concatenate([[-1], self.codes >> 3])
        self.starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        self.sizes = sizes
        # Each entry ends with a sign of its own, so that all suffixes differ and their order is total.
        end = np.zeros(self.n, bool)
        end[self.starts + sizes] = True
        rank = np.empty(self.n, np.int64)
        rank[end] = np.arange(self.ends)
        rank[~end] = code + self.ends
        order, width = rank, 1
        while width <= sizes.max():  # prefix doubling
            after = np.zeros(self.n, np.int64)
            after[:-width] = order[width:] + 1
            order = np.unique(order * (self.n + self.ends + 2) + after, return_inverse=True)[1]
            if order.max() == self.n - 1:
                break
            width *= 2
        suffixes = np.argsort(order, kind="stable")
        text = np.where(end, 0, rank - self.ends + 1)  # all end signs are 0 from here on: no step passes one
        count = np.bincount(text, minlength=len(self.codes) + 1)
        self.first = np.concatenate([[0], np.cumsum(count)])
        self._wavelet(text[suffixes - 1])
        kept = (suffixes % SAMPLE == 0) | np.isin(suffixes, self.starts)
        self.sampled, self.places = Bits(kept), suffixes[kept].astype(np.int32)

    def _wavelet(self, bwt: np.ndarray) -> None:
        """The transform bit by bit, the zeros of each bit before its ones."""
        self.levels = []
        for bit in reversed(range(max(1, int(len(self.codes)).bit_length()))):
            bits = (bwt >> bit) & 1 == 1
            self.levels.append((bit, Bits(bits), len(bits) - int(np.count_nonzero(bits))))
            bwt = np.concatenate([bwt[~bits], bwt[bits]])
        begin = np.zeros(len(self.codes) + 1, np.int64)
        found, at = np.unique(bwt, return_index=True)
        begin[found] = at
        self.shift = self.first[:-1] - begin

    def step(self, suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sign before each suffix, and the suffix that begins with it."""
        i, sign = suffix, np.zeros(len(suffix), np.int64)
        for bit, bits, zeros in self.levels:
            ones, one = bits.rank(i)
            i = np.where(one, zeros + ones, i - ones)
            sign |= one.astype(np.int64) << bit
        return sign, i + self.shift[sign]

    def extend(self, sign: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of suffixes that begin with ``sign`` and go on as those in lo..hi."""
        n, i = len(sign), np.concatenate([lo, hi])
        both = np.concatenate([sign, sign])
        for bit, bits, zeros in self.levels:
            ones, _ = bits.rank(i)
            i = np.where((both >> bit) & 1 == 1, zeros + ones, i - ones)
        i = i + self.shift[both]
        return i[:n], i[n:]

    def signs(self, words: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """The signs of marked words; -1 for one that the index lacks."""
        code = self.words(words) * 8 + marks
        i = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where((code >= 0) & (self.codes[i] == code), i + 1, -1)

    def words(self, words: np.ndarray) -> np.ndarray:
        """The numbers of words whatever their mark; -1 for one that the index lacks."""
        i = np.minimum(np.searchsorted(self.alphabet, words), len(self.alphabet) - 1)
        return np.where(self.alphabet[i] == words, i, -1).astype(np.int64)

    def locate(self, suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entries in which suffixes start, and the place of their first word in them."""
        i, open_ = suffix, np.arange(len(suffix))
        steps, out = np.zeros(len(suffix), np.int64), np.empty(len(suffix), np.int64)
        while len(open_):
            before, done = self.sampled.rank(i)
            out[open_[done]] = self.places[before[done]] + steps[open_[done]]
            open_, i = open_[~done], i[~done]
            steps[open_] += 1
            i = self.step(i)[1]
        e = np.searchsorted(self.starts, out, "right") - 1
        return e, self.sizes[e] - 1 - (out - self.starts[e])


def _key_rows(bits):
    """The keys of evaluation records that are in the filter."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        inside = bits.value
        for pdf in batches:
            if len(pdf):
                k = _keys(pdf.symbols, True)[1]
                yield pd.DataFrame({"key": k[_inside(inside, k)].view(np.int64)})

    return rows


def _shards_of(rows: pd.DataFrame, evaluation: bool, inside, blocks_of: dict, shards: int):
    """Row, shard, position and kind of each key of the records that is in the filter. A hot key has
    several blocks: an evaluation record is in one of them, a training record meets all."""
    row, keys, at, kinds = _keys(rows.symbols, evaluation)
    ok = _inside(inside, keys)
    row, keys, at, kinds = row[ok], keys[ok], at[ok], kinds[ok]
    block = np.zeros(len(keys), np.uint64)
    if blocks_of:
        n = np.array([blocks_of.get(k, 1) for k in keys.view(np.int64).tolist()], np.int64)
        if evaluation:
            own = np.array([int.from_bytes(c[:8], "little") for c in rows["class"]], np.uint64)
            block = own[row] % n.astype(np.uint64)
        else:
            row, keys, at, kinds = (np.repeat(v, n) for v in (row, keys, at, kinds))
            block = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)).astype(np.uint64)
    return row, (_mix(keys + block * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(shards)).astype(np.int64), at, kinds


def _loads(bits, hot, shards: int):
    """How many training records go to each shard."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                row, shard, _, _ = _shards_of(pdf, False, bits.value, hot.value, shards)
                found, n = np.unique(np.unique(row * shards + shard) % shards, return_counts=True)
                yield pd.DataFrame({"shard": found, "n": n})

    return rows


def _routed(evaluation: bool, bits, hot, shards: int, split):
    """A record once for each shard that one of its keys belongs to, with these keys. ``split`` has the
    tasks of the shards that several search: an evaluation record is in all, a training record in one."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tasks_of = split.value
        for pdf in batches:
            if not len(pdf):
                continue
            row, shard, at, kinds = _shards_of(pdf, evaluation, bits.value, hot.value, shards)
            order = np.lexsort((shard, row))
            row, shard, at, kinds = row[order], shard[order], at[order].tobytes(), kinds[order].tobytes()
            first = np.flatnonzero(np.diff(row * shards + shard, prepend=-1))
            cls, symbols, side, out = pdf["class"].tolist(), pdf.symbols.tolist(), 0 if evaluation else 1, []
            for a, b, i, s in zip(first.tolist(), [*first[1:].tolist(), len(row)], row[first].tolist(), shard[first].tolist()):
                tasks = tasks_of.get(s, (s,))
                if not evaluation:
                    tasks = (tasks[int.from_bytes(cls[i][8:16], "little") % len(tasks)],)
                out += [(t, side, cls[i], symbols[i], kinds[a:b], at[4 * a : 4 * b]) for t in tasks]
            yield pd.DataFrame(out, columns=["task", "side", "class", "symbols", "kinds", "at"])

    return rows


def _search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by task, evaluation records first."""
    task, pending, index, held = None, [], None, None
    for pdf in batches:
        edges = np.flatnonzero(np.diff(pdf["task"].to_numpy() * 2 + pdf.side.to_numpy())) + 1
        for a, b in zip([0, *edges], [*edges, len(pdf)]):
            part = pdf.iloc[a:b]
            if not len(part):
                continue
            if part["task"].iat[0] != task:
                task, pending, index, held = part["task"].iat[0], [], None, None
            if part.side.iat[0] == 0:
                pending.append(part)
                continue
            if not pending:
                continue
            if index is None:
                y = pd.concat(pending)
                pending = [y.iloc[:0]]
                words = [np.frombuffer(v, np.uint64) for v in y.symbols]
                marks = [np.zeros(len(w), np.int64) for w in words]
                for m, at, kinds in zip(marks, y["at"], y["kinds"]):
                    np.bitwise_or.at(m, np.frombuffer(at, np.int32), 1 << np.frombuffer(kinds, np.uint8).astype(np.int64))
                index, held = BackwardIndex(words, marks), y["class"].to_numpy()
            yield from _matches(part, index, held)


#: The marks under which the index holds a word that is a key of each kind there.
MARKS = ((1, 3), (2, 3), (4,))
#: Occurrences that are followed at a time.
_OCCURRENCES = 400_000


def _matches(part: pd.DataFrame, index: BackwardIndex, held) -> Iterator[pd.DataFrame]:
    """Pairs of the training records ``part`` with those of the index."""
    xs = [np.frombuffer(v, np.uint64) for v in part.symbols]
    at, kinds = [np.frombuffer(a, np.int32) for a in part["at"]], [np.frombuffer(k, np.uint8) for k in part["kinds"]]
    row = np.repeat(np.arange(len(part)), [len(k) for k in kinds])
    at, kinds = np.concatenate(at).astype(np.int64), np.concatenate(kinds)
    size = np.array([len(x) for x in xs])
    begin = np.cumsum(size) - size
    flat = np.concatenate(xs)
    words = flat[begin[row] + at]
    asked = [(row[kinds == k], at[kinds == k], index.signs(words[kinds == k], m)) for k, marks in enumerate(MARKS) for m in marks]
    row, at, sign = (np.concatenate(v) for v in zip(*asked))
    known = sign >= 0
    order = np.flatnonzero(known)[np.lexsort((at[known], row[known]))]  # all keys of a row stay together
    row, at, sign = row[order], at[order], sign[order]
    if not len(row):
        return
    lo, hi = index.extend(sign, np.zeros(len(sign), np.int64), np.full(len(sign), index.n))
    # x's words by number, to see whether a word that the index spells out is one of them, and where
    number = index.words(flat)
    of = np.repeat(np.arange(len(xs)), size)
    n_words = len(index.alphabet) + 1
    held_at = np.flatnonzero(number >= 0)
    table = of[held_at] * n_words + number[held_at]
    by = np.argsort(table, kind="stable")
    table, place = table[by], (held_at - begin[of[held_at]])[by]
    ends = np.cumsum(hi - lo)
    bounds = np.searchsorted(ends, np.arange(_OCCURRENCES, ends[-1], _OCCURRENCES))
    starts = np.searchsorted(row, row[bounds], "left") if len(bounds) else bounds
    for chunk in np.split(np.arange(len(row)), np.unique(starts[starts > 0])):
        if len(chunk):
            out = _follow(part["class"].to_numpy(), size, row[chunk], at[chunk], lo[chunk], hi[chunk], index, held, (table, place, n_words))
            if len(out):
                yield out


def _follow(x_class, size, row, at, lo, hi, index: BackwardIndex, y_class, words) -> pd.DataFrame:
    """Pairs of the threshold among the occurrences lo..hi of the keys of training rows."""
    count = hi - lo
    x, p = np.repeat(row, count), np.repeat(at, count)
    suffix = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
    y, q = index.locate(suffix)
    nx, ny = size[x], index.sizes[y]
    # lengths that can agree, and words before the keys that then can't be common
    fits = (nx * DEN >= NUM * ny) & (ny * DEN >= NUM * nx) & ((p + q) * NUM <= (DEN - NUM) * np.minimum(nx - p, ny - q))
    order = np.flatnonzero(fits)
    order = order[np.lexsort((p[order], y[order], x[order]))]
    one = np.ones(len(order), bool)
    one[1:] = (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])
    pick = order[one]  # the earliest key of each pair
    x, p, y, nx, ny = x[pick], p[pick], y[pick], nx[pick], ny[pick]
    if not len(x):
        return pd.DataFrame()

    table, place, n_words = words
    need = -(-NUM * (nx + ny) // (NUM + DEN))  # common words at the threshold
    common, spans, longest, run = (np.zeros(len(x), np.int64) for _ in range(4))
    earliest, last = np.full(len(x), -1), np.full(len(x), -2)
    live, here, depth = np.arange(len(x)), y.copy(), 0
    while len(live):
        sign, here = index.step(here)
        wanted = x[live] * n_words + index.word_of[sign]
        i = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
        same = table[i] == wanted
        hit, pos = live[same], place[i[same]]
        goes_on = pos == last[hit] + 1  # the maximal match grows by a word; else another one begins
        run[hit] = np.where(goes_on, run[hit] + 1, 1)
        spans[hit] += ~goes_on
        common[hit] += 1
        longest[hit] = np.maximum(longest[hit], run[hit])
        earliest[hit] = np.where(earliest[hit] < 0, pos, earliest[hit])
        last[live[~same]] = -2
        last[hit] = pos
        depth += 1
        more = (depth < ny[live]) & (common[live] + ny[live] - depth >= need[live])
        live, here = live[more], here[more]
    ok = (common >= need) & (earliest == p)
    return pd.DataFrame(
        {"x": x_class[x[ok]], "y": y_class[y[ok]], "n_common": common[ok], "n_either": (nx + ny - common)[ok], "n_spans": spans[ok], "longest_run": longest[ok]}
    )


class Side(NamedTuple):
    """The members (class, sample_id) of a side, and the rows (class, n) of each class."""

    members: DataFrame
    sizes: DataFrame


def class_matches(records: DataFrame) -> tuple[DataFrame, Side, Side]:
    """Matches (x, y, n_common, n_either, n_spans, longest_run) of training class x and evaluation
    class y, and either side."""
    spark = records.sparkSession
    broadcast = spark.sparkContext.broadcast
    held, train = records.filter("split <> 'train'"), records.filter("split = 'train'")
    sketch = broadcast(word_sketch(held))
    eval_rows = cut(symbol_rows(held, sketch, None, True))
    keys_each = 9  # keys of a record of usual length; only the filter's size hangs on it
    of_eval = key_filter(eval_rows, True, keys_each * eval_rows.count())
    train_rows = cut(symbol_rows(train, sketch, broadcast(of_eval), False))
    bits = broadcast(key_filter(train_rows, False, keys_each * train_rows.count(), of_eval))
    one = lambda rows: cut(rows.groupBy("class").agg(F.min("symbols").alias("symbols"), F.count("*").alias("n")))
    held_classes, train_classes = one(eval_rows), one(train_rows)
    keys = held_classes.select("symbols").mapInPandas(_key_rows(bits), "key long").groupBy("key").agg(F.count("*").alias("n"))
    total, most = keys.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    hot = {}
    if most > KEY_ENTRIES:  # at most total / KEY_ENTRIES of them
        hot = {r.key: -(-r.n // KEY_ENTRIES) for r in keys.filter(F.col("n") > KEY_ENTRIES).collect()}
    hot = broadcast(hot)
    shards = max(1, -(-total // SHARD_ENTRIES))
    loads = train_classes.select("class", "symbols").mapInPandas(_loads(bits, hot, shards), "shard long, n long").groupBy("shard").agg(F.sum("n").alias("n"))
    split, tasks = {}, shards
    for r in loads.filter(F.col("n") > SHARD_RECORDS).orderBy("shard").collect():  # at most a shard for SHARD_RECORDS routed records
        more = -(-r.n // SHARD_RECORDS) - 1
        split[r.shard] = (r.shard, *range(tasks, tasks + more))
        tasks += more
    split = broadcast(split)
    shape = "task long, side int, class binary, symbols binary, kinds binary, at binary"
    y = held_classes.select("class", "symbols").mapInPandas(_routed(True, bits, hot, shards, split), shape)
    x = train_classes.select("class", "symbols").mapInPandas(_routed(False, bits, hot, shards, split), shape)
    found = (
        y.unionByName(x)
        .repartitionById(tasks, F.col("task").cast("int"))
        .sortWithinPartitions("task", "side")
        .mapInPandas(_search, "x binary, y binary, n_common long, n_either long, n_spans long, longest_run long")
    )
    member = lambda rows: rows.select("class", "sample_id").distinct()
    return cut(found), Side(member(train_rows), train_classes.select("class", "n")), Side(member(eval_rows), held_classes.select("class", "n"))


def pairs(records: DataFrame) -> DataFrame:
    """train_id, eval_id, n_common, n_either, n_spans, longest_run of all pairs of a training and an
    evaluation record with the same non-empty bare answer whose questions share at least
    NUM/DEN of their distinct words. Questions without words match nothing."""
    found, train, held = class_matches(records)
    both = expanded(expanded(found, train.members.toDF("x", "train_id"), "x", train.sizes), held.members.toDF("y", "eval_id"), "y", held.sizes)
    return both.select("train_id", "eval_id", "n_common", "n_either", "n_spans", "longest_run")


def report(records: DataFrame) -> DataFrame:
    """Per split and source of the evaluation record: n_records, n_overlapping, n_same (equal
    words), n_pairs and longest_run. Every group of evaluation records has a row. Copies are
    counted by the sizes of their classes, not paired. A sample_id delivered with several texts
    is counted once in the first three, and its pairs with each text."""
    group = ["split", "source"]
    of = lambda c: [F.regexp_extract(c, SPLIT, 2).alias("split"), F.regexp_extract(c, SPLIT, 1).alias("source")]
    all_ = records.filter("split <> 'train'").groupBy(*group).agg(F.countDistinct("sample_id").alias("n_records"))
    found, train, held = class_matches(records)
    size = train.members.groupBy(F.col("class").alias("x")).agg(F.count("*").alias("n"))
    of_class = (
        found.join(size, "x")
        .groupBy(F.col("y").alias("class"))
        .agg(F.sum("n").alias("n"), F.max(F.col("n_common") == F.col("n_either")).alias("same"), F.max("longest_run").alias("run"))
    )
    hits = (
        held.members.join(of_class, "class")
        .groupBy("sample_id")
        .agg(F.sum("n").alias("n"), F.max("same").alias("same"), F.max("run").alias("run"))
        .select(*of("sample_id"), "*")
        .groupBy(*group)
        .agg(F.count("*").alias("n_overlapping"), F.sum(F.col("same").cast("long")).alias("n_same"), F.sum("n").alias("n_pairs"), F.max("run").alias("longest_run"))
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return all_.join(hits, group, "left").select(*group, "n_records", *[zero(c) for c in ("n_overlapping", "n_same", "n_pairs", "longest_run")])
