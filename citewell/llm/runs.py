"""Maximal runs of repeated words, by longest previous factors.

A document's words are numbered, and its suffixes sorted by doubling: the ranks of all
prefixes of 1, 2, 4, ... words are kept, and the common prefix of any two suffixes is
read from them. Suffix array and LCP give each word's longest previous factor (the
longest stretch from there that also begins earlier), and walking these cuts the words
into the blocks of Lempel and Ziv. A run that touches the border of two blocks is found
by extending every period that their lengths allow in both directions; a run strictly
inside a block is the copy of one that begins earlier, and is taken from there.

With ``times`` repetitions asked for, a run that ends in block h begins less than a
period before block h - 1, so periods go up to (|h - 1| + |h| - 1) / (times - 1).

Sorting, ranks and extensions are array operations over the words of many documents
at once; documents never share a rank. Rows stay where they are: no shuffle.

Defined results: a null text has no words, one without words no runs; repeated rows
get equal results; a null doc_id plants nothing (see ``planted``); a text of any
length is read whole, by one task, in memory that grows with its words; an empty table
gives an empty result; only doc_id and text are read, so further columns may have any
names.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right, insort
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citewell import ship
from citewell.llm.common import documents

#: A run has at least so many words, and so many times its period.
LEAST, TIMES = 6, 4
#: Words that are sorted together.
BATCH_WORDS = 1 << 18

Run = tuple[int, int, int]  # start, length, period


class Ranks:
    """Ranks of the prefixes of 1, 2, 4, ... items of every suffix. ``ends`` has, for
    each item, where its document ends; a document's items are next to each other, and
    documents in order have ascending suffix ranks."""

    def __init__(self, items: np.ndarray, ends: np.ndarray):
        n = len(items)
        self.ends, self.levels = ends, []
        # Items of different documents are told apart, and documents stay in order.
        self.order = np.lexsort((items, ends))
        place = np.arange(n)
        apart = np.ones(n, dtype=bool)
        apart[1:] = (items[self.order[1:]] != items[self.order[:-1]]) | (ends[self.order[1:]] != ends[self.order[:-1]])
        rank = np.empty(n, dtype=np.int64)
        rank[self.order] = np.maximum.accumulate(np.where(apart, place, 0))
        step = 1
        while True:
            self.levels.append(rank.astype(np.int32 if n < 1 << 31 else np.int64))
            alone = np.append(apart[1:], True) & apart
            slots = np.flatnonzero(~alone)
            if not len(slots):
                break
            # Only what is still tied is sorted again, each group within its slots.
            tied = self.order[slots]
            after = tied + step
            inside = after < ends[tied]
            second = np.where(inside, rank[np.where(inside, after, 0)] + 1, 0)
            key = rank[tied] * (n + 1) + second
            turn = np.argsort(key, kind="stable")
            tied, key = tied[turn], key[turn]
            self.order[slots] = tied
            first = np.ones(len(slots), dtype=bool)
            first[1:] = key[1:] != key[:-1]
            rank[tied] = np.maximum.accumulate(np.where(first, slots, 0))
            apart[slots] = first
            step *= 2

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The common prefix of the suffixes at ``a`` and ``b``, pair by pair, within
        their document; a place at the end of a document has an empty suffix."""
        length = np.zeros(len(a), dtype=np.int64)
        live = np.flatnonzero((a >= 0) & (b >= 0))
        end = np.minimum(self.ends[a[live]] if len(live) else 0, self.ends[b[live]] if len(live) else 0)
        for k in range(len(self.levels) - 1, -1, -1):
            i, j = a[live] + length[live], b[live] + length[live]
            inside = (i < end) & (j < end)
            same = inside.copy()
            same[inside] = self.levels[k][i[inside]] == self.levels[k][j[inside]]
            length[live[same]] += 1 << k
        return length


def previous_factors(ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """For each item, the length of its longest previous factor and where that begins (-1: none).

    Items leave the suffix order from the last to the first; the neighbours that an item
    has when it leaves all begin before it, and the better one is its factor. Suffixes that
    share no item with a neighbour have none, and are left out from the start.
    """
    n, order = len(ranks.order), ranks.order
    factor, source = np.zeros(n, dtype=np.int64), np.full(n, -1, dtype=np.int64)
    first = ranks.levels[0]
    near = np.flatnonzero(first[order[1:]] == first[order[:-1]]) + 1  # slots alike to the one before
    if not len(near):
        return factor, source
    held = np.union1d(near, near - 1)
    lcp = np.zeros(len(held) + 1, dtype=np.int64)
    lcp[np.searchsorted(held, near)] = ranks.common(order[near - 1], order[near])
    at = order[held]
    slot_of = np.argsort(-at, kind="stable").tolist()  # by place, the last first
    where, high = at.tolist(), lcp.tolist()
    up, down = list(range(-1, len(held) - 1)), list(range(1, len(held) + 1))
    lengths, sources = [0] * len(held), [-1] * len(held)
    down.append(0)
    up.append(len(held) - 1)
    for s in slot_of:
        below, a, b = down[s], high[s], high[down[s]]
        if a >= b:
            lengths[s] = a
            if a:
                sources[s] = where[up[s]]
            high[below] = b
        else:
            lengths[s], sources[s] = b, where[below]
            high[below] = a
        down[up[s]], up[below] = below, up[s]
    factor[at], source[at] = lengths, sources
    return factor, source


def blocks(start: int, end: int, factor: list[int]) -> list[int]:
    """Where the blocks of a document begin, and its end."""
    cuts, at = [], start
    while at < end:
        cuts.append(at)
        at += factor[at] or 1
    cuts.append(end)
    return cuts


def _touching(items: np.ndarray, cuts: dict[int, list[int]], least: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    """Borders and periods to be tried: those that the lengths of two blocks allow and
    where a word next to the border is found again a period away."""
    borders, periods = [], []
    for c in cuts.values():
        at = np.array(c, dtype=np.int64)
        size = np.append(np.diff(at), 0)
        room = size[1:] + size[:-1]  # of the blocks before and behind at[1:]
        most = (room - 1) // (times - 1)
        good = np.flatnonzero(most > 0)
        # A run is shorter than the blocks and a period together.
        fits = room[good] + most[good] - 1 >= least
        for k in good[fits].tolist():
            b, p = int(at[k + 1]), np.arange(1, int(most[k]) + 1)
            first, end = c[0], c[-1]
            after, before = b + p < end, b - p >= first
            hit = np.zeros(len(p), dtype=bool)
            if b < end:
                hit[after] |= items[b + p[after]] == items[b]
                hit[before] |= items[b - p[before]] == items[b]
            over = b - 1 + p < end
            hit[over] |= items[b - 1 + p[over]] == items[b - 1]
            over = b - 1 - p >= first
            hit[over] |= items[b - 1 - p[over]] == items[b - 1]
            borders.append(np.full(int(hit.sum()), b))
            periods.append(p[hit])
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *borders]), np.concatenate([none, *periods])


def _extended(items: np.ndarray, ends: np.ndarray, starts: np.ndarray, ahead: Ranks, border: np.ndarray, period: np.ndarray):
    """start, end (exclusive) and period of the stretches around each border that keep
    the period and have a whole period right or left of it."""
    # Backward extensions are forward ones of the reversed documents that are concerned.
    top = np.where(border < len(items), border, len(items) - 1)
    first = np.where((border > starts[top]) & (border < len(items)), starts[top], starts[border - 1])
    end = ends[first]
    docs = np.unique(first)
    size = ends[docs] - docs
    offset = np.concatenate([[0], np.cumsum(size)])
    back = np.concatenate([items[d:e][::-1] for d, e in zip(docs, ends[docs], strict=True)])
    behind = Ranks(back, np.repeat(offset[1:], size))
    base = offset[np.searchsorted(docs, first)]
    mirror = lambda x: np.where(x >= first, base + (end - 1 - x), -1)
    found = []
    for left in (border, border - period):  # a period right of the border, or left of it
        right = left + period
        ok = (left >= first) & (right <= end)
        a, b, f, e, p = left[ok], right[ok], first[ok], end[ok], period[ok]
        forward = np.zeros(len(a), dtype=np.int64)
        live = b < e
        forward[live] = ahead.common(a[live], b[live])
        backward = behind.common(mirror(left - 1)[ok], mirror(right - 1)[ok])
        backward[a == f] = 0
        found.append(np.stack([a - backward, b + forward, p], axis=1))
    return np.concatenate(found)


def _copied(runs: dict[int, list[tuple[int, int]]], cuts: list[int], source: np.ndarray, least: int) -> None:
    """Runs strictly inside a block are those strictly inside its source, further on.
    ``runs`` has (end, period) by start, and grows."""
    places = sorted(runs)
    for s, e in zip(cuts, cuts[1:], strict=False):
        if e - s < least + 2:
            continue
        j = int(source[s])
        shift, last = s - j, e - (s - j) - 1
        k = bisect_right(places, j)
        # Copies are filed behind what they are made of: a source that overlaps its
        # block takes up what has just been copied.
        while k < len(places) and places[k] < last:
            p = places[k]
            for end, q in list(runs[p]):
                to = (end + shift, q)
                if end <= last and to not in runs[p + shift]:
                    if not runs[p + shift]:
                        insort(places, p + shift)
                    runs[p + shift].append(to)
            k += 1


def all_runs(docs: list[np.ndarray], least: int = LEAST, times: int = TIMES) -> list[list[Run]]:
    """The runs of each document, given as arrays of numbers, by start and period."""
    sizes = np.array([len(d) for d in docs], dtype=np.int64)
    out: list[list[Run]] = [[] for _ in docs]
    if not sizes.sum():
        return out
    items = np.concatenate(docs)
    last = np.cumsum(sizes)
    ends, starts = np.repeat(last, sizes), np.repeat(last - sizes, sizes)
    ranks = Ranks(items, ends)
    factor, source = previous_factors(ranks)
    lengths = factor.tolist()
    cuts = {k: blocks(int(e - n), int(e), lengths) for k, (n, e) in enumerate(zip(sizes, last, strict=True)) if n >= least}
    border, period = _touching(items, cuts, least, times)
    if not len(border):
        return out
    found = _extended(items, ends, starts, ranks, border, period)
    length = found[:, 1] - found[:, 0]
    found = found[length >= np.maximum(least, times * found[:, 2])]
    # A stretch that was found with several periods has the smallest.
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    once = np.ones(len(found), dtype=bool)
    once[1:] = (found[1:, 0] != found[:-1, 0]) | (found[1:, 1] != found[:-1, 1])
    found = found[once]
    owner = np.searchsorted(last, found[:, 0], side="right")
    for k in np.unique(owner).tolist():
        runs: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for s, e, p in found[owner == k].tolist():
            runs[s].append((e, p))
        _copied(runs, cuts[k], source, least)
        first = int(last[k] - sizes[k])
        out[k] = sorted({(s - first, e - s, p) for s in runs for e, p in runs[s]}, key=lambda r: (r[0], r[2]))
    return out


def planted(words: list, doc_id: int | None) -> list:
    """The words with a stretch repeated to their end, in one document of ten by the
    hash of its id; the others, and those without an id, as they are."""
    n, hashed = len(words), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if hashed % 10 or not n:
        return words
    g = hashed // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that no run has behind its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [w for w, g in zip(words, np.cumsum(gone[:-1]).tolist(), strict=True) if not g]


def _numbered(words: list[bytes], codes: dict[bytes, int]) -> np.ndarray:
    return np.fromiter((codes.setdefault(w, len(codes)) for w in words), dtype=np.int64, count=len(words))


def document_runs(docs: DataFrame, change: Callable[[list, object], list] | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length, period in words, by start and period) and
    the collapsed text (words joined by blanks) of every row. ``change`` replaces the
    words of a row, given these and its doc_id."""

    def some(ids: list, words: list[list[bytes]]) -> pa.RecordBatch:
        codes: dict[bytes, int] = {}
        found = all_runs([_numbered(w, codes) for w in words])
        rows = [[{"start": s, "length": n, "period": p} for s, n, p in runs] for runs in found]
        texts = [b" ".join(collapsed(w, r)).decode() for w, r in zip(words, found, strict=True)]
        return pa.RecordBatch.from_arrays(
            [ids, pa.array([len(w) for w in words], pa.int64()), pa.array(rows, RUNS), pa.array(texts, pa.string())], NAMES
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, first, held, n = batch.column("doc_id"), 0, [], 0
            keys = ids.to_pylist()
            for k, text in enumerate(batch.column("text")):
                words = (text.as_py() or "").encode().split()  # bytes split at ASCII white space alone
                words = change(words, keys[k]) if change else words
                held.append(words)
                n += len(words)
                if n >= BATCH_WORDS or k + 1 == len(keys):
                    yield some(ids.slice(first, len(held)), held)
                    first, held, n = k + 1, [], 0

    ship()
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    )


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
NAMES = ["doc_id", "n_words", "runs", "collapsed"]


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = document_runs(documents(spark, sf_dir), planted)
    # The longest, of these the first, of these the one with the smallest period.
    key = F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p")))
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    best = rows.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.array_max(key).alias("b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    period = -F.col("b.p")
    return best.select(
        "doc_id", "n_runs", (-F.col("b.s")).alias("start"), F.col("b.length").alias("length"), period.alias("period"),
        F.floor(1000 * F.col("b.length") / period).cast("bigint").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
