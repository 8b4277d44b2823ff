"""Language identification with word-first backoff.

A word that the model knows is scored by its log frequency in each language. A
word that it doesn't know is scored by character n-grams: at each letter the
longest known n-gram, from ``LONGEST`` letters down to one. Frequencies are
learned from labelled training rows: a sample of about ``MAX_ROWS`` rows a language
in expectation, drawn by a hash of each row. That bound is a parameter, and the only
one: every word and n-gram of the sample is learned, and prediction reads every
whole text.

The model is three sorted arrays. Terms stand in it as 64-bit hashes, so that it
takes some 20 bytes for each pair of a term and a language that has it; two of ten
million terms share a hash with a probability under 1e-5.

Defined results: a letter is what ``str.isalpha`` says (other numbers than digits are none),
and marks belong to the word they stand in; a null text, or one without a letter, is
``und`` with score 0, as is everything where nothing could be learned or the table is empty of labelled rows;
null languages teach nothing; ties go to the language that sorts first; repeated rows
get equal results; a text of any length is read whole; an empty table gives an empty
result; only doc_id, text and (to learn) lang are read, so further columns may have
any names.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from citewell import ship
from citewell.llm.common import discard, documents, durable

UNKNOWN = "und"
LONGEST = 4
MAX_ROWS = 4000
#: Count given to a term that a language has not shown.
FLOOR = 0.5
#: Words, and starts of n-grams, that a worker remembers.
CACHED = 1 << 17
#: Up to so many languages, their shares are sent to every task; beyond, they are joined.
MANY = 10_000


def _ranges(test: Callable[[str], bool]) -> str:
    """A class's inside: the characters that pass, as ranges."""
    passing = [k for k in range(sys.maxunicode + 1) if test(chr(k))]
    starts = [k for k, before in zip(passing, [-2, *passing], strict=False) if k != before + 1]
    ends = [k for k, after in zip(passing, [*passing[1:], -2], strict=True) if k != after - 1]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends, strict=True))


@cache
def _word() -> re.Pattern:
    """A letter and what letters and marks follow it. A letter is what ``str.isalpha`` says, so
    numbers that are no digits are none; marks that write vowels stay in their word."""
    letter = _ranges(str.isalpha)
    mark = _ranges(lambda c: unicodedata.category(c)[0] == "M")
    return re.compile(f"[{letter}][{letter}{mark}]*")


#: What takes more than the pattern of Latin texts, which have no marks and six numbers
#: that are no digits; general punctuation takes no more.
BEYOND = re.compile("[^\x00-\u024f\u2000-\u206f]")
LATIN = re.compile(r"[^\W\d_²³¹¼½¾]+")


def words_of(text: str) -> list[str]:
    low = text.lower()
    return (_word() if BEYOND.search(low) else LATIN).findall(low)


def grams_of(word: str) -> Iterator[str]:
    """Every n-gram of a word between its marks."""
    marked = f"<{word}>"
    for n in range(1, LONGEST + 1):
        for k in range(len(marked) - n + 1):
            yield marked[k : k + n]


def hash_of(kind: int, term: str) -> int:
    """Unsigned; words (kind 0) and n-grams (their length) hash apart."""
    return xxh64_intdigest(term.encode(), bool(kind))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3 == 1


def sample(labelled: DataFrame, most: int, many: int = MANY) -> DataFrame:
    """lang and text of about ``most`` rows a language, fewer where it has fewer."""
    share = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("lang").alias("_lang"), (F.lit(float(most)) / F.col("n")).alias("share")
    )
    few = share.limit(many + 1).collect()
    if len(few) <= many:  # the draw is then a filter on the scan: no text is shuffled
        share = F.broadcast(labelled.sparkSession.createDataFrame(few, share.schema))
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return labelled.join(share, F.col("lang") == F.col("_lang")).where(draw < F.col("share")).select("lang", "text")


def term_counts(rows: DataFrame) -> DataFrame:
    """hash (signed), kind (0: word, else length of n-gram), lang, n; counted batch by
    batch before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, Counter] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                by.setdefault(lang, Counter()).update(words_of(text.as_py()))
            for lang, words in by.items():
                grams = Counter()
                for word, n in words.items():
                    for gram in grams_of(word):
                        grams[gram] += n
                terms = [(0, w) for w in words] + [(len(g), g) for g in grams]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.array([hash_of(*t) for t in terms], dtype=np.uint64).view(np.int64)),
                        pa.array([k for k, _ in terms], pa.int32()),
                        pa.array([lang] * len(terms), pa.string()),
                        pa.array([*words.values(), *grams.values()], pa.int64()),
                    ],
                    ["hash", "kind", "lang", "n"],
                )

    ship()
    counted = rows.mapInArrow(run, "hash bigint, kind int, lang string, n bigint")
    return counted.groupBy("hash", "kind", "lang").agg(F.sum("n").alias("n"))


class Model:
    """Log frequencies of terms: what a language shows beyond the floor, in arrays."""

    def __init__(self, langs: list[str], totals: np.ndarray, hashes: np.ndarray, kinds: np.ndarray, which: np.ndarray, n: np.ndarray):
        """``totals`` counts terms by kind and language; the rest, one entry for each
        term and language, are its hash, kind, the language's place and its count."""
        self.langs = langs
        # A term counts by its share of its language, so that a language with more
        # training text has no head start.
        self.floor = np.log(FLOOR / (totals + 1.0))
        order = np.lexsort((which, hashes))
        hashes = hashes[order]
        self.keys, first = np.unique(hashes, return_index=True)
        self.ptr = np.append(first, len(hashes))
        self.kinds = kinds[order][first].astype(np.int8)
        self.which = which[order].astype(np.int32)
        self.more = np.log1p(n[order] / FLOOR).astype(np.float32)
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.cache = np.zeros((0, len(self.langs)))
        self.starts: dict[str, int] = {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("slots", "cache", "starts")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._forget()

    def place(self, terms: list[tuple[int, str]]) -> np.ndarray:
        """The row of each term, -1 where it isn't known."""
        if not terms or not len(self.keys):
            return np.full(len(terms), -1)
        hashes = np.array([hash_of(*t) for t in terms], dtype=np.uint64)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, at, -1)

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        """Log frequencies of known terms, a column per language."""
        out = self.floor[self.kinds[rows]]
        sizes = self.ptr[rows + 1] - self.ptr[rows]
        entry = np.arange(sizes.sum()) + np.repeat(self.ptr[rows] - (np.cumsum(sizes) - sizes), sizes)
        out[np.repeat(np.arange(len(rows)), sizes), self.which[entry]] += self.more[entry]
        return out

    def longest(self, starts: list[str]) -> np.ndarray:
        """The row of the longest known n-gram that each of ``starts`` (of up to
        ``LONGEST`` letters) begins with, or -1."""
        new = [s for s in dict.fromkeys(starts) if s not in self.starts]
        if len(self.starts) + len(new) > CACHED:
            self.starts.clear()
            new = list(dict.fromkeys(starts))
        best = np.full(len(new), -1)
        for n in range(LONGEST, 0, -1):
            open_ = [k for k in np.flatnonzero(best < 0).tolist() if len(new[k]) >= n]
            best[open_] = self.place([(n, new[k][:n]) for k in open_])
        self.starts.update(zip(new, best.tolist(), strict=True))
        return np.array([self.starts[s] for s in starts], dtype=np.int64)

    def scores(self, words: list[str]) -> np.ndarray:
        """A row per word: its log frequencies, or the mean of its n-grams', or zeros."""
        out = np.zeros((len(words), len(self.langs)))
        at = self.place([(0, w) for w in words])
        known, unseen = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
        out[known] = self.vectors(at[known])
        marked = [f"<{words[k]}>" for k in unseen.tolist()]
        rows = self.longest([m[k : k + LONGEST] for m in marked for k in range(len(m))])
        owners = np.repeat(unseen, np.array([len(m) for m in marked], dtype=np.int64))[rows >= 0]
        np.add.at(out, owners, self.vectors(rows[rows >= 0]))
        out[unseen] /= np.maximum(np.bincount(owners, minlength=len(words))[unseen], 1)[:, None]
        return out

    def remembered(self, words: list[str]) -> np.ndarray:
        """``scores`` of words that mostly came before."""
        new = [w for w in words if w not in self.slots]
        if len(self.slots) + len(new) > CACHED:
            self._forget()
            new = words
        if new:
            need = len(self.slots) + len(new)
            if need > len(self.cache):
                wider = np.zeros((min(max(2 * len(self.cache), need, 1024), max(CACHED, need)), len(self.langs)))
                wider[: len(self.slots)] = self.cache[: len(self.slots)]
                self.cache = wider
            self.cache[len(self.slots) : need] = self.scores(new)
            self.slots.update(zip(new, range(len(self.slots), need), strict=True))
        return self.cache[[self.slots[w] for w in words]]

    def predict(self, text: str | None) -> tuple[str, float]:
        """Each word weighs one, shared among its n-grams if it is unseen."""
        words = Counter(words_of(text or ""))
        if not words or not self.langs:
            return UNKNOWN, 0.0
        every, counts, total = list(words), np.array(list(words.values()), dtype=np.float64), np.zeros(len(self.langs))
        for k in range(0, len(every), CACHED):
            total += counts[k : k + CACHED] @ self.remembered(every[k : k + CACHED])
        best = int(np.argmax(total))
        return self.langs[best], float(1 / np.exp(np.maximum(total - total[best], -700.0)).sum())


def fit(labelled: DataFrame, most_rows: int = MAX_ROWS) -> Model:
    """From rows with doc_id, lang and text. What comes to the driver are the terms of
    the sample, as hashes with their counts."""
    labelled = labelled.select("doc_id", "lang", "text").where("lang IS NOT NULL AND text IS NOT NULL")
    counts = durable(term_counts(sample(labelled, most_rows)), "langid-terms")
    found = counts.toArrow()
    langs = sorted(set(found["lang"].unique().to_pylist()))
    place = {g: k for k, g in enumerate(langs)}
    coded = found["lang"].combine_chunks().dictionary_encode()
    which = np.array([place[g] for g in coded.dictionary.to_pylist()], dtype=np.int64)[coded.indices.to_numpy()] if langs else np.zeros(0, dtype=np.int64)
    hashes, kinds, n = (found[c].to_numpy() for c in ("hash", "kind", "n"))
    totals = np.zeros((LONGEST + 1, len(langs)))
    np.add.at(totals, (kinds, which), n)
    discard(counts)
    return Model(langs, totals, hashes.astype(np.int64).view(np.uint64), kinds, which, n)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score. The model is as large as its sample makes it."""
    ship()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            found = [own.predict(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    train = docs.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(False))).select("doc_id", "lang", "text")
    found = predict(docs, fit(train))
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
