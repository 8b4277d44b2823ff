"""Token counts by a tokenizer, attached to rows as arrays.

A tokenizer is named in the settings: ``pieces:<n>`` is a rule (a word has one token for every
started group of n characters), ``sentencepiece:<path>`` and ``wordpiece:<path>`` load a
model or a tokenizer file that every worker can read; ``register`` adds others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citewell import ship
from citewell.config import Settings
from citewell.errors import ConfigError
from citewell.functions.text import count_tokens, normalize_ws

#: Tokens of each of some words.
Count = Callable[[list[str]], list[int]]
#: Words whose counts a worker remembers.
REMEMBERED = 1 << 17
#: Rows whose words a worker holds as arrays at a time; strings are made of distinct words only.
ROWS = 256


def _rule(size: str) -> Count:
    n = int(size)
    return lambda words: [-(-len(w) // n) for w in words]


def _sentencepiece(path: str) -> Count:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda words: [len(ids) for ids in model.encode(words)]


def _wordpiece(path: str) -> Count:
    import tokenizers

    model = tokenizers.Tokenizer.from_file(path)
    return lambda words: [len(e.ids) for e in model.encode_batch(words, add_special_tokens=False)]


LOADERS: dict[str, Callable[[str], Count]] = {"pieces": _rule, "sentencepiece": _sentencepiece, "wordpiece": _wordpiece}


def register(kind: str, load: Callable[[str], Count]) -> None:
    """``load`` is called once in each worker, with what follows the colon of the name."""
    LOADERS[kind] = load


def loader(name: str) -> Callable[[], Count]:
    kind, _, rest = name.partition(":")
    if kind not in LOADERS:
        raise ConfigError(f"no tokenizer of kind {kind!r}; there are {', '.join(sorted(LOADERS))}")
    load = LOADERS[kind]
    return lambda: load(rest)


def _offsets(lists: pa.ListArray) -> pa.Array:
    """Where each list begins among all values, and the end; a null one is empty."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())


def counted(rows: DataFrame, words: Column, name: str, s: Settings) -> DataFrame:
    """``rows`` with the tokens of every word of ``words`` (array<array<string>>), in arrays of
    the same form. A worker counts a word once, as long as it remembers it."""
    load = loader(s.tokenizer)
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.ArrayType(T.ArrayType(T.IntegerType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, known = load(), {}
        for b in (whole.slice(a, ROWS) for whole in batches for a in range(0, whole.num_rows, ROWS)):
            lists = b.column("_words")
            inner = lists.flatten()
            coded = inner.flatten().dictionary_encode()
            words = coded.dictionary.to_pylist()
            if len(known) > REMEMBERED:
                known.clear()
            new = sorted(set(words) - known.keys())
            known.update(zip(new, count(new) if new else [], strict=True))
            sizes = np.array([known[w] for w in words], dtype=np.int32)[coded.indices.to_numpy()]
            out = pa.ListArray.from_arrays(_offsets(inner), pa.array(sizes, pa.int32()))
            out = pa.ListArray.from_arrays(_offsets(lists), out, mask=lists.is_null())
            rest = b.drop_columns(["_words"])
            yield pa.RecordBatch.from_arrays([*rest.columns, out], [*rest.schema.names, name])

    ship()
    return rows.withColumn("_words", words).mapInArrow(run, schema)



def sized(rows: DataFrame, text: str, name: str, s: Settings) -> DataFrame:
    """``rows`` with the tokens of a text, counted or estimated as the settings say."""
    if not s.tokens_are_exact:
        return rows.withColumn(name, count_tokens(text, s.chars_per_token))
    words = F.filter(F.split(normalize_ws(text), " ", -1), lambda w: w != "")
    made = counted(rows, F.array(words), "_each", s)
    return made.withColumn(name, F.aggregate(F.get("_each", F.lit(0)), F.lit(0), lambda acc, n: acc + n)).drop("_each")
