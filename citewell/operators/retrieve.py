"""Retrieval: scheme filter, exact nearest neighbours, threshold, section dedupe,
maximal marginal relevance.

Questions are the small side. They go out in blocks of checked size, one at a time: a
single block is part of the plan; of several, each is searched and its few results
stored before the next is fetched, so the driver never holds two. Workers multiply
tiles of bounded size and keep each question's best rows over their whole partition:
what is shuffled is a few rows per task and question, whatever the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citewell import ship
from citewell.config import Settings
from citewell.errors import CorpusEmptyError
from citewell.functions.text import let, normalize_url, strip_context_header
from citewell.operators.encode import dot
from citewell.operators.store import checkpointed

#: Bytes of question vectors sent to the workers at a time, and of a tile of products.
BLOCK_BYTES = 32 << 20
TILE_BYTES = 16 << 20
#: Aliases that are folded into patterns; more are joined.
FEW = 256


def resolve_scheme(questions: DataFrame, aliases: DataFrame, query: str = "query", few: int = FEW) -> DataFrame:
    """``questions`` with scheme_id where the aliases in the question name exactly
    one scheme, else null.

    ``aliases`` (scheme_id, alias) is a manifest. Up to ``few`` of them become one
    pattern per scheme, and nothing is joined. Longer lists are looked up by word: an
    alias meets the questions that have its first word, and only then is it searched.
    """
    named = aliases.where("alias <> '' AND scheme_id IS NOT NULL").select("scheme_id", F.lower("alias").alias("alias")).distinct()
    text = F.lower(F.coalesce(F.col(query), F.lit("")))
    found = named.limit(few + 1).collect()
    if len(found) > few:
        return _looked_up(questions, named, text)
    by: dict[str, list[str]] = {}
    for r in found:
        by.setdefault(r.scheme_id, []).append(r.alias)
    quote = lambda a: r"\Q" + a.replace(r"\E", r"\E\\E\Q") + r"\E"
    hits = [F.when(text.rlike(r"(?U)(?<!\w)(?:" + "|".join(map(quote, sorted(by[s]))) + r")(?!\w)"), F.lit(s)) for s in sorted(by)]
    found = F.filter(F.array(*hits), lambda s: s.isNotNull()) if hits else F.array().cast("array<string>")
    return questions.withColumn("scheme_id", let(found, lambda f: F.when(F.size(f) == 1, F.get(f, F.lit(0)))))


#: Words of aliases, and aliases, that are sent to all workers; more are joined by shuffles.
SENT = 1 << 18


def _looked_up(questions: DataFrame, named: DataFrame, text: Column) -> DataFrame:
    """By an equality join: an alias is filed under the one of its words that the fewest
    questions have, so a word that many have ("the") draws none but those that have no other. An
    alias without a word is filed under its rarest character. A question is known by the hash
    of its text; no text is shuffled once for each of its words. Up to ``SENT`` words and
    aliases go out to the workers, and then only hits are shuffled."""
    words = lambda x: F.array_distinct(F.regexp_extract_all(x, F.lit(r"(?U)\w+"), F.lit(0)))
    others = lambda x: F.regexp_replace(x, r"(?U)\w+", "")
    signs = lambda x: F.array_distinct(F.filter(F.split(others(x), "(?s)(?!^)(?=.)", -1), lambda c: c != ""))
    place = F.sha2(text, 256)
    asked = questions.select(place.alias("_at"), text.alias("_text"))
    quoted = F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.replace("alias", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?!\w)"))
    named = named.withColumn("_words", words(F.col("alias"))).withColumn("_pattern", quoted)

    def hits(aliases: DataFrame, parts) -> DataFrame:
        keys = aliases.select("scheme_id", "_pattern", F.explode(parts(F.col("alias"))).alias("_key"))
        few = keys.limit(SENT + 1).count() <= SENT
        sent = F.broadcast if few else (lambda rows: rows)
        offered = asked.select("_at", *(["_text"] if few else []), F.explode(parts(F.col("_text"))).alias("_key"))
        often = offered.select("_key").join(sent(keys.select("_key").distinct()), "_key").groupBy("_key").agg(F.count(F.lit(1)).alias("_often"))
        # A key that no question has is the rarest: its alias is in none of them.
        rarest = keys.join(often, "_key", "left").groupBy("scheme_id", "_pattern").agg(F.min(F.struct(F.coalesce("_often", F.lit(0)).alias("n"), "_key")).alias("_r"))
        filed = rarest.where("_r.n > 0").select("scheme_id", "_pattern", F.col("_r._key").alias("_key"))
        met = offered.join(sent(filed), "_key")
        if not few:  # pairs of a hash and an alias, then the texts once
            met = met.join(asked.dropDuplicates(["_at"]), "_at")
        return met.where(F.call_function("rlike", F.col("_text"), F.col("_pattern"))).select("_at", "scheme_id")

    found = hits(named.where(F.size("_words") > 0), words)
    loose = named.where((F.size("_words") == 0) & (F.col("alias") != ""))
    if not loose.isEmpty():
        found = found.unionByName(hits(loose, signs))
    one = found.groupBy("_at").agg(F.min("scheme_id").alias("_least"), F.max("scheme_id").alias("_most")).where("_least = _most")
    joined = questions.withColumn("_at", place).join(one.select("_at", F.col("_least").alias("_scheme")), "_at", "left")
    return joined.withColumn("scheme_id", F.col("_scheme")).drop("_at", "_scheme")


def nearest(
    corpus: DataFrame,
    questions: DataFrame,
    n: int = Settings.over_fetch,
    *,
    key: str = "chunk_id",
    vector: str = "embedding",
    question: str = "query_id",
    question_vector: str = "embedding",
    filter_by: str | None = None,
    least: float | None = None,
    exclude_self: bool = False,
) -> DataFrame:
    """question, key, similarity, rank: the ``n`` rows of the corpus nearest to each
    question by dot product, ties by key.

    ``filter_by`` names a column of both sides; a question with a value there sees
    only rows with that value. ``least`` drops similarities under it.
    """
    ship()
    columns = [question, question_vector, *([filter_by] if filter_by else [])]
    # Held while they are counted and fetched: an encoder may be behind them.
    held = questions.select(*columns).persist()
    asked = held.where(F.col(question_vector).isNotNull())
    keys, kind = corpus.schema[key].dataType.simpleString(), questions.schema[question].dataType.simpleString()
    side = corpus.select(key, vector, *([filter_by] if filter_by else [])).where(F.col(vector).isNotNull())
    schema = f"{question} {kind}, {key} {keys}, similarity double"
    spark = corpus.sparkSession
    size = asked.select(F.count(F.lit(1)).alias("n"), F.max(F.size(question_vector)).alias("d")).first()
    blocks = -(-size.n * (size.d or 0) * 8 // BLOCK_BYTES)
    place = F.pmod(F.xxhash64(question, question_vector), F.lit(max(blocks, 1)))
    found = spark.createDataFrame([], schema)
    for k in range(blocks):
        sent = spark.sparkContext.broadcast((asked.where(place == k) if blocks > 1 else asked).toArrow())
        best = side.mapInArrow(_search(sent, n, key, vector, question, question_vector, filter_by, least, exclude_self), schema)
        if blocks > 1:
            best = checkpointed(best)
            sent.destroy()
        found = best if k == 0 else found.unionByName(best)
    held.unpersist()
    order = W.partitionBy(question).orderBy(F.col("similarity").desc(), key)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of numbers as rows; they must be equally long."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(array.offsets.to_numpy())
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError(f"vectors of {sizes.min()} to {sizes.max()} numbers in one column")
    flat = array.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(array), -1)


class Best:
    """The best rows of each question so far: similarities, and keys beside them."""

    def __init__(self, questions: int, n: int):
        self.n = n
        self.rows: list[list[tuple[float, object]]] = [[] for _ in range(questions)]
        #: What a row must reach to be among the best: the last of them, once there are n.
        self.floor = np.full(questions, -np.inf)

    def add(self, q: int, similar: np.ndarray, at: np.ndarray, keys: list) -> None:
        """Candidates at places ``at`` of a tile; ties with the last go by key."""
        if len(at) > self.n:  # all that tie with the n-th stay until they are sorted
            at = at[similar[at] >= np.partition(similar[at], len(at) - self.n)[len(at) - self.n]]
        both = self.rows[q] + [(-similar[k], keys[k]) for k in at.tolist()]
        both.sort()
        self.rows[q] = both[: self.n]
        if len(self.rows[q]) == self.n:
            self.floor[q] = -self.rows[q][-1][0]


def _search(sent, n, key, vector, question, question_vector, filter_by, least, exclude_self):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: pa.Table = sent.value
        wanted, ids = matrix(block[question_vector]), block[question].to_pylist()
        best, kind = Best(len(ids), n), None
        codes: dict = {}
        code = lambda values: np.array([-1 if v is None else codes.setdefault(v, len(codes)) for v in values])
        limits = code(block[filter_by].to_pylist()) if filter_by else None
        own_place = {k: i for i, k in enumerate(ids)} if exclude_self else {}
        if least is not None:
            best.floor[:] = least
        for batch in batches:
            if not batch.num_rows:
                continue
            kind, own, rows = batch.column(key).type, batch.column(key).to_pylist(), matrix(batch.column(vector))
            labels = code(batch.column(filter_by).to_pylist()) if filter_by else None
            step = max(1, TILE_BYTES // (8 * len(own)))
            selves = [(own_place[k], j) for j, k in enumerate(own) if k in own_place]
            for a in range(0, len(ids), step):
                tile = wanted[a : a + step] @ rows.T
                good = tile >= best.floor[a : a + step, None]
                if filter_by:
                    good &= (limits[a : a + step, None] == -1) | (limits[a : a + step, None] == labels[None, :])
                for q, j in selves:
                    if a <= q < a + step:
                        good[q - a, j] = False
                for q in np.flatnonzero(good.any(axis=1)).tolist():
                    best.add(a + q, tile[q], np.flatnonzero(good[q]), own)
        out = [(ids[q], k, -s) for q, found in enumerate(best.rows) for s, k in found]
        columns = list(zip(*out, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], block[question].type), pa.array(columns[1], kind or pa.null()), pa.array(columns[2], pa.float64())],
            [question, key, "similarity"],
        )

    return run


def similarity(distance: Column) -> Column:
    return F.lit(1.0) - distance.cast("double")


def threshold(candidates: DataFrame, least: float = Settings.min_similarity) -> DataFrame:
    """At the floor counts as above it."""
    return candidates.where(F.col("similarity") >= least)


def best_of_section(candidates: DataFrame, by: tuple[str, ...] = ("section",), question: str = "query_id") -> DataFrame:
    """The best candidate of each section; ``by`` may name the scheme as well."""
    order = W.partitionBy(question, *by).orderBy("rank")
    return candidates.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")


def first_k(candidates: DataFrame, k: int = Settings.top_k, question: str = "query_id") -> DataFrame:
    """Ranking without marginal relevance: the score stays null."""
    order = W.partitionBy(question).orderBy("rank")
    ranked = candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.withColumn("mmr_score", F.lit(None).cast("double"))


def mmr(candidates: DataFrame, k: int = Settings.top_k, lam: float = Settings.mmr_lambda, question: str = "query_id", vector: str = "body_embedding") -> DataFrame:
    """Candidates (a few per question) chosen one by one for similarity to the
    question and unlikeness to those chosen before; ties go to the better rank.

    The score is the one that chose the row; the first row's is its similarity, as
    are all scores where there are no more than ``k`` candidates.
    """
    columns = [c for c in candidates.columns if c not in (question, "rank", "mmr_score")]
    packed = candidates.groupBy(question).agg(
        F.sort_array(F.collect_list(F.struct("rank", *columns))).alias("c")
    )
    pairs = F.transform("c", lambda x: F.transform("c", lambda y: dot(x[vector], y[vector])))
    packed = packed.withColumn("pairs", F.when(F.size("c") > k, pairs))
    zero = F.struct(
        F.array(F.lit(0)).alias("chosen"), F.array(F.get(F.col("c"), F.lit(0))["similarity"]).alias("scores")
    )

    def step(acc: Column, _: Column) -> Column:
        def score(x: Column, i: Column) -> Column:
            alike = F.array_max(F.transform(acc["chosen"], lambda j: F.get(F.get(F.col("pairs"), i), j)))
            value = F.lit(lam) * x["similarity"] - F.lit(1.0 - lam) * alike
            return F.when(~F.array_contains(acc["chosen"], i), F.struct(value.alias("score"), (-i).alias("at")))

        best = F.array_max(F.transform("c", score))
        return let(
            best,
            lambda b: F.struct(
                F.concat(acc["chosen"], F.array(-b["at"])).alias("chosen"),
                F.concat(acc["scores"], F.array(b["score"])).alias("scores"),
            ),
        )

    folded = F.aggregate(F.sequence(F.lit(1), F.lit(max(k - 1, 1))), zero, step)
    if k <= 1:
        folded = zero
    picked = let(
        folded,
        lambda f: F.transform(f["chosen"], lambda i, p: F.struct(F.get(F.col("c"), i).alias("x"), F.get(f["scores"], p).alias("score"))),
    )
    every = F.transform("c", lambda x: F.struct(x.alias("x"), x["similarity"].alias("score")))
    rows = packed.select(question, F.posexplode(F.when(F.size("c") > k, picked).otherwise(every)).alias("at", "s"))
    return rows.select(
        question, *(F.col(f"s.x.{c}").alias(c) for c in columns), (F.col("at") + 1).alias("rank"), F.col("s.score").alias("mmr_score")
    )


def citation_url(source_url: str | Column) -> Column:
    return normalize_url(source_url)


def retrieve(questions: DataFrame, corpus: DataFrame, s: Settings = Settings(), empty_check: bool = True, index=None) -> DataFrame:
    """query_id, rank, chunk columns, similarity, mmr_score for questions that have
    query_id, embedding and scheme_id (null: all schemes).

    ``corpus`` has the chunk columns, embedding and body_embedding. Only keys and
    similarities take part in the search; the few rows found fetch the rest. With an
    ``index`` over the corpus (``operators.index``, filtered by scheme_id) only the lists
    near each question are read.
    """
    if empty_check and corpus.isEmpty():
        raise CorpusEmptyError("the corpus has no chunks")
    n = max(1, s.over_fetch)
    if index is not None:
        found = index.search(questions, n, least=s.min_similarity)
    else:
        found = nearest(corpus, questions, n, filter_by="scheme_id", least=s.min_similarity)
    # The corpus is joined by key: its side is filtered to what was found.
    rows = corpus.drop("embedding").join(found, "chunk_id")
    rows = rows.withColumn("text", strip_context_header("display_text"))
    if not s.use_mmr:
        return first_k(rows, s.top_k)
    return mmr(best_of_section(rows), s.top_k, s.mmr_lambda)


def results(questions: DataFrame, ranked: DataFrame) -> DataFrame:
    """query_id, filtered_scheme_id, chunks (by rank), max_similarity, is_empty."""
    chunk = F.struct("rank", "chunk_id", "text", "section", "scheme_name", "source_url", "fetched_at", "similarity", "mmr_score")
    by = ranked.groupBy("query_id").agg(
        F.sort_array(F.collect_list(chunk)).alias("chunks"), F.max("similarity").alias("max_similarity")
    )
    none = F.array().cast(by.schema["chunks"].dataType)
    return questions.select("query_id", F.col("scheme_id").alias("filtered_scheme_id")).join(by, "query_id", "left").select(
        "query_id", "filtered_scheme_id",
        F.coalesce("chunks", none).alias("chunks"),
        F.coalesce("max_similarity", F.lit(0.0)).alias("max_similarity"),
        F.col("chunks").isNull().alias("is_empty"),
    )
