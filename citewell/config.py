"""All tunables in one frozen record; the defaults are part of the semantics."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    # Retrieval
    top_k: int = 12
    over_fetch: int = 24
    min_similarity: float = 0.25
    use_mmr: bool = True
    mmr_lambda: float = 0.7
    # Chunking, in estimated tokens
    chunk_target_tokens: int = 200
    chunk_max_tokens: int = 240
    chunk_overlap_tokens: int = 60
    min_section_tokens: int = 40
    max_table_chars: int = 1800
    embed_limit: int = 256
    chars_per_token: int = 4
    #: Name of the tokenizer that chunking counts with (see operators.tokens); None: tokens are estimated.
    tokenizer: str | None = None
    # Encoder
    dimensions: int = 384
    # Fetching
    fetch_delay_s: float = 1.5
    fetch_timeout_s: int = 30
    fetch_retries: int = 3
    user_agent: str = "citewell/0.1"
    # Extraction
    min_page_chars: int = 500
    min_table_pairs: int = 3
    # Answers
    max_sentences: int = 3
    max_history_turns: int = 3
    # Optional language model
    llm_model: str | None = None
    llm_temperature: float = 0.0
    llm_max_tokens: int = 1024
    llm_timeout_s: int = 20
    llm_attempts: int = 2
    mode: str = "demo"

    @property
    def tokens_are_exact(self) -> bool:
        """Whether chunks are made by a tokenizer's counts, or by an estimate."""
        return self.tokenizer is not None

    @property
    def llm_enabled(self) -> bool:
        return self.llm_model is not None and self.mode != "eval"


def settings(spark: SparkSession | None = None, **changes) -> Settings:
    """The defaults, overridden by ``spark.citewell.<name>`` and then ``changes``."""
    given = {}
    if spark is not None:
        for f in fields(Settings):
            value = spark.conf.get(f"spark.citewell.{f.name}", None)
            if value is not None:
                kind = type(f.default)
                given[f.name] = value.lower() == "true" if kind is bool else value if f.default is None else kind(value)
    return replace(Settings(), **given | changes)
