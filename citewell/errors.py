"""Errors raised on the driver. Row-level trouble is a column, not an exception."""


class CitewellError(Exception):
    """Base of all."""


class ConfigError(CitewellError):
    """A setting or manifest that cannot be used."""


class FetchError(CitewellError):
    """A page that could not be fetched."""


class ExtractionError(CitewellError):
    """A page without enough content."""


class CorpusEmptyError(CitewellError):
    """Retrieval was asked of a corpus without chunks."""


class GenerationError(CitewellError):
    """The language model failed in a way that has no fallback."""


class ConflictError(CitewellError):
    """Another writer has committed the version that a write was made from."""
