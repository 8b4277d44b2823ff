"""SentencePiece encoding with offsets, and decoding.

The text is normalised by longest-prefix match through the model's compiled
character map, which records for every normalised byte the original byte it comes
from. The library gives the ids; the pieces, laid end to end over the normalised
bytes, are projected through that record to spans of the original bytes.

Defined results: a null text is empty; begin and end ids are on by default and
have empty spans at the ends; repeated rows are encoded each on its own; a text of
any length is encoded whole; an empty table gives an empty result; only doc_id and
text are read, so further columns may have any names.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citewell import ship
from citewell.llm.common import documents

MODEL = "piece_bpe_32k.model"
SPACE = "▁".encode()
#: Characters encoded at a time: bounds what a worker holds beside its batch.
STEP_CHARS = 4_000_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


class CharacterMap:
    """The compiled map: a double-array trie of byte strings and their replacements."""

    def __init__(self, blob: bytes):
        self.units, self.texts = (), b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key that starts at ``at``."""
        best, node = None, 0
        unit = self.units[0]
        node ^= (unit >> 10) << ((unit & 0x200) >> 6)
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != data[k]:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit >> 8 & 1:
                value = self.units[node] & 0x7FFFFFFF
                best = (k + 1 - at, self.texts[value : self.texts.index(b"\0", value)])
        return best


class Pieces:
    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            blob = f.read()
        proto = sentencepiece_model_pb2.ModelProto.FromString(blob)
        self.spec = proto.normalizer_spec
        if proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("models with white space as a suffix are not supported")
        self.map = CharacterMap(self.spec.precompiled_charsmap)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=blob)
        # Bytes of the normalised text that a piece covers: a byte piece one, a control piece none.
        self.length = np.array(
            [{3: 0, 6: 1}.get(p.type, len(p.piece.encode())) for p in proto.pieces], dtype=np.int64
        )
        self.unknown = proto.trainer_spec.unk_id

    def normalised(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each and the end the original byte."""
        data = text.encode()
        out, origin, lead = self._mapped(data) if self.map.units else self._same(data)
        squeeze = self.spec.remove_extra_whitespaces
        if not data or (squeeze and lead == len(data)):
            return b"", np.full(1, lead if data else 0)
        if squeeze:
            out, origin = self._squeezed(out, origin)
        if self.spec.add_dummy_prefix:  # it stands where the spaces ahead of the text end
            out, origin = b" " + out, np.concatenate([[lead if squeeze else 0], origin])
        space = SPACE if self.spec.escape_whitespaces else b" "
        if self.spec.escape_whitespaces:
            widths = np.where(np.frombuffer(out, dtype=np.uint8) == 32, len(SPACE), 1)
            out = out.replace(b" ", SPACE)
            origin = np.concatenate([np.repeat(origin[:-1], widths), origin[-1:]])
        if squeeze:  # after the escape: a mark that the text itself ends in goes as well
            n = len(out)
            while out[:n].endswith(space):
                n -= len(space)
            out, origin = out[:n], origin[: n + 1]
        return out, origin

    @staticmethod
    def _same(data: bytes) -> tuple[bytes, np.ndarray, int]:
        return data, np.arange(len(data) + 1), len(data) - len(data.lstrip(b" "))

    def _mapped(self, data: bytes) -> tuple[bytes, np.ndarray, int]:
        """The mapped bytes, their origins, and where the leading spaces end."""
        parts, origin, at, lead, ahead = [], [], 0, 0, True
        while at < len(data):
            hit = self.map.longest(data, at)
            if hit is None:  # the character itself
                n = next((k for k in range(1, 4) if at + k >= len(data) or data[at + k] & 0xC0 != 0x80), 4)
                hit = n, data[at : at + n]
            parts.append(hit[1])
            origin += [at] * len(hit[1])
            at += hit[0]
            ahead = ahead and hit[1] == b" "
            lead = at if ahead else lead
        return b"".join(parts), np.array([*origin, len(data)], dtype=np.int64), lead

    def _squeezed(self, out: bytes, origin: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Of each run of spaces the first stays, of the one ahead of the text none."""
        keep = np.ones(len(out) + 1, dtype=bool)
        for m in re.finditer(b" +", out):
            keep[m.start() + (m.start() > 0) : m.end()] = False
        return np.frombuffer(out, dtype=np.uint8)[keep[:-1]].tobytes(), origin[keep]

    def encode(self, texts: list[str], ends: bool = True) -> list[list[int]]:
        return self.library.encode(texts, add_bos=ends, add_eos=ends, num_threads=1)

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids, num_threads=1)

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Original byte offsets where each piece begins and ends."""
        out, origin = self.normalised(text)
        lengths = self.length[ids]
        if (ids == self.unknown).any():  # an unknown piece covers what the others leave
            lengths = self._with_unknown(out, ids, lengths)
        ends = np.cumsum(lengths)
        if len(ends) and ends[-1] != len(out):
            raise ValueError("the pieces do not cover the normalised text")
        return origin[ends - lengths], origin[ends]

    def _with_unknown(self, out: bytes, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        lengths, at = lengths.copy(), 0
        for k, piece in enumerate(ids):
            if piece == self.unknown:
                rest = [self.library.id_to_piece(int(p)).encode() for p in ids[k + 1 : k + 2] if self.length[p]]
                stop = out.find(rest[0], at + 1) if rest else len(out)
                lengths[k] = (len(out) if stop < 0 else stop) - at
            at += lengths[k]
        return lengths


@cache
def pieces_of(path: str) -> Pieces:
    """Loaded once in each Python worker."""
    return Pieces(path)


def steps(texts: list[str], most: int = STEP_CHARS) -> Iterator[list[str]]:
    step, n = [], 0
    for text in texts:
        if step and n + len(text) > most:
            yield step
            step, n = [], 0
        step.append(text)
        n += len(text)
    if step:
        yield step


def encoded(texts: list[str], path: str, ends: bool) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, str]]:
    """text, ids, begins, ends, decoded for each text: what both forms below use."""
    pieces = pieces_of(path)
    for step in steps([t or "" for t in texts]):
        ids = pieces.encode(step, ends)
        for text, own, decoded in zip(step, ids, pieces.decode(ids), strict=True):
            own = np.array(own, dtype=np.int64)
            begin, end = pieces.spans(text, own)
            yield text, own, begin, end, decoded


def encode(docs: DataFrame, path: str | None = None, ends: bool = True) -> DataFrame:
    """doc_id, ids, begins and ends (original UTF-8 byte offsets), decoded."""
    ship()
    path = path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(encoded(batch.column("text").to_pylist(), path, ends))
            ints = [pa.array([r[k] for r in rows], pa.list_(pa.int32())) for k in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *ints, pa.array([r[4] for r in rows], pa.string())],
                ["doc_id", "ids", "begins", "ends", "decoded"],
            )

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, begins array<int>, ends array<int>, decoded string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and spans_sha256 (begins, then
    ends, as little-endian unsigned 32-bit integers), without moving the ids."""
    ship()
    path = path or default_model()
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (
                    len(ids),
                    sha(ids.astype("<u4").tobytes()),
                    sha(decoded.encode()),
                    sha(np.concatenate([begin, end]).astype("<u4").tobytes()),
                )
                for _, ids, begin, end, decoded in encoded(batch.column("text").to_pylist(), path, True)
            ]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(columns[0], pa.int64()), *(pa.array(c, pa.string()) for c in columns[1:])],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"],
            )

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(documents(spark, sf_dir).select(F.col("doc_id"), F.col("text")))
