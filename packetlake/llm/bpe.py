"""Byte-level BPE over Arrow batches, and its inverse.

The vocabulary is a file of ranks: one token in base 64 and its rank per line.
The tokenizers library does the merges. A text is cut by the pattern; each
match is mapped byte by byte to the printable alphabet that byte-level
vocabularies use, and the model splits that string into tokens. Ids of matches
seen before come from a bounded table per worker, as words repeat.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from packetlake.llm.common import worker_state

# Matches whose ids a worker keeps; others are encoded again.
CACHED_MATCHES = 600_000
# A match longer than this is not kept.
CACHED_LENGTH = 64

# Letters and digits for which Python's classes and the pattern's Unicode
# classes agree: ASCII without its separators, Latin-1 letters, Latin Extended-A.
_PLAIN_TEXT = re.compile(r"[\t\n\r\x20-\x7eÀ-ÖØ-öø-ž]*+")
_PLAIN_SPLIT = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
)


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: printable Latin-1 ones for
    themselves, the others, in order, from code point 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 256
    for byte in range(256):
        out.append(chr(byte if byte in printable else spare))
        spare += byte not in printable
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    return ranks


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The merge that makes each token, in the order of the ranks: the token is
    merged by the earlier ranks until two parts are left."""
    merges = []
    for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
        if len(token) == 1:
            continue
        parts = [token[i:i + 1] for i in range(len(token))]
        while len(parts) > 2:
            joined = [
                ranks.get(parts[i] + parts[i + 1], rank) for i in range(len(parts) - 1)
            ]
            best = min(joined)
            if best >= rank:
                break
            at = joined.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            merges.append((parts[0], parts[1]))
    return merges


class ByteBpe:
    """Encoder and decoder for one vocabulary and pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self._letters = dict(enumerate(byte_alphabet()))
        spell = self.spell
        model = models.BPE(
            vocab={spell(token): rank for token, rank in ranks.items()},
            merges=[(spell(a), spell(b)) for a, b in merges_of(ranks)],
        )
        self._merge = model.tokenize
        self._split = regex.compile(pattern).findall
        # The library's own splitter, for texts outside the plain alphabet.
        self._library_split = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        byte_of = {letter: byte for byte, letter in self._letters.items()}
        self._bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self._bytes[rank] = bytes(byte_of[letter] for letter in spell(token))
        self._lengths = np.array([len(token) for token in self._bytes], np.int64)
        self._known = _Known(self)

    @classmethod
    def from_tokenizer_file(cls, path: str, pattern: str) -> ByteBpe:
        """The vocabulary of a byte-level BPE file of the tokenizers library."""
        byte_of = {letter: byte for byte, letter in enumerate(byte_alphabet())}
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        return cls(
            {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items()},
            pattern,
        )

    def spell(self, token: bytes) -> str:
        return token.decode("latin-1").translate(self._letters)

    def matches(self, text: str) -> list[str]:
        if _PLAIN_TEXT.fullmatch(text):
            return _PLAIN_SPLIT.findall(text)
        return [piece for piece, _ in self._library_split.pre_tokenize_str(text)]

    def encode_match(self, match: str) -> bytes:
        """Ids of one match as little-endian unsigned 32-bit numbers."""
        spelt = self.spell(match.encode("utf-8"))
        return np.array([token.id for token in self._merge(spelt)], "<u4").tobytes()

    def encode(self, text: str) -> np.ndarray:
        packed = b"".join(map(self._known.__getitem__, self.matches(text)))
        return np.frombuffer(packed, "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids. A token may hold part of a character, so only
        the joined bytes are text."""
        return b"".join(map(self._bytes.__getitem__, ids.tolist()))

    def offsets(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end character of each token in the decoded text. Tokens
        that share a split character both cover it."""
        data = np.frombuffer(self.decode(ids), np.uint8)
        ends = np.cumsum(self._lengths[ids])
        # Characters begun up to and with each byte.
        begun = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        first = begun[ends - self._lengths[ids] + 1] - 1
        return first, begun[ends]


class _Known(dict):
    """Ids by match, filled on demand up to a bound."""

    def __init__(self, coder: ByteBpe) -> None:
        super().__init__()
        self._coder = coder

    def __missing__(self, match: str) -> bytes:
        packed = self._coder.encode_match(match)
        if len(self) < CACHED_MATCHES and len(match) <= CACHED_LENGTH:
            self[match] = packed
        return packed


def ranks_coder(path: str, pattern: str) -> ByteBpe:
    """The worker's coder for a file of ranks."""
    return worker_state(("ranks", path, pattern), lambda: ByteBpe(read_ranks(path), pattern))


def tokenizer_coder(path: str, pattern: str) -> ByteBpe:
    """The worker's coder for a tokenizers file; special tokens are plain text."""
    return worker_state(
        ("tokenizer", path, pattern), lambda: ByteBpe.from_tokenizer_file(path, pattern)
    )


def encode_texts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>, starts array<int>, ends array<int>): token ids
    of each whole text with their character spans; a null or empty text has
    none. Rows are mapped one by one: repeated rows and null ids come back as
    they are, other columns are not looked at, an empty table gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ranks_coder(path, pattern)
        for batch in batches:
            for doc_id, text in zip(*batch.to_pydict().values(), strict=True):
                ids = coder.encode(text or "")
                first, end = coder.offsets(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc_id], pa.int64()),
                     *(pa.array([x.astype(np.int32)], pa.list_(pa.int32())) for x in (ids, first, end))],
                    ["doc_id", "ids", "starts", "ends"],
                )

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id bigint, ids array<int>, starts array<int>, ends array<int>"
    )


def decode_ids(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, data binary) from (doc_id, ids); null ids give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ranks_coder(path, pattern)
        for batch in batches:
            ids, tokens = batch.to_pydict().values()
            data = [coder.decode(np.array(t or [], np.int64)) for t in tokens]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(data, pa.binary())], ["doc_id", "data"]
            )

    return encoded.select(F.col("doc_id").cast("bigint"), "ids").mapInArrow(
        run, "doc_id bigint, data binary"
    )


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Digests of encoding and decoding in one pass over the texts:
    (doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes, exact). ``exact``
    says whether the decoded bytes are those of the text. Nulls, repeated rows
    and other columns as in ``encode_texts``."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ranks_coder(path, pattern)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(*batch.to_pydict().values(), strict=True):
                text = text or ""
                ids = coder.encode(text)
                data = coder.decode(ids)
                written = " ".join(map(str, ids.tolist())).encode()
                out.append((
                    doc_id, len(ids), hashlib.sha256(written).hexdigest(),
                    hashlib.sha256(data).hexdigest(), len(data), data == text.encode(),
                ))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(column), kind) for column, kind in zip(
                    zip(*out, strict=True) if out else [()] * 6,
                    (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()),
                    strict=True)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes", "exact"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        run,
        "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, "
        "n_bytes bigint, exact boolean",
    )
