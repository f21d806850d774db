"""Word-level BPE by backtracking over longest matches, and its inverse.

A word is a sequence of symbols: one for each byte, and for its last byte the
one that ends a word. An Aho-Corasick automaton finds the longest token at each
position. Tokens are taken left to right; a token stays only if the pair with
the one before it is compatible, which means that merging both symbol sequences
together gives the same two tokens. Else a shorter prefix is tried, and where
none is left the position is dead and the token before it is shortened. Each
position dies once, so the time is linear in the word. A sequence whose
neighbours are all compatible is what the merges give, and there is one only.

Decoding gathers the tokens' text from one byte string by a table of offsets.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from math import inf

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from packetlake.llm.bpe import byte_alphabet
from packetlake.llm.common import worker_state

# Words and token pairs a worker keeps; others are worked out again.
CACHED_WORDS = 600_000
CACHED_LENGTH = 64
CACHED_PAIRS = 2_000_000

# Texts for which Python lower-cases and splits as the library does: ASCII
# without separators, Latin-1 letters, Latin Extended-A without the dotted I.
_PLAIN_TEXT = re.compile(r"[\t\n\r\x20-\x7eÀ-ÖØ-öø-įı-ž]*+")
_PLAIN_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


class WordBpe:
    """Encoder and decoder for one file of the tokenizers library: a BPE model
    with a suffix for word ends, split into words before."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, self._suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        self._byte_of = {letter: byte for byte, letter in enumerate(byte_alphabet())}
        self._letters = dict(enumerate(byte_alphabet()))
        self._library = Tokenizer.from_file(path)

        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self._added = {text: np.array([i], "<u4").tobytes() for text, i in added.items()}
        self._cut = re.compile(
            "(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")"
        ) if added else None

        vocab = model["vocab"]
        self._load_merges(vocab, model["merges"])
        self._load_texts({**vocab, **added})
        self._known = _Known(self)

    def _symbols(self, token: str) -> str:
        """A token as one character for each symbol: the byte, plus 256 at a word's end."""
        ends = token.endswith(self._suffix) and len(token) > len(self._suffix)
        bytes_ = [self._byte_of[c] for c in (token[:-len(self._suffix)] if ends else token)]
        if ends:
            bytes_[-1] += 256
        return "".join(map(chr, bytes_))

    def _load_merges(self, vocab: dict[str, int], merges: list[list[str]]) -> None:
        symbols = {i: self._symbols(token) for token, i in vocab.items()}
        self._rule: dict[tuple[int, int], int] = {}
        # How a token is made: rank and parts of its merge.
        self._made: dict[int, tuple[int, int, int]] = {}
        for rank, (left, right) in enumerate(merges):
            a, b, made = vocab[left], vocab[right], vocab[left + right]
            self._rule.setdefault((a, b), rank)
            # Only what the merges yield from a token's own symbols is used: a
            # later way to make the same token never runs.
            if made not in self._made and self._first_crossing(a, b) == rank:
                self._made[made] = (rank, a, b)
        usable = {i: s for i, s in symbols.items() if len(s) == 1 or i in self._made}
        self._length = {i: len(s) for i, s in usable.items()}
        by_symbols = {s: i for i, s in usable.items()}
        self._shorter = {}
        for i, s in usable.items():
            self._shorter[i] = next(
                (by_symbols[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in by_symbols), None
            )
        self._pairs: dict[tuple[int, int], bool] = {}
        self._automaton = ahocorasick.Automaton()
        for s, i in by_symbols.items():
            self._automaton.add_word(s, (len(s), i))
        self._automaton.make_automaton()

    def _first_crossing(self, a: int, b: int) -> float:
        """Rank of the first merge over the border between ``a`` and ``b`` when
        their symbols are merged together; infinite without one.

        The tokens beside the border grow through a's right and b's left edge.
        A rule joins two of them if both still stand when its turn comes. Of
        equal ranks the leftmost merge comes first.
        """
        first, made, rule = inf, self._made, self._rule
        x, x_gone = a, inf
        while True:
            y, y_gone = b, inf
            while True:
                rank = rule.get((x, y))
                if rank is not None and rank < x_gone and rank <= y_gone:
                    first = min(first, rank)
                if y not in made:
                    break
                y_gone, y, _ = made[y]
            if x not in made:
                return first
            x_gone, _, x = made[x]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges leave ``a`` and ``b`` next to each other as they are."""
        found = self._pairs.get((a, b))
        if found is None:
            found = self._first_crossing(a, b) == inf
            if len(self._pairs) < CACHED_PAIRS:
                self._pairs[a, b] = found
        return found

    def encode_word(self, word: str) -> list[int]:
        data = word.encode("utf-8")
        symbols = data[:-1].decode("latin-1") + chr(256 + data[-1])
        longest: list = [None] * len(symbols)
        for end, (length, token) in self._automaton.iter(symbols):
            longest[end - length + 1] = token  # later ends come later
        ids: list[int] = []
        dead: set[int] = set()
        at, token = 0, longest[0]
        while at < len(symbols):
            end = at + self._length[token]
            if end not in dead and (not ids or self.compatible(ids[-1], token)):
                ids.append(token)
                at, token = end, longest[end] if end < len(symbols) else None
                continue
            token = self._shorter[token]
            if token is None:
                dead.add(at)
                token = ids.pop()
                at -= self._length[token]
        return ids

    def words(self, text: str) -> list[str]:
        """The words of a text without added tokens, normalised."""
        if _PLAIN_TEXT.fullmatch(text):
            return _PLAIN_SPLIT.findall(text.lower())
        # The splitter gives byte letters; back to characters.
        normal = self._library.normalizer.normalize_str(text)
        spelt = self._library.pre_tokenizer.pre_tokenize_str(normal)
        return [bytes(map(self._byte_of.__getitem__, word)).decode() for word, _ in spelt]

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text. Strings of added tokens are these tokens, as in
        the library."""
        known = self._known
        packed = []
        for part in self._cut.split(text) if self._cut else [text]:
            if part in self._added:
                packed.append(self._added[part])
            elif part:
                packed.extend(map(known.__getitem__, self.words(part)))
        return np.frombuffer(b"".join(packed), "<u4")

    def _load_texts(self, vocab: dict[str, int]) -> None:
        texts = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            texts[i] = token.encode() + b" "
        self._blob = np.frombuffer(b"".join(texts), np.uint8)
        self._starts = np.concatenate([[0], np.cumsum([len(x) for x in texts])])

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded text: the tokens' strings with one space between
        them, as the file names no decoder."""
        if not len(ids):
            return b""
        starts = self._starts[ids]
        lengths = self._starts[np.asarray(ids, np.int64) + 1] - starts
        ends = np.cumsum(lengths)
        # Place in the blob of each byte of the result.
        places = np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)
        return self._blob[places].tobytes()[:-1]


class _Known(dict):
    """Packed ids by word, filled on demand up to a bound."""

    def __init__(self, coder: WordBpe) -> None:
        super().__init__()
        self._coder = coder

    def __missing__(self, word: str) -> bytes:
        packed = np.array(self._coder.encode_word(word), "<u4").tobytes()
        if len(self) < CACHED_WORDS and len(word) <= CACHED_LENGTH:
            self[word] = packed
        return packed


def word_coder(path: str) -> WordBpe:
    """The worker's coder for a file."""
    return worker_state(("words", path), lambda: WordBpe(path))


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>) of each whole text; a null or empty text has
    none. Rows are mapped one by one: repeated rows, null ids and very long
    texts come back as they are, other columns are not looked at, an empty
    table gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_coder(path)
        for batch in batches:
            for doc_id, text in zip(*batch.to_pydict().values(), strict=True):
                ids = coder.encode(text or "").astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc_id], pa.int64()), pa.array([ids], pa.list_(pa.int32()))],
                    ["doc_id", "ids"],
                )

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id bigint, ids array<int>"
    )


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text string) from (doc_id, ids); null ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_coder(path)
        for batch in batches:
            doc_ids, tokens = batch.to_pydict().values()
            texts = [coder.decode(np.array(t or [], np.int64)).decode() for t in tokens]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"]
            )

    return encoded.select(F.col("doc_id").cast("bigint"), "ids").mapInArrow(
        run, "doc_id bigint, text string"
    )


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Digests of encoding and decoding in one pass over the texts: (doc_id,
    n_tokens, ids_sha256, decoded_sha256). Nulls, repeated rows, very long texts,
    an empty table and other columns as in ``encode_texts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_coder(path)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(*batch.to_pydict().values(), strict=True):
                ids = coder.encode(text or "")
                written = " ".join(map(str, ids.tolist())).encode()
                out.append((
                    doc_id, len(ids), hashlib.sha256(written).hexdigest(),
                    hashlib.sha256(coder.decode(ids)).hexdigest(),
                ))
            columns = list(zip(*out, strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(column), kind) for column, kind in zip(columns, kinds, strict=True)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )
