"""Byte-level byte-pair encoding and decoding by backtracking over longest matches.

Bytes are mapped to Latin-1 characters so that an Aho-Corasick automaton over the vocabulary finds
the longest token at each place. The encoder goes from longest match to longest match and takes a
token only if it is compatible with the token before: if merging by rank keeps both apart when they
stand side by side. Otherwise it tries the next shorter token, or goes back one. A text whose
neighbouring tokens are all compatible is the one that merging by rank gives, and each place is
given up at most once, so the time is linear.
"""

from __future__ import annotations

import base64
import struct
from array import array
from collections.abc import Iterator
from itertools import islice

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.llm.common import extended, held, slices

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pieces that a worker keeps at most, half of them the latest; and slots for what it knows of pairs (8 bytes each).
KEPT_PIECES, PAIR_SLOTS = 1 << 18, 1 << 20
#: Pieces that are encoded together; longer texts are cut part by part.
PIECES_AT_ONCE = 1 << 16


class _Pieces(dict):
    """Packed ids by piece. Pieces not seen lately are encoded, and kept unless they are very long.

    When half of the room is full, its pieces become the older half, and what was older and not seen since is forgotten.
    """

    def __init__(self, codec: BytePairCodec):
        super().__init__()
        self.codec, self.older = codec, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            tokens = self.codec.encode_piece(piece if piece.isascii() else piece.encode().decode("latin-1"))
            ids = struct.pack(f"<{len(tokens)}I", *tokens)
        if len(piece) <= 64:
            if len(self) >= KEPT_PIECES // 2:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class BytePairCodec:
    """Ranks of byte strings, and the pattern that cuts text before encoding."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        # White space by its Unicode property, so that the pattern cuts as other engines do.
        shape = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        self.cut, self.cut_one_by_one = shape.findall, shape.finditer
        self.ranks = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        self.text_of = {rank: token for token, rank in self.ranks.items()}
        self.size_of = {rank: len(token) for token, rank in self.ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.automaton.add_word(token, rank)
        self.reach = max(map(len, self.ranks))
        # The longest token that each text begins with which a token begins with: what a match leads to.
        self.begins: dict[str, int] = {}
        for token in sorted(self.ranks, key=len):
            for n in range(1, len(token) + 1):
                start = token[:n]
                if start in self.ranks:
                    best = self.begins[start] = self.ranks[start]
                else:
                    self.begins[start] = best
        #: A pair of tokens as one number: the left one's rank times this, and the right one's.
        self.base = max(ranks.values()) + 1
        self.halves: dict[int, tuple[int, int]] = {}
        self.shorter: dict[int, int] = {}
        # Per slot the pair known last, plus 1, and below it in 24 bits the token that fits, plus 1: 8 bytes.
        self.known = array("Q", bytes(8 * PAIR_SLOTS))
        self.pieces = _Pieces(self)

    def split(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge gives ``token``; a single byte gives itself twice."""
        if token not in self.halves:
            parts = list(self.text_of[token])
            while len(parts) > 2:
                found = [(self.ranks.get(a + b, self.base), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
                _, i = min(found)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.halves[token] = (self.ranks[parts[0]], self.ranks[parts[-1]])
        return self.halves[token]

    def prefix(self, token: int) -> int:
        """The longest token that ``token`` begins with, itself excepted; -1 if there is none."""
        if token not in self.shorter:
            text = self.text_of[token]
            ends = range(len(text) - 1, 0, -1)
            self.shorter[token] = next((self.ranks[text[:n]] for n in ends if text[:n] in self.ranks), -1)
        return self.shorter[token]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging by rank leaves ``left`` and ``right`` as they are, side by side."""
        ranks, text_of, limit = self.ranks, self.text_of, 1 << 62
        while True:
            joined = ranks.get(text_of[left] + text_of[right])
            if joined is not None and joined < limit:
                return False  # these two would have been merged before what holds them apart
            if left > right:
                limit, left = left, self.split(left)[1]
                if left == limit:
                    limit, right = right + 1, self.split(right)[0]
                    if right + 1 == limit:
                        return True
            else:
                limit, right = right + 1, self.split(right)[0]
                if right + 1 == limit:
                    limit, left = left, self.split(left)[1]
                    if left == limit:
                        return True

    def fitting(self, left: int, token: int) -> int:
        """The longest of ``token`` and the tokens it begins with that is compatible with ``left`` before it; else -1."""
        while token >= 0 and not self.compatible(left, token):
            token = self.prefix(token)
        return token

    def encode_piece(self, piece: str) -> list[int]:
        """The tokens of a piece whose bytes are given as Latin-1 characters."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        size, reach, match, begins = len(piece), self.reach, self.automaton.longest_prefix, self.begins
        size_of, known, base, slots = self.size_of, self.known, self.base, PAIR_SLOTS - 1
        closed = set()  # places that no tokens of the rest are compatible with
        token = begins[piece[: match(piece[:reach])]]
        tokens, place = [token], size_of[token]
        while place < size:
            ahead = piece[place : place + reach]
            left, token = tokens[-1], begins[ahead[: match(ahead)]]
            while token >= 0:
                pair = left * base + token + 1
                slot = (left * 40503 ^ token) & slots
                seen = known[slot]
                if seen >> 24 == pair:
                    token = (seen & 0xFFFFFF) - 1
                else:
                    token = self.fitting(left, token)
                    known[slot] = pair << 24 | token + 1
                if token < 0 or not closed or place + size_of[token] not in closed:
                    break
                token = self.prefix(token)
            while token < 0:
                # Nothing goes on from here: the token before is shortened, or given up as well.
                closed.add(place)
                token = tokens.pop()
                place -= size_of[token]
                token = self.prefix(token)
                while token >= 0 and (place + size_of[token] in closed or tokens and not self.compatible(tokens[-1], token)):
                    token = self.prefix(token)
            tokens.append(token)
            place += size_of[token]
        return tokens

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces one after the other, and how many each has; a piece is looked up once."""
        coded = pa.array(pieces, pa.string()).dictionary_encode()
        packed = [self.pieces[p] for p in coded.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        starts = np.cumsum(sizes) - sizes
        codes = coded.indices.to_numpy(zero_copy_only=False)
        counts = sizes[codes]
        shift = np.repeat(starts[codes] - (np.cumsum(counts) - counts), counts)
        return np.frombuffer(b"".join(packed), "<u4")[np.arange(len(shift)) + shift], counts

    def encode_all(self, texts: list[str | None]) -> pa.Array:
        """The ids of each text as little-endian unsigned 32-bit integers; none for null or empty texts."""
        ends, parts, total = [0], [np.zeros(0, "<u4")], 0
        pieces: list[str] = []
        waiting: list[int] = []  # pieces up to the end of each text that is not encoded yet

        def flush() -> None:
            nonlocal total
            ids, counts = self._encode_pieces(pieces)
            upto = np.append(0, np.cumsum(counts))
            ends.extend((total + upto[waiting]).tolist())
            parts.append(ids)
            total += len(ids)
            pieces.clear()
            waiting.clear()

        for text in texts:
            for found in self._cut_in_parts(text or ""):
                pieces.extend(found)
                if len(pieces) >= PIECES_AT_ONCE:
                    flush()
            waiting.append(len(pieces))
        flush()
        offsets = np.array(ends, np.int32) * 4
        return pa.Array.from_buffers(
            pa.binary(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(np.concatenate(parts).tobytes())])

    def _cut_in_parts(self, text: str) -> Iterator[list[str]]:
        if len(text) <= PIECES_AT_ONCE:
            yield self.cut(text)
        else:
            found = (match[0] for match in self.cut_one_by_one(text))
            while part := list(islice(found, PIECES_AT_ONCE)):
                yield part

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0].as_py()

    def decode(self, ids: bytes) -> bytes:
        return "".join(map(self.text_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).encode("latin-1")


def codec(ranks: bytes, pattern: str) -> BytePairCodec:
    """The codec of a rank file's content; a Python worker builds it once if it has no other work in between."""

    def build() -> BytePairCodec:
        pairs = (line.split() for line in ranks.splitlines() if line)
        return BytePairCodec({base64.b64decode(t): int(r) for t, r in pairs}, pattern)

    return held((ranks, pattern), build)


def _vocabulary(spark: SparkSession, path: str | None):
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as file:
        return spark.sparkContext.broadcast(file.read())  # a rank file: under a megabyte at any input


def encode(
    docs: DataFrame, text: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN
) -> DataFrame:
    """Add ``token_ids`` (packed little-endian unsigned 32-bit integers) and ``n_tokens`` per document.

    Whole texts of any length are encoded, without special tokens. A null text counts as empty and has no
    ids. Columns of these two names are replaced; all others, nulls and repeated rows stay.
    The vocabulary is read on the driver; ``path`` names another rank file.
    """
    ranks = _vocabulary(docs.sparkSession, path)
    schema = extended(docs, T.StructField("token_ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()))
    kept = [f.name for f in schema.fields[:-2]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = codec(ranks.value, pattern)
        for batch in slices(batches, text):
            ids = known.encode_all(batch.column(text).to_pylist())
            n_tokens = pc.divide(pc.binary_length(ids).cast(pa.int64()), 4)
            columns = [*(batch.column(c) for c in kept), ids, n_tokens]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "token_ids", "n_tokens"])

    return docs.mapInArrow(run, schema)


def decode(
    tokens: DataFrame, ids: str = "token_ids", path: str | None = None, pattern: str = public_tokenizers.PATTERN
) -> DataFrame:
    """Add ``decoded``: the bytes that packed ids stand for; null ids stand for none."""
    ranks = _vocabulary(tokens.sparkSession, path)
    schema = extended(tokens, T.StructField("decoded", T.BinaryType()))
    kept = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = codec(ranks.value, pattern)
        for batch in slices(batches, ids):
            texts = [known.decode(b) if b else b"" for b in batch.column(ids).to_pylist()]
            columns = [*(batch.column(c) for c in kept), pa.array(texts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "decoded"])

    return tokens.mapInArrow(run, schema)


def digests(tokens: DataFrame) -> DataFrame:
    """SHA-256 of the packed ids and of the decoded bytes, in lower-case hexadecimal digits."""
    return tokens.withColumn("ids_sha256", F.sha2("token_ids", 256)).withColumn(
        "decoded_sha256", F.sha2("decoded", 256)
    )
