"""Byte-level BPE encoding and decoding by tree reduction.

Both levels of the encoding are monoids whose elements are encoded stretches of input.

Text level: a text is halved down to leaves, each leaf is cut into pieces by the splitting
pattern, and neighbours are joined by cutting a window at their border anew. The pattern
looks forward only, at most one character past a match and three past its start, so a piece
of the left side that ends far enough from the border stands; on the right side all pieces
after the first common cut stand. The window grows until it holds such a cut.

Piece level: a piece is halved down to LEAF_BYTES, each leaf is merged by rank, and
neighbours are joined by encoding a window of tokens around their border anew. A sequence of
tokens is the encoding of its bytes exactly if each two neighbours encode to themselves, so
the tokens outside the window stand once this holds at both of its ends; until then the
window grows.

Decoding concatenates the bytes of tokens up a tree of halves. Texts are independent, so the
table is never shuffled; a worker keeps one text, its tokens and a bounded memory of pieces.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaloom.llm.common import with_column

LEAF_CHARS = 4096
LEAF_BYTES = 32
LEAF_TOKENS = 65536
# Tokens on each side of the border in the first window.
WINDOW = 4
REMEMBERED_PIECES = 600_000
RANK_FILE = "byte_bpe_50k.tiktoken"

# Characters that the pattern may look at: after the end of a match, and after its start.
_PAST_END, _PAST_START = 1, 3


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Codec:
    """Encodes and decodes by the ranks of a vocabulary file."""

    def __init__(self, path: str, pattern: str) -> None:
        self.ranks = read_ranks(path)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        # Python's white space holds four control characters more than Unicode's property.
        self.pattern = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(
            r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.known: dict[str, array] = {}
        self.fits: dict[tuple[int, int], bool] = {}

    # --- texts to pieces ---------------------------------------------------------------

    def pieces(self, text: str) -> list[str]:
        if len(text) <= LEAF_CHARS:
            return self.pattern.findall(text)
        half = len(text) // 2
        return self._join_pieces(self.pieces(text[:half]), self.pieces(text[half:]))

    def _join_pieces(self, left: list[str], right: list[str]) -> list[str]:
        kept, tail = len(left), 0
        while kept:
            size = len(left[kept - 1])
            if tail >= _PAST_END and tail + size >= _PAST_START:
                break
            kept, tail = kept - 1, tail + size
        start, count = "".join(left[kept:]), WINDOW
        while True:
            window = start + "".join(right[:count])
            whole = count >= len(right)
            cuts, at = {}, len(start)
            for i, piece in enumerate(right[:count]):
                cuts[at] = i
                at += len(piece)
            middle, end = [], 0
            for match in self.pattern.finditer(window):
                if end in cuts and end > 0:
                    return left[:kept] + middle + right[cuts[end]:]
                seen = max(match.end() + _PAST_END, match.start() + _PAST_START)
                if not whole and seen > len(window):
                    break
                middle.append(match.group())
                end = match.end()
            if whole:
                return left[:kept] + middle
            count *= 2

    # --- pieces to tokens --------------------------------------------------------------

    def encode_piece(self, piece: bytes) -> list[int]:
        rank = self.ranks.get(piece)
        if rank is not None:
            return [rank]
        if len(piece) <= LEAF_BYTES:
            return self._merge(piece)
        half = len(piece) // 2
        return self._join_tokens(self.encode_piece(piece[:half]), self.encode_piece(piece[half:]))

    def _merge(self, piece: bytes) -> list[int]:
        """Merges the neighbours of lowest rank, the leftmost first, while any has a rank."""
        find = self.ranks.get
        parts = [piece[i : i + 1] for i in range(len(piece))]
        none = len(self.ranks) << 8
        pairs = [find(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs:
            low = min(pairs)
            if low == none:
                break
            i = pairs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = find(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = find(parts[i] + parts[i + 1], none)
        return [self.ranks[p] for p in parts]

    def _neighbours(self, one: int, other: int) -> bool:
        key = one, other
        if key not in self.fits:
            if len(self.fits) >= REMEMBERED_PIECES:
                self.fits.clear()
            self.fits[key] = self._merge(self.tokens[one] + self.tokens[other]) == [one, other]
        return self.fits[key]

    def _join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        count = WINDOW
        while True:
            a, b = max(0, len(left) - count), min(len(right), count)
            middle = self._merge(self.decode(left[a:] + right[:b]))
            if (a == 0 or self._neighbours(left[a - 1], middle[0])) and (
                b == len(right) or self._neighbours(middle[-1], right[b])
            ):
                return left[:a] + middle + right[b:]
            count *= 2

    # --- whole texts -------------------------------------------------------------------

    def encode(self, text: str) -> array:
        """Token ids of a whole text as unsigned 32-bit integers."""
        known, ids = self.known, array("I")
        for piece in self.pieces(text):
            found = known.get(piece)
            if found is None:
                found = array("I", self.encode_piece(piece.encode()))
                if len(piece) <= LEAF_CHARS:
                    if len(known) >= REMEMBERED_PIECES:
                        known.clear()
                    known[piece] = found
            ids += found
        return ids

    def decode(self, ids: array | list[int]) -> bytes:
        if len(ids) <= LEAF_TOKENS:
            return b"".join(map(self.tokens.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@cache
def _codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _little_endian(ids: array) -> bytes:
    if array("H", [1]).tobytes()[0] == 0:
        ids = array("I", ids)
        ids.byteswap()
    return ids.tobytes()


def encode(
    docs: DataFrame,
    text_col: str = "text",
    path: str | None = None,
    pattern: str = public_tokenizers.PATTERN,
) -> DataFrame:
    """`docs` with `ids`, the token ids of the whole text, in place of any such column.

    A null text counts as empty; an empty text has no ids. Other columns, also null or
    repeated rows, pass unchanged.
    """
    path = path or public_tokenizers.path(RANK_FILE)
    return with_column(
        docs, F.coalesce(F.col(text_col).cast("string"), F.lit("")), "ids", pa.list_(pa.int32()),
        "array<int>", lambda: (lambda text: _codec(path, pattern).encode(text)),
    )


def decode(docs: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """`docs` with `decoded`, the bytes of the ids, in place of any such column.

    Null ids count as none. An id outside the vocabulary is an error.
    """
    path = path or public_tokenizers.path(RANK_FILE)
    return with_column(
        docs, F.coalesce(F.col(ids_col), F.array().cast("array<int>")), "decoded", pa.binary(),
        "binary", lambda: _codec(path, public_tokenizers.PATTERN).decode,
    )


def _digests(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern)
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                texts = batch.column(1).to_pylist()
                ids = [codec.encode(text or "") for text in texts]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                flat = np.concatenate([np.asarray(i, np.int32) for i in ids])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([len(i) for i in ids], pa.int64()),
                        pa.array([_sha256(_little_endian(i)) for i in ids]),
                        pa.array([_sha256(codec.decode(i)) for i in ids]),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"],
                )

    return run


def _sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def round_trip(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    pattern: str = public_tokenizers.PATTERN,
) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids of every whole text.

    The ids are hashed as little-endian 32-bit integers, the decoded bytes as they are.
    Encoding and decoding run in one pass. A null text counts as empty; every row is
    returned, also those that repeat an id or have none. An empty table gives an empty table.
    """
    path = path or public_tokenizers.path(RANK_FILE)
    return docs.select(
        F.col(id_col).cast("long"), F.col(text_col).cast("string")
    ).mapInArrow(
        _digests(path, pattern),
        "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, ids array<int>",
    )
