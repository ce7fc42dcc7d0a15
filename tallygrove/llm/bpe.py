"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece of text there is exactly one last token of its encoding: the token that ends there,
starts where another prefix ends, and stands validly after that prefix's own last token. Two tokens stand validly
side by side if merging their joined bytes gives just them. The table of last tokens is the whole encoding; it
takes appended bytes as they come, and after an edit it is rebuilt only until it agrees with the old one again.

Defined results: a null text is empty and has no tokens. Long texts and pieces take time in proportion to their
length. Repeated rows are encoded each. An empty table gives an empty result; columns of other names are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import sys
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Entries that each of a worker's memories (encoded pieces, pairs of tokens; twice as many prefixes) holds before it starts anew.
REMEMBERED = 400_000
_LONGEST_REMEMBERED = 64
#: Last bytes by which the lengths of tokens are listed, and the lengths of tokens too short to be.
_TAIL = 3
_SHORT = (2, 1)


class Encoder:
    """Encodes and decodes with the ranks of one vocabulary."""

    def __init__(self, rank_lines: bytes, pattern: str):
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in rank_lines.splitlines() if line)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.pieces = regex.compile(pattern).findall
        self._side_by_side: dict[int, bool] = {}
        lengths: dict[bytes, set[int]] = {}
        for token in self.ranks:
            if len(token) >= _TAIL:
                lengths.setdefault(token[-_TAIL:], set(_SHORT)).add(len(token))
        self._lengths = {tail: sorted(some, reverse=True) for tail, some in lengths.items()}
        self._alone: dict[int, bool] = {}
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._prefixes: dict[bytes, int] = {}
        self._packed = _Remembered(self)

    def merged(self, data: bytes) -> list[int]:
        """Encoding of a short byte string by merging the lowest-ranked neighbours, first place first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            pairs = [(self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
            rank, i = min(pairs)
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the last merge inside a token joins; None for a single byte."""
        if (known := self._halves.get(token, ())) == ():
            data = self.tokens[token]
            parts = [data[i : i + 1] for i in range(len(data))]
            while len(parts) > 2:
                rank, i = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                if rank == 1 << 60:
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            known = self._halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return known

    def follows(self, before: int, token: int) -> bool:
        """Whether both tokens come out again when their joined bytes are encoded."""
        key = before << 32 | token
        if (known := self._side_by_side.get(key)) is None:
            if len(self._side_by_side) >= REMEMBERED:
                self._side_by_side.clear()
            known = self._side_by_side[key] = self._stays_apart(before, token)
        return known

    def _stays_apart(self, left: int, right: int) -> bool:
        """No merge crosses the border between two tokens.

        Merges run by rank, so undo them latest first: of the two parts at the border, that with the higher rank was
        merged last (the left one first where ranks are equal). While a part lasts, it may merge across the border only
        before the merge that takes it up, so only with a rank below that; the left part's own rank counts as taken.
        """
        tokens, ranks = self.tokens, self.ranks
        until = 1 << 60
        while True:
            across = ranks.get(tokens[left] + tokens[right])
            if across is not None and across < until:
                return False
            inner_left, inner_right = self.halves(left), self.halves(right)
            if inner_left is None and inner_right is None:
                return True
            if inner_right is None or inner_left is not None and left > right:
                until, left = left, inner_left[1]
            else:
                until, right = right + 1, inner_right[0]

    def starts(self, token: int) -> bool:
        if (known := self._alone.get(token)) is None:
            known = self._alone[token] = self.merged(self.tokens[token]) == [token]
        return known

    def _last(self, piece: bytes, table: list[int], end: int) -> int:
        # Only lengths that a token with these last bytes has.
        get, known = self.ranks.get, self._side_by_side
        for length in self._lengths.get(piece[max(end - _TAIL, 0) : end], _SHORT):
            if length <= end:
                start = end - length
                token = get(piece[start:end])
                if token is not None:
                    if start:
                        before = table[start - 1]
                        stands = known.get(before << 32 | token)
                        if stands or stands is None and self.follows(before, token):
                            return token
                    elif self.starts(token):
                        return token
        raise ValueError("the vocabulary lacks a byte")

    def table(self, piece: bytes) -> list[int]:
        """Last token of every prefix."""
        return self.append(b"", [], piece)

    def append(self, piece: bytes, table: list[int], more: bytes) -> list[int]:
        """Table of ``piece + more``, given that of ``piece``, which is extended in place."""
        piece += more
        for end in range(len(table) + 1, len(piece) + 1):
            table.append(self._last(piece, table, end))
        return table

    def edit(self, piece: bytes, table: list[int], start: int, end: int, new: bytes) -> tuple[bytes, list[int]]:
        """Piece and table after ``piece[start:end]`` has become ``new``.

        Prefixes up to ``start`` keep their tokens. Behind the edit, once as many places as the longest token
        has bytes agree with the old table, all later ones do.
        """
        changed = piece[:start] + new + piece[end:]
        fresh, shift, same = table[:start], len(new) - (end - start), 0
        while len(fresh) < len(changed):
            place = len(fresh) + 1
            fresh.append(self._last(changed, fresh, place))
            if place > start + len(new):
                same = same + 1 if fresh[-1] == table[place - 1 - shift] else 0
                if same >= self.longest:
                    fresh += table[place - shift :]
        return changed, fresh

    def tokens_of(self, table: list[int]) -> list[int]:
        """Token ids, read from the end of the table."""
        ids, end = [], len(table)
        while end:
            ids.append(table[end - 1])
            end -= len(self.tokens[ids[-1]])
        return ids[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        return self.tokens_of(self._shared_table(piece) if len(piece) <= _LONGEST_REMEMBERED else self.table(piece))

    def _shared_table(self, piece: bytes) -> list[int]:
        """The table of a short piece: a prefix's last token is the same in every piece that begins with it."""
        last, table = self._prefixes, []
        if len(last) >= 2 * REMEMBERED:
            last.clear()
        for end in range(1, len(piece) + 1):
            prefix = piece[:end]
            token = last.get(prefix)
            if token is None:
                token = last[prefix] = self._last(piece, table, end)
            table.append(token)
        return table

    def encode_packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self._packed.__getitem__, self.pieces(text)))

    def decode_packed(self, ids: bytes) -> bytes:
        numbers = array("I", ids)
        if sys.byteorder == "big":
            numbers.byteswap()
        return b"".join(map(self.tokens.__getitem__, numbers))


class _Remembered(dict):
    """Packed ids by piece; a piece not yet there is encoded on the spot."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        ids = self.encoder.encode_piece(piece.encode())
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= _LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = packed
        return packed


def encode(docs: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text", ids: bool = True) -> DataFrame:
    """Per document its ``key``, ``n_tokens``, digests of ids and of the text decoded from them, and the packed ids.

    ``vocabulary`` is a rank file that the driver reads (its size is that of a vocabulary, not of the data).
    Decoding starts from the packed ids alone.
    """
    docs = docs.select(key, text)
    kind = docs.schema[key].dataType.simpleString()
    with open(vocabulary, "rb") as ranks:
        shared = docs.sparkSession.sparkContext.broadcast({"ranks": ranks.read()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = shared.value  # kept by the worker from task to task
        if "encoder" not in state:
            state["encoder"] = Encoder(state["ranks"], pattern)
        encoder = state["encoder"]
        for batch in batches:
            counts, encoded, decoded, packed = [], [], [], []
            for value in batch.column(1):
                data = encoder.encode_packed(value.as_py() or "")
                counts.append(len(data) // 4)
                encoded.append(hashlib.sha256(data).hexdigest())
                decoded.append(hashlib.sha256(encoder.decode_packed(data)).hexdigest())
                if ids:
                    packed.append(data)
            columns = {key: batch.column(0), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": encoded, "decoded_sha256": decoded}
            yield pa.RecordBatch.from_pydict(columns | ({"ids": pa.array(packed, pa.binary())} if ids else {}))

    schema = f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary" if ids else "")
    return docs.mapInArrow(run, schema)
