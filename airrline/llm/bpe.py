"""Byte-level BPE encoding and decoding (exact merges, linear time).

A text is cut into pieces by the tokenizer's pattern. A piece's bytes are read
as Latin-1, so that an Aho-Corasick automaton over the vocabulary finds the
longest token at each place. From there the encoder walks left to right and
backtracks to shorter tokens whenever a token cannot stand next to the one
before it, or leads to a place already known to be dead. "Can stand next to" is
decided by undoing merges from both sides and is remembered for each pair.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from airrline.llm.common import MAX_BATCH_BYTES, map_arrow, ship, sliced

_MEMO = 1_000_000  # pairs and
_PIECES = 250_000  # pieces remembered in a worker; both are only caches
_PIECE_LEN = 64


class Bpe:
    """Encoder and decoder for a rank file: lines of base64 bytes and a rank."""

    def __init__(self, rank_file: bytes, pattern: str):
        import ahocorasick
        import regex

        rows = [line.split() for line in rank_file.splitlines() if line.strip()]
        self.bytes_of = {int(rank): base64.b64decode(token) for token, rank in rows}
        self.rank_of = {token.decode("latin-1"): rank for rank, token in self.bytes_of.items()}
        if missing := [i for i in range(256) if chr(i) not in self.rank_of]:
            raise ValueError(f"no rank for the bytes {missing[:8]}")
        self.find = regex.compile(pattern).findall
        self._made_of: dict[int, tuple[int, int]] = {}
        self._merged: dict[tuple[int, int], int] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        self._pieces: dict[str, bytes] = {}
        self._shorter: dict[int, int | None] = {}
        text_of = {rank: token for token, rank in self.rank_of.items()}
        reachable = [rank for rank in sorted(text_of) if self._learn(rank, text_of[rank])]
        self._fits.clear()
        self.longest = ahocorasick.Automaton()
        for rank in reachable:
            self.longest.add_word(text_of[rank], (rank, len(text_of[rank])))
        self.longest.make_automaton()
        usable = set(reachable)
        for rank in reachable:  # the next shorter token that starts the same way
            t = text_of[rank]
            self._shorter[rank] = next((r for n in range(len(t) - 1, 0, -1) if (r := self.rank_of.get(t[:n])) in usable), None)
        self._len = {rank: len(t) for rank, t in text_of.items()}
        top = max(text_of, default=-1) + 1
        self._table = [self.bytes_of.get(i, b"") for i in range(top)]

    def _learn(self, rank: int, token: str) -> bool:
        """Find the two tokens that merge into this one; False if merging never gets there."""
        if len(token) == 1:
            return True
        for cut in range(len(token) - 1, 0, -1):
            left, right = self.rank_of.get(token[:cut]), self.rank_of.get(token[cut:])
            if left is None or right is None or max(self._age(left), self._age(right)) >= rank:
                continue
            if self._can_meet(left, right):
                self._made_of[rank] = (left, right)
                self._merged[left, right] = rank
                return True
        return False

    def _age(self, rank: int) -> int:
        """When a token is made: bytes are there from the start, whatever their rank."""
        return rank if rank in self._made_of else -1 if len(self.bytes_of[rank]) == 1 else 1 << 60

    def _can_meet(self, a: int, b: int) -> bool:
        """Whether merging leaves tokens a and b side by side.

        Goes back in time: the later made of the two is taken apart, and no
        merge across the border may come before what is already undone. Of equal
        tokens the right one is later, as merging goes from the left.
        """
        known = self._fits.get((a, b))
        if known is not None:
            return known
        x, y, before = a, b, 1 << 60
        fits = True
        while True:
            across = self._merged.get((x, y))
            if across is not None and across < before:
                fits = False
                break
            age_x, age_y = self._age(x), self._age(y)
            if age_x < 0 and age_y < 0:
                break
            if age_x > age_y:
                before = age_x
                x = self._made_of[x][1]
            else:
                before = age_y + 1
                y = self._made_of[y][0]
        if len(self._fits) >= _MEMO:
            self._fits.clear()
        self._fits[a, b] = fits
        return fits

    def _backtrack(self, piece: str) -> list[int]:
        best = [0] * len(piece)
        for end, (rank, n) in self.longest.iter(piece):
            best[end - n + 1] = rank  # ends only grow, so the longest comes last
        out: list[int] = []
        dead = bytearray(len(piece) + 1)
        at, token = 0, best[0]
        length, shorter = self._len, self._shorter
        while at < len(piece):
            end = at + length[token]
            if not dead[end] and (not out or self._can_meet(out[-1], token)):
                out.append(token)
                at = end
                token = best[at] if at < len(piece) else 0
                continue
            nxt = shorter[token]
            while nxt is None:  # nothing fits here: give up this place and shorten the token before
                dead[at] = 1
                last = out.pop()
                at -= length[last]
                nxt = shorter[last]
            token = nxt
        return out

    def encode_piece(self, piece: str) -> bytes:
        """A piece's ids, packed as little-endian unsigned 32-bit integers."""
        got = self._pieces.get(piece)
        if got is None:
            raw = piece.encode("utf-8", "replace").decode("latin-1")
            whole = self.rank_of.get(raw)
            ids = [whole] if whole is not None else self._backtrack(raw)
            got = np.array(ids, "<u4").tobytes()
            if len(piece) <= _PIECE_LEN:
                if len(self._pieces) >= _PIECES:
                    self._pieces.clear()
                self._pieces[piece] = got
        return got

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.encode_piece, self.find(text)))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self._table.__getitem__, np.frombuffer(packed, "<u4").tolist()))


_LOADED: dict[tuple[int, str], Bpe] = {}


def _loaded(rank_file: bytes, pattern: str) -> Bpe:
    """One encoder for each worker process and vocabulary."""
    key = (hash(rank_file), pattern)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Bpe(rank_file, pattern)
    return _LOADED[key]


def encode(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_decoded: bool = True) -> DataFrame:
    """Encode every text; one row for each input row.

    Returns ``id_col``, ``n_tokens``, ``ids`` (binary: little-endian unsigned
    32-bit integers) and, by default, ``decoded`` (binary: the bytes the ids
    stand for). NULL texts count as empty and give no ids. No special tokens.
    Repeated rows are encoded each; other columns are not read; an empty table
    gives an empty result. A very long text takes memory in proportion to it. The
    vocabulary (a few MB at most) is read by the driver and broadcast; one
    without a rank for every single byte is refused.
    """
    with open(rank_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    fields = [("n_tokens", pa.int64()), ("ids", pa.binary()), *([("decoded", pa.binary())] if with_decoded else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(shared.value, pattern)
        for batch in sliced(batches, 1, MAX_BATCH_BYTES):
            ids = [bpe.encode(t or "") for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            if with_decoded:
                columns.append(pa.array([bpe.decode(x) for x in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, *[n for n, _ in fields]])

    rows = docs.select(id_col, text_col)
    kind = rows.schema[0].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids binary" + (", decoded binary" if with_decoded else "")
    return rows.transform(map_arrow, run, schema)


def decode(tokens: DataFrame, rank_path: str, ids_col: str = "ids") -> DataFrame:
    """Add ``decoded``, the bytes of packed ids; NULL ids give NULL. Other columns stay."""
    from pyspark.sql import functions as F

    with open(rank_path, "rb") as f:
        shared = tokens.sparkSession.sparkContext.broadcast(f.read())

    ship(tokens.sparkSession)

    @F.pandas_udf("binary")
    def undo(ids):
        bpe = _loaded(shared.value, "")
        return ids.map(lambda x: None if x is None else bpe.decode(x))

    return tokens.withColumn("decoded", undo(ids_col))
