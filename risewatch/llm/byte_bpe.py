"""Byte-level BPE: pieces of a text are encoded together as padded matrices, one merge for each row and round.

Pieces are bucketed by length. In every round each row of a matrix looks up the ranks of its adjacent pairs in an open
hash table, merges the leftmost pair of the least rank and is compacted; rows without a known pair leave. Pieces longer
than ``LONG`` bytes are rows of their own in which all occurrences of the least pair merge at once, unless a pair made
on the way would have come first: the result is that of single merges, without a round for every byte.

Texts are whole. Null texts are empty: no ids, empty bytes. Repeated rows get equal ids. Extra columns stay; the added
columns get underscores if their names are taken.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from risewatch.llm.common import slices, spare

NONE = np.int32(2**31 - 1)
LONG = 128
CELLS = 1 << 20
#: Distinct pieces that a Python worker remembers before it starts anew.
MEMORY_PIECES = 150_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, from lines of base64 and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class PairTable:
    """(left id, right id) -> rank of their concatenation, in an open-addressing table of numpy arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = {v: k for k, v in ranks.items()}
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, to = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), to.append(rank)
        key = (np.array(left, np.int64) << 32) | np.array(right, np.int64)
        self.bits = max(4, int(np.ceil(np.log2(len(key) * 3 + 1))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        todo, slot = np.arange(len(key)), self._slot(key)
        while len(todo):
            free = self.keys[slot] < 0
            first = np.unique(slot[free], return_index=True)[1]
            taken = np.flatnonzero(free)[first]
            self.keys[slot[taken]] = key[todo[taken]]
            self.values[slot[taken]] = np.array(to, np.int32)[todo[taken]]
            left_over = np.ones(len(todo), bool)
            left_over[taken] = False
            todo, slot = todo[left_over], (slot[left_over] + 1) & (len(self.keys) - 1)
        size = max(self.tokens) + 1
        lengths = np.zeros(size, np.int64)
        for rank, token in self.tokens.items():
            lengths[rank] = len(token)
        self.length, self.start = lengths, np.concatenate([[0], np.cumsum(lengths)[:-1]])
        self.bytes = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(size)), np.uint8)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        h = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; ``NONE`` where a side is padding (-1) or the pair is unknown."""
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        key = np.where((left < 0) | (right < 0), np.int64(-2), key)
        slot, shape = self._slot(key.ravel()), key.shape
        key = key.ravel()
        seen = self.keys[slot]
        out = np.where(seen == key, self.values[slot], NONE)
        todo = np.flatnonzero((seen != key) & (seen >= 0) & (key >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)
            seen = self.keys[slot[todo]]
            hit = seen == key[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (seen >= 0)]
        return out.reshape(shape)


def _merge_rows(tokens: np.ndarray, table: PairTable, out: list, names: np.ndarray) -> None:
    """Encodes the rows of a padded matrix; ``out[name]`` gets each row's ids."""
    ranks = table.rank(tokens[:, :-1], tokens[:, 1:])
    while len(tokens):
        at = ranks.argmin(axis=1)
        best = ranks[np.arange(len(tokens)), at]
        done = best == NONE
        if done.any():
            for name, row in zip(names[done].tolist(), tokens[done]):
                out[name] = row[row >= 0]
            go = ~done
            tokens, ranks, at, best, names = tokens[go], ranks[go], at[go], best[go], names[go]
            if not len(tokens):
                return
        n, width = tokens.shape
        row = np.arange(n)
        tokens[row, at] = best
        keep = np.ones((n, width), bool)
        keep[row, at + 1] = False
        tokens = tokens[keep].reshape(n, width - 1)
        if width == 2:
            for name, x in zip(names.tolist(), tokens):
                out[name] = x
            return
        keep = np.ones((n, width - 1), bool)
        keep[row, at] = False
        ranks = ranks[keep].reshape(n, width - 2)
        near = at < width - 2
        ranks[row[near], at[near]] = table.rank(tokens[row[near], at[near]], tokens[row[near], at[near] + 1])
        near = at > 0
        ranks[row[near], at[near] - 1] = table.rank(tokens[row[near], at[near] - 1], tokens[row[near], at[near]])


def _merge_long(tokens: np.ndarray, table: PairTable) -> np.ndarray:
    """One long row: every occurrence of the least pair at once, or the leftmost alone where order could matter."""
    ranks = table.rank(tokens[:-1], tokens[1:])
    while len(ranks) and (best := ranks.min()) != NONE:
        at = np.flatnonzero(ranks == best)
        run = np.concatenate([[True], np.diff(at) != 1])
        start = at[np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))]
        at = at[(at - start) % 2 == 0]
        merged = tokens.copy()
        merged[at] = best
        keep = np.ones(len(tokens), bool)
        keep[at + 1] = False
        after = at[at + 2 < len(tokens)]
        before = at[at > 0]
        left = np.where(keep[before - 1], merged[before - 1], best)
        made = np.full(len(before), best, np.int32), np.full(len(after), best, np.int32)
        if len(at) > 1 and min(table.rank(left, made[0]).min(initial=NONE), table.rank(made[1], tokens[after + 2]).min(initial=NONE)) < best:
            keep = np.ones(len(tokens), bool)
            keep[at[0] + 1] = False
            merged = tokens.copy()
            merged[at[0]] = best
        tokens = merged[keep]
        ranks = table.rank(tokens[:-1], tokens[1:])
    return tokens


def encode_pieces(pieces: list[bytes], table: PairTable) -> list[np.ndarray]:
    """Ids of each piece."""
    out: list = [np.zeros(0, np.int32)] * len(pieces)
    size = np.array([len(p) for p in pieces], np.int64)
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = _merge_long(table.byte_id[np.frombuffer(pieces[i], np.uint8)], table)
    low = 0
    for high in (1, 2, 4, 6, 8, 12, 16, 24, 32, 64, LONG):
        rows = np.flatnonzero((size > low) & (size <= high))
        low = high
        step = max(1, CELLS // high)
        for part in (rows[i : i + step] for i in range(0, len(rows), step)):
            blob = np.frombuffer(b"".join(pieces[i].ljust(high, b"\0") for i in part.tolist()), np.uint8).reshape(-1, high)
            tokens = table.byte_id[blob]
            tokens[np.arange(high) >= size[part][:, None]] = -1
            if high == 1:
                for i, x in zip(part.tolist(), tokens):
                    out[i] = x
            else:
                _merge_rows(tokens, table, out, part)
    return out


class _Index(dict):
    """Piece -> its number in order of first sight; ``new`` lists those not yet encoded."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        number = self[piece] = len(self)
        self.new.append(piece)
        return number


class _Pieces:
    """Pieces seen by this Python worker with their ids in one pool."""

    def __init__(self, table: PairTable):
        self.table = table
        self.clear()

    def clear(self) -> None:
        self.index = _Index()
        self.ids, self.start, self.length = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all lists of pieces, and the offsets of the lists."""
        if len(self.index) > MEMORY_PIECES:
            self.clear()
        get = self.index.__getitem__
        which = np.concatenate([np.zeros(0, np.int64), *(np.fromiter(map(get, x), np.int64, len(x)) for x in lists)])
        if new := self.index.new:
            self.index.new = []
            ids = encode_pieces([p.encode("utf-8") for p in new], self.table)
            length = np.array([len(x) for x in ids], np.int64)
            start = len(self.ids) + np.concatenate([[0], np.cumsum(length)[:-1]])
            self.ids = np.concatenate([self.ids, *ids]).astype(np.int32)
            self.start, self.length = np.concatenate([self.start, start]), np.concatenate([self.length, length])
        length = self.length[which]
        end = np.concatenate([[0], np.cumsum(length)])
        flat = self.ids[np.arange(end[-1]) + np.repeat(self.start[which] - end[:-1], length)]
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        return flat, end[bounds]


_tables: dict[bytes, PairTable] = {}


def _table(blob) -> PairTable:
    """The worker's table of a broadcast rank file."""
    if (key := blob.value[0]) not in _tables:
        _tables.clear()
        _tables[key] = PairTable(dict(zip(blob.value[1], blob.value[2])))
    return _tables[key]


def _send(df: DataFrame, path: str):
    """The vocabulary as a broadcast: its size is that of one rank file, whatever the corpus."""
    ranks = read_ranks(path)
    return df.sparkSession.sparkContext.broadcast((path.encode(), list(ranks), list(ranks.values())))


def encode(df: DataFrame, text: str, path: str, pattern: str) -> DataFrame:
    """Adds ``ids`` (array of int): each match of ``pattern`` encoded by the ranks at ``path``, no special tokens."""
    return _encode(df, text, path, pattern, False)


def encode_and_decode(df: DataFrame, text: str, path: str, pattern: str) -> DataFrame:
    """``encode`` and ``decode`` of its ids in one pass: adds ``ids`` and ``decoded``."""
    return _encode(df, text, path, pattern, True)


def _encode(df: DataFrame, text: str, path: str, pattern: str, back: bool) -> DataFrame:
    names = spare(df.columns, "ids", "decoded")[: 1 + back]
    fields = [T.StructField(names[0], T.ArrayType(T.IntegerType(), False), False), *(T.StructField(n, T.BinaryType(), False) for n in names[1:])]
    blob = _send(df, path)

    def run(batches):
        table = _table(blob)
        pieces, find = _Pieces(table), regex.compile(pattern).findall
        for batch in batches:
            for part, texts in slices(batch, text):
                flat, off = pieces.encode([find(t) for t in texts])
                columns = [pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(flat, pa.int32()))]
                if back:
                    columns.append(_decoded(table, flat.astype(np.int64), off))
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*part.schema.names, *names])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *fields]))


def _decoded(table: PairTable, flat: np.ndarray, off: np.ndarray) -> pa.Array:
    """The bytes of each list of ids."""
    if len(flat) and (flat.min() < 0 or flat.max() >= len(table.length) or not table.length[flat].all()):
        raise ValueError("an id that the vocabulary does not hold")
    length = table.length[flat]
    end = np.concatenate([[0], np.cumsum(length)])
    data = table.bytes[np.arange(end[-1]) + np.repeat(table.start[flat] - end[:-1], length)]
    at = end[off].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(data.tobytes())])


def decode(df: DataFrame, ids: str, path: str) -> DataFrame:
    """Adds ``decoded`` (binary): the bytes of the ids; null ids give no bytes, an unknown id is an error."""
    name = spare(df.columns, "decoded")[0]
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.BinaryType(), False)])
    blob = _send(df, path)

    def run(batches):
        table = _table(blob)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                lists = part.column(part.schema.get_field_index(ids))
                size = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                column = _decoded(table, flat, np.concatenate([[0], np.cumsum(size)]).astype(np.int64))
                yield pa.RecordBatch.from_arrays([*part.columns, column], [*part.schema.names, name])

    return df.mapInArrow(run, schema)
