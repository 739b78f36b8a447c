"""Byte-level BPE with a segment tree over byte positions."""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from airlake.llm.common import empty_if_null, lean, slices

_NONE = 1 << 62


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken file: base64 bytes and rank on each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the pair of least rank merges first, of equal ranks the leftmost.

    A leaf of the segment tree holds (rank, position) of the pair that starts at its byte, packed in one
    integer; an inner node holds the least of its children, so the root is the leftmost minimum. A merge
    changes the pairs at its own and its left neighbour's start and removes the right part: three point updates of
    logarithmic cost.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    size = 1 << (n - 1).bit_length()
    shift = size.bit_length()
    mask = (1 << shift) - 1
    tree = [_NONE] * (2 * size)
    get = ranks.get
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            tree[size + i] = rank << shift | i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, value: int) -> None:
        i += size
        tree[i] = value
        while i > 1:
            a, b = tree[i], tree[i ^ 1]
            least = a if a < b else b
            i >>= 1
            if tree[i] == least:
                return
            tree[i] = least

    while tree[1] != _NONE:
        at = tree[1] & mask
        gone = after[at]
        end = after[at] = after[gone]
        put(gone, _NONE)
        if end < n:
            before[end] = at
            rank = get(piece[at : after[end]])
            put(at, _NONE if rank is None else rank << shift | at)
        else:
            put(at, _NONE)
        left = before[at]
        if left >= 0:
            rank = get(piece[left:end])
            put(left, _NONE if rank is None else rank << shift | left)
    out, at = [], 0
    while at < n:
        out.append(ranks[piece[at : after[at]]])
        at = after[at]
    return out


class Pairs:
    """Ranks of pairs of neighbouring tokens, by their ids: the ways in which a token's bytes fall into two tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        found = sorted(
            (left << 32 | right, rank)
            for token, rank in ranks.items()
            for k in range(1, len(token))
            if (left := ranks.get(token[:k])) is not None and (right := ranks.get(token[k:])) is not None
        )
        self.keys, self.ranks = (np.array([x[k] for x in found] or [-1], np.int64) for k in (0, 1))
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, ``_NONE`` where it has none."""
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], _NONE)


def merge_pieces(pieces: list[bytes], pairs: Pairs, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, how many of each piece) of pieces of at most ``size`` bytes, ``size`` a power of two: as ``merge_piece``, all pieces at once.

    Every piece has its own segment tree, one row of a matrix; a step takes the root of each tree that has a pair left and
    updates the three points in it.
    """
    n, shift = len(pieces), size.bit_length()
    length = np.array([len(p) for p in pieces])
    ids = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(n, size)
    ids = pairs.single[ids]
    alive = np.arange(size)[None, :] < length[:, None]
    after = np.tile(np.arange(1, size + 2), (n, 1))
    before = np.tile(np.arange(-1, size), (n, 1))
    tree = np.full((n, 2 * size), _NONE)
    first = pairs.rank(ids[:, :-1], ids[:, 1:])
    live = (first != _NONE) & alive[:, 1:]
    tree[:, size : 2 * size - 1][live] = (first << shift | np.arange(size - 1)[None, :])[live]
    for level in range(size.bit_length() - 2, -1, -1):
        low = 1 << level
        tree[:, low : 2 * low] = np.minimum(tree[:, 2 * low : 4 * low : 2], tree[:, 2 * low + 1 : 4 * low : 2])
    flat = tree.reshape(-1)

    def put(rows: np.ndarray, at: np.ndarray, value) -> None:
        base, at = rows * (2 * size), at + size
        flat[base + at] = value
        while at[0] > 1:
            twin = base + (at & ~1)
            at = at >> 1
            flat[base + at] = np.minimum(flat[twin], flat[twin + 1])

    rows = np.flatnonzero(tree[:, 1] != _NONE)
    while len(rows):
        top = tree[rows, 1]
        at = top & ((1 << shift) - 1)
        gone = after[rows, at]
        end = after[rows, gone]
        ids[rows, at] = top >> shift
        alive[rows, gone] = False
        after[rows, at] = end
        before[rows, end] = at
        put(rows, gone, _NONE)
        value = np.full(len(rows), _NONE)
        some = np.flatnonzero(end < length[rows])
        rank = pairs.rank(ids[rows[some], at[some]], ids[rows[some], end[some]])
        value[some] = np.where(rank == _NONE, _NONE, rank << shift | at[some])
        put(rows, at, value)
        left = before[rows, at]
        some = np.flatnonzero(left >= 0)
        if len(some):
            here, left = rows[some], left[some]
            rank = pairs.rank(ids[here, left], ids[here, at[some]])
            put(here, left, np.where(rank == _NONE, _NONE, rank << shift | left))
        rows = rows[tree[rows, 1] != _NONE]
    return ids[alive], alive.sum(1)


class PieceIds(dict):
    """Ids of pieces of text as little-endian 32-bit bytes; short ones are remembered, in two bounded generations.

    New pieces of up to 64 bytes are merged together, by the power of two that holds them, longer ones one by one.
    """

    limit, longest, together = 300_000, 64, 20_000

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.pairs = ranks, Pairs(ranks)
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        return np.array(merge_piece(piece.encode("utf-8"), self.ranks), "<u4").tobytes()

    def learn(self, rows: list[list[str]]) -> None:
        """Make sure that every short piece of ``rows`` is known."""
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        new = set().union(*rows).difference(self)
        classes: dict[int, tuple[list[str], list[bytes]]] = {}
        for piece in new:
            known = self.old.get(piece)
            if known is None:
                data = piece.encode("utf-8")
                whole = self.ranks.get(data)
                if whole is None:
                    if len(data) <= self.longest:
                        names, texts = classes.setdefault(1 << (len(data) - 1).bit_length(), ([], []))
                        names.append(piece)
                        texts.append(data)
                    continue
                known = whole.to_bytes(4, "little")
            self[piece] = known
        for size, (names, texts) in classes.items():
            for k in range(0, len(names), self.together):
                ids, counts = merge_pieces(texts[k : k + self.together], self.pairs, size)
                data, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
                self.update(zip(names[k : k + self.together], map(data.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))


def _column(cells: list[bytes]) -> pa.Array:
    ends = pa.array(np.cumsum([0, *map(len, cells)]).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(cells), [None, ends.buffers()[1], pa.py_buffer(b"".join(cells))])


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) of every document; ids is a binary of little-endian unsigned 32-bit integers.

    Whole texts (null: empty) are split by ``pattern``; every match is merged on its own by the ranks, without special
    tokens. Rows are encoded one by one: null or repeated doc_ids are documents of their own. An empty
    table gives an empty result; further columns are not read. ``ranks_path`` is a tiktoken file that
    every executor can read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import regex

        cache, split = PieceIds(load_ranks(ranks_path)), regex.compile(pattern).findall
        get = cache.__getitem__
        for batch in batches:
            for part in slices(batch, 1_500_000):
                rows = [split(text) for text in part.column("text").to_pylist()]
                cache.learn(rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), _column([b"".join(map(get, row)) for row in rows])], ["doc_id", "ids"])

    return lean(docs).select("doc_id", empty_if_null("text").alias("text")).mapInArrow(run, f"doc_id {kind}, ids binary")


def decode_documents(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, ids, decoded): the bytes that the ids stand for. An id without a rank is an error; null ids count as none.

    Rows are decoded one by one, whatever their doc_id. An empty table gives an empty result; further columns are not read.
    """
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches):
        ranks = load_ranks(ranks_path)
        table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        blob, sizes = np.frombuffer(b"".join(table), np.uint8), np.array([len(t) for t in table])
        begins = np.cumsum(sizes) - sizes
        for batch in batches:
            for part in slices(batch, 2_000_000, column="ids"):
                column = part.column("ids").to_pylist()
                ids = np.frombuffer(b"".join(x or b"" for x in column), "<u4")
                if len(ids) and (ids.max() >= len(table) or not sizes[ids].all()):
                    raise ValueError("an id has no rank")
                size = sizes[ids]
                ends = np.cumsum(size)
                data = blob[np.repeat(begins[ids] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
                rows = np.cumsum([0, *(len(x or b"") // 4 for x in column)])
                cuts = pa.array(np.concatenate([[0], ends])[rows].astype(np.int32))
                decoded = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, cuts.buffers()[1], pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), decoded], ["doc_id", "ids", "decoded"])

    return lean(encoded).select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids binary, decoded binary")
