"""Packing by power-of-two decomposition: sequences that never cross documents and need no padding."""

from __future__ import annotations

import os
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlake.llm.common import empty_if_null, lean, slices

_BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Small letters that no normal form changes.
_SMALL = "a-z\u00df-\u00f6\u00f8-\u00ff\u0430-\u045f"
#: Runs of characters that are not Unicode white space; a word of small letters is parted from the mark, but an apostrophe, that follows it.
CHUNK = re.compile(rf"[{_SMALL}]++(?=[{_BLANK}!-&(-/:-@\[-`{{-~]|\Z)|[^{_BLANK}]+")
_WORD = re.compile(rf"[{_SMALL}]+")
#: The characters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the rest from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = dict(zip([b for b in range(256) if b not in _SHOWN], range(256, 512), strict=False))
#: Marks that can compose with an ASCII letter.
_MARK = re.compile("[\u0300-\u036f]")


def chunks_of(text: str, lowered: str) -> list[str]:
    """The parts of a text whose ids, joined, are the ids of the whole text under a lower-casing tokenizer.

    ASCII letters are ``lowered``, so that "Word" and "word" are one chunk, unless the text has combining
    marks: some compose with a small letter only.
    """
    return CHUNK.findall(text if _MARK.search(text) else lowered)


class ChunkIds(dict):
    """Token ids, as little-endian 32-bit bytes, of texts without white space.

    Two generations bound the memory: when the young one is full it becomes the old one, from which what is met
    again returns.
    """

    limit, longest = 200_000, 64

    def __init__(self, tokenizer: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer)
        self.model = self.tokenizer.model
        #: Texts of the tokenizer's own tokens, which it finds before anything else.
        self.added = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)")
        self.old: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        data = self.old.get(chunk)
        if data is None:
            # A word of small letters is one word of the model, without normal forms and splits.
            if _WORD.fullmatch(chunk):
                shown = chunk if chunk.isascii() else chunk.encode().decode("latin-1").translate(_BYTES)
                ids = [t.id for t in self.model.tokenize(shown)]
            else:
                ids = self.whole(chunk)
            data = struct.pack(f"<{len(ids)}I", *ids)
        if len(chunk) <= self.longest:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[chunk] = data
        return data

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def of(self, text: str) -> bytes:
        """Ids of a whole text."""
        lowered = text.encode().lower().decode()
        # In other letters, too: the tokenizer's own tokens are not looked for in small ones, but a lowered chunk would be taken for one.
        if self.added.search(text) or self.added.search(lowered):
            return np.array(self.whole(text), "<u4").tobytes()
        return b"".join(map(self.__getitem__, chunks_of(text, lowered)))


def pieces(sizes: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, length) of ``sizes`` ids each cut into powers of two, the largest first, none above ``longest``."""
    whole, rest = sizes // longest, sizes % longest
    rows = [np.repeat(np.arange(len(sizes)), whole)]
    starts = [(np.arange(len(rows[0])) - np.repeat(np.cumsum(whole) - whole, whole)) * longest]
    lengths = [np.full(len(rows[0]), longest)]
    for bit in range(longest.bit_length() - 1):
        at = np.flatnonzero(rest >> bit & 1)
        rows.append(at)
        starts.append(sizes[at] - rest[at] % (2 << bit))
        lengths.append(np.full(len(at), 1 << bit))
    row, start, length = (np.concatenate(x) for x in (rows, starts, lengths))
    order = np.lexsort((start, row))
    return row[order], start[order], length[order]


def pack_documents(docs: DataFrame, tokenizer: str, longest: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per sequence: doc_id, start, length, ids, doc_tokens, bucket, sequence_id, offset.

    Every document (null text: empty) is tokenized whole, as ``encode(text, add_special_tokens=False)`` does: strings of
    the tokenizer's own tokens in a text are these tokens. ``end_id`` follows. Its ids
    are cut into pieces of 2^k <= ``longest`` ids, the binary digits of their number after as many pieces of
    ``longest`` as fit. A piece is a sequence of its own: no sequence holds two documents, none is
    padded, and ``bucket`` = k names the ones of equal length that a batch can take together
    (``write_buckets``). ids is a binary of little-endian unsigned 32-bit integers. sequence_id is unique and
    ordered by bucket; offset is 0. Rows are packed one by one, so null or repeated doc_ids are documents of
    their own. An empty table gives an empty result; further columns are not read.

    ``tokenizer`` is the path of a tokenizers file that every executor can read. It must lower letters, drop white
    space and part letters from punctuation, as the word tokenizer does: chunks are encoded once and remembered.
    """
    if longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        cache, seen = ChunkIds(tokenizer), 0
        tail = end_id.to_bytes(4, "little")
        base = TaskContext.get().partitionId() << 34
        for batch in batches:
            for part in slices(batch, 1_500_000):
                coded = [cache.of(text) + tail for text in part.column("text").to_pylist()]
                sizes = np.array([len(data) // 4 for data in coded])
                row, start, length = pieces(sizes, longest)
                bucket = np.log2(length).astype(np.int64)
                ends = pa.array(np.concatenate([[0], np.cumsum(4 * length)]).astype(np.int32))
                ids = pa.Array.from_buffers(pa.binary(), len(row), [None, ends.buffers()[1], pa.py_buffer(b"".join(coded))])
                number = (bucket << 58) + base + seen + np.arange(len(row))
                seen += len(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(row)), pa.array(start.astype(np.int64)), pa.array(length.astype(np.int64)), ids,
                        pa.array(sizes[row].astype(np.int64)), pa.array(bucket.astype(np.int32)), pa.array(number), pa.array(np.zeros(len(row), np.int64)),
                    ],
                    ["doc_id", "start", "length", "ids", "doc_tokens", "bucket", "sequence_id", "offset"],
                )

    return lean(docs).select("doc_id", empty_if_null("text").alias("text")).mapInArrow(
        run,
        f"doc_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, bucket int, sequence_id bigint, offset bigint",
    )


def write_buckets(packed: DataFrame, path: str) -> None:
    """Write sequences as Parquet, one folder for each length, so that a loader batches equal lengths.

    All rows and columns of ``pack_documents`` are written, null doc_ids too; an empty table writes no folder. A path that exists is an error.
    """
    packed.write.partitionBy("bucket").parquet(path)


def with_ids_crc(packed: DataFrame) -> DataFrame:
    """The CRC-32 of each sequence's ids in place of the ids."""
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
