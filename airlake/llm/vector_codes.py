"""Vector code compression: parts of vectors named by codebook entries, exactly, in integers."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlake.llm.common import Scratch
from airlake.llm.vectors import integers, parcel, schema, summed, usable

#: Parts that are compared at once, and coefficients between two eliminations.
BLOCK, STEP = 512, 4
MOST = 2**62


def _butterflies(rows: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row, in the order of its recursion."""
    n, size = rows.shape
    h = 1
    while h < size:
        pairs = rows.reshape(n, size // (2 * h), 2, h)
        rows = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], 2).reshape(n, size)
        h *= 2
    return rows


def sequency_order(width: int) -> np.ndarray:
    """Coefficients of parts of ``width``, padded to a power of two, by the sign changes of their basis functions."""
    size = 1 << max(0, width - 1).bit_length()
    basis = _butterflies(np.eye(size, dtype=np.int64))
    return np.argsort((basis[:, 1:] != basis[:, :-1]).sum(1), kind="stable")


def transform(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Integer coefficients of zero-padded rows in sequency order; Python integers where a long might not hold them."""
    size = len(order)
    top = int(abs(rows).max()) if rows.size else 0
    wide = np.zeros((len(rows), size), np.int64 if top < MOST // size else object)
    wide[:, : rows.shape[1]] = rows
    return _butterflies(wide)[:, order]


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, scaled squared distance) of the nearest entry, ties to the lower index; both come as coefficients.

    The squared differences of all coefficients add up to the squared distance times their number. They are added up from the
    lowest sequency on, where smooth vectors differ most. The entry that is nearest so far gives a bound for its part, and
    entries that pass the bound leave; what is left at the end is compared in full. Equal entries never leave each other behind.
    """
    size = parts.shape[1]
    top = max(int(abs(parts).max()), int(abs(entries).max()))
    if size * (2 * top) ** 2 >= MOST:
        parts, entries = parts.astype(object), entries.astype(object)
    head = min(STEP, size)
    partial = (parts[:, None, 0] - entries[None, :, 0]) ** 2
    for k in range(1, head):
        partial = partial + (parts[:, None, k] - entries[None, :, k]) ** 2
    bound = ((parts - entries[partial.argmin(1)]) ** 2).sum(1)
    row, entry = np.nonzero(partial <= bound[:, None])
    total = partial[row, entry]
    for start in range(head, size, STEP):
        for k in range(start, min(start + STEP, size)):
            total = total + (parts[row, k] - entries[entry, k]) ** 2
        stay = total <= bound[row]
        row, entry, total = row[stay], entry[stay], total[stay]
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    best = np.minimum.reduceat(total, first)
    hits = np.flatnonzero(total == np.repeat(best, np.diff(np.r_[first, len(row)])))
    _, lead = np.unique(row[hits], return_index=True)
    return entry[hits][lead], best


def _add(sums: dict, counts: dict, part: int, rows: np.ndarray, code: np.ndarray) -> None:
    by = np.argsort(code, kind="stable")
    names, first, n = np.unique(code[by], return_index=True, return_counts=True)
    exact = rows if not rows.size or int(abs(rows).max()) < MOST // len(rows) else rows.astype(object)
    for name, total, k in zip(names.tolist(), np.add.reduceat(exact[by], first, axis=0).tolist(), n.tolist(), strict=True):
        before = sums.get((part, name))
        sums[part, name] = total if before is None else [a + b for a, b in zip(before, total, strict=True)]
        counts[part, name] = counts.get((part, name), 0) + k


def compress_vectors(vectors: DataFrame, label: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4) -> DataFrame:
    """One row per kept vector: vec_id, code, error, label_error, codebooks_sha256.

    Rows whose vector is null, or holds null or non-finite components, are dropped. A component x becomes floor(1024 x), with |x| above 2**52
    counted as 2**52; shorter vectors end in zeros, up to the longest length and the next multiple of ``parts``. Each of the ``parts`` positions has a
    codebook of the parts of the ``entries`` (256 at most) smallest vec_ids: nulls come last, rows of one vec_id by their components. ``rounds`` times, every part goes to its
    nearest entry and every entry that was used becomes the floored mean of its parts; then parts are coded. code has two hex digits for each part. Errors
    are squared distances; one beyond a long is null, as is a label_error (over equal labels, nulls together) that contains it or is beyond a long. Rows
    that repeat a vec_id are vectors of their own; an empty table gives an empty result; empty vectors have parts without components, at distance 0.

    Tasks sum the parts of each entry before anything is shuffled; the driver holds codebooks and sums only, 256 rows for each part.
    """
    scratch = Scratch(vectors.sparkSession)
    kept = scratch.keep(usable(vectors).select("vec_id", F.col(label).alias("label"), "embedding"))
    kind = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    longest = kept.agg(F.max(F.size("embedding"))).first()[0] or 0
    length = -(-longest // parts)
    width, order = length * parts, sequency_order(max(1, length))
    seeds = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").collect()
    first = integers(pa.array([r[0] for r in seeds], pa.list_(pa.float64())), width) if seeds else np.zeros((1, width), np.int64)
    books = [first[:, p * length : (p + 1) * length] for p in range(parts)]

    def coded(column, books, coefficients):
        """(parts, codes, scaled distances) of blocks of a batch."""
        x = integers(column, width)
        for start in range(0, len(x), BLOCK):
            rows = [x[start : start + BLOCK, p * length : (p + 1) * length] for p in range(parts)]
            found = [nearest(transform(r, order), c) for r, c in zip(rows, coefficients, strict=True)]
            yield rows, [f[0] for f in found], [f[1] for f in found]

    def gather(books, coefficients):
        def run(batches):
            sums: dict = {}
            counts: dict = {}
            for batch in batches:
                for rows, codes, _ in coded(batch.column("embedding"), books, coefficients):
                    for p in range(parts):
                        _add(sums, counts, p, rows[p], codes[p])
            if sums:
                # the count goes in front of the sums
                yield parcel(list(sums), [[counts[k], *s] for k, s in sums.items()], ["part", "entry"], pa.decimal128(38, 0))

        return run

    for _ in range(rounds if seeds else 0):
        task = gather(books, [transform(b, order) for b in books])
        tasks = kept.select("embedding").mapInArrow(task, schema(["part", "entry"], "decimal(38,0)"))
        for (p, e), (n, *s) in summed(tasks, ["part", "entry"], length + 1).items():
            books[p] = books[p].copy()
            books[p][e] = [int(v) // int(n) for v in s]
    digest = hashlib.sha256(",".join(str(v) for b in books for row in b.tolist() for v in row).encode() if seeds else b"").hexdigest()
    coefficients = [transform(b, order) for b in books]
    hexes = np.array([f"{i:02x}" for i in range(256)], object)

    def name(batches):
        for batch in batches:
            codes, errors = [], []
            for _, code, total in coded(batch.column("embedding"), books, coefficients):
                codes += ["".join(t) for t in zip(*(hexes[c] for c in code), strict=True)]
                errors += [sum(t) // len(order) for t in zip(*(t.tolist() for t in total), strict=True)]
            errors = [e if e < 2**63 else None for e in errors]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], ["vec_id", "label", "code", "error"])

    named = scratch.keep(kept.mapInArrow(name, f"vec_id {kind['vec_id']}, label {kind['label']}, code string, error bigint"))
    total = F.expr("try_cast(sum(cast(error AS decimal(38, 0))) AS bigint)")
    by_label = scratch.keep(named.groupBy("label").agg(F.when(F.count("error") == F.count(F.lit(1)), total).alias("label_error")))
    scratch.drop(kept)
    same = F.col("n.label").eqNullSafe(F.col("l.label"))
    return named.alias("n").join(by_label.alias("l"), same).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
