"""Repeated paragraphs and passages across documents."""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airlake.llm import shingles as S
from airlake.llm.common import Scratch, empty_if_null, lean, slices, tune_bands
from airlake.llm.near import near_classes

ROWS = 3
#: Words of the shortest passage that is reported; words of a block and of the seed it starts with; seeds from which one is chosen.
#: PASSAGE words hold a block, wherever they stand.
PASSAGE, SIZE, SEED = 24, 12, 6
CHOICE = PASSAGE - SIZE + 1
#: Words between blocks of one chain.
GAP = 64
#: Lines of fewer words are too common to be removed.
FLOOR = 25

#: Signs beyond ASCII that are not part of words.
_SIGNS = re.compile(r"[^\w\x00-\x7f]+")
_GOLD, _SILVER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)


#: Bytes of words once other characters are blanks: ASCII letters in lower case, digits, underscores, and what is beyond ASCII.
_INSIDE = np.array([b >= 128 or chr(b).isalnum() or b == 95 for b in range(256)])
#: Longest word, in bytes, whose hash is a sum of table cells; bytes hashed at once.
_SHORT, _AT_ONCE = 64, 1 << 17
_CELLS = S.mix(np.arange(1, 256 * _SHORT + 1, dtype=np.uint64) * _GOLD)


def _hashes(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words at ``begin``: sums of a random number for each byte and its place in the word."""
    out = np.zeros(len(begin), np.uint64)
    for k in np.flatnonzero(size > _SHORT).tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[begin[k] : begin[k] + size[k]].tobytes())
    short = np.flatnonzero(size <= _SHORT)
    until, at = np.cumsum(size[short]), 0
    while at < len(short):
        done = until[at - 1] if at else 0
        some = short[at : np.searchsorted(until, done + _AT_ONCE, "right")]
        n, first = size[some], until[at : at + len(some)] - size[some] - done
        place = np.arange(n.sum()) - np.repeat(first, n)
        out[some] = S.mix(np.add.reduceat(_CELLS[place * 256 + data[np.repeat(begin[some], n) + place]], first))
        at += len(some)
    return out


def _lower(text: str) -> str:
    """A text in lower case with blanks for signs beyond ASCII; its words do not change with what stands around them."""
    if not text.isascii():
        # Signs go first: letters such as a dotted capital I become two characters, of which the second is a sign only where it stands alone.
        text = _SIGNS.sub(" ", text)
        # The sigma at a word's end has a form of its own, which signs behind it can hide.
        text = re.sub(r"\w+", lambda m: m[0].lower(), text) if "Σ" in text else text
    return text.lower()


def _words(texts: list[str]):
    """Word hashes of all texts, the place where each text begins, and a number that changes with text or line.

    Words are hashed together as bytes.
    """
    plain = [_lower(text).encode("utf-8", "surrogatepass") for text in texts]
    data = np.frombuffer(b"\0".join(plain) + b"\0", np.uint8)
    inside = _INSIDE[data]
    turns = np.flatnonzero(np.diff(inside, prepend=False))
    begin, size = turns[::2], turns[1::2] - turns[::2]
    texts_at = np.concatenate([[0], np.cumsum(np.array([len(p) + 1 for p in plain], np.int64))])
    starts = np.searchsorted(begin, texts_at)
    owner = np.repeat(np.arange(len(texts)), np.diff(starts))
    return _hashes(data, begin, size), starts, np.searchsorted(np.flatnonzero(data == 10), begin) + owner


def _sets(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int):
    """(owner, shingle, 1) of the shingle sets of runs of words that hold ``width`` words at least."""
    counts = sizes - width + 1
    owner = np.repeat(np.arange(len(starts)), counts)
    first = np.repeat(starts, counts) + np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    value = np.zeros(len(owner), np.uint64)
    for k in range(width):
        value = S.mix(value * _GOLD + words[first + k])
    if not len(owner):
        return owner, value, np.zeros(0, np.int64)
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])])
    return owner[new], value[new], np.ones(int(new.sum()), np.int64)


def _blocks(words: np.ndarray, starts: np.ndarray):
    """(place, key, check, text) of content-defined blocks: of every CHOICE seeds in a row in a text the one with the least hash starts one."""
    n = max(0, len(words) - SEED + 1)
    value, check = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for k in range(SEED if n else 0):
        value = value * _GOLD + words[k : k + n]
        check = check * _SILVER + words[k : k + n]
    value = S.mix(value)
    span = CHOICE + SEED - 1
    if len(words) < span:
        return (np.zeros(0, np.int64),) * 4
    ends = np.repeat(starts[1:], np.diff(starts))
    here = np.flatnonzero(np.arange(len(words) - span + 1) + span <= ends[: len(words) - span + 1])
    views = np.lib.stride_tricks.sliding_window_view(value, CHOICE)
    at = np.unique(np.concatenate([views[here[k : k + 200_000]].argmin(1) + here[k : k + 200_000] for k in range(0, len(here), 200_000)] or [here]))
    at = at[at + SIZE <= ends[at]]
    key = S.mix(value[at] * _GOLD + value[at + SEED])
    return at, key.view(np.int64), (S.mix(check[at] * _SILVER + check[at + SEED]) >> np.uint64(33)).astype(np.int32), np.searchsorted(starts, at, "right") - 1


def sketches(docs: DataFrame, bands: int, min_words: int, width: int = 5) -> DataFrame:
    """(doc, paragraphs, blocks) of rows (doc, text): lines of ``min_words`` or more with MinHash bands, and content-defined blocks."""
    kind = docs.schema["doc"].dataType.simpleString()

    def lists(owner: np.ndarray, n: int, names: list[str], columns: list[pa.Array]) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(columns, names))

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1_500_000):
                rows = part.num_rows
                words, starts, line = _words(part.column("text").to_pylist())
                cuts = np.flatnonzero(np.diff(line)) + 1
                begin = np.concatenate([[0], cuts]).astype(np.int64)[: len(words)]
                sizes = np.diff(np.append(begin, len(words)))
                wide = sizes >= max(min_words, width)
                begin, sizes = begin[wide], sizes[wide]
                n = len(begin)
                owner, value, count = _sets(words, begin, sizes, width)
                sig = S.min_hash(owner, value, n, bands * ROWS)
                buckets = S.band_hashes(sig, bands, ROWS)
                text = np.searchsorted(starts, begin, "right") - 1
                paragraphs = lists(text, rows, ["start", "words", "key", "buckets", "sig"], [
                    pa.array((begin - starts[text]).astype(np.int32)), pa.array(sizes.astype(np.int32)),
                    pa.array(S.content_keys(owner, value, count, n), pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(buckets.reshape(-1))),
                    S.fixed_cells(sig.astype(np.uint8)),
                ])
                at, key, check, text = _blocks(words, starts)
                blocks = lists(text, rows, ["key", "check", "pos"], [pa.array(key.view(np.int64)), pa.array(check.astype(np.int32)), pa.array((at - starts[text]).astype(np.int32))])
                yield pa.RecordBatch.from_arrays([part.column("doc"), paragraphs, blocks], ["doc", "paragraphs", "blocks"])

    return docs.mapInArrow(
        run,
        f"doc {kind}, paragraphs array<struct<start:int,words:int,key:binary,buckets:array<bigint>,sig:binary>>, "
        "blocks array<struct<key:bigint,check:int,pos:int>>",
    )


def _contents(rows: DataFrame, width: int) -> DataFrame:
    """(key, shingles) of rows (text, wanted array<struct<start, words, key>>); other keys are left out."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1_000_000):
                words, starts, _ = _words(part.column("text").to_pylist())
                wanted = [(starts[i] + w["start"], w["words"], w["key"], starts[i + 1]) for i, ws in enumerate(part.column("wanted").to_pylist()) for w in ws]
                wanted = [w for w in wanted if w[0] + w[1] <= w[3]]
                sets = _sets(words, np.array([w[0] for w in wanted], np.int64), np.array([w[1] for w in wanted], np.int64), width)
                found, packed = S.content_keys(*sets, len(wanted)), S.pack(*sets, len(wanted))
                out = [(f, p) for w, f, p in zip(wanted, found, packed, strict=True) if f == w[2]]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())], ["key", "shingles"])

    return rows.select("text", "wanted").mapInArrow(run, "key binary, shingles binary")


def _regions(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (doc, start, end, reach) with the hashes of the words between, and of up to ``reach`` words on either side."""
    kind = docs.schema["doc"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1_000_000):
                words, texts_at, _ = _words(part.column("text").to_pylist())
                words, wanted = words.astype(np.uint32), part.column("wanted")
                owner = np.repeat(np.arange(part.num_rows), wanted.value_lengths().to_numpy())
                spots = wanted.flatten()
                starts, ends, reaches = (spots.field(c).to_numpy().astype(np.int64) for c in ("start", "end", "reach"))
                low = texts_at[owner] + np.maximum(0, starts - reaches)
                high = np.minimum(texts_at[owner] + ends + reaches, texts_at[owner + 1])
                cells, size = [], 0
                for k, (i, j) in enumerate(zip(low.tolist(), high.tolist(), strict=True)):
                    cells.append(words[i:j].tobytes())
                    size += len(cells[-1])
                    if size > 4_000_000 or k + 1 == len(starts):
                        some = slice(k + 1 - len(cells), k + 1)
                        yield pa.RecordBatch.from_arrays(
                            [
                                part.column("doc").take(pa.array(owner[some])),
                                *(pa.array(x[some].astype(np.int32)) for x in (starts, ends, reaches)), pa.array(cells, pa.binary()),
                            ],
                            ["doc", "start", "end", "reach", "words"],
                        )
                        cells, size = [], 0

    wanted = asked.distinct().groupBy("doc").agg(F.collect_list(F.struct("start", "end", "reach")).alias("wanted"))
    return docs.join(wanted, "doc").select("doc", "text", "wanted").mapInArrow(run, f"doc {kind}, start int, end int, reach int, words binary")


def _grams(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of ``width`` words."""
    n = max(0, len(words) - width + 1)
    value = np.zeros(n, np.uint64)
    for k in range(width if n else 0):
        value = value * _GOLD + words[k : k + n].astype(np.uint64)
    return S.mix(value)


def _same(x: np.ndarray, y: np.ndarray) -> int:
    """How many first words are equal."""
    n, size = min(len(x), len(y)), 64
    while True:
        apart = np.flatnonzero(x[: min(n, size)] != y[: min(n, size)])
        if len(apart):
            return int(apart[0])
        if size >= n:
            return n
        size *= 8


def _flank(x: np.ndarray, y: np.ndarray, gap: int, width: int) -> list[tuple[int, int, int]]:
    """Where equal runs of ``width`` words or more end beyond an equal run: words of one and of the other text, and equal shingles so far.

    x and y are the hashes of runs of ``width`` words on that side of it, nearest first.
    """
    grams, others = x.tolist(), y.tolist()
    common = set(others).intersection(grams)
    if not common:
        return []
    places: dict[int, list[int]] = {}
    for q, g in enumerate(others):
        if g in common:
            places.setdefault(g, []).append(q)
    out, i, j, same = [], 0, 0, 0
    while True:
        for p in range(i, min(i + gap + 1, len(grams))):
            where = places.get(grams[p])
            k = bisect_left(where, j) if where else 0
            if where and k < len(where) and where[k] <= j + gap:
                q = where[k]
                break
        else:
            return out
        while p < len(grams) and q < len(others) and grams[p] == others[q]:
            p, q, same = p + 1, q + 1, same + 1
        i, j = p + width - 1, q + width - 1
        out.append((i, j, same))


def _extend(texts: list[np.ndarray], grams: list[np.ndarray], i: int, j: int, size: int, room: int | None, threshold: float, width: int):
    """(start, end, other start, other end) of the longest span around ``size`` equal words at i of the text and j of the kept one.

    Equal words are taken on both sides, then edited text that ends with equal words, as long as the Jaccard similarity of the
    spans' shingles is ``threshold`` or more. ``room``, if both are in one document, is the number of words between them: the earlier
    run stays whole.
    """
    (a, b), (x, y) = texts, grams
    before, after = _same(a[:i][::-1], b[:j][::-1]), _same(a[i + size :], b[j + size :])
    if room is not None:
        before = min(before, max(0, room))
    core = size + before + after
    # Between runs of fewer than PASSAGE equal words, more than a fifth of the shingles differ: a run carries 1.2 times its length at 0.8.
    far, gap = 2 * PASSAGE + 6 * core // 5, core // 2 + 8
    i, j, end, stop = i - before, j - before, i + size + after, j + size + after
    back = [g[max(0, at - far) : max(0, at - width + 1)][::-1] for g, at in ((x, i), (y, j))]
    ahead = [g[at : at + far - width + 1] for g, at in ((x, end), (y, stop))]
    none, count = (0, 0, 0), core - width + 1
    best = (0, none, none)
    rights = [none, *_flank(*ahead, gap, width)]
    for p in [none, *_flank(*back, gap, width)]:
        for q in rights:
            longer, same = p[0] + q[0], count + p[2] + q[2]
            if longer > best[0] and same >= threshold * (2 * count + longer + p[1] + q[1] - same):
                if room is None or room - before - p[0] >= after + q[1]:
                    best = (longer, p, q)
    _, p, q = best
    return i - p[0], end + q[0], j - p[1], stop + q[1]


def _chains(hits: DataFrame) -> DataFrame:
    """(doc, keep, hits array<struct<pos, other>>) of rows (doc, pos, keep, other): blocks that follow each other in both texts; a document's blocks bound a chain."""
    kind = hits.schema["doc"].dataType.simpleString()

    def turns(docs: pa.StructArray) -> np.ndarray:
        columns = [docs.field(i) for i in range(docs.type.num_fields)]
        return np.any([pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False) for c in columns], 0)

    def run(batches):
        parts: list[pa.RecordBatch] = []  # of the chain that the last batch leaves open
        for batch in batches:
            pair = pa.Table.from_batches([parts[-1].slice(parts[-1].num_rows - 1), batch] if parts else [batch]).combine_chunks().to_batches()[:1]
            for both in pair:
                pos, other = (both.column(c).to_numpy().astype(np.int64) for c in ("pos", "other"))
                new = (np.diff(pos) > SIZE + GAP) | (np.abs(np.diff(pos - other)) > GAP) | turns(both.column("doc")) | turns(both.column("keep"))
                cuts = np.flatnonzero(new) + (0 if parts else 1)
                if len(cuts):
                    yield of([*parts, batch.slice(0, cuts[-1])], [0, *(cuts + sum(p.num_rows for p in parts)).tolist()])
                    parts = []
                parts.append(batch.slice(cuts[-1] if len(cuts) else 0))
        if parts:
            yield of(parts, [0, sum(p.num_rows for p in parts)])

    def of(parts: list[pa.RecordBatch], ends: list[int]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([rows.column("pos"), rows.column("other")], ["pos", "other"]))
        first = pa.array(ends[:-1])
        return pa.RecordBatch.from_arrays([rows.column("doc").take(first), rows.column("keep").take(first), lists], ["doc", "keep", "hits"])

    return (
        hits.select("doc", "keep", "pos", "other").repartition("doc", "keep").sortWithinPartitions("doc", "keep", "pos")
        .mapInArrow(run, f"doc {kind}, keep {kind}, hits array<struct<pos:int,other:int>>")
    )


def _runs(row: np.ndarray, pos: np.ndarray, there: np.ndarray):
    """(row, start, end, other start) of equal runs that blocks of one shift form where they meet, in every row the longest first."""
    order = np.lexsort((there, pos, row))
    row, pos, there = row[order], pos[order], there[order]
    begin = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (np.diff(pos - there) != 0) | (np.diff(pos) > SIZE)])[: len(row)])
    row, start, end, there = row[begin], pos[begin], pos[np.append(begin[1:], len(pos))[: len(begin)] - 1] + SIZE, there[begin]
    order = np.lexsort((start - end, row))
    return row[order], start[order], end[order], there[order]


def _spans(
    runs: list[tuple[int, int, int]], texts: list[np.ndarray], grams: list[np.ndarray], first: int, other: int, alone: bool, threshold: float, width: int
):
    """(start, end, other start, other end) of spans that hold all equal runs of a chain of blocks; the texts begin at words ``first`` and ``other``."""
    out: list[tuple[int, int, int, int]] = []
    for start, end, there in runs:
        if any(s <= start and end <= e for s, e, _, _ in out):
            continue
        size = end - start
        left, right, low, high = _extend(texts, grams, start - first, there - other, size, start - there - size if alone else None, threshold, width)
        if alone:
            high = max(there + size - other, min(high, left + first - other))
        out.append((left + first, right + first, low + other, high + other))
    return [x for x in out if x[1] - x[0] >= PASSAGE]


def _open_grams(here: np.ndarray, there: np.ndarray, bounds: list[np.ndarray], a: np.ndarray, b: np.ndarray):
    """(place, hash) of the runs of PASSAGE words around blocks at ``here`` in a that do not stand around the blocks at ``there`` in b, too.

    ``bounds`` are the least place and the end of each block's text in a, then in b.
    """
    along = np.arange(PASSAGE - SIZE + PASSAGE) - (PASSAGE - SIZE)
    places = [np.zeros(0, np.int64)]
    for k in range(0, len(here), 20_000):
        low, high, least, most = (x[k : k + 20_000, None] for x in bounds)
        x, y = here[k : k + 20_000, None] + along, there[k : k + 20_000, None] + along
        equal = (x >= low) & (x < high) & (y >= least) & (y < most) & (a.take(x, mode="clip") == b.take(y, mode="clip"))
        count = np.cumsum(np.pad(equal, ((0, 0), (1, 0))), 1, dtype=np.int8)
        # Windows that lie in the text, less those of equal words.
        at = x[:, :CHOICE]
        places.append(np.unique(at[(at >= low) & (at + PASSAGE <= high) & (count[:, PASSAGE:] - count[:, :CHOICE] < PASSAGE)]))
    place = np.unique(np.concatenate(places))
    value = np.zeros(len(place), np.uint64)
    for k in range(PASSAGE if len(place) else 0):
        value = value * _GOLD + a[place + k].astype(np.uint64)
    return place, S.mix(value).view(np.int64)


def _grown(docs: DataFrame, chains: DataFrame, threshold: float, width: int, scratch: Scratch) -> DataFrame:
    """(doc, start, end, keep, other, stop, gram): the spans of ``chains`` (doc, keep, hits array<struct<pos, other>>), without a
    gram, and hashes of the runs of PASSAGE words around their blocks that the kept occurrence does not have, without a keep.

    Reaches are powers of two beyond what ``_extend`` can use, so that many copies of a run ask for the same words of the kept one.
    """
    kind = docs.schema["doc"].dataType.simpleString()
    ends = {f"{end}_{name}": getattr(F, f"array_{end}")(F.col(f"hits.{name}")) for name in ("pos", "other") for end in ("min", "max")}
    chains = chains.withColumns(ends).select(
        "doc", F.col("min_pos").alias("start"), (F.col("max_pos") + SIZE).alias("end"),
        "keep", F.col("min_other").alias("other"), (F.col("max_other") + SIZE).alias("stop"), "hits",
    )
    size = F.greatest(F.col("end") - F.col("start"), F.col("stop") - F.col("other"), F.lit(2 * PASSAGE))
    chains = scratch.keep(chains.withColumn("reach", F.pow(F.lit(2.0), F.ceil(F.log2(size * 1.2 + 2 * PASSAGE))).cast("int")))
    asked = chains.select("doc", "start", "end", "reach").unionByName(
        chains.select(F.col("keep").alias("doc"), F.col("other").alias("start"), F.col("stop").alias("end"), "reach")
    )
    found = scratch.keep(_regions(docs, asked))
    scratch.sweep()
    schema = f"doc {kind}, start int, end int, keep {kind}, other int, stop int, gram bigint"
    pairs = chains.join(found, ["doc", "start", "end", "reach"]).join(
        found.select(F.col("doc").alias("keep"), F.col("start").alias("other"), F.col("end").alias("stop"), "reach", F.col("words").alias("words_2")),
        ["keep", "other", "stop", "reach"],
    ).select("doc", "start", "keep", "other", "reach", "hits", (F.col("doc") == F.col("keep")).alias("alone"), "words", "words_2")

    def words_of(cells: pa.Array):
        """The words of all cells, and where each cell begins."""
        size = pc.binary_length(cells).to_numpy().astype(np.int64) // 4
        return np.frombuffer(b"".join(cells.to_pylist()), np.uint32), np.concatenate([[0], np.cumsum(size)])

    def run(batches):
        for batch in batches:
            for part in slices(batch, column="words"):
                start, other, reach = (part.column(c).to_numpy().astype(np.int64) for c in ("start", "other", "reach"))
                first, at = np.maximum(0, start - reach), np.maximum(0, other - reach)
                (a, a_at), (b, b_at) = words_of(part.column("words")), words_of(part.column("words_2"))
                grams, hits = (_grams(a, width), _grams(b, width)), part.column("hits")
                row, hits = np.repeat(np.arange(part.num_rows), hits.value_lengths().to_numpy()), hits.flatten()
                pos, there = (hits.field(c).to_numpy().astype(np.int64) for c in ("pos", "other"))
                owner, *runs = _runs(row, pos, there)
                cuts, runs = np.searchsorted(owner, np.arange(part.num_rows + 1)).tolist(), list(zip(*(r.tolist() for r in runs), strict=True))
                rows, out = [], []
                for i, alone in enumerate(part.column("alone").to_pylist()):
                    ends = [(x[i], x[i + 1]) for x in (a_at, b_at)]
                    found = _spans(
                        runs[cuts[i] : cuts[i + 1]], [x[e[0] : e[1]] for x, e in zip((a, b), ends, strict=True)],
                        [g[e[0] : max(e[0], e[1] - width + 1)] for g, e in zip(grams, ends, strict=True)], int(first[i]), int(at[i]), alone, threshold, width,
                    )
                    rows += [i] * len(found)
                    out += found
                take = pa.array(rows, pa.int64())
                spans = [pa.array([x[k] for x in out], pa.int32()) for k in range(4)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc").take(take), *spans[:2], part.column("keep").take(take), *spans[2:], pa.nulls(len(out), pa.int64())], names
                )
                bounds = [x[row + k] for x in (a_at, b_at) for k in (0, 1)]
                place, gram = _open_grams(pos - first[row] + a_at[row], there - at[row] + b_at[row], bounds, a, b)
                owner = np.searchsorted(a_at, place, "right") - 1
                place = (place - a_at[owner] + first[owner]).astype(np.int32)
                for k in range(0, len(place), 100_000):
                    take, begin = pa.array(owner[k : k + 100_000]), place[k : k + 100_000]
                    none = pa.nulls(len(begin), pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("doc").take(take), pa.array(begin), pa.array(begin + np.int32(PASSAGE)),
                            pa.nulls(len(begin), part.column("keep").type), none, none, pa.array(gram[k : k + 100_000]),
                        ],
                        names,
                    )

    names = ["doc", "start", "end", "keep", "other", "stop", "gram"]
    grown = scratch.keep(pairs.mapInArrow(run, schema))
    scratch.drop(chains, found)
    scratch.sweep()
    return grown


def _later(grown: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc, start, end, keep, other, stop): runs of PASSAGE words whose first occurrence is not the first one of their blocks."""
    grams = grown.where("gram IS NOT NULL").select("gram", "doc", "start", "end")
    # Most of them occur once; a run's first occurrence keeps it.
    shared = scratch.keep(
        grams.groupBy("gram").agg(F.min(F.struct("doc", "start")).alias("kept"), F.max(F.struct("doc", "start")).alias("last"))
        .where("kept < last").drop("last")
    )
    return grams.join(shared, "gram").select(
        "doc", "start", "end", F.col("kept.doc").alias("keep"), F.col("kept.start").alias("other"), (F.col("kept.start") + PASSAGE).alias("stop")
    ).where((F.col("doc") > F.col("keep")) | (F.col("start") >= F.col("stop"))).distinct()


def repeated_passages(
    docs: DataFrame, threshold: float = 0.8, min_words: int = 5, width: int = 5, miss: float = 1e-3, floor: int = FLOOR
) -> DataFrame:
    """Spans of text that occur more than once: doc_id, row_key, start_word, end_word, kind, keep_id, removed.

    Positions count words (lower-cased runs of letters, digits and underscores), the end is exclusive. One row
    for each occurrence and each occurrence that it repeats, also for the ones that stay; documents without
    repeats have no row. Two kinds:

    ``paragraph``: lines of ``min_words`` or more. Their sets of word ``width``-shingles are banded by MinHash (bands
    of 3 registers, as many as lose at most ``miss`` of the pairs at the threshold), colliding paragraphs are
    compared by their exact Jaccard similarity, and the components of the links are the classes. The
    occurrence with the smallest doc_id, then position, stays; of the others, lines of ``floor`` words or more are removed.

    ``passage``: runs of words inside lines or across them, which paragraph bounds would hide. Blocks of 12 words start
    where a hash of their first 6 words is least among 13 neighbours, so the blocks of a shared run do not
    depend on what stands around it, and every run of 24 words holds one. Blocks with an equal 95-bit hash are the same;
    the one with the smallest doc_id, then position, stays, in one document, too. Blocks of one document that repeat
    neighbouring blocks of another one are a chain, which is compared word by word with what it repeats to its maximal length,
    then over edited text while the Jaccard similarity of both spans reaches the threshold (``_extend``); spans of 24 words
    or more are reported. Where the first occurrence of a block has other words beside it, the runs of 24 words around the block are
    compared among all its later occurrences by 64-bit hashes, and the first of equal ones keeps them. So each run of 24 words or more that
    stands earlier, whichever documents share its parts, is covered by removed spans. Only where a block repeats
    over itself (a period below 12 words) are its later places in that document not held against other ones.

    A null text has no words; a null doc_id has no spans. row_key is a hash of the text: rows that repeat a doc_id with different texts
    are documents of their own; with the same text they are one document. An empty table gives an empty result; further
    columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    bands = tune_bands(threshold, ROWS, miss)
    text = empty_if_null("text")
    docs = lean(docs).where("doc_id IS NOT NULL").select(F.struct("doc_id", F.xxhash64(text).alias("row_key")).alias("doc"), text.alias("text"))
    table = scratch.keep(sketches(docs, bands, min_words, width))

    blocks = table.select("doc", F.explode("blocks").alias("b")).select("doc", "b.*")
    # Most blocks occur once: counts, which need no sort, leave them out before the least occurrence is sought.
    often = scratch.keep(blocks.groupBy("key", "check").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    blocks = scratch.keep(blocks.join(often, ["key", "check"]))
    scratch.drop(often)
    scratch.sweep()

    paragraphs = table.select("doc", F.explode("paragraphs").alias("p")).select("doc", "p.*")
    nodes = scratch.keep(
        paragraphs.groupBy("key").agg(
            F.count(F.lit(1)).alias("mult"), F.min(F.struct("doc", "start", "words")).alias("rep"),
            F.first("buckets").alias("buckets"), F.first("sig").alias("sig"),
        )
    )
    paragraphs = scratch.keep(paragraphs.select("doc", "start", "words", "key"))
    scratch.drop(table)
    scratch.sweep()

    def fetch(keys: DataFrame) -> DataFrame:
        wanted = (
            nodes.join(keys, "key").select("rep.*", "key").groupBy("doc")
            .agg(F.collect_list(F.struct("start", "words", "key")).alias("wanted"))
        )
        return _contents(docs.join(wanted, "doc").select("text", "wanted"), width).dropDuplicates(["key"])

    classes = near_classes(nodes, fetch, threshold, bands * ROWS, scratch)
    member = nodes.join(classes, "key", "left").select("key", "mult", "rep", F.coalesce("root", "key").alias("root"))
    # Grouped tables are written before a join on their group: its partitions can then be split where one group is large.
    named = scratch.keep(member.groupBy("root").agg(F.min("rep").alias("best"), F.sum("mult").alias("size")).where("size > 1"))
    lookup = scratch.keep(member.join(named, "root").select("key", "best"))
    lines = scratch.keep(paragraphs.join(lookup, "key").select(
        "doc", "start", (F.col("start") + F.col("words")).alias("end"), F.lit("paragraph").alias("kind"), F.col("best.doc").alias("keep"),
        ((F.struct("doc", "start") != F.struct("best.doc", "best.start")) & (F.col("words") >= floor)).alias("removed"),
    ))
    scratch.drop(nodes, paragraphs, named, lookup)
    scratch.sweep()

    shared = scratch.keep(
        blocks.groupBy("key", "check").agg(F.min(F.struct("doc", "pos")).alias("kept"), F.max(F.struct("doc", "pos")).alias("last"))
        .where("kept < last").drop("last")
    )
    # A block that overlaps its kept occurrence in one document stays with it.
    hits = blocks.join(shared, ["key", "check"]).select("doc", "pos", F.col("kept.doc").alias("keep"), F.col("kept.pos").alias("other")).where(
        (F.col("doc") > F.col("keep")) | (F.col("pos") >= F.col("other") + SIZE)
    )
    chains = _chains(hits)
    grown = _grown(docs, chains, threshold, width, scratch)
    scratch.drop(blocks, shared)
    grown = grown.where("gram IS NULL").drop("gram").unionByName(scratch.keep(_later(grown, scratch)))
    spans = grown.select("doc", "start", "end", "keep", F.lit(True).alias("removed")).unionByName(
        grown.select(F.col("keep").alias("doc"), F.col("other").alias("start"), F.col("stop").alias("end"), "keep", F.lit(False).alias("removed")).distinct()
    )
    here = Window.partitionBy("doc", "keep", "removed").orderBy("start", "end")
    before = F.max("end").over(here.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.coalesce((F.col("start") > before).cast("int"), F.lit(1)))
    passages = spans.withColumn("island", F.sum("new").over(here.rowsBetween(Window.unboundedPreceding, 0))).groupBy("doc", "keep", "removed", "island").agg(
        F.min("start").alias("start"), F.max("end").alias("end")
    ).select("doc", "start", "end", F.lit("passage").alias("kind"), "keep", "removed")
    return lines.unionByName(passages).select(
        "doc.doc_id", "doc.row_key", F.col("start").alias("start_word"), F.col("end").alias("end_word"), "kind", F.col("keep.doc_id").alias("keep_id"), "removed"
    )


def cut_repeats(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` without the words of the removed ``spans``; a document left without words is dropped.

    Text between the words of a span goes with it; the rest stays as it is. n_chars, where present, is
    counted anew for documents that were cut. Rows are found by doc_id and a hash of the text, so rows that
    repeat a doc_id with another text are left alone. A null or empty text that no span names stays, as does a null doc_id.
    """
    from pyspark.sql.pandas.functions import pandas_udf

    @pandas_udf("string")
    def cut(texts, spans):
        out = []
        for text, ranges in zip(texts, spans, strict=True):
            bounds = [m.span() for m in S.WORD.finditer(text)]
            kept, at = [], 0
            for start, end in sorted((int(r["s"]), int(r["e"])) for r in ranges):
                start, end = max(0, start), min(end, len(bounds))
                if start >= end or bounds[end - 1][1] <= at:
                    continue
                kept.append(text[at : max(at, bounds[start][0])])
                at = bounds[end - 1][1]
            rest = "".join(kept) + text[at:]
            out.append(rest if S.WORD.search(rest) else None)
        import pandas as pd

        return pd.Series(out, dtype=object)

    ranges = (
        spans.where("removed").groupBy(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key"))
        .agg(F.collect_list(F.struct(F.col("start_word").alias("s"), F.col("end_word").alias("e"))).alias("_spans"))
    )
    # Columns are named through their tables: those of docs may have any name.
    joined = docs.join(ranges, (docs["doc_id"] == ranges["_id"]) & (F.xxhash64(empty_if_null(docs["text"])) == ranges["_key"]), "left")
    whole = joined.where(ranges["_spans"].isNull()).select(*[docs[c] for c in docs.columns])
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    kept = joined.where(ranges["_spans"].isNotNull()).select(row, cut(empty_if_null(docs["text"]), ranges["_spans"]).alias("text")).where("text IS NOT NULL")
    columns = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return whole.unionByName(kept.select(*[columns.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns]))


def drop_repeats(docs: DataFrame, threshold: float = 0.8, min_words: int = FLOOR) -> DataFrame:
    """``docs`` with every passage and every line of ``min_words`` or more that ``repeated_passages`` marks as removed cut out.

    All columns stay; nulls, empty texts and repeated rows fare as in ``cut_repeats``; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    return cut_repeats(docs, scratch.keep(repeated_passages(docs, threshold, min_words, floor=min_words)))
