"""Exact Jaccard join of word shingle sets, by regions of pivots.

Distance is 1 - Jaccard, a metric; two documents link at 0.25 or less.

*First level.* Nearly all documents are at distance 1 from any given document, so
document pivots can't part them. The pivots of the first level are the singleton
sets {s} of shingles: a document is nearest to those it holds (1 - 1/n), ties going
by a fixed global order, and its cell is that of its first shingle. What a window
has to replicate follows from the radius: a link at 0.25 leaves at most n -
ceil(0.75 n) shingles of either side unshared, so linked documents meet in the
cells of the first n - ceil(0.75 n) + l shingles of both, and at least l times.
Shingles that a fixed-size sketch shows to be frequent come last in the order, so
common lines and passages open no cells of their own. The sketch gets blunter as
the input grows: where its cells turn out to be crowded all the same, the shingles
of these cells are put last by name, and the cells are dealt again.

*Second level.* Balls come first: sets with a common smallest hash are measured
against the first of them, a pivot, and those within 0.25 of it are one component.
A cell then needs only pairs of different components: members outside its largest
component meet all others. If those are more than ``CELL`` squared, the cell goes to a
region of cells that share sets, and the region is joined in blocks of bounded size:
sets outside the region's largest ball component against all of its sets. That
copies each set to as many blocks as there are parts of the other side, which is
why cells are dealt again as long as it would copy more sets than there are, and why
blocks are solved in lots. No link
between different components is lost, and links inside one need not be listed.

Candidates that meet at least l times are compared on their whole sets, which
travel once to a block of candidates around a common neighbour. Equal sets are one
class from the start. All of it is hashed to buckets in proportion to the input.
Shingles are 64-bit identities.

Edge cases: null, empty and blank texts have empty sets and link with nothing
(their own id is their component); texts of 1 to 4 words are one shingle; whole
texts are read; rows that share an id are one node that has all their links; rows
with a null id get a null component; equal rows give equal results; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithline.llm.common import arrow_map, dropped, kind, release, written
from kithline.llm.components import components

SHINGLE = 5
#: Similarity in hundredths.
SIMILARITY = 75
#: A cell of up to CELL x CELL pairs (of sets outside its largest component with all) is joined whole; cells of the sketch and of a slice of it.
CELL, SKETCH_BITS, SLICE_BITS = 96, 23, 17
#: Sets of either side that meet in a task, in a region of crowded cells.
REGION_SETS = 2_000
#: How often cells are dealt at most: again while crowded ones would copy more sets than there are.
DEALS = 4
#: Postings of a bucket, sets of a block, candidate classes sent as a sorted array.
BUCKET_POSTINGS, BLOCK_SETS, MOST_SENT = 400_000, 2_000, 1_000_000
#: Smallest hashes that seed the components; salts of blocks.
HASHES, SALTS = 4, 64
_CHUNK = 2 << 20
_SIZE_STEP = 1.07


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles sorted by text, ends of each text's, and sizes."""
    from kithline.llm.textscan import LOWER, SPACED, Words, flat, mix, runs

    words = Words(*flat(texts), SPACED, LOWER)
    h, n_words = words.hashes(), words.per_doc()
    s, at = runs(h, words.doc, k)
    parts, docs = [s], [words.doc[at]]
    for short in range(1, k):  # a text of fewer words is one shingle
        own = np.flatnonzero(n_words == short)
        if len(own):
            s, at = runs(h, words.doc, short)
            ok = n_words[words.doc[at]] == short
            parts.append(mix(s[ok] + np.uint64(short)))
            docs.append(words.doc[at][ok])
    s, doc = np.concatenate(parts), np.concatenate(docs)
    order = np.lexsort((s, doc))
    s, doc = s[order], doc[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    s, doc = s[new], doc[new]
    n = np.bincount(doc, minlength=words.n_docs).astype(np.int64)
    return s, doc, n


def set_identity(s: np.ndarray, doc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """64 bits of each set, the same for equal sets."""
    from kithline.llm.textscan import mix

    sums = np.zeros(len(s) + 1, np.uint64)
    np.cumsum(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)), out=sums[1:])
    ends = np.concatenate([[0], np.cumsum(n)])
    return mix(sums[ends[1:]] - sums[ends[:-1]] + n.astype(np.uint64))


def size_code(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(np.log(np.maximum(n, 1)) / np.log(_SIZE_STEP) + 1e-9), 255).astype(np.uint8)


def size_range(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes that a code can stand for: least, most."""
    return np.floor(_SIZE_STEP ** code.astype(float)), np.where(code == 255, np.inf, np.ceil(_SIZE_STEP ** (code.astype(float) + 1)))


def extra(n: np.ndarray) -> np.ndarray:
    """How often linked sets meet at least: l."""
    return np.floor(n / 16).astype(np.int64) + 1


def prefix_sizes(n: np.ndarray, similarity: int = SIMILARITY) -> np.ndarray:
    return np.minimum(n, n - -(-similarity * n // 100) + extra(n))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, set (identity, null if empty), n_shingles and the smallest hashes of each row."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        from kithline.llm.textscan import mix

        s, doc, n = shingle_sets(batch.column("text"))
        ident = set_identity(s, doc, n).view(np.int64)
        some = np.flatnonzero(n)
        heads = np.concatenate([[0], np.cumsum(n)[:-1]])[some].astype(np.int64)
        least = np.zeros((len(n), HASHES), np.int64)
        if len(some):
            for k in range(HASHES):
                least[some, k] = np.minimum.reduceat(mix(s + np.uint64(k + 1)), heads).view(np.int64)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * HASHES, pa.int32()), pa.array(least.ravel()))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ident, mask=n == 0), pa.array(n), flat], ["doc_id", "set", "n_shingles", "hashes"])

    return arrow_map(docs.select("doc_id", "text"), work, f"doc_id {kind(docs, 'doc_id')}, set bigint, n_shingles bigint, hashes array<bigint>")


def seeds(own: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets with a common smallest hash and the first set that has it: where near copies are likely. Only speeds up what follows."""
    rows = own.where("set is not null").select("set", "hashes", F.col("n_shingles").alias("n")).distinct().select("set", "n", F.posexplode("hashes").alias("k", "h"))
    first = rows.groupBy("k", "h").agg(F.min("set").alias("a"), F.count("*").alias("of")).where("of > 1").select("k", "h", "a")
    pairs = rows.select(F.col("set").alias("b"), F.col("n").alias("nb"), "k", "h").join(first, ["k", "h"]).where("a < b").select("a", "b").distinct()
    return pairs


def frequent(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Bits of the sketch cells with far more shingles than others, and the number of all shingles."""
    cells, per_slice = 1 << SKETCH_BITS, 1 << SLICE_BITS

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from kithline.llm.textscan import chunks

        seen = np.zeros(cells, np.uint32)
        for batch in batches:
            for part in chunks(batch, "text", _CHUNK):
                s, _, _ = shingle_sets(part.column("text"))
                at, n = np.unique(s >> np.uint64(64 - SKETCH_BITS), return_counts=True)
                seen[at.astype(np.int64)] += n.astype(np.uint32)
        if seen.any():
            blobs = [zlib.compress(seen[i : i + per_slice].tobytes(), 1) for i in range(0, cells, per_slice)]
            del seen
            release()
            yield pa.RecordBatch.from_arrays([pa.array(range(len(blobs)), pa.int32()), pa.array(blobs, pa.binary())], ["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist()):
                sums[part] = sums.get(part, 0) + np.frombuffer(zlib.decompress(blob), np.uint32).astype(np.int64)
        for part, n in sums.items():
            usual = float(np.median(n))
            hot = np.packbits(n > 1.5 * usual + 8 * np.sqrt(usual) + CELL // 2).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([hot], pa.binary()), pa.array([int(n.sum())], pa.int64())], ["part", "hot", "n"])
        release()

    slices = docs.select("text").mapInArrow(tally, "part int, counts binary").repartition(16, "part").mapInArrow(add, "part int, hot binary, n bigint")
    hot = np.zeros(cells // 8, np.uint8)
    total = 0
    for row in slices.collect():  # cells / 8 bytes in all, whatever the input
        hot[row["part"] * (per_slice // 8) : (row["part"] + 1) * (per_slice // 8)] = np.frombuffer(row["hot"], np.uint8)
        total += row["n"]
    return hot, total


def _blobs(batch_rows: list[tuple[int, list[np.ndarray]]], names: list[str]) -> pa.RecordBatch:
    cols = [pa.array([b for b, _ in batch_rows], pa.int32()), *(pa.array([a[i].tobytes() for _, a in batch_rows], pa.binary()) for i in range(len(names)))]
    return pa.RecordBatch.from_arrays(cols, ["bucket", *names])


def _dealt(bucket: np.ndarray, arrays: list[np.ndarray]) -> list[tuple[int, list[np.ndarray]]]:
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    heads = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    ends = np.append(heads[1:], len(bucket))
    return [(int(bucket[a]), [x[order[a:b]] for x in arrays]) for a, b in zip(heads.tolist(), ends.tolist())]


def named(docs: DataFrame, labels: DataFrame, most_sent: int = MOST_SENT) -> tuple[DataFrame, tuple[np.ndarray, np.ndarray] | None]:
    """text and component, if labels are too many to travel as sorted arrays; else text and those arrays."""
    if labels.count() <= most_sent:
        rows = labels.select("node", "component").toPandas()
        node = rows["node"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(node)
        return docs.select("text").where("text is not null"), (node[order], rows["component"].to_numpy(np.int64).view(np.uint64)[order])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        s, doc, n = shingle_sets(batch.column("text"))
        return pa.RecordBatch.from_arrays([batch.column("text"), pa.array(set_identity(s, doc, n).view(np.int64))], ["text", "node"])

    return arrow_map(docs.select("text").where("text is not null"), work, "text string, node bigint").join(labels, "node", "left").select("text", F.coalesce("component", "node").alias("component")), None


def postings(texts: DataFrame, labels: tuple[np.ndarray, np.ndarray] | None, hot: np.ndarray, buckets: int, last: np.ndarray = np.zeros(0, np.uint64)) -> DataFrame:
    """The first shingles of each set with its identity, component and size code, packed by bucket of the shingle. last: shingles that come last in the order, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from kithline.llm.textscan import chunks

        for batch in batches:
            for part in chunks(batch, "text", _CHUNK):
                s, doc, n = shingle_sets(part.column("text"))
                ident, code = set_identity(s, doc, n), size_code(n)
                if labels is None:
                    comp = part.column("component").to_numpy(zero_copy_only=False).view(np.uint64)
                else:
                    at = np.minimum(np.searchsorted(labels[0], ident), max(len(labels[0]) - 1, 0))
                    comp = np.where(labels[0][at] == ident, labels[1][at], ident) if len(labels[0]) else ident
                _, own = np.unique(ident, return_index=True)  # equal sets of a slice open their cells once
                once = np.zeros(len(n), bool)
                once[own] = True
                once &= n > 0
                ok = once[doc]
                s, doc = s[ok], doc[ok]
                cell = (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
                late = (hot[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1
                if len(last):
                    late[last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s] = 2
                order = np.lexsort((s, late, doc))
                s, doc = s[order], doc[order]
                sizes = np.where(once, n, 0)
                first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                keep = np.arange(len(s)) - first[doc] < prefix_sizes(n)[doc]
                s, doc = s[keep], doc[keep]
                rows = _dealt((s % np.uint64(buckets)).astype(np.int32), [s, ident[doc], comp[doc], code[doc]])
                if rows:
                    yield _blobs(rows, ["s", "ident", "comp", "code"])
        release()

    return texts.mapInArrow(run, "bucket int, s binary, ident binary, comp binary, code binary")


def _by_bucket(batches: Iterator[pa.RecordBatch], kinds: list[tuple[str, type]]) -> Iterator[list[np.ndarray]]:
    """The arrays of one bucket after another, from rows sorted by bucket."""
    held: list[list[bytes]] = [[] for _ in kinds]
    now = None
    joined = lambda: [np.frombuffer(b"".join(x), t) for x, (_, t) in zip(held, kinds)]
    for batch in batches:
        for row in zip(batch.column("bucket").to_pylist(), *(batch.column(k).to_pylist() for k, _ in kinds)):
            if row[0] != now and held[0]:
                yield joined()
                held = [[] for _ in kinds]
            now = row[0]
            for x, v in zip(held, row[1:]):
                x.append(v)
    if held[0]:
        yield joined()


def _pairs_within(start: np.ndarray, size: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j), i < j, inside groups; i among the first ``reach`` of its group."""
    first = np.repeat(start, reach) + (np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach))
    end = np.repeat(start + size, reach)
    n = end - first - 1
    i = np.repeat(first, n)
    j = i + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return i, j


def _fitting(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sizes of these codes can link at all."""
    low, high = size_range(np.maximum(a, b))[0], size_range(np.minimum(a, b))[1]
    return 100 * high >= SIMILARITY * low


def meetings(post: DataFrame, buckets: int, pair_buckets: int) -> DataFrame:
    """Packed candidates (a < b of different components, and how often they met), and the members (cell, set) of crowded cells in rows of bucket -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, ident, comp, code in _by_bucket(batches, [("s", np.uint64), ("ident", np.uint64), ("comp", np.uint64), ("code", np.uint8)]):
            order = np.lexsort((ident, comp, s))
            s, ident, comp, code = s[order], ident[order], comp[order], code[order]
            new = np.ones(len(s), bool)
            new[1:] = (s[1:] != s[:-1]) | (ident[1:] != ident[:-1])
            s, ident, comp, code = s[new], ident[new], comp[new], code[new]
            if not len(s):
                continue
            # members outside the largest component of a cell come first; only they need partners
            kind = np.ones(len(s), bool)
            kind[1:] = (s[1:] != s[:-1]) | (comp[1:] != comp[:-1])
            heads = np.flatnonzero(kind)
            run_size = np.diff(np.append(heads, len(s)))
            by_size = np.lexsort((run_size, s[heads]))
            last = np.append(s[heads][by_size][1:] != s[heads][by_size][:-1], True)
            main = np.zeros(len(heads), bool)
            main[by_size[last]] = True
            main = np.repeat(main, run_size)
            order = np.lexsort((main, s))
            s, ident, comp, code, main = s[order], ident[order], comp[order], code[order], main[order]
            start = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            size = np.diff(np.append(start, len(s)))
            outer = np.add.reduceat((~main).astype(np.int64), start)
            start, size, outer = start[outer > 0], size[outer > 0], outer[outer > 0]
            crowded = outer * size > CELL * CELL
            found: list[tuple[np.ndarray, ...]] = []
            whole, n, reach = start[~crowded], size[~crowded], outer[~crowded]
            work = np.cumsum(reach * n)
            for lot in range(int(work[-1] // 1_000_000) + 1 if len(work) else 0):
                own = work // 1_000_000 == lot
                i, j = _pairs_within(whole[own], n[own], reach[own])
                ok = (comp[i] != comp[j]) & _fitting(code[i], code[j])
                i, j = i[ok], j[ok]
                low = ident[i] < ident[j]
                i, j = np.where(low, i, j), np.where(low, j, i)
                found.append(_merged(ident[i], ident[j], np.ones(len(i), np.int32), code[i], code[j]))
            if found:
                a, b, met, ca, cb = _merged(*(np.concatenate(x) for x in zip(*found)))
                rows = _dealt(((a ^ b) % np.uint64(pair_buckets)).astype(np.int32), [a, b, met, ca, cb])
                if rows:
                    yield _blobs(rows, ["a", "b", "n", "ca", "cb"])
            if crowded.any():
                first, n = start[crowded], size[crowded]
                at = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                none = np.zeros(0, np.uint8)
                yield _blobs([(-1, [s[at], ident[at], none, none, none])], ["a", "b", "n", "ca", "cb"])
        release()

    return post.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "bucket int, a binary, b binary, n binary, ca binary, cb binary")


def _merged(a: np.ndarray, b: np.ndarray, n: np.ndarray, ca: np.ndarray, cb: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.lexsort((b, a))
    a, b, n, ca, cb = a[order], b[order], n[order], ca[order], cb[order]
    heads = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
    return a[heads], b[heads], (np.add.reduceat(n, heads) if len(heads) else n).astype(np.int32), ca[heads], cb[heads]


def candidates(met: DataFrame, pair_buckets: int) -> DataFrame:
    """Pairs (a, b) that met as often as linked sets of their sizes must."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for arrays in _by_bucket(batches, [("a", np.uint64), ("b", np.uint64), ("n", np.int32), ("ca", np.uint8), ("cb", np.uint8)]):
            a, b, n, ca, cb = _merged(*arrays)
            ok = n >= extra(np.minimum(size_range(ca)[0], size_range(cb)[0]))
            yield pa.RecordBatch.from_arrays([pa.array(a[ok].view(np.int64)), pa.array(b[ok].view(np.int64))], ["a", "b"])
        release()

    return met.where("bucket >= 0").repartition(pair_buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "a bigint, b bigint")


def crowded_members(met: DataFrame) -> DataFrame:
    """cell, set of the cells that weren't joined whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, ident in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.int64)) for x in (s, ident)], ["cell", "set"])

    return met.where("bucket < 0").select("a", "b").mapInArrow(run, "cell bigint, set bigint")


def whole_sets(docs: DataFrame, wanted: DataFrame, most_sent: int = MOST_SENT) -> DataFrame:
    """set and its sorted shingles (packed), once for each wanted identity."""
    listed = None
    if wanted.count() <= most_sent:
        listed = np.sort(wanted.select("set").toPandas()["set"].to_numpy(np.int64).view(np.uint64))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        s, doc, n = shingle_sets(batch.column("text"))
        ident = set_identity(s, doc, n)
        ok = n > 0
        if listed is not None:
            ok &= listed[np.minimum(np.searchsorted(listed, ident), len(listed) - 1)] == ident if len(listed) else False
        _, own = np.unique(ident, return_index=True)
        once = np.zeros(len(n), bool)
        once[own] = True
        ends = np.concatenate([[0], np.cumsum(n)])
        rows = np.flatnonzero(ok & once)
        if not len(rows):
            return None
        return pa.RecordBatch.from_arrays([pa.array(ident[rows].view(np.int64)), pa.array([s[ends[i] : ends[i + 1]].tobytes() for i in rows], pa.binary())], ["set", "shingles"])

    found = arrow_map(docs.select("text").where("text is not null"), work, "set bigint, shingles binary")
    if listed is None:
        found = found.join(wanted, "set", "left_semi")
    return found.dropDuplicates(["set"])


def distances(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """a, b, linked and the distance of each pair, from whole sets.

    A pair goes to the block of the smallest neighbour that its two sets have; a
    set travels once to each block it is needed in. A block with many pairs is
    dealt out by its pairs' second set.
    """
    ends = pairs.select(F.col("a").alias("set"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    near = written(ends.groupBy("set").agg(F.least(F.col("set"), F.min("other")).alias("near")), "near", narrow=True)
    placed = (
        pairs.join(near.select(F.col("set").alias("a"), F.col("near").alias("na")), "a").join(near.select(F.col("set").alias("b"), F.col("near").alias("nb")), "b")
        .select("a", "b", F.least("na", "nb").alias("block"))
    )
    placed = written(placed, "placed", narrow=True)
    # blocks with many pairs are parted by the second set; salted rows meet a copy of the narrow list of such blocks for each salt
    parts = placed.groupBy("block").count().where(F.col("count") > BLOCK_SETS).select("block", F.ceil(F.col("count") / BLOCK_SETS).cast("int").alias("parts"))
    parts = parts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = placed.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    placed = salted.join(parts, ["block", "salt"], "left").select("a", "b", "block", F.coalesce(F.pmod(F.xxhash64("b", F.lit(1)), "parts"), F.lit(0)).cast("int").alias("part"))
    sets = whole_sets(docs, near.select("set"))
    none = lambda t: F.lit(None).cast(t)
    needed = placed.select(F.col("a").alias("set"), "block", "part").union(placed.select("b", "block", "part")).distinct()
    rows = needed.join(sets, "set").select("block", "part", F.col("set").alias("a"), none("bigint").alias("b"), "shingles").unionByName(placed.select("block", "part", "a", "b", none("binary").alias("shingles")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        now = None
        for batch in batches:
            out = []
            for block, part, a, b, shingles in zip(*(batch.column(c).to_pylist() for c in ("block", "part", "a", "b", "shingles"))):
                if (block, part) != now:
                    held, now = {}, (block, part)
                if b is None:
                    held[a] = np.frombuffer(shingles, np.uint64)
                else:
                    x, y = held[a], held[b]
                    if len(x) > len(y):
                        x, y = y, x
                    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                    both = int((y[at] == x).sum())
                    union = len(x) + len(y) - both
                    out.append((a, b, 100 * both >= SIMILARITY * union, 1 - both / union))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.bool_(), pa.float64()))], ["a", "b", "linked", "distance"])

    dealt = rows.repartition("block", "part").sortWithinPartitions("block", "part", F.col("b").isNotNull())
    return dealt.mapInArrow(run, "a bigint, b bigint, linked boolean, distance double")


def dealt(docs: DataFrame, own: DataFrame, labels: DataFrame, hot: np.ndarray, buckets: int, pair_buckets: int, most_sent: int = MOST_SENT) -> tuple[DataFrame, DataFrame]:
    """What ``meetings`` finds, and the members of crowded cells.

    Cells are dealt again, with the shingles of crowded cells last, while the blocks
    of these cells' sets could copy more sets than there are. The order decides only
    where sets meet, so the list may be cut to the largest cells; if crowded cells
    remain after ``DEALS``, or hardly fewer sets are in them than before, they are
    joined as regions all the same.
    """
    n, last, before = own.count(), np.zeros(0, np.uint64), float("inf")
    for deal in range(DEALS):
        met = written(meetings(postings(*named(docs, labels), hot, buckets, last), buckets, pair_buckets), "met")
        members = written(crowded_members(met), "members", narrow=True)
        sets = members.select("set").distinct().count()
        if deal == DEALS - 1 or 2 * sets * -(-sets // REGION_SETS) <= n or len(last) >= most_sent or 4 * sets > 3 * before:
            break
        before = sets
        cells = members.groupBy("cell").count().orderBy(F.desc("count"), "cell").limit(most_sent - len(last))
        last = np.union1d(last, cells.select("cell").toPandas()["cell"].to_numpy(np.int64).view(np.uint64))
        dropped(met), dropped(members)
    return met, members


def linked_sets(docs: DataFrame, own: DataFrame) -> DataFrame:
    """node (set), component for all sets that link with another. own: the classes of docs."""
    hot, total = frequent(docs)
    buckets = max(8, -(-total * 32 // (100 * BUCKET_POSTINGS)))
    pair_buckets = max(8, buckets // 4)
    known = written(distances(written(seeds(own), "seeds", narrow=True), docs), "distances")
    labels = components(known.where("linked").select("a", "b"))
    met, members = dealt(docs, own, labels, hot, buckets, pair_buckets)
    fresh = written(candidates(met, pair_buckets).join(known.select("a", "b"), ["a", "b"], "left_anti"), "candidates", narrow=True)
    if not fresh.isEmpty():
        known = written(known.unionByName(distances(fresh, docs)), "distances")
        labels = components(known.where("linked").select("a", "b"))
    if members.isEmpty():
        return labels
    more = region_links(members, labels, docs)
    return components(known.where("linked").select("a", "b").unionByName(more))


def region_links(members: DataFrame, labels: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) that tie components in the crowded cells.

    Cells that share a set are one region. Sets outside the region's largest
    component meet all its sets, block by block: ``REGION_SETS`` of either side are
    in a task, whose answer is a spanning forest of the links between components.
    """
    first = members.groupBy("cell").agg(F.min("set").alias("a"))
    regions = written(components(members.join(first, "cell").select("a", F.col("set").alias("b"))), "regions", narrow=True)
    own = regions.select(F.col("node").alias("set"), F.col("component").alias("region")).join(labels.withColumnRenamed("node", "set"), "set", "left").select("set", "region", F.coalesce("component", "set").alias("component"))
    sizes = own.groupBy("region", "component").count().groupBy("region").agg(F.max_by("component", F.struct("count", "component")).alias("largest"), F.sum("count").alias("size"), F.max("count").alias("most"), F.count("*").alias("kinds")).where("kinds > 1")
    rows = own.join(sizes, "region").select("set", "region", "component", (F.col("component") != F.col("largest")).alias("outer"), F.ceil(F.col("size") / REGION_SETS).cast("int").alias("parts"), F.ceil((F.col("size") - F.col("most")) / REGION_SETS).cast("int").alias("outer_parts"))
    rows = written(rows.withColumn("part", F.pmod(F.xxhash64("set"), "parts").cast("int")), "region-sets", narrow=True)
    if rows.isEmpty():
        return members.select(F.col("set").alias("a"), F.col("set").alias("b")).limit(0)
    # block (i, j): outer sets of part i against all sets of part j
    every = lambda parts: F.explode(F.expr(f"sequence(0, {parts} - 1)"))
    sent = rows.where("outer").select("region", "set", "component", F.expr("cast(pmod(xxhash64(set), outer_parts) as int)").alias("i"), every("parts").alias("j"), F.lit(True).alias("outer"))
    sent = sent.unionByName(rows.select("region", "set", "component", every("outer_parts").alias("i"), F.col("part").alias("j"), F.lit(False).alias("outer")))
    sets = whole_sets(docs, rows.select("set").distinct())
    copies = rows.agg(F.sum(F.when(F.col("outer"), F.col("parts")).otherwise(0) + F.col("outer_parts"))).first()[0]
    lots = -(-copies // max(docs.count(), 1))
    if lots > 1:
        sets = written(sets, "region-shingles")

    def solve(left: list[tuple], right: list[tuple]) -> tuple[list[int], list[int]]:
        links: tuple[list[int], list[int]] = ([], [])
        if not left or not right:
            return links
        size = np.array([len(x[2]) // 8 for x in left])
        shingles = np.frombuffer(b"".join(x[2] for x in left), np.uint64)
        order = np.argsort(shingles, kind="stable")
        owner = np.repeat(np.arange(len(left)), size)[order]
        shingles = shingles[order]
        component = np.array([x[1] for x in left], np.int64)
        parent: dict[int, int] = {}

        def find(c: int) -> int:
            while parent.get(c, c) != c:
                parent[c] = parent.get(parent[c], parent[c])
                c = parent[c]
            return c

        for ident, own, packed in right:
            x = np.frombuffer(packed, np.uint64)
            lo, hi = np.searchsorted(shingles, x, "left"), np.searchsorted(shingles, x, "right")
            n = hi - lo
            both = np.bincount(owner[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(left))
            for k in np.flatnonzero((100 * both >= SIMILARITY * (size + len(x) - both)) & (component != own)).tolist():
                u, v = find(own), find(int(component[k]))
                if u != v:
                    parent[u] = v
                    links[0].append(ident), links[1].append(left[k][0])
        return links

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, left, right = None, [], []
        for batch in batches:
            for region, i, j, outer, ident, component, packed in zip(*(batch.column(c).to_pylist() for c in ("region", "i", "j", "outer", "set", "component", "shingles"))):
                if (region, i, j) != now:
                    a, b = solve(left, right)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                    now, left, right = (region, i, j), [], []
                (left if outer else right).append((ident, component, packed))
        a, b = solve(left, right)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    found = []
    for lot in range(lots):
        now = sent.where(F.pmod(F.xxhash64("region", "i", "j"), F.lit(lots)) == lot).join(sets, "set")
        dealt = now.repartition("region", "i", "j").sortWithinPartitions("region", "i", "j", F.desc("outer"))
        found.append(written(dealt.mapInArrow(run, "a bigint, b bigint"), "region-links"))
    if lots > 1:
        dropped(sets)
    return reduce(DataFrame.union, found)


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of each row."""
    own = written(classes(docs), "classes")
    labels = linked_sets(docs, own)
    # each set's linked component; sets without links are their own
    named = own.where("set is not null and doc_id is not null").join(labels.withColumnRenamed("node", "set"), "set", "left").select("doc_id", F.coalesce("component", "set").alias("group"))
    least = written(named.groupBy("group").agg(F.min("doc_id").alias("least")), "least", narrow=True)
    by_doc = named.distinct().join(least, "group").select("doc_id", "group", "least")
    # ids with several rows of different sets tie groups together
    shared = by_doc.groupBy("doc_id").agg(F.min("least").alias("least"), F.count("*").alias("groups"))
    several = shared.where("groups > 1")
    if not several.isEmpty():
        edges = by_doc.select(F.col("doc_id").alias("a"), F.col("least").alias("b"))
        shared = components(edges).select(F.col("node").alias("doc_id"), F.col("component").alias("least"))
    out = own.join(shared.select("doc_id", "least"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def distinct(docs: DataFrame) -> DataFrame:
    """One row of docs for each component: that with the smallest id; rows with a null id stay, equal ids go with their component's first id."""
    keep = join(docs).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(keep, "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))


ORACLE_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT rid, array_to_string(w[j:j + {SHINGLE} - 1], ' ') AS g
  FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - {SHINGLE} + 1, 1) + 1)) AS j FROM w WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
l AS (
  SELECT a.rid AS a, b.rid AS b FROM s a JOIN s b ON a.g = b.g AND a.rid < b.rid JOIN n x ON x.rid = a.rid JOIN n y ON y.rid = b.rid
  GROUP BY a.rid, b.rid, x.n, y.n HAVING 100 * count(*) >= {SIMILARITY} * (x.n + y.n - count(*))
  UNION SELECT a.rid, b.rid FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.rid < b.rid),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT r.a AS rid, min(o.doc_id) AS least FROM r JOIN w o ON o.rid = r.b GROUP BY r.a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, CASE WHEN doc_id IS NULL THEN NULL ELSE least(doc_id, coalesce(least, doc_id)) END AS component_id
FROM w LEFT JOIN n USING (rid) LEFT JOIN c USING (rid)
"""
