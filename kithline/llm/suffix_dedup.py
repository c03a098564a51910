"""Removal of repeated byte strings by a column-wise collection suffix structure.

A byte goes if a string of ``LENGTH`` bytes over it also starts elsewhere, in the
same document or another. All of it is judged on the input.

1. Anchors. Every string of ``LENGTH`` bytes contains one chosen place: where the
   smallest hash of a 32-byte gram in it stands, leftmost on ties. Equal strings
   have equal gram hashes at equal offsets, so only strings with a common anchor
   hash need to be compared. A place is the anchor of a run of string starts; there
   is about one for each 185 bytes.
2. Anchor hashes that occur once are out. For the others a narrow row says where
   the piece of text around the anchor lies (from its first string's start to its
   last string's end) and has 64 bits of its bytes. Pieces that occur more than once
   are repeated strings all over; so copies need no more than these rows.
3. Only hashes with different pieces need bytes: these pieces are sent, once for
   each task, to the task of their hash. Laid out by their anchors, they go through the
   column-wise construction: from the last column to the first, one byte of each
   piece is put in front of its suffix, the order of suffixes (the column's part of
   the collection's Burrows-Wheeler transform) is updated by a stable sort on that
   byte, and the common prefixes of neighbours by range minima over the old ones.
   Neighbours with a common prefix of ``LENGTH`` bytes are repeated strings. Bytes
   are read column by column from a sequential file. Only suffixes in the same
   column can begin with the same string, so columns need not be merged; doing so
   would take as many rounds over all files as the longest document has bytes.
4. A hash with more than ``GROUP`` different pieces is first split by the bytes
   that runs of neighbouring strings have in common, down to single strings.

Rows with the same text are told apart only by how often the text occurs. Sizes
of what a task holds at once are bounded; nothing is collected but counts, and
lists of hashes if they are short. Longer lists are joined by text: then texts
travel once more, and still only the pieces that are needed.

Edge cases: null and empty texts have 0 bytes; texts shorter than LENGTH stay
whole; texts of any length are scanned in overlapping slices; equal rows repeat
each other; null ids are results like others; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithline.llm.common import arrow_map, dropped, kind, release, text_key, written

LENGTH, GRAM = 400, 32
#: Different pieces of one hash that are compared at once, and pieces in a batch.
GROUP, BATCH = 20_000, 4_096
#: Hashes up to this number travel as a sorted array; beyond it they are joined. Pieces a task remembers to have sent.
MOST_SENT, SEEN = 1_000_000, 200_000
_SLICE = 4 << 20


def anchors_of(buf: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Hash, place, first and last string start of each anchor of one text's bytes."""
    from kithline.llm.textscan import _INV, _ODD, _BYTE, _power, mix

    n = len(buf)
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    if n > _SLICE:
        parts, a = [], 0
        while a + length <= n:
            h, p, lo, hi = anchors_of(buf[a : a + _SLICE], length, gram)
            parts.append((h, p + a, lo + a, hi + a))
            a += _SLICE - length + 1
        return tuple(np.concatenate(x) for x in zip(*parts))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[buf] * _power("odd", _ODD, n)[:n], out=sums[1:])
    m = n - gram + 1
    h = mix((sums[gram:] - sums[:m]) * _power("inv", _INV, n + 1)[:m])
    # smallest of each window of w grams: prefix and suffix minima of blocks of w; the place in the low bits keeps ties leftmost
    bits = np.uint64(23)
    key = h >> bits << bits | np.arange(m, dtype=np.uint64)
    w = length - gram + 1
    blocks = -(-m // w) + 1
    padded = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:m] = key
    square = padded.reshape(blocks, w)
    before = np.minimum.accumulate(square, 1).ravel()
    after = np.minimum.accumulate(square[:, ::-1], 1)[:, ::-1].ravel()
    starts = n - length + 1
    least = np.minimum(after[:starts], before[w - 1 : w - 1 + starts])
    place = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.append(first[1:], starts) - 1
    return h[place[first]], place[first], first, last


def _rows(texts: pa.Array, length: int) -> Iterator[tuple[int, np.ndarray, tuple[np.ndarray, ...]]]:
    from kithline.llm.textscan import flat

    buf, offsets = flat(texts)
    for i in range(len(texts)):
        own = buf[offsets[i] : offsets[i + 1]]
        if len(own) >= length:
            yield i, own, anchors_of(own, length)


def anchors(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """h and number of places, by task."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        found = [a[0] for _, _, a in _rows(batch.column("text"), length)]
        if not found:
            return None
        h, n = np.unique(np.concatenate(found), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    return arrow_map(docs.select("text"), work, "h bigint, n bigint")


def _listed(listed: np.ndarray, h: np.ndarray) -> np.ndarray:
    return listed[np.minimum(np.searchsorted(listed, h), len(listed) - 1)] == h if len(listed) else np.zeros(len(h), bool)


def _digest(piece: bytes) -> bytes:
    return hashlib.blake2b(piece, digest_size=16).digest()


def _id(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def places(docs: DataFrame, repeated: np.ndarray | None, length: int = LENGTH) -> DataFrame:
    """h, text, lo (where the piece begins), first and last (string starts, from the anchor) and id (of the bytes) of each anchor whose hash is listed; of all if there is no list."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        cols: list[list] = [[] for _ in range(7)]
        k1, k2 = batch.column("k1").to_pylist(), batch.column("k2").to_pylist()
        for i, own, (h, place, lo, hi) in _rows(batch.column("text"), length):
            if repeated is not None:
                ok = _listed(repeated, h)
                h, place, lo, hi = h[ok], place[ok], lo[ok], hi[ok]
            raw = own.tobytes()
            for x, p, a, b in zip(h.view(np.int64).tolist(), place.tolist(), lo.tolist(), hi.tolist()):
                for c, v in zip(cols, (x, k1[i], k2[i], a, a - p, b - p, _id(_digest(raw[a : b + length])))):
                    c.append(v)
        if not cols[0]:
            return None
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["h", "k1", "k2", "lo", "first", "last", "id"])

    return arrow_map(docs.select(*text_key(), "text").where("text is not null"), work, "h bigint, k1 bigint, k2 bigint, lo int, first int, last int, id bigint")


def pieces(docs: DataFrame, listed: tuple[np.ndarray, np.ndarray] | None, length: int = LENGTH) -> DataFrame:
    """h, first, id, bytes, and whether the hash is crowded, once for each piece that a task remembers.

    listed: hashes, sorted, and those of them that are crowded. Without it docs has
    the places of each text (h, lo, first, last, crowded) in its column at.
    """

    def asked(batch: pa.RecordBatch) -> Iterator[tuple]:
        if listed is None:
            for text, at in zip(batch.column("text").to_pylist(), batch.column("at").to_pylist()):
                raw = text.encode()
                for v in at:
                    yield v["h"], v["first"], raw[v["lo"] : v["lo"] + v["last"] - v["first"] + length], v["crowded"]
            return
        for _, own, (h, place, lo, hi) in _rows(batch.column("text"), length):
            ok = np.flatnonzero(_listed(listed[0], h))
            raw = own.tobytes()
            for x, p, a, b, c in zip(h[ok].view(np.int64).tolist(), place[ok].tolist(), lo[ok].tolist(), hi[ok].tolist(), _listed(listed[1], h[ok]).tolist()):
                yield x, a - p, raw[a : b + length], c

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from kithline.llm.textscan import chunks

        seen: set[tuple[bytes, int]] = set()
        for batch in batches:
            for part in chunks(batch, "text"):
                out: list[tuple] = []
                for h, first, piece, crowded in asked(part):
                    digest = _digest(piece)
                    if (digest, first) not in seen:
                        if len(seen) < SEEN:
                            seen.add((digest, first))
                        out.append((h, first, _id(digest), piece, crowded))
                if out:
                    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.bool_())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["h", "first", "id", "piece", "crowded"])
        seen.clear()
        release()

    return docs.mapInArrow(run, "h bigint, first int, id bigint, piece binary, crowded boolean")


def repeated_starts(rows: list[tuple[int, bytes]], length: int = LENGTH) -> list[np.ndarray]:
    """For each piece (its first column, its bytes): which of its strings some other piece has in the same column.

    The rounds go from the last column to the first; each puts one byte of every
    piece in front of its suffix.
    """
    m = len(rows)
    left = min(a for a, _ in rows)
    right = max(a + len(b) for a, b in rows)
    width = right - left
    found = np.zeros((m, width), bool)
    with tempfile.SpooledTemporaryFile(max_size=32 << 20) as columns:
        # bytes by column, last column first; 0 where a piece has none, else the byte + 1
        square = np.zeros((m, width), np.uint16)
        for i, (a, b) in enumerate(rows):
            square[i, a - left : a - left + len(b)] = np.frombuffer(b, np.uint8).astype(np.uint16) + 1
        columns.write(np.ascontiguousarray(square[:, ::-1].T).tobytes())
        del square
        columns.seek(0)
        order = np.arange(m)
        common = np.zeros(m, np.int32)  # prefix that a suffix has in common with the one before it in the order
        for x in range(width - 1, -1, -1):
            byte = np.frombuffer(columns.read(2 * m), np.uint16)[order]
            step = np.argsort(byte, kind="stable")
            sorted_byte = byte[step]
            new = np.zeros(m, np.int32)
            heads = np.flatnonzero(np.concatenate([[True], sorted_byte[1:] != sorted_byte[:-1]]))
            for a, b in zip(heads.tolist(), np.append(heads[1:], m).tolist()):
                if b - a > 1:
                    # between two suffixes that follow each other now, all that stood between them counts
                    old = step[a:b]
                    if old[-1] - old[0] == b - a - 1:
                        new[a + 1 : b] = common[old[1:]] + 1
                    else:
                        new[a + 1 : b] = np.minimum.reduceat(common, old[:-1] + 1)[: b - a - 1] + 1 if old[-1] == m - 1 else _between(common, old) + 1
            order, common = order[step], new
            hit = common >= length
            if hit.any():
                both = hit.copy()
                both[:-1] |= hit[1:]
                found[order[both], x] = True
    return [found[i, a - left : a - left + len(b) - length + 1] for i, (a, b) in enumerate(rows)]


def _between(common: np.ndarray, old: np.ndarray) -> np.ndarray:
    """Least of common over (old[i], old[i + 1]] for all i."""
    edges = np.append(old[:-1] + 1, old[-1] + 1)
    return np.minimum.reduceat(common, edges)[:-1]


def _intervals(mask: np.ndarray, start: int) -> list[int]:
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return (np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], 1).ravel() + start).tolist()


def compare(classes: DataFrame, length: int = LENGTH) -> DataFrame:
    """Rows (h, first, id, piece, n) in order of h, first and id: repeated string starts of each, as intervals from the piece's start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def solve(group: list[tuple]) -> pa.RecordBatch:
            found = repeated_starts([(g[1], g[2]) for g in group], length) if len(group) > 1 else [np.zeros(len(group[0][2]) - length + 1, bool)]
            spans = [_intervals(np.ones(len(f), bool) if g[3] > 1 else f, 0) for g, f in zip(group, found)]
            cols = [pa.array([g[i] for g in group], pa.int64()) for i in (0, 4)]
            return pa.RecordBatch.from_arrays([*cols, pa.array([g[1] for g in group], pa.int32()), pa.array(spans, pa.list_(pa.int32()))], ["h", "id", "first", "spans"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("h", "first", "piece", "n", "id"))):
                if held and (row[0], row[1], row[4]) == (held[-1][0], held[-1][1], held[-1][4]):
                    continue  # the same piece from another task
                if len(held) >= BATCH and row[0] != held[-1][0]:
                    yield solve(held)
                    held = []
                held.append(row)
        if held:
            yield solve(held)
        release()

    return classes.mapInArrow(run, "h bigint, id bigint, first int, spans array<int>")


def refined(classes: DataFrame, step: int, length: int = LENGTH) -> DataFrame:
    """Pieces cut into runs of ``step`` string starts; a run's hash is that of the bytes all its strings have in common.

    Runs begin at multiples of the step from the anchor, so equal strings fall into
    runs of the same number and have the same bytes in common.
    """
    last = F.expr(f"first + length(piece) - {length}")
    cut = classes.withColumn("run", F.explode(F.sequence(F.floor(F.col("first") / step).cast("int"), F.floor(last / step).cast("int"))))
    cut = cut.withColumn("a", F.greatest(F.col("first"), F.col("run") * step)).withColumn("b", F.least(last + 1, (F.col("run") + 1) * step))
    core = F.expr(f"substring(piece, (run + 1) * {step} - first, {length} - {step} + 1)")
    return cut.select(
        F.xxhash64("h", "run", core).alias("h"), F.col("h").alias("h0"), F.col("first").alias("first0"), F.col("id").alias("id0"),
        F.col("a").alias("first"), F.expr(f"substring(piece, a - first + 1, b - a + {length} - 1)").alias("piece"), "n",
    ).withColumn("id", F.xxhash64("piece"))


def _ordered(classes: DataFrame, length: int) -> DataFrame:
    return compare(classes.repartition("h").sortWithinPartitions("h", "first", "id"), length)


def solved(classes: DataFrame, length: int = LENGTH, group: int = GROUP, steps: tuple[int, ...] = (48, 1)) -> DataFrame:
    """h, first, id and the repeated string starts of each class (h, first, id, piece, n); hashes with too many classes are refined first."""
    if not steps:
        return _ordered(classes, length)
    crowded = written(classes.groupBy("h").count().where(F.col("count") > group).select("h"), "crowded")
    if crowded.isEmpty():
        return _ordered(classes, length)
    fine = written(refined(classes.join(crowded, "h", "left_semi"), steps[0], length), "runs")
    again = written(fine.groupBy("h", "first", "id", "piece").agg(F.sum("n").alias("n")), "run-classes")
    back = (
        fine.select("h", "first", "id", "h0", "first0", "id0").distinct().join(solved(again, length, group, steps[1:]), ["h", "first", "id"])
        .groupBy("h0", "id0", "first0").agg(F.flatten(F.collect_list(F.transform("spans", lambda v: v + F.col("first") - F.col("first0")))).alias("spans"))
        .select(F.col("h0").alias("h"), F.col("id0").alias("id"), F.col("first0").alias("first"), "spans")
    )
    return _ordered(classes.join(crowded, "h", "left_anti"), length).unionByName(back)


def _hashes(rows: DataFrame) -> np.ndarray:
    return np.sort(rows.select("h").toPandas()["h"].to_numpy(np.int64).view(np.uint64))


def spans(docs: DataFrame, length: int = LENGTH, most_sent: int = MOST_SENT, group: int = GROUP) -> DataFrame:
    """k1, k2 and the repeated string starts (intervals) of each text that has some."""
    often = written(anchors(docs, length).groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"), "hashes")
    if often.count() <= most_sent:
        found = places(docs, _hashes(often), length)
    else:
        found = places(docs, None, length).join(often, "h", "left_semi")
    found = written(found, "places")
    dropped(often)
    classes = written(found.groupBy("h", "first", "last", "id").agg(F.count("*").alias("n")), "classes")
    several = written(classes.groupBy("h").count().where("count > 1").select("h", (F.col("count") > group).alias("crowded")), "several")
    texts = docs.where("text is not null")
    if (total := several.count()) <= most_sent:
        sent = pieces(texts.select("text"), (_hashes(several), _hashes(several.where("crowded"))), length)
    else:
        at = found.join(several, "h").groupBy("k1", "k2").agg(F.collect_set(F.struct("h", "lo", "first", "last", "crowded")).alias("at"))
        once = texts.select(*text_key(), "text").dropDuplicates(["k1", "k2"])
        sent = pieces(once.join(at, ["k1", "k2"]).select("text", "at"), None, length)
    alike = classes.where("n > 1").select("h", "id", "first", F.array(F.lit(0), F.col("last") - F.col("first") + 1).alias("spans"))
    if total and not several.where("crowded").isEmpty():
        sent = written(sent, "pieces")
        full = written(sent.where("crowded").groupBy("h", "first", "id", "piece").agg(F.lit(1).cast("bigint").alias("n")), "crowded-pieces")
        alike = alike.unionByName(solved(full, length, group))
    if total:
        plain = sent.where("not crowded").select("h", "first", "id", "piece", F.lit(1).cast("bigint").alias("n"))
        alike = alike.unionByName(_ordered(plain, length))
    return (
        found.select("h", "first", "id", "k1", "k2", "lo").distinct().join(alike.where(F.size("spans") > 0), ["h", "first", "id"])
        .groupBy("k1", "k2").agg(F.flatten(F.collect_list(F.transform("spans", lambda s: s + F.col("lo")))).alias("spans"))
    )


def cut(docs: DataFrame, length: int = LENGTH, most_sent: int = MOST_SENT, group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the kept bytes."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        from kithline.llm.textscan import flat

        buf, offsets = flat(batch.column("text"))
        removed, runs, kept = [], [], []
        for i, s in enumerate(batch.column("spans").to_pylist()):
            own = buf[offsets[i] : offsets[i + 1]]
            if s:
                steps = np.zeros(len(own) + 1, np.int32)
                np.add.at(steps, np.array(s[::2]), 1)
                np.add.at(steps, np.array(s[1::2]) + length - 1, -1)
                gone = np.cumsum(steps[:-1]) > 0
                removed.append(int(gone.sum()))
                runs.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                own = own[~gone]
            else:
                removed.append(0), runs.append(0)
            kept.append(own.tobytes())
        sha = [hashlib.sha256(x).hexdigest() for x in kept]
        cols = [batch.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha), pa.array(kept, pa.binary())]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    schema = f"doc_id {kind(docs, 'doc_id')}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    rows = docs.select("doc_id", "text", *text_key())
    # texts shorter than length have nothing to be joined to
    long = F.coalesce(F.octet_length("text") >= length, F.lit(False))
    joined = rows.where(long).join(spans(docs, length, most_sent, group), ["k1", "k2"], "left").select("doc_id", "text", "spans")
    short = rows.where(~long).select("doc_id", "text", F.lit(None).cast("array<int>").alias("spans"))
    return arrow_map(joined, work, schema).unionByName(arrow_map(short, work, schema))


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
g AS (SELECT rid, i, md5(substr(x, 2 * i + 1, {2 * LENGTH})) AS h FROM (SELECT rid, x, unnest(range(CAST(length(x) // 2 AS BIGINT) - {LENGTH} + 1)) AS i FROM d WHERE length(x) >= {2 * LENGTH})),
f AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1),
t AS (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS before FROM g SEMI JOIN f USING (h)),
k AS (SELECT rid, i, sum(CASE WHEN before IS NULL OR i > before + {LENGTH} THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY i) AS run FROM t),
r AS (SELECT rid, run, min(i) AS a, max(i) + {LENGTH} AS b FROM k GROUP BY rid, run),
p AS (SELECT rid, run, a, b, lag(b, 1, 0) OVER (PARTITION BY rid ORDER BY run) AS since FROM r),
o AS (SELECT rid, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, max(b) AS upto, string_agg(substr(x, 2 * since + 1, 2 * (a - since)), '' ORDER BY run) AS head FROM p JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head, '') || CASE WHEN upto IS NULL THEN x ELSE substr(x, 2 * upto + 1) END)) AS kept_sha256
FROM d LEFT JOIN o USING (rid)
"""
