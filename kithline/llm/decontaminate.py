"""Benchmark decontamination by training suffix arrays.

Each slice of the training texts (a shard: some megabytes of whole documents)
gets a word suffix array: positions sorted by the following 16 words, packed as
16-bit word codes into four 64-bit keys. Every suffix of every test item is
looked up by binary search, key by key; the range of positions that share its
window is checked word by word on 64-bit word identities, so equal codes of
different words do no harm. Matched windows give the hit words of a document,
the items found, and the longest verbatim match with its place.

Every suffix of an item that has a whole window is searched for by that window;
windows that follow one another in both texts make up the longest verbatim match
of their suffixes, and the longest of a document is kept with its place in both.

Shards are independent, so there is no shuffle. Test items travel to the tasks
in blocks of about ``BLOCK_WORDS`` words. With more than one block, what was found
is written beside the texts after each, and the next block is read from the table
only then: the driver and the tasks never hold more than one.

Windows are 13 consecutive words of an item; a shorter item with words is one
window. A document is contaminated if it has hit words and 20 times their number
reaches its words.

Edge cases: null and empty texts have no words and are never contaminated; whole
texts are searched; a window never crosses documents; repeated rows give repeated
results; items with a null id hit words but aren't listed; items with equal ids
count once; of equally long matches the first in the document counts, then the
smallest item id (null last), then the first place in the item; an empty table on
either side gives the defined counts with no hits; extra columns are ignored; ids
may have any type.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kithline.llm.common import dropped, kind, release, written

WINDOW = 13
#: Words of test items that travel to the tasks at once, and bytes of text in a shard.
BLOCK_WORDS, SHARD_BYTES = 1_000_000, 2 << 20


def scan(texts: pa.Array):
    from kithline.llm.textscan import ALNUM, LOWER, Words, flat

    return Words(*flat(texts), ALNUM, LOWER)


def codes(h: np.ndarray) -> np.ndarray:
    """16-bit word codes from 1 on; 0 stands for the end of a text."""
    return (h % np.uint64(65535) + np.uint64(1)).astype(np.uint64)


class Items:
    """The windows of a block of test items, by window length."""

    def __init__(self, texts: list[str | None], ids: list[int | None]):
        words = scan(pa.array(texts, pa.large_string()))
        h = words.hashes()
        self.h, self.ids = h, ids
        count = words.per_doc()
        first = np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64)
        start, item, size = [], [], []
        for i, n in enumerate(count.tolist()):
            m = min(n, WINDOW)
            for j in range(n - m + 1 if n else 0):
                start.append(first[i] + j), item.append(i), size.append(m)
        self.start, self.item, self.size = (np.array(v, np.int64) for v in (start, item, size))
        self.place = self.start - first[self.item] if len(self.item) else self.start


def packed(c: np.ndarray, level: int) -> np.ndarray:
    """Key number ``level``: words 4 x level to 4 x level + 3 from each position; c is padded with 16 zeros."""
    n, at = len(c) - 16, 4 * level
    return c[at : at + n] << np.uint64(48) | c[at + 1 : at + 1 + n] << np.uint64(32) | c[at + 2 : at + 2 + n] << np.uint64(16) | c[at + 3 : at + 3 + n]


class Shard:
    """The suffix array of some texts; an end code stands between texts."""

    def __init__(self, h: np.ndarray, doc: np.ndarray, n_docs: int):
        # each text is followed by 16 end codes' worth of distance: its place in c is moved on by one end per text before it
        self.h, self.doc = h, doc
        self.at = np.arange(len(h)) + doc  # one end code after each text
        c = np.zeros(len(h) + n_docs + 16, np.uint64)
        c[self.at] = codes(h)
        self.c = c
        self.word = np.full(len(c), -1, np.int64)
        self.word[self.at] = np.arange(len(h))
        keys = packed(c, 0)[self.at]
        order = np.argsort(keys, kind="stable")
        self.sa = self.at[order]
        self.keys = [keys[order]]
        # positions whose first key ties are put in order by the keys after it
        same = self.keys[0][1:] == self.keys[0][:-1]
        tied = np.zeros(len(order), bool)
        tied[1:] |= same
        tied[:-1] |= same
        rows = np.flatnonzero(tied)
        later = [packed(c, k) for k in (1, 2, 3)]
        if len(rows):
            p = self.sa[rows]
            self.sa[rows] = p[np.lexsort((later[2][p], later[1][p], later[0][p], self.keys[0][rows]))]
        self.later = later

    def ranges(self, q: np.ndarray, start: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """For each window of ``size`` words in the code string q: where the suffixes that begin with it stand."""
        n = len(self.sa)
        lo, hi = np.zeros(len(start), np.int64), np.full(len(start), n, np.int64)
        for level in range(-(-size // 4)):
            key = packed(q, level)[start]
            free = np.uint64(16 * max(0, 4 * level + 4 - size))
            low = key >> free << free
            high = low | ((np.uint64(1) << free) - np.uint64(1))
            if level == 0:
                lo, hi = np.searchsorted(self.keys[0], low, "left"), np.searchsorted(self.keys[0], high, "right")
            else:
                lo, hi = self._bound(level, low, lo, hi, False), self._bound(level, high, lo, hi, True)
        return lo, hi

    def _bound(self, level: int, key: np.ndarray, lo: np.ndarray, hi: np.ndarray, after: bool) -> np.ndarray:
        """Binary search for all queries at once, each inside its own range."""
        lo, hi, values = lo.copy(), hi.copy(), self.later[level - 1]
        while (going := np.flatnonzero(lo < hi)).size:
            mid = (lo[going] + hi[going]) // 2
            found = values[self.sa[mid]]
            right = found <= key[going] if after else found < key[going]
            lo[going[right]] = mid[right] + 1
            hi[going[~right]] = mid[~right]
        return lo


def search(texts: pa.Array, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Verified matches: window numbers, first words (in all words of the texts), texts; and words by text, first word of each text."""
    words = scan(texts)
    h, n_words = words.hashes(), words.per_doc()
    first = np.concatenate([[0], np.cumsum(n_words)[:-1]]).astype(np.int64)
    none = np.zeros(0, np.int64)
    if not len(h) or not len(items.start):
        return none, none, none, n_words, first
    shard = Shard(h, words.doc, len(texts))
    q = np.concatenate([codes(items.h), np.zeros(16, np.uint64)])
    qh = np.concatenate([items.h, np.zeros(16, np.uint64)])
    found_w, found_p = [none], [none]
    for size in np.unique(items.size):
        mine = np.flatnonzero(items.size == size)
        lo, hi = shard.ranges(q, items.start[mine], int(size))
        n = np.maximum(hi - lo, 0)
        window = np.repeat(mine, n)
        place = shard.sa[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
        at = shard.word[place]
        ok = np.ones(len(at), bool)
        for k in range(int(size)):
            ok &= h[np.minimum(at + k, len(h) - 1)] == qh[items.start[window] + k]
        found_w.append(window[ok])
        found_p.append(at[ok])
    window, at = np.concatenate(found_w), np.concatenate(found_p)
    return window, at, words.doc[at] if len(at) else none, n_words, first


def _search_batch(batch: pa.RecordBatch, items: Items) -> pa.RecordBatch:
    """Adds what a block of items finds to the columns spans, found and longest."""
    from kithline.llm.textscan import covered

    window, at, doc, n_words, first = search(batch.column("text"), items)
    n = batch.num_rows
    spans, found, best = (batch.column(k).to_pylist() for k in ("spans", "found", "longest"))
    mask = covered(int(n_words.sum()), at, items.size[window]) if len(at) else None
    for d in np.unique(doc):
        own = doc == d
        w, p = window[own], at[own]
        a = int(first[d])
        edge = np.diff(np.concatenate([[0], mask[a : a + int(n_words[d])].astype(np.int8), [0]]))
        spans[d] = (spans[d] or []) + np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], 1).ravel().tolist()
        found[d] = (found[d] or []) + [items.ids[i] for i in np.unique(items.item[w]) if items.ids[i] is not None]
        # windows that follow one another in both texts are one longer match
        order = np.lexsort((p, p - items.start[w]))
        w, p = w[order], p[order]
        new = np.ones(len(w), bool)
        new[1:] = (np.diff(p) != 1) | (np.diff(items.start[w]) != 1) | (items.item[w][1:] != items.item[w][:-1])
        head = np.flatnonzero(new)
        length = np.diff(np.append(head, len(w))) - 1 + items.size[w[head]]
        length = length.tolist()
        most = max(length)
        match = [{"item_id": items.ids[items.item[w[k]]], "first_word": int(p[k] - a), "item_word": int(items.place[w[k]]), "words": most} for k, n in zip(head.tolist(), length) if n == most]
        best[d] = min([*match, *([best[d]] if best[d] else [])], key=_order)
    return pa.RecordBatch.from_arrays(
        [*(batch.column(i) for i in range(batch.num_columns - 4)), *(pa.array(v, batch.schema.field(k).type) for k, v in (("n_words", n_words), ("spans", spans), ("found", found), ("longest", best)))],
        batch.schema.names,
    )


def _order(match: dict) -> tuple:
    """Longest matches first, then by place in the document, item and place in the item."""
    item = match["item_id"]
    return -match["words"], match["first_word"], item is None, 0 if item is None else item, match["item_word"]


FOUND = ["n_words", "spans", "found", "longest"]


def found_type(item_id: str) -> str:
    return f"n_words bigint, spans array<bigint>, found array<{item_id}>, longest struct<item_id: {item_id}, first_word: bigint, item_word: bigint, words: bigint>"


def blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> tuple[int, Callable[[int], list[Row]]]:
    """The number of blocks that the test items are dealt to, and how to read one of them; its size is bounded."""
    rows = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    size = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-size // (2 * block_words)))
    part = F.pmod(F.xxhash64("text"), F.lit(n))
    return n, lambda k: (rows if n == 1 else rows.where(part == k)).collect()


def find(docs: DataFrame, benchmark: DataFrame, finish: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, finished: str | StructType = "") -> DataFrame:
    """The rows of docs with n_words, spans (starts and ends of hit words), found (item ids) and longest; or what finish makes of them, in the same worker, with its schema."""
    out = docs.drop(*FOUND)
    more = StructType.fromDDL(found_type(kind(benchmark, "item_id")))
    out = out.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in more.fields))
    schema = StructType([*docs.drop(*FOUND).schema.fields, *more.fields])
    n, block = blocks(benchmark)
    before = None
    for k in range(n):
        rows = block(k)

        def run(batches, texts=[r["text"] for r in rows], ids=[r["item_id"] for r in rows], last=finish if k + 1 == n else None):
            from kithline.llm import textscan

            items = Items(texts, ids)
            for batch in batches:
                for part in textscan.chunks(batch, "text", SHARD_BYTES):
                    got = _search_batch(part, items)
                    yield last(got) if last else got
            release()

        out = out.mapInArrow(run, finished if finish and k + 1 == n else schema)
        if k + 1 < n:
            out = written(out, "found")
            if before is not None:
                dropped(before)
            before = out
    return out


def merged(spans: list[int]) -> int:
    """Words inside the union of spans."""
    pairs = sorted(zip(spans[::2], spans[1::2]))
    total, end = 0, 0
    for a, b in pairs:
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


def is_contaminated(n_hit: int, n_words: int) -> bool:
    return n_hit > 0 and 20 * n_hit >= n_words


def judge(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the longest match: its words, where it begins, and the item."""

    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_words = batch.column("n_words").to_pylist()
        hit = [merged(s) if s else 0 for s in batch.column("spans").to_pylist()]
        found = [sorted({str(i) for i in f or []}) for f in batch.column("found").to_pylist()]
        sha = [hashlib.sha256(",".join(f).encode()).hexdigest() for f in found]
        bad = [is_contaminated(a, b) for a, b in zip(hit, n_words)]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(f) for f in found], pa.int64()), pa.array(sha, pa.string()), pa.array(bad, pa.bool_()), batch.column("longest")],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest"],
        )

    longest = found_type(kind(benchmark, "item_id")).partition(", longest ")[2]
    out = find(docs.select("doc_id", "text"), benchmark, digest, f"doc_id {kind(docs, 'doc_id')}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, longest {longest}")
    place = {"longest_words": F.coalesce("longest.words", F.lit(0).cast("bigint")), "longest_first_word": F.col("longest.first_word"), "longest_item_id": F.col("longest.item_id"), "longest_item_word": F.col("longest.item_word")}
    return out.withColumns(place).drop("longest")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that aren't contaminated."""
    # what docs already calls by the names of results is kept aside, whatever it holds
    aside = {c: f"kith_own_{c}" for c in docs.columns if c in FOUND}
    rows = docs.withColumnsRenamed(aside)
    names = rows.columns

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        bad = [is_contaminated(merged(s) if s else 0, n) for s, n in zip(batch.column("spans").to_pylist(), batch.column("n_words").to_pylist())]
        return batch.filter(pa.array([not x for x in bad], pa.bool_())).select(names)

    return find(rows, benchmark, keep, rows.schema).withColumnsRenamed({v: k for k, v in aside.items()})


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT row_number() OVER () AS iid, item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT iid, item_id, j, least(len(w), 13) AS m, array_to_string(w[j:j + least(len(w), 13) - 1], ' ') AS win
  FROM (SELECT iid, item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS j FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM bw),
dw AS (
  SELECT rid, m, p, array_to_string(w[p:p + m - 1], ' ') AS win
  FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, sizes WHERE len(w) >= m)),
hits AS (SELECT dw.rid, dw.p, dw.m, bw.iid, bw.j, bw.item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.win = bw.win),
cov AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + m)) AS q FROM (SELECT DISTINCT rid, p, m FROM hits)) GROUP BY rid),
one AS (SELECT rid, iid, item_id, m, p, j, p - row_number() OVER (PARTITION BY rid, iid, p - j ORDER BY p) AS g FROM hits),
lens AS (SELECT rid, item_id, min(p) - 1 AS first_word, min(j) - 1 AS item_word, count(*) + any_value(m) - 1 AS words FROM one GROUP BY rid, iid, item_id, p - j, g),
lng AS (SELECT * FROM lens QUALIFY row_number() OVER (PARTITION BY rid ORDER BY words DESC, first_word, item_id NULLS LAST, item_word) = 1),
its AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM hits WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
       CAST(coalesce(words, 0) AS BIGINT) AS longest_words, CAST(first_word AS BIGINT) AS longest_first_word, lng.item_id AS longest_item_id, CAST(item_word AS BIGINT) AS longest_item_word
FROM d LEFT JOIN cov USING (rid) LEFT JOIN its USING (rid) LEFT JOIN lng USING (rid)
"""
