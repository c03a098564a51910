"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are the words of a text (ASCII case folded, split at ASCII marks) and those
of their first 4, 5 and 6 bytes that go with the label. A term weighs (1 + log tf)
x idf x relevance; relevance is ``FLOOR`` for a term that has nothing to do with the
label and rises to 1 with the standard errors by which it is more frequent in
toxic examples. So every text with words has a vector over all of them, its copies
are at cosine 1, and texts that share what the label goes with are near.

The examples, a bounded sample of labelled texts, form postings in blocks of
``BLOCK`` examples; for each term and block with that term the largest weight is
kept. The ``FREQUENT`` most frequent terms have long postings and little weight; an
example has its weights for them in one row, and the row's length bounds (after
Cauchy and Schwarz) what they can add. A search scores the most promising blocks,
then every block, and of it every example, whose bound reaches the k-th best
similarity found: the result is that of a full scan. The score of a text is the share of its neighbours' votes, weighted by similarity
squared and by how the sample thinned the classes, and calibrated by isotonic
regression on leave-one-out votes. Neighbours are the evidence.

Edge cases: null and empty texts, and texts without any known word, get the
calibrated rate of examples without neighbours; whole texts are scanned; ties are
broken by the order of examples (by id, then text); repeated rows give repeated
results; a document with conflicting labels counts as toxic, one with several
texts as several examples; texts of more than ``MOST_BYTES`` bytes are scored, but
aren't examples; without labels the score is 0; an empty table gives an empty
result; extra columns are ignored; rows with a null id are scored and never learnt
from; doc_id may have any type.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithline.llm.common import arrow_map, fold, held_out, kind, sample_fraction, sampled

#: Bounds of the fitted model: labelled examples of each class, and bytes of one.
MOST_PER_CLASS, MOST_BYTES = 2_000, 200_000
#: Relevance of a term that doesn't go with the label; standard errors at which it begins to rise and at which it is 1; toxic examples that such a term is in at least.
FLOOR, FROM, TO, SUPPORT = 0.03, 2.5, 7.0, 3
NEIGHBOURS, BLOCK, FREQUENT = 15, 64, 512
#: More than the error of a sum of FREQUENT products of numbers up to 1 in 32 bits.
SLACK = 1e-4
PREFIXES = (4, 5, 6)
_PREFIX = np.uint64(0x5851F42D4C957F2D)


def term_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, term) with frequencies, sorted; and whether the term is a whole word."""
    from kithline.llm.textscan import ALNUM, LOWER, Words, flat

    words = Words(*flat(texts), ALNUM, LOWER)
    parts = [(*_counted(words.doc, words.hashes()), True)]
    long = [words.end - words.start > k for k in PREFIXES]
    starts = [words.span_hash(words.start[x], words.start[x] + k) ^ _PREFIX for x, k in zip(long, PREFIXES)]
    parts.append((*_counted(np.concatenate([words.doc[x] for x in long]), np.concatenate(starts)), False))
    doc, term, tf = (np.concatenate([p[i] for p in parts]) for i in range(3))
    whole = np.concatenate([np.full(len(p[0]), p[3]) for p in parts])
    order = np.lexsort((term, doc))
    return doc[order], term[order], tf[order], whole[order]


def _counted(doc: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((term, doc))
    doc, term = doc[order], term[order]
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])
    at = np.flatnonzero(first)
    return doc[at], term[at], np.diff(np.append(at, len(doc)))


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the ranges one after another, and the size of each range."""
    size = hi - lo
    ends = np.cumsum(size, dtype=np.int32)
    return np.repeat(lo - ends + size, size) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32), size


@dataclass
class Examples:
    """The fitted model."""

    terms: np.ndarray  # sorted identities
    weigh: np.ndarray  # idf x relevance of each
    unknown: float  # the same of a word that no example has
    ids: list  # doc_id of each example
    label: np.ndarray
    weight: np.ndarray  # how many documents an example stands for
    row: np.ndarray  # term: its column among the frequent ones, or -1
    rows: np.ndarray  # example x frequent term
    short: np.ndarray  # the same the other way round, in 32 bits
    length: np.ndarray  # of each row
    block_length: np.ndarray  # the longest of each block
    post_id: np.ndarray  # postings by (term, example) of the other terms
    post_weight: np.ndarray
    term_at: np.ndarray  # term: its first entry
    entry_block: np.ndarray  # entries: a term in a block
    entry_max: np.ndarray
    entry_at: np.ndarray  # entry: its first posting
    steps_x: np.ndarray
    steps_y: np.ndarray
    silent: float  # rate of examples without neighbours

    def known(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.terms):
            return np.zeros(len(term), np.int64), np.zeros(len(term), bool)
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        return at, self.terms[at] == term

    def _scores(self, entries: np.ndarray, weights: np.ndarray) -> np.ndarray:
        take, size = _ranges(self.entry_at[entries], self.entry_at[entries + 1])
        return np.bincount(self.post_id[take], self.post_weight[take] * np.repeat(weights, size), len(self.ids))

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k most similar examples with positive similarity, and the similarities."""
        often = self.row[terms] >= 0
        column, much = self.row[terms[often]], weights[often]
        far = float(np.sqrt((much * much).sum()))
        terms, weights = terms[~often], weights[~often]
        entries, size = _ranges(self.term_at[terms], self.term_at[terms + 1])
        w, block = np.repeat(weights, size), self.entry_block[entries]
        blocks = len(self.block_length)
        bound = np.bincount(block, w * self.entry_max[entries], blocks) + far * self.block_length
        asked = np.zeros(self.rows.shape[1])
        asked[column] = much
        scored: list[tuple[np.ndarray, np.ndarray]] = []

        def exact(some: np.ndarray, part: np.ndarray) -> float:
            """Takes these examples in; the k-th best so far."""
            scored.append((some, np.where(some == without, 0.0, part[some] + self.rows[some] @ asked)))
            got = np.concatenate([x for _, x in scored])
            return float(np.partition(got, len(got) - k)[len(got) - k]) if len(got) > k else 0.0

        now = np.zeros(blocks, bool)
        now[np.argpartition(-bound, k // BLOCK + 1)[: k // BLOCK + 2] if blocks > k // BLOCK + 2 else slice(None)] = True
        mine = now[block]
        least = exact(np.flatnonzero(np.repeat(now, BLOCK)[: len(self.ids)]), self._scores(entries[mine], w[mine]))
        rest = ~now & (bound >= max(least - 1e-9, 1e-12))
        if rest.any():
            mine = rest[block]
            part = self._scores(entries[mine], w[mine])
            first = np.flatnonzero(np.repeat(rest, BLOCK)[: len(self.ids)] & (part + far * self.length >= least - 1e-9))
            if len(first) > 8 * k:
                # what the rows add, in short numbers: right to SLACK, so a closer bound
                reach = part[first] + (much.astype(np.float32) @ self.short[column])[first] + SLACK
                top = np.argpartition(-reach, 2 * k)
                least = exact(first[top[: 2 * k]], part)
                first = first[top[2 * k :]]
                first = first[reach[top[2 * k :]] >= least - 1e-9]
            exact(first, part)
        some, score = (np.concatenate([x[i] for x in scored]) for i in (0, 1))
        score = np.round(score, 9)
        best = np.lexsort((some, -score))[:k]  # ties go by order
        best = best[score[best] > 0]
        return some[best], score[best]

    def vote(self, best: np.ndarray, similarity: np.ndarray) -> float:
        """Share of the votes that are for the label; -1 without neighbours."""
        w = similarity * similarity * self.weight[best]
        return float((w * self.label[best]).sum() / w.sum()) if len(best) else -1.0

    def calibrated(self, vote: float) -> float:
        if vote < 0 or not len(self.steps_x):
            return self.silent
        return float(np.interp(vote, self.steps_x, self.steps_y))

    def vectors(self, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows (text, term number, weight in the unit vector) of the known terms; words that no example has count in the length."""
        at, ok = self.known(term)
        w = (1 + np.log(tf)) * np.where(ok, self.weigh[at] if len(self.terms) else 0.0, np.where(whole, self.unknown, 0.0))
        norm = np.sqrt(np.bincount(doc, w * w, (doc.max() + 1) if len(doc) else 0))
        return doc[ok], at[ok], w[ok] / norm[doc[ok]]

    def score(self, texts: pa.Array) -> tuple[np.ndarray, list[list]]:
        doc, at, w = self.vectors(*term_counts(texts))
        out, evidence = np.full(len(texts), self.silent), [[] for _ in range(len(texts))]
        starts = np.searchsorted(doc, np.arange(len(texts) + 1))
        for d in np.unique(doc):
            a, b = starts[d], starts[d + 1]
            best, similarity = self.search(at[a:b], w[a:b], NEIGHBOURS)
            out[d] = self.calibrated(self.vote(best, similarity))
            evidence[d] = [self.ids[i] for i in best[:3]]
        return out, evidence


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; the step ends and their means."""
    blocks: list[list[float]] = []
    for i in np.lexsort((y, x)):
        blocks.append([x[i], x[i], y[i] * w[i], w[i]])
        while len(blocks) > 1 and (blocks[-2][2] / blocks[-2][3] >= blocks[-1][2] / blocks[-1][3] or blocks[-2][1] == blocks[-1][0]):
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0], last[1], blocks[-1][2] + last[2], blocks[-1][3] + last[3]]
    return np.array([v for b in blocks for v in b[:2]]), np.array([b[2] / b[3] for b in blocks for _ in range(2)])


def relevance(bad: np.ndarray, fine: np.ndarray, n_bad: float, n_fine: float) -> np.ndarray:
    """FLOOR to 1 by the standard errors that a term is more frequent in n_bad toxic examples than in n_fine others."""
    p = (bad + fine) / max(n_bad + n_fine, 1)
    apart = (bad / max(n_bad, 1) - fine / max(n_fine, 1)) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / max(n_bad, 1) + 1 / max(n_fine, 1)))
    return FLOOR + (1 - FLOOR) * np.where(bad >= SUPPORT, np.clip((apart - FROM) / (TO - FROM), 0, 1), 0.0)


def index(ids: list, label: np.ndarray, weight: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, whole: np.ndarray) -> Examples:
    """Weights, blocks, postings and calibration over examples given as (doc, term, tf, whole word) rows."""
    n, none = len(ids), np.zeros(0)
    model = Examples(none.astype(np.uint64), none, 0.0, [], none, none, none.astype(np.int64), *[np.zeros((0, 0))] * 2, *[none] * 10, silent=0.0)
    if not n:
        return model
    terms, first, at = np.unique(term, return_index=True, return_inverse=True)
    bad, fine = (np.bincount(at, v[doc], len(terms)) for v in (label, 1 - label))
    related = relevance(bad, fine, label.sum(), (1 - label).sum())
    keep = whole[first] | (related > FLOOR)
    total = weight.sum()
    idf = np.log((total + 1) / (np.bincount(at, weight[doc], len(terms)) + 1)) + 1
    model.terms, model.weigh, model.unknown = terms[keep], (idf * related)[keep], float((np.log(total + 1) + 1) * FLOOR)
    doc, at, w = model.vectors(doc, term, tf, whole)
    # examples with the same leading term go to neighbouring blocks, so that bounds are tight
    lead = np.full(n, len(model.terms))
    by_weight = np.lexsort((at, -w, doc))
    some, where = np.unique(doc[by_weight], return_index=True)
    lead[some] = at[by_weight][where]
    order = np.lexsort((np.arange(n), lead))
    new = np.empty(n, np.int64)
    new[order] = np.arange(n)
    model.ids, model.label, model.weight = [ids[i] for i in order], label[order], weight[order]
    doc = new[doc]
    order = np.lexsort((doc, at))
    doc, at, w = doc[order], at[order], w[order]
    blocks = -(-n // BLOCK)
    df = np.bincount(at, minlength=len(model.terms))
    often = np.sort(np.argsort(-df, kind="stable")[:FREQUENT])
    often = often[df[often] * 32 > n]
    model.row = np.full(len(model.terms), -1)
    model.row[often] = np.arange(len(often))
    model.rows = np.zeros((n, len(often)))
    own = model.row[at] >= 0
    model.rows[doc[own], model.row[at[own]]] = w[own]
    model.short = np.ascontiguousarray(model.rows.T, np.float32)
    model.length = np.sqrt((model.rows**2).sum(1))
    model.block_length = np.maximum.reduceat(model.length, np.arange(0, n, BLOCK))
    every = doc, at, w
    doc, at, w = doc[~own], at[~own], w[~own]
    model.post_id, model.post_weight = doc.astype(np.int32), w
    cell = at * blocks + doc // BLOCK
    heads = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
    model.entry_at = np.append(heads, len(cell)).astype(np.int32)
    model.entry_block = (cell[heads] % blocks).astype(np.int32)
    model.entry_max = np.maximum.reduceat(w, heads) if len(heads) else w
    model.term_at = np.searchsorted(cell[heads] // blocks, np.arange(len(model.terms) + 1)).astype(np.int32)
    doc, at, w = every
    votes = np.full(n, -1.0)
    by_doc = np.lexsort((at, doc))
    starts = np.searchsorted(doc[by_doc], np.arange(n + 1))
    for d in range(n):
        own = by_doc[starts[d] : starts[d + 1]]
        if len(own):
            votes[d] = model.vote(*model.search(at[own], w[own], NEIGHBOURS, without=d))
    heard = votes >= 0
    if heard.any():
        model.steps_x, model.steps_y = isotonic(votes[heard], model.label[heard], model.weight[heard])
    if (~heard).any():
        model.silent = float(np.average(model.label[~heard], weights=model.weight[~heard]))
    return model


def fit(docs: DataFrame, labels: DataFrame, most_per_class: int = MOST_PER_CLASS) -> Examples:
    """The model from at most about most_per_class labelled documents of each class outside fold 2."""
    labelled = labels.where(F.col("toxic").isin(0, 1) & (fold(F.col("doc_id")) != 2)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    there = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    wanted = None
    for y, total in there.items():
        own = sampled(labelled.where(F.col("toxic") == y), sample_fraction(total, most_per_class), "doc_id")
        wanted = own if wanted is None else wanted.unionByName(own)
    none = np.zeros(0)
    if wanted is None:
        return index([], none, none, none.astype(np.int64), none.astype(np.uint64), none.astype(np.int64), none.astype(bool))
    # bounded by 2 x most_per_class pairs of numbers
    sample = docs.select("doc_id", "text").where(F.octet_length("text") <= MOST_BYTES).join(F.broadcast(wanted), "doc_id").select("doc_id", "text", "toxic", F.xxhash64("text").alias("k1"))

    def vectors(batch: pa.RecordBatch) -> pa.RecordBatch:
        doc, term, tf, whole = term_counts(batch.column("text"))
        ends = pa.array(np.searchsorted(doc, np.arange(batch.num_rows + 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (term.view(np.int64), np.minimum(tf, 1 << 30).astype(np.int32), whole)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("k1"), batch.column("toxic").cast(pa.int32()), *lists], ["doc_id", "k1", "toxic", "term", "tf", "whole"])

    rows = arrow_map(sample, vectors, f"doc_id {kind(docs, 'doc_id')}, k1 bigint, toxic int, term array<bigint>, tf array<int>, whole array<boolean>")
    rows = rows.toArrow().combine_chunks().sort_by([("doc_id", "ascending"), ("k1", "ascending"), ("toxic", "ascending")])
    label = rows.column("toxic").to_numpy().astype(float)
    weight = np.array([there[int(y)] / max((label == y).sum(), 1) for y in label])
    lists = {c: rows.column(c).combine_chunks() for c in ("term", "tf", "whole")}
    size = np.asarray(lists["term"].value_lengths()).astype(np.int64) if len(label) else np.zeros(0, np.int64)
    term, tf, whole = (lists[c].flatten().to_numpy(zero_copy_only=False) for c in ("term", "tf", "whole"))
    return index(rows.column("doc_id").to_pylist(), label, weight, np.repeat(np.arange(len(label)), size), term.view(np.uint64), tf.astype(np.int64), whole.astype(bool))


def score(docs: DataFrame, model: Examples, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, and the ids of the three nearest examples as evidence."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        p, evidence = model.score(batch.column("text"))
        id_type = batch.schema.field("doc_id").type
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(evidence, pa.list_(id_type))],
            ["doc_id", "held_out", "score", "predicted", "evidence"],
        )

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return arrow_map(rows, work, f"doc_id {kind(docs, 'doc_id')}, held_out boolean, score double, predicted int, evidence array<{kind(docs, 'doc_id')}>")
