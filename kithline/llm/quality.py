"""Quality rules: document statistics, two fixed rules, and boosted trees on the statistics.

One narrow pass computes the statistics of whole texts; the trees are fitted on
the driver on a bounded sample of labelled documents (``most_labelled`` rows of
numbers, no texts) and travel to the executors as flat numpy arrays.

Edge cases: null or empty text has no words and fails the base rules; texts of
any length are scanned whole; repeated rows give repeated results; without
labels (or with one class) the trees keep whatever passes the base rules; an
empty table gives an empty result; extra columns are ignored. Labels that are
null or conflict count as they stand, row by row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithline.llm import boosted_trees
from kithline.llm.common import arrow_map, fold, sample_fraction, sampled

#: Fixed by the contract.
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SYMBOLS = b"[#*$%&|<>]"[1:-1]
#: Statistics the trees see; quality may only fall with those marked -1.
FEATURES = {
    "log_words": 0, "word_length": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": 0, "digit_share": 0,
    "mark_share": -1, "bar_share": -1, "wide_share": 0, "words_per_line": 0, "distinct_share": 1, "top_run_share": -1,
}
#: Labelled documents that the trees are fitted on, at most; and the probability of good quality from which a document stays.
MOST_LABELLED = 20_000
KEEP_FROM = 0.5


def _table(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


_CLASSES = {
    "symbol": _table(SYMBOLS), "upper": _table(bytes(range(65, 91))), "digit": _table(b"0123456789"), "mark": _table(b"!?"), "bar": _table(b"|"),
    "wide": _table(bytes(range(0xC0, 256))), "head": ~_table(bytes(range(0x80, 0xC0))), "line": _table(b"\n"),
}


def statistics(texts: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Base columns by name, and the feature matrix, of whole texts."""
    from kithline.llm.textscan import SPACED, Words, covered, flat, runs

    texts = texts.cast(pa.large_string()).fill_null("")
    buf, offsets = flat(texts)
    n = len(texts)
    words = Words(buf, offsets, SPACED)
    sums = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
    classed = {k: sums(t[buf]) for k, t in _CLASSES.items()}
    n_words = words.per_doc()
    solid = ~SPACED[buf]

    # lines with a word, by exact text
    lines = pc.split_pattern(texts, "\n")
    counts = np.diff(lines.offsets.to_numpy())
    line_doc = np.repeat(np.arange(n), counts)
    codes = lines.flatten().dictionary_encode()
    filled = pc.match_substring_regex(codes.dictionary, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)
    which = codes.indices.to_numpy()
    has = filled[which]
    pairs = line_doc[has] * np.int64(len(filled) + 1) + which[has]
    n_lines = np.bincount(line_doc[has], minlength=n)
    distinct = np.bincount(np.unique(pairs) // np.int64(len(filled) + 1), minlength=n) if len(pairs) else np.zeros(n, np.int64)

    h = words.hashes()
    five, at = runs(h, words.doc, 5)
    doc = words.doc[at]
    order = np.lexsort((five, doc))
    same = (five[order][1:] == five[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    twice = np.zeros(len(five), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    inside = covered(len(h), at[twice], 5)
    repeat = np.bincount(words.doc[inside], minlength=n)

    order = np.lexsort((h, words.doc))
    hd = words.doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (hd[1:] != hd[:-1])
    kinds = np.bincount(hd[new], minlength=n)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (words.doc[1:] == words.doc[:-1])

    base = {"n_words": n_words, "word_chars": sums(solid & _CLASSES["head"][buf]), "n_symbols": classed["symbol"], "n_dup_lines": n_lines - distinct, "n_repeat_words": repeat}
    some, letters = np.maximum(n_words, 1), np.maximum(base["word_chars"], 1)
    x = np.stack([
        np.log1p(n_words), letters / some, classed["symbol"] / some, base["n_dup_lines"] / np.maximum(n_lines, 1), repeat / some, classed["upper"] / letters, classed["digit"] / letters,
        classed["mark"] / some, classed["bar"] / some, classed["wide"] / letters, n_words / (classed["line"] + 1), kinds / some, np.bincount(words.doc[again], minlength=n) / some,
    ], 1)
    return base, x


def base_failed(base: dict[str, np.ndarray]) -> np.ndarray:
    return (base["n_words"] < 10) | (100 * base["n_repeat_words"] > 20 * base["n_words"])


def fit(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED) -> boosted_trees.FlatTrees:
    """Trees from labelled documents outside fold 2; the sample is by id hash, the same in every run."""
    labelled = labels.where(F.col("quality").isNotNull() & (fold(F.col("doc_id")) != 2)).select("doc_id", "quality")
    wanted = sampled(labelled, sample_fraction(labelled.count(), most_labelled), "doc_id")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, x = statistics(batch.column("text"))
        return pa.RecordBatch.from_arrays([batch.column("quality").cast(pa.int32()), pa.array(list(x), pa.list_(pa.float64()))], ["quality", "x"])

    # at most about most_labelled pairs of numbers are broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id").select("text", "quality")
    got = arrow_map(rows, work, "quality int, x array<double>").toPandas()
    x = np.stack(got["x"].to_list()) if len(got) else np.zeros((0, len(FEATURES)))
    order = np.lexsort((*x.T, got["quality"].to_numpy(float)))  # sums don't depend on the order of tasks
    return boosted_trees.fit(x[order], got["quality"].to_numpy(float)[order], list(FEATURES.values()))


def judge(docs: DataFrame, trees: boosted_trees.FlatTrees, keep_from: float = KEEP_FROM) -> DataFrame:
    """doc_id, the base columns, base_failed, kept and the trees' probability."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        base, x = statistics(batch.column("text"))
        failed, p = base_failed(base), trees.probability(x)
        cols = [batch.column("doc_id"), *(pa.array(base[k], pa.int64()) for k in BASE), pa.array(failed), pa.array(~failed & (p >= keep_from)), pa.array(p)]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", *BASE, "base_failed", "kept", "quality_score"])

    schema = "doc_id bigint, " + ", ".join(f"{k} bigint" for k in BASE) + ", base_failed boolean, kept boolean, quality_score double"
    return arrow_map(docs.select("doc_id", "text"), work, schema)


def keep(docs: DataFrame, trees: boosted_trees.FlatTrees, keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of docs that are kept, with all their columns; row by row, nothing is joined."""
    names = docs.columns

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        base, x = statistics(batch.column("text"))
        return batch.filter(pa.array(~base_failed(base) & (trees.probability(x) >= keep_from))).select(names)

    return arrow_map(docs, work, docs.schema)
