"""Token counts of a byte-level BPE without ids.

1. Every text is split into pre-tokens. How often each occurs is tallied by task
   and summed over the corpus, which leaves each distinct pre-token once; its
   pieces are counted there and the table is written.
2. A document is the bag of its pre-tokens with their frequencies. The counts of
   the ``COMMON`` most frequent pre-tokens (of at most ``COMMON_BYTES`` bytes each) go
   to all tasks and are joined where the bag is made: what occurs in a large share
   of all rows never is a key of a shuffle.
3. The other entries of the bags are joined to the table by their pre-token and
   summed by text. Texts that a task has met before send nothing again, so copies
   are one set of rows a task. Ids of documents never exist.

Edge cases: null text is empty (0 bytes, 0 tokens); long texts need memory for
their distinct pre-tokens only; repeated rows give repeated results; an empty
table gives an empty result; extra columns are ignored; doc_id may have any type.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithline.llm.bpe_automaton import _PLAIN_BELOW, byte_labels, plain_pattern
from kithline.llm.common import kind, release, text_key, written

#: Pre-tokens whose counts are sent to all tasks, and the bytes of one; distinct pre-tokens tallied in a task before they are passed on; texts a task remembers.
COMMON, COMMON_BYTES = 100_000, 512
TALLY, SEEN = 300_000, 200_000


class PieceCounter:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        # splitting of texts beyond the plain characters; the model isn't loaded
        self.library = Tokenizer.from_str(json.dumps(spec | {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": [], "post_processor": None}))
        import public_tokenizers

        self.pieces = plain_pattern(public_tokenizers.PATTERN)

    def split(self, text: str) -> list[str]:
        if text.isascii() or max(text) < _PLAIN_BELOW:
            return self.pieces.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def bag(self, text: str) -> tuple[int, list[str]]:
        """Special strings in the text, and the pre-tokens between them."""
        parts = [text]
        for s in self.special:
            if s in text:
                parts = [x for part in parts for x in part.split(s)]
        return len(parts) - 1, [x for part in parts if part for x in self.split(part)]


@lru_cache(maxsize=1)
def splitter(path: str) -> PieceCounter:
    return PieceCounter(path)


def _encoder(path: str):
    """Pieces of one pre-token. Ids of this vocabulary are merge ranks, so the rank-based encoder finds the same pieces."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    byte_of = {c: b for b, c in enumerate(byte_labels())}
    special = {t["content"] for t in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in special}
    return tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


def _path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def piece_table(docs: DataFrame, name: str) -> DataFrame:
    """piece, n (occurrences in the corpus) and tokens: each distinct pre-token once."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from kithline.llm.textscan import chunks

        pieces = splitter(_path(name))
        seen: Counter = Counter()
        rows = lambda: pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["piece", "n"])
        for batch in batches:
            for part in chunks(batch, "text"):
                seen.update(x for t in part.column("text").to_pylist() if t for x in pieces.bag(t)[1])
                if len(seen) > TALLY:
                    yield rows()
                    seen.clear()
        if seen:
            yield rows()
        seen.clear()
        release()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = None
        for batch in batches:
            one = one or _encoder(_path(name))
            tokens = [len(one(x.encode())) for x in batch.column("piece").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tokens, pa.int64())], ["piece", "n", "tokens"])
        del one
        release()

    distinct = docs.select("text").mapInArrow(tally, "piece string, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))
    return distinct.mapInArrow(count, "piece string, n bigint, tokens bigint")


def bags(docs: DataFrame, common: dict[str, int], name: str) -> DataFrame:
    """doc_id, n_bytes, n_common (tokens of special strings and common pre-tokens), k1, k2, is_rest, and rest: the other pre-tokens with their frequencies, once for each text a task remembers; sent: the number of that sending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from kithline.llm.textscan import chunks

        pieces, sent, seen = splitter(_path(name)), TaskContext.get().partitionId() << 40, set()
        entry = pa.list_(pa.struct([("piece", pa.string()), ("times", pa.int64())]))
        for batch in batches:
            for rows in chunks(batch, "text"):
                size, known, has, rest = [], [], [], []
                for text, key in zip(rows.column("text").to_pylist(), zip(rows.column("k1").to_pylist(), rows.column("k2").to_pylist())):
                    found, bag = pieces.bag(text or "")
                    left: Counter = Counter()
                    for piece, times in Counter(bag).items():
                        n = common.get(piece)
                        if n is None:
                            left[piece] = times
                        else:
                            found += n * times
                    size.append(len((text or "").encode())), known.append(found), has.append(bool(left))
                    rest.append([{"piece": p, "times": t} for p, t in left.items()] if left and key not in seen else None)
                    if left and len(seen) < SEEN:
                        seen.add(key)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(size, pa.int64()), pa.array(known, pa.int64()), rows.column("k1"), rows.column("k2"), pa.array(range(sent, sent + len(size)), pa.int64()), pa.array(has, pa.bool_()), pa.array(rest, entry)],
                    ["doc_id", "n_bytes", "n_common", "k1", "k2", "sent", "is_rest", "rest"],
                )
                sent += len(size)
        release()

    schema = f"doc_id {kind(docs, 'doc_id')}, n_bytes bigint, n_common bigint, k1 bigint, k2 bigint, sent bigint, is_rest boolean, rest array<struct<piece: string, times: bigint>>"
    return docs.select("doc_id", "text", *text_key()).mapInArrow(run, schema)


def count_tokens(docs: DataFrame, name: str = "byte_bpe_50k.json", limit: int = 512, most_common: int = COMMON) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit."""
    table = written(piece_table(docs, name), "pieces")
    # bounded by most_common pre-tokens of COMMON_BYTES bytes
    often = table.where(F.octet_length("piece") <= COMMON_BYTES).orderBy(F.desc("n"), "piece").limit(most_common).select("piece", "tokens").toPandas()
    rows = written(bags(docs, dict(zip(often["piece"], often["tokens"].tolist())), name), "bags")
    entries = rows.where("rest is not null").select("k1", "k2", "sent", F.explode("rest").alias("e")).select("k1", "k2", "sent", "e.piece", "e.times")
    # each sending is summed for itself, and a text has the sum of any of its sendings
    sums = (
        entries.join(table.select("piece", "tokens"), "piece").groupBy("k1", "k2", "sent").agg(F.sum(F.col("tokens") * F.col("times")).alias("n"))
        .groupBy("k1", "k2").agg(F.max("n").alias("n"))
    )
    whole = rows.where("not is_rest").select("doc_id", "n_bytes", F.col("n_common").alias("n_tokens"))
    split = rows.where("is_rest").join(sums, ["k1", "k2"]).select("doc_id", "n_bytes", (F.col("n_common") + F.col("n")).alias("n_tokens"))
    return whole.unionByName(split).withColumn("over_limit", F.col("n_tokens") > limit)
