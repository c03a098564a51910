"""Linkage of records that arrive in micro-batches against standing postings, with the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from kithline.functions.constants import RULE_THRESHOLD
from kithline.operators import keys, records, rules


def link_arrivals(arrivals: DataFrame, indexed: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, threshold: float = RULE_THRESHOLD) -> StreamingQuery:
    """Each micro-batch of source 1 records gets its result rows; ``sink`` is given them with the batch number.

    The number is the same when a batch is repeated after a failure, so a sink that
    overwrites by it writes each batch once. ``indexed`` are the records of the other
    sources; their postings and signatures are batch frames, planned with each batch.
    """
    views = records.with_views(indexed)
    postings = rules.rule_postings(keys.rule_keys(views))
    signatures = records.signature(views)

    def link(batch: DataFrame, number: int) -> None:
        own = records.with_views(batch)
        pairs = rules.candidates(rules.exploded(keys.rule_keys(own)), postings)
        chosen = rules.accepted(rules.scored(pairs, signatures.unionByName(records.signature(own))), threshold)
        sink(rules.submission(batch, chosen), number)

    return arrivals.writeStream.foreachBatch(link).option("checkpointLocation", checkpoint).start()
