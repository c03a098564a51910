"""Gradient-boosted trees as ``pyspark.ml`` grows them, over groups of equal rows.

Rows whose features fall into the same bins are the same to every tree, so they become
one group with the weight of either label. Groups are dealt to the tasks of one barrier
stage, which hold them for all rounds: a round takes no job. Sums by node, feature and
bin go to the first task and back by sockets, as a barrier's own exchange takes a second
and more. Weights and gradients are whole numbers, so trees don't depend on how groups
are dealt. Stages need a slot for each of their tasks at once, and no dynamic allocation.
"""

from __future__ import annotations

import hashlib
import json
import secrets
import socket
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from kithline.operators.store import kept

#: Bins of a feature (pyspark.ml's default), steps of a feature between 0 and 8, parts of a weight of 1, and groups that are worth a task.
BINS, STEPS, PARTS, TASK_GROUPS = 32, 4096, 1 << 22, 65_536
MOST_STEP, GROUPS = 8 * STEPS, "bins binary, w0 bigint, w1 bigint"


@dataclass
class Trees:
    """Complete trees, node by node in order of levels: rows whose bin is above ``at`` go right. edges: the last step of each bin but the highest."""

    features: list[str]
    edges: list[list[int]]
    split: list[list[int]]
    at: list[list[int]]
    leaf: list[list[float]]

    def said(self) -> str:
        return json.dumps(asdict(self))

    def signature(self) -> str:
        return hashlib.sha256(self.said().encode()).hexdigest()

    def save(self, spark: SparkSession, path: str) -> None:
        """Refuses to overwrite."""
        spark.createDataFrame([(self.said(),)], "value string").coalesce(1).write.mode("errorifexists").text(path)

    def margins(self, bins: np.ndarray) -> np.ndarray:
        """Trees are folded from their last level up: a node's place among the leaves is its left or right child's, by masks of bytes."""
        split, at, leaf = np.array(self.split, np.int64), np.array(self.at, np.uint8)[:, :, None], np.array(self.leaf)
        out = np.zeros(len(bins))
        for start in range(0, len(bins), 4096):
            some, own = np.ascontiguousarray(bins[start : start + 4096].T), out[start : start + 4096]
            for nodes, above, leaves in zip(split, at, leaf):
                right = some[nodes] > above
                last = len(nodes) // 2
                place, bit = right[last:].view(np.uint8), 2
                while last:
                    last //= 2
                    left, other = place[0::2], place[1::2] | np.uint8(bit)
                    place, bit = left ^ ((left ^ other) & -right[last : 2 * last + 1].view(np.uint8)), 2 * bit
                own += leaves[place[0]]
        return out


def load(spark: SparkSession, path: str) -> Trees:
    return Trees(**json.loads(spark.read.text(path).first()["value"]))


def _steps(batch: pa.RecordBatch, features: list[str]) -> np.ndarray:
    """Features in steps, one row a feature."""
    return stepped(np.stack([batch.column(f).to_numpy(zero_copy_only=False).astype(np.float64) for f in features]))


def stepped(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(np.nan_to_num(x) * STEPS), 0, MOST_STEP).astype(np.int64)


def binned(steps: np.ndarray, edges: list[list[int]]) -> np.ndarray:
    """One row of bytes a row."""
    return np.ascontiguousarray(np.stack([np.searchsorted(e, x, "left") for e, x in zip(map(np.array, edges), steps)], 1).astype(np.uint8))


def same(bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different rows, and the place of each row among them."""
    found, place = np.unique(bins.view(np.dtype((np.void, bins.shape[1]))).ravel(), return_inverse=True)
    return found.view(np.uint8).reshape(-1, bins.shape[1]), place


def edges(rows: DataFrame, features: list[str]) -> list[list[int]]:
    """The last steps of bins with about as many rows each; a step of its own for each value if there are few. Steps of all rows are counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(features), MOST_STEP + 1), np.int64)
        for batch in batches:
            for own, x in zip(counts, _steps(batch, features)):
                own += np.bincount(x, minlength=len(own))
        feature, step = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(feature), pa.array(step), pa.array(counts[feature, step])], ["feature", "step", "n"])

    counted = rows.select(*features).mapInArrow(run, "feature bigint, step bigint, n bigint").groupBy("feature", "step").agg(F.sum("n").alias("n")).collect()  # at most MOST_STEP + 1 a feature
    return cut(counted, len(features))


def cut(counted: list, features: int) -> list[list[int]]:
    """Bins from how many rows (n) have which step of which feature."""
    out = []
    for i in range(features):
        own = sorted((r["step"], r["n"]) for r in counted if r["feature"] == i)
        steps, upto = np.array([s for s, _ in own], np.int64), np.cumsum([n for _, n in own])
        if len(steps) > BINS:
            ends = np.unique(np.searchsorted(upto, np.arange(1, BINS) * upto[-1] / BINS))
            steps = steps[np.append(ends[ends < len(steps) - 1], len(steps) - 1)]
        out.append(steps[:-1].tolist())
    return out


def groups(rows: DataFrame, features: list[str], cuts: list[list[int]]) -> DataFrame:
    """bins (a byte for each feature), w0, w1: the weight of rows with label 0 and 1. rows: features, label and weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, place = same(binned(_steps(batch, features), cuts))
            weight = np.rint(batch.column("weight").to_numpy(zero_copy_only=False) * PARTS)
            true = batch.column("label").to_numpy(zero_copy_only=False) > 0
            yield grouped(found, *(np.bincount(place, np.where(of, weight, 0), len(found)) for of in (~true, true)))

    return rows.select(*features, "label", "weight").mapInArrow(run, GROUPS).groupBy("bins").agg(F.sum("w0").alias("w0"), F.sum("w1").alias("w1"))


def grouped(found: np.ndarray, w0: np.ndarray, w1: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in found], pa.binary()), pa.array(w0.astype(np.int64)), pa.array(w1.astype(np.int64))], ["bins", "w0", "w1"])


def _best(weight: np.ndarray, total: np.ndarray) -> tuple[list[int], list[int], np.ndarray]:
    """Of each node: the feature and bin of the split with the most variance taken, and the means on either side. Sums by node, feature and bin."""
    left_w, left = weight.cumsum(2)[:, :, :-1].astype(float), total.cumsum(2)[:, :, :-1].astype(float)
    all_w, all_ = weight[:, 0].sum(1).astype(float), total[:, 0].sum(1).astype(float)
    right_w, right = all_w[:, None, None] - left_w, all_[:, None, None] - left
    mean = np.divide(all_, all_w, out=np.zeros_like(all_), where=all_w > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where((left_w > 0) & (right_w > 0), left**2 / left_w + right**2 / right_w - (mean * all_)[:, None, None], 0.0)
    split, at, means = [], [], np.zeros((len(weight), 2))
    for node, own in enumerate(gain):
        f, b = divmod(int(own.argmax()), own.shape[1])
        if own[f, b] > 0:
            split.append(f), at.append(b)
            means[node] = left[node, f, b] / left_w[node, f, b], right[node, f, b] / right_w[node, f, b]
        else:  # all rows go left
            split.append(0), at.append(BINS)
            means[node] = mean[node], 0.0
    return split, at, means


class _Sums:
    """Adds up arrays of all tasks of a barrier stage."""

    def __init__(self, task: BarrierTaskContext, wait: float = 600.0):
        hosts = [x.address.rpartition(":")[0].strip("[]") for x in task.getTaskInfos()]
        self.first, self.peers = task.partitionId() == 0, []
        if len(hosts) == 1:
            return
        server = socket.create_server((hosts[0], 0)) if self.first else None
        port, token = task.allGather(f"{server.getsockname()[1]} {secrets.token_hex(16)}" if server else "")[0].split()
        if server is None:
            self.peers.append(socket.create_connection((hosts[0], int(port)), wait))
            self.peers[0].sendall(token.encode())
        else:
            server.settimeout(wait)
            while len(self.peers) < len(hosts) - 1:
                peer = server.accept()[0]
                peer.settimeout(wait)
                if secrets.compare_digest(self._read(peer, len(token)), token.encode()):
                    self.peers.append(peer)
                else:
                    peer.close()
            server.close()
        for peer in self.peers:
            peer.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)

    @staticmethod
    def _read(peer: socket.socket, size: int) -> bytes:
        out = bytearray()
        while len(out) < size:
            some = peer.recv(size - len(out))
            if not some:
                raise ConnectionError("a task of the stage has ended")
            out += some
        return bytes(out)

    def __call__(self, own: np.ndarray) -> np.ndarray:
        if not self.peers:
            return own
        received = lambda peer: np.frombuffer(self._read(peer, own.nbytes), own.dtype).reshape(own.shape)
        if not self.first:
            self.peers[0].sendall(own.tobytes())
            return received(self.peers[0])
        total = sum(map(received, self.peers), own)
        for peer in self.peers:
            peer.sendall(total.tobytes())
        return total


def _grown(features: int, rounds: int, depth: int, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(np.frombuffer(b"".join(x.column("bins").to_pylist()), np.uint8).reshape(-1, features), x.column("w0").to_numpy(), x.column("w1").to_numpy()) for x in batches]
        bins = np.ascontiguousarray(np.concatenate([np.zeros((0, features), np.uint8), *(r[0] for r in rows)]).T)
        w0, w1 = (np.concatenate([np.zeros(0, np.int64), *(r[i] for r in rows)]).astype(np.float64) for i in (1, 2))
        weight, margin = w0 + w1, np.zeros(len(w0))
        trees: dict[str, list] = {"split": [], "at": [], "leaf": []}
        added = _Sums(BarrierTaskContext.get())
        for turn in range(rounds):
            if turn:  # of the loss 2 log(1 + exp(-2 y margin))
                e = np.exp(2 * np.clip(margin, -300, 300))
                want = np.rint(4 * (w1 / (1 + e) - w0 * (e / (1 + e))))
            else:
                want = w1 - w0
            split, at, node = [], [], np.zeros(len(weight), np.int64)
            for level in range(depth):
                size = (1 << level) * BINS
                sums = np.empty((2, 1 << level, features, BINS), np.int64)
                for f in range(features):
                    place = node * BINS + bins[f]
                    for i, of in enumerate((weight, want)):
                        sums[i, :, f] = np.bincount(place, of, size).reshape(-1, BINS)  # exact: whole numbers below 2 ** 53
                both = added(sums)
                s, a, means = _best(both[0], both[1])
                right = bins[np.array(s)[node], np.arange(len(node))] > np.array(a)[node]
                node = 2 * node + right
                split += s
                at += a
            leaf = means.ravel() * (rate if turn else 1.0)
            margin += leaf[node]
            for name, x in (("split", split), ("at", at), ("leaf", leaf.tolist())):
                trees[name].append(x)
        if added.first:
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps(trees)])], ["trees"])

    return run


def fit(rows: DataFrame, features: list[str], rounds: int, depth: int, rate: float) -> Trees:
    """rows: features, label (0 or 1) and weight. The first tree is fitted to the labels as -1 and 1, the others to the gradient of the logistic loss; leaves are weighted means."""
    cuts = edges(rows, features)
    return grown(groups(rows, features, cuts), features, cuts, rounds, depth, rate)


def grown(found: DataFrame, features: list[str], cuts: list[list[int]], rounds: int, depth: int, rate: float) -> Trees:
    """The same from groups."""
    found = kept(found, "groups")
    n = found.count()
    if not n:
        raise ValueError("there are no rows to learn from")
    tasks = int(min(found.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_GROUPS)))
    trees = found.repartition(tasks).mapInArrow(_grown(len(features), rounds, depth, rate), "trees string", barrier=True)
    return Trees(list(features), cuts, **json.loads(trees.collect()[0]["trees"]))


def probability(margins: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-2 * np.clip(margins, -300, 300)))


def predict(trees: Trees, rows: DataFrame) -> DataFrame:
    """Adds probability; a margin is computed once for the equal rows of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, place = same(binned(_steps(batch, trees.features), trees.edges))
            p = probability(trees.margins(found))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p[place])], [*batch.schema.names, "probability"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("probability", DoubleType())]))
