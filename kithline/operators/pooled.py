"""Pools of the pair model over classes of equal records: one row for the queries of a class, not for each pair.

Records with the same name, address and country have the same keys, scores and features
but for their source, so they are searched as one class, in which members take ranks one
after another. What features compare is computed in numpy for a query's classes where it
is searched. A row has the queries, the candidates, and the different feature rows in
steps; pairs are listed only where they are scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kithline.functions import text as T
from kithline.functions.constants import FEATURES, ROUTE_GROUPS
from kithline.operators import boosting, index, keys, records, sampling, search
from kithline.operators.boosting import STEPS, Trees
from kithline.operators.retrieve import ROUTES
from kithline.operators.store import kept, spread

#: Queries of a row, about; pairs of a batch and of a task that scores them.
UNIT_QUERIES, BATCH, TASK_PAIRS = 128, 50_000, 1_000_000
_POOLS = "queries array<string>, split string, candidates array<string>, pattern binary, label binary, steps binary"
_SETS = ("tokens", "name_grams", "skeleton_grams", "address", "numbers")
_MASKS = [sum(1 << ROUTES.index(r) for r in g) for g in ROUTE_GROUPS]
_CLASS = ["country", "business_name", "business_address"]


def classes(rows: DataFrame, k: int) -> DataFrame:
    """class, country, name and address, how many queries and indexed records they have, and the first k of the latter as members (o, id) in rank order."""
    by = [F.coalesce(c, F.lit("")).alias(c) for c in _CLASS]
    sized = rows.groupBy(*by).agg(F.expr("count_if(entity_id like 'S1-%')").alias("asked"), F.expr("count_if(entity_id rlike '^S[23]-')").alias("there"))
    order = Window.partitionBy(*_CLASS).orderBy("o", "entity_id")
    first = index.indexed_only(rows).select(*by, F.expr(T.id_order("entity_id")).alias("o"), "entity_id").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    members = first.groupBy(*_CLASS).agg(F.array_sort(F.collect_list(F.struct("place", "o", F.col("entity_id").alias("id")))).alias("m"))
    members = members.select(*_CLASS, F.expr("transform(m, x -> named_struct('o', x.o, 'id', x.id))").alias("members"))
    return kept(sized.join(members, _CLASS, "left").withColumn("class", F.monotonically_increasing_id()), "classes")


def pools(rows: DataFrame, population: DataFrame, lists_of: DataFrame, lists: DataFrame, k: int) -> DataFrame:
    """The first k candidates of each query over the enhanced keys, by class, split and true links.

    rows: entity_id, business_name, business_address, country. lists_of: query_id and g,
    which names the list of its true links; lists: g and ids.
    """
    found = classes(rows, k)
    named = F.concat(F.lit("C-"), F.col("class"))
    views = kept(records.with_views(spread(found.select(named.alias("entity_id"), *_CLASS))), "views")
    keyed = kept(keys.exploded(keys.enhanced_keys(views.repartition("entity_id"))), "keys")
    sizes = found.select(named.alias("entity_id"), "asked", "there")
    posts = keyed.join(sizes.where("there > 0"), "entity_id").select("country", "key", "entity_id", "there")
    stats = posts.groupBy("country", "key").agg(F.sum("there").alias("df")).withColumn("cap", keys.cap())

    matches = lists.select("g", F.size("ids").alias("n"))
    ours = rows.where("entity_id like 'S1-%'").select(F.col("entity_id").alias("query_id"), *(F.coalesce(c, F.lit("")).alias(c) for c in _CLASS))
    ours = ours.join(found.select(*_CLASS, "class", F.ceil(F.col("asked") / F.lit(UNIT_QUERIES)).alias("parts")), _CLASS)
    ours = ours.join(lists_of, "query_id", "left").join(matches, "g", "left").select(F.col("query_id").alias("source1_entity_id"), "country", F.coalesce("n", F.lit(0)).cast("bigint").alias("match_count"), "class", "parts", "g")
    units = sampling.split(ours).groupBy("class", "split", "g", F.expr("pmod(xxhash64(source1_entity_id), parts)").alias("part")).agg(F.sort_array(F.collect_list("source1_entity_id")).alias("queries"))
    units = kept(units.withColumn("unit", F.concat(F.lit("U-"), F.monotonically_increasing_id())), "units")

    asked = units.select("unit", named.alias("entity_id")).join(keyed, "entity_id").select(F.col("unit").alias("entity_id"), "country", "key", "weight")
    stats = kept(stats.join(keyed.join(sizes.where("asked > 0"), "entity_id", "left_semi").select("country", "key").distinct(), ["country", "key"], "left_semi"), "stats")
    packed = views.select("entity_id", F.struct(F.col("name_core_folded").alias("name"), F.expr(T.compact("name_core_folded")).alias("compact"), F.expr(T.compact("core_skeleton")).alias("skeleton"), F.col("address_words").alias("address"), F.col("address_numbers").alias("numbers")).alias("view"))
    empty = lambda t: F.array().cast(f"array<{t}>")  # noqa: E731; null lists are slow on their way to Python
    of_classes = packed.join(found.where("there > 0").select(named.alias("entity_id"), "members"), "entity_id").select("entity_id", F.struct("view.*", "members", empty("string").alias("queries"), F.lit("").alias("split"), empty("string").alias("true")).alias("view"))
    of_units = units.withColumn("entity_id", named).join(packed.select("entity_id", "view"), "entity_id").join(lists, "g", "left").select(F.col("unit").alias("entity_id"), F.struct("view.*", empty("struct<o bigint, id string>").alias("members"), "queries", "split", F.coalesce("ids", empty("string")).alias("true")).alias("view"))
    both = kept(of_classes.unionByName(of_units), "pool-views")
    blank = F.struct(*(F.lit("").alias(c) for c in ("name", "compact", "skeleton")), *(empty(t).alias(c) for c, t in {"address": "string", "numbers": "string", "members": "struct<o bigint, id string>", "queries": "string"}.items()), F.lit("").alias("split"), empty("string").alias("true"))
    return search.dealt(asked, posts, stats, population, both).withColumn("view", F.coalesce("view", blank)).mapInArrow(_pools(k), _POOLS)


def _grams(compact: str) -> list[str]:
    """As ``text.grams`` has them."""
    return list(dict.fromkeys(compact[i : i + 3] for i in range(max(1, len(compact) - 2)))) if compact else []


def _tokens(name: str) -> list[str]:
    return list(dict.fromkeys(w for w in name.split(" ") if w))


class _Records:
    """The records of a block: members, and sets of words, grams and numbers as codes."""

    def __init__(self, views: pa.Array):
        fields = dict(zip((f.name for f in views.type), views.flatten()))
        members = fields["members"]
        name, skeleton = fields["name"].dictionary_encode(), fields["skeleton"].dictionary_encode()
        names, self.name_at = name.dictionary.to_pylist(), name.indices.to_numpy().astype(np.int64)
        self.names, self.length = {x: i for i, x in enumerate(names)}, np.array([len(x) for x in names], np.int64)[self.name_at]
        compact = fields["compact"].take(pa.array(np.unique(self.name_at, return_index=True)[1])).to_pylist()
        every, skeleton_at = np.arange(len(views)), skeleton.indices.to_numpy().astype(np.int64)
        lists = lambda x: pa.array(x, pa.list_(pa.string()))
        grams = lists([_grams(x) for x in compact]), self.name_at
        #: Lists of the different names, skeletons and so on, and which of them a record has.
        given = {"tokens": (lists([_tokens(x) for x in names]), self.name_at), "name_grams": grams, "skeleton_grams": (lists([_grams(x) for x in skeleton.dictionary.to_pylist()]), skeleton_at)}
        given |= {s: (fields[s], every) for s in ("address", "numbers")}
        self.of, self.members = self._ends(members), members.flatten()
        ids, orders = self.members.field("id"), self.members.field("o")
        self.ids, self.orders = ids, pc.fill_null(orders, np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        self.third = pc.starts_with(ids, "S3-").to_numpy(zero_copy_only=False)
        self.sets, self.codes, self.marks = {}, {}, {}
        for s, (values, at) in given.items():
            coded = values.flatten().dictionary_encode()
            known = coded.dictionary.to_pylist()
            self.sets[s] = self._ends(values), at, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            self.codes[s], self.marks[s] = {x: i for i, x in enumerate(known)}, np.zeros(len(known), np.int64)
        #: A shared number counts 1; from bit 20 on if it has three digits, from bit 40 on if it has more.
        self.number_marks = np.array([1 + ((len(x) == 3) << 20) + ((len(x) >= 4) << 40) for x in self.codes["numbers"]], np.int64)

    @staticmethod
    def _ends(lists: pa.Array) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)

    def shared(self, name: str, own: list[str], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many elements the sets at these places share with the query's, and how many they have."""
        (ends, of, flat), codes, marks = self.sets[name], self.codes[name], self.marks[name]
        hit = np.array([codes[x] for x in own if x in codes], np.int64)
        marks[hit] = self.number_marks[hit] if name == "numbers" else 1
        where, sizes = _spans(ends, of[at])
        upto = np.concatenate([[0], np.cumsum(marks[flat[where]])])
        stops = np.cumsum(sizes)
        marks[hit] = 0
        return upto[stops] - upto[stops - sizes], sizes


def _query(view: dict[str, pa.Array]) -> dict:
    """The name of a query, and its sets."""
    name, compact, skeleton, address, numbers = (view[s][0].as_py() for s in ("name", "compact", "skeleton", "address", "numbers"))
    return {"name": name, "tokens": _tokens(name), "name_grams": _grams(compact), "skeleton_grams": _grams(skeleton), "address": address, "numbers": numbers}


def _spans(ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all elements of the lists at these places, list by list, and the lists' lengths."""
    sizes = ends[at + 1] - ends[at]
    stops = np.cumsum(sizes)
    return np.arange(stops[-1] if len(stops) else 0) + np.repeat(ends[at] - (stops - sizes), sizes), sizes


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.divide(part, whole, out=np.zeros(len(part)), where=whole > 0)


def _compared(q: dict, r: _Records, at: np.ndarray, score: np.ndarray, best: float, bits: np.ndarray) -> dict[str, np.ndarray]:
    """The features of a query with the records at these places, as ``features`` has them; source3 is left to the members."""
    (tokens, n_tokens), (names, n_names), (skeleton, n_skeleton), (address, n_address), (numbers, n_numbers) = (r.shared(s, q[s], at) for s in _SETS)
    own = {s: len(q[s]) for s in _SETS}
    x = {
        "name_exact": (r.name_at[at] == r.names.get(q["name"], -1)).astype(float) if q["name"] else np.zeros(len(at)),
        "name_tokens": _share(tokens, own["tokens"] + n_tokens - tokens), "name_chars": _share(2 * names, own["name_grams"] + n_names), "name_skeleton": _share(2 * skeleton, own["skeleton_grams"] + n_skeleton),
        "address_words": _share(address, own["address"] + n_address - address), "address_containment": address / np.maximum(1, np.minimum(own["address"], n_address)),
        "number_long": (numbers >> 40 > 0).astype(float), "number_medium": (numbers >> 20 & 0xFFFFF > 0).astype(float), "number_short": (numbers > 0).astype(float),
        "number_conflict": ((own["numbers"] > 0) & (n_numbers > 0) & (numbers == 0)).astype(float),
        "missing_address": ((own["address"] + own["numbers"] == 0) | (n_address + n_numbers == 0)).astype(float),
    }
    name, length = np.maximum(np.maximum(x["name_tokens"], x["name_chars"]), x["name_skeleton"]), len(q["name"])
    return x | {
        "name_best": name, "name_address_interaction": name * x["address_words"], "skeleton_address_interaction": x["name_skeleton"] * x["address_words"], "number_name_interaction": name * x["number_short"],
        "name_length_ratio": np.minimum(length, r.length[at]) / np.maximum(1, np.maximum(length, r.length[at])), "retrieval_relative_score": score / max(1e-9, best),
        "route_count": sum(((bits & m) != 0).astype(float) for m in _MASKS), "source3": np.zeros(len(at)),
    }


def _chosen(score: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """Places of the classes that the first k members are of, best score first: those that reach k, and all with the last one's score."""
    some = np.arange(len(score)) if len(score) <= k else np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    order = some[np.argsort(-score[some], kind="stable")]
    upto = np.cumsum(sizes[order])
    if not len(order) or upto[-1] <= k:
        return order
    return order[score[order] >= score[order[np.searchsorted(upto, k)]]]


def _in_order(r: _Records, members: np.ndarray, score: np.ndarray) -> np.ndarray:
    """The rank order of members: best score first, then as their ids say."""
    order = np.lexsort((r.orders[members], -score))
    s, o = score[order], r.orders[members][order]
    if ((s[1:] == s[:-1]) & (o[1:] == o[:-1])).any():
        ids = r.ids.take(pa.array(members)).to_pylist()
        order = np.array(sorted(range(len(members)), key=lambda i: (-score[i], r.orders[members[i]], ids[i])), np.int64)
    return order


def _pools(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, seen, r = 0, None, None

        def batch() -> pa.RecordBatch:
            lists = lambda i: pa.concat_arrays([h[i] for h in held])
            data = lambda i: pa.array([h[i].tobytes() for h in held], pa.binary())
            ends = pa.array(np.concatenate([[0], np.cumsum([len(h[2]) for h in held])]), pa.int32())
            return pa.RecordBatch.from_arrays([lists(0), pa.array([h[1] for h in held], pa.string()), pa.ListArray.from_arrays(ends, lists(2)), data(3), data(4), data(5)], ["queries", "split", "candidates", "pattern", "label", "steps"])

        for b in search.queries_of(batches):
            if not len(b.found) or b.views is None:
                continue
            if b.views is not seen:
                seen, r = b.views, _Records(b.views)
            at, score = b.found + b.extra, b.sums / 1e12
            own = _chosen(score, r.of[at + 1] - r.of[at], k)
            members, sizes = _spans(r.of, at[own])
            place = np.repeat(np.arange(len(own)), sizes)
            order = _in_order(r, members, score[own][place])[:k]
            members, place = members[order], place[order]
            view = dict(zip((f.name for f in b.view.type), b.view.flatten()))
            x = _compared(_query(view), r, at[own], score[own], score.max(), b.bits[own])
            steps = boosting.stepped(np.stack([x[f] for f in FEATURES])).T
            different, pattern = np.unique(2 * place + r.third[members], return_inverse=True)
            steps = steps[different >> 1].astype(np.uint16)
            steps[:, FEATURES.index("source3")] = (different & 1) * STEPS
            names, true = r.ids.take(pa.array(members)), view["true"].flatten()
            label = pc.is_in(names, value_set=true).to_numpy(zero_copy_only=False).astype(np.uint8) if len(true) else np.zeros(len(members), np.uint8)
            held.append((view["queries"], view["split"][0].as_py(), names, pattern.astype(np.uint16 if k <= 65_536 else np.uint32), label, steps))
            size += len(names) + len(view["queries"].flatten())
            if size >= BATCH:
                yield batch()
                held, size = [], 0
        if held:
            yield batch()

    return run


class _Rows:
    """The arrays of a batch of rows: sizes, and patterns as places among all feature rows of the batch."""

    def __init__(self, batch: pa.RecordBatch):
        column = lambda name: batch.column(batch.schema.get_field_index(name))
        size = lambda name: pc.list_value_length(column(name)).to_numpy(zero_copy_only=False).astype(np.int64)
        data = lambda name, kind: np.frombuffer(b"".join(column(name).to_pylist()), kind)
        self.queries, self.candidates, self.column = size("queries"), size("candidates"), column
        self.steps = data("steps", np.uint16).reshape(-1, len(FEATURES))
        self.label = data("label", np.uint8)
        shapes = np.array([len(x) for x in column("steps").to_pylist()], np.int64) // (2 * len(FEATURES))
        width = len(b"".join(column("pattern").to_pylist())) // max(1, len(self.label))
        self.row = np.repeat(np.arange(len(batch)), self.candidates)
        self.pattern = data("pattern", np.uint32 if width == 4 else np.uint16).astype(np.int64) + (np.cumsum(shapes) - shapes)[self.row]


def edges(rows: DataFrame) -> tuple[list[list[int]], int, int]:
    """The bins of all pairs, how many pairs there are, and of how many queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, pairs, queries = np.zeros((len(FEATURES), boosting.MOST_STEP + 1), np.int64), 0, 0
        for batch in batches:
            x = _Rows(batch)
            times = np.bincount(x.pattern, x.queries[x.row], len(x.steps))
            for own, steps in zip(counts, x.steps.T):
                own += np.bincount(steps, times, counts.shape[1]).astype(np.int64)
            pairs += int((x.queries * x.candidates).sum())
            queries += int(x.queries.sum())  # every row has candidates
        feature, step = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([*feature, -1, -2], pa.int64()), pa.array([*step, 0, 0], pa.int64()), pa.array([*counts[feature, step], pairs, queries], pa.int64())], ["feature", "step", "n"])

    counted = rows.select("queries", "candidates", "pattern", "label", "steps").mapInArrow(run, "feature bigint, step bigint, n bigint").groupBy("feature", "step").agg(F.sum("n").alias("n")).collect()
    sums = {r["feature"]: r["n"] for r in counted if r["feature"] < 0}
    return boosting.cut(counted, len(FEATURES)), sums.get(-1, 0), sums.get(-2, 0)


def fit(rows: DataFrame, rounds: int, depth: int, rate: float) -> Trees:
    """The trees that ``model.fit`` grows on the pairs of these rows: every query weighs the same."""
    cuts, pairs, queries = edges(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _Rows(batch)
            found, place = boosting.same(boosting.binned(x.steps.T, cuts))
            weight = (x.queries * np.rint(pairs / queries / x.candidates * boosting.PARTS))[x.row]
            group = place[x.pattern]
            yield boosting.grouped(found, *(np.bincount(group, np.where(x.label == of, weight, 0), len(found)) for of in (0, 1)))

    rows_in = rows.select("queries", "candidates", "pattern", "label", "steps").mapInArrow(run, boosting.GROUPS)
    return boosting.grown(rows_in.groupBy("bins").agg(F.sum("w0").alias("w0"), F.sum("w1").alias("w1")), FEATURES, cuts, rounds, depth, rate)


def _rounded(p: np.ndarray) -> np.ndarray:
    """Six digits, as Spark rounds: halves of the shortest decimal form away from zero."""
    out = np.floor(p * 1e6 + 0.5) / 1e6
    for i in np.flatnonzero(np.abs(p * 1e6 % 1 - 0.5) < 1e-4):
        out[i] = float(Decimal(repr(float(p[i]))).quantize(Decimal("1e-6"), ROUND_HALF_UP))
    return out


def predict(trees: Trees, rows: DataFrame) -> DataFrame:
    """query_id, candidate_id, probability (six digits), label and split: a row a pair; a margin is computed once for the equal rows of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _Rows(batch)
            found, place = boosting.same(boosting.binned(x.steps.T, trees.edges))
            p = _rounded(boosting.probability(trees.margins(found)))[place][x.pattern]
            queries, candidates, split = x.column("queries").flatten(), x.column("candidates").flatten(), x.column("split")
            size, q0, c0 = x.queries * x.candidates, np.cumsum(x.queries) - x.queries, np.cumsum(x.candidates) - x.candidates
            upto, start = np.cumsum(size), 0
            while start < len(batch):
                end = max(start + 1, int(np.searchsorted(upto, upto[start] - size[start] + BATCH, "right")))
                row = np.repeat(np.arange(start, end), size[start:end])
                query, candidate = np.divmod(np.arange(len(row)) - (upto - size - upto[start] + size[start])[row], x.candidates[row])
                candidate += c0[row]
                yield pa.RecordBatch.from_arrays([queries.take(pa.array(q0[row] + query)), candidates.take(pa.array(candidate)), pa.array(p[candidate]), pa.array(x.label[candidate].astype(np.int32)), split.take(pa.array(row))], ["query_id", "candidate_id", "probability", "label", "split"])
                start = end

    cores, pairs = rows.sparkSession.sparkContext.defaultParallelism, rows.agg(F.sum(F.size("queries") * F.size("candidates"))).first()[0] or 0
    tasks = max(cores, -(-pairs // TASK_PAIRS))
    few = rows.rdd.getNumPartitions() < min(tasks, 8 * cores)  # rows are dealt to more tasks if these would have too many pairs
    return (rows.repartition(tasks) if few else rows).mapInArrow(run, "query_id string, candidate_id string, probability double, label int, split string")
