"""Profiles of inputs: entity files, truth, countries, key overlap and examples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithline.functions import text as T
from kithline.operators.sampling import per_group


def id_number(column: str, prefix: str) -> str:
    return f"try_cast(regexp_extract({column}, '^{prefix}-([0-9]+)$', 1) as bigint)"


def profile(records: DataFrame, prefix: str) -> DataFrame:
    """rows, malformed_ids, duplicate_ids, missing_names, missing_addresses, countries. Ids are equal by number; malformed ones by text."""
    rows = records.withColumn("number", F.expr(id_number("entity_id", prefix)))
    blank = lambda c: f"trim(coalesce({c}, '')) = ''"
    return rows.agg(
        F.count("*").alias("rows"), F.expr("count_if(number is null)").alias("malformed_ids"),
        F.expr("count(number) - count(distinct number) + count_if(number is null) - count(distinct if(number is null, coalesce(entity_id, ''), null))").alias("duplicate_ids"),
        F.expr(f"count_if({blank('business_name')})").alias("missing_names"), F.expr(f"count_if({blank('business_address')})").alias("missing_addresses"), F.expr("count(distinct trim(coalesce(country, '')))").alias("countries"),
    )


def countries(records: DataFrame) -> DataFrame:
    return records.groupBy(F.expr("if(trim(coalesce(country, '')) = '', '<EMPTY>', trim(country))").alias("country")).agg(F.count("*").alias("rows"))


def country_compare(train: DataFrame, test: DataFrame) -> DataFrame:
    """country, train_rows, test_rows, test_only."""
    a, b = countries(train).withColumnRenamed("rows", "train_rows"), countries(test).withColumnRenamed("rows", "test_rows")
    return a.join(b, "country", "full").na.fill(0, ["train_rows", "test_rows"]).withColumn("test_only", F.expr("train_rows = 0"))


def duplicates(records: DataFrame) -> DataFrame:
    return records.groupBy("entity_id").agg(F.count("*").alias("n")).where("n > 1")


def _items(truth: DataFrame) -> DataFrame:
    return truth.select("source1_entity_id", F.explode(F.expr("if(coalesce(matched_entity_ids, '') = '', cast(array() as array<string>), split(matched_entity_ids, ','))")).alias("id"))


def truth_anomalies(truth: DataFrame, s1: DataFrame, s2: DataFrame, s3: DataFrame) -> DataFrame:
    """anomaly, n: the counters of a truth table against the sources (each with entity_id)."""
    number = lambda frame, p: frame.select(F.expr(id_number("entity_id", p)).alias("n")).where("n is not null").distinct()
    own = truth.withColumn("n", F.expr(id_number("source1_entity_id", "S1")))
    items, unique = _items(truth), _items(truth).distinct()
    of = lambda p: unique.where(f"id like '{p}-%'").withColumn("n", F.expr(id_number("id", p)))
    single = lambda frame, name: frame.agg(F.count("*").alias("n")).select(F.lit(name).alias("anomaly"), "n")
    out = [
        single(own, "rows"),
        own.agg(F.expr("count(n) - count(distinct n) + count_if(n is null) - count(distinct if(n is null, source1_entity_id, null))").alias("n")).select(F.lit("duplicate_source1_rows").alias("anomaly"), "n"),
        single(own.where("n is null").select("n").unionByName(own.where("n is not null").join(number(s1, "S1"), "n", "left_anti").select("n")), "invalid_source1_references"),
        single(number(s1, "S1").join(own.where("n is not null").select("n"), "n", "left_anti"), "missing_ground_truth_rows"),
        items.agg(F.count("*").alias("a")).crossJoin(unique.agg(F.count("*").alias("b"))).select(F.lit("duplicate_ids_in_lists").alias("anomaly"), F.expr("a - b").alias("n")),
        single(unique.where("id like 'S1-%'"), "source1_ids_as_matches"),
        single(unique.where("not id like 'S1-%'").where(F.expr(f"coalesce(if(id like 'S2-%', {id_number('id', 'S2')}, if(id like 'S3-%', {id_number('id', 'S3')}, null)), -1) = -1")), "malformed_match_ids"),
        single(of("S2").where("n is not null"), "s2_matches"),
        single(of("S3").where("n is not null"), "s3_matches"),
        single(of("S2").where("n is not null").join(number(s2, "S2"), "n", "left_anti").select("n").unionByName(of("S3").where("n is not null").join(number(s3, "S3"), "n", "left_anti").select("n")), "missing_target_references"),
    ]
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    return found


def match_distribution(truth: DataFrame) -> DataFrame:
    """kind (zero, one, multiple), n: rows by number of different valid match ids."""
    n = F.expr(f"size(filter({T.id_list('matched_entity_ids')}, x -> x rlike '^S[23]-[0-9]+$'))")
    return truth.groupBy(F.when(n == 0, "zero").when(n == 1, "one").otherwise("multiple").alias("kind")).agg(F.count("*").alias("n"))


def cartesian(records: DataFrame) -> DataFrame:
    """country, s1, others, pairs: sizes of the full products, from counts."""
    got = records.groupBy(F.trim("country").alias("country")).agg(F.expr("count_if(entity_id like 'S1-%')").alias("s1"), F.expr("count_if(not entity_id like 'S1-%')").alias("others"))
    return got.withColumn("pairs", F.col("s1") * F.col("others"))


def family_overlap(truth: DataFrame, keys: DataFrame, per_country: int = 400) -> DataFrame:
    """country, family, links: in how many of a sample of links both sides share a key of the family; links of each entity's first match."""
    first = truth.groupBy("query_id").agg(F.min("true_id").alias("true_id"))
    named = first.join(keys.select(F.col("entity_id").alias("query_id"), "country").distinct(), "query_id")
    sample = per_group(named, ["country"], per_country, "query_id")
    q = keys.select(F.col("entity_id").alias("query_id"), "key")
    c = keys.select(F.col("entity_id").alias("true_id"), "key")
    shared = sample.join(q, "query_id").join(c, ["true_id", "key"]).select("country", "query_id", F.substring_index("key", ":", 1).alias("family")).distinct()
    return shared.groupBy("country", "family").agg(F.count("*").alias("links"))


def pair_examples(truth: DataFrame, records: DataFrame, per_country: int = 15, most: int = 2) -> DataFrame:
    """country, query_id, true_id and both records' texts for a few entities of each country."""
    few = truth.join(records.select(F.col("entity_id").alias("query_id"), "country"), "query_id")
    chosen = per_group(few.select("query_id", "country").distinct(), ["country"], per_country, "query_id")
    pairs = per_group(few.join(chosen.select("query_id"), "query_id", "left_semi"), ["query_id"], most, "true_id")
    side = lambda a, p: records.select(F.col("entity_id").alias(a), F.col("business_name").alias(f"{p}_name"), F.col("business_address").alias(f"{p}_address"))
    return pairs.join(side("query_id", "q"), "query_id").join(side("true_id", "c"), "true_id")


def example_lines(pairs: DataFrame) -> DataFrame:
    """Lengths, word similarity (1 for two empty texts) and number overlap of pairs, without the texts."""
    return pairs.select(
        "country", F.length("q_name").alias("q_name_length"), F.length("c_name").alias("c_name_length"),
        F.expr(T.jaccard(f"array_distinct({T.words('lower(q_name)')})", f"array_distinct({T.words('lower(c_name)')})", "1.0D")).alias("name_similarity"),
        F.expr(f"size(array_intersect({T.numbers('q_address')}, {T.numbers('c_address')}))").alias("shared_numbers"),
    )


def anomaly_examples(truth: DataFrame, s1: DataFrame, most: int = 10) -> DataFrame:
    """kind, example: the first few ids behind the counters of malformed, unknown and repeated references."""
    items = _items(truth)
    strange = items.where("not id rlike '^S[23]-[0-9]+$'").select(F.lit("malformed or foreign match id").alias("kind"), F.concat_ws(":", "source1_entity_id", "id").alias("example"))
    unknown = truth.join(s1.select(F.col("entity_id").alias("source1_entity_id")), "source1_entity_id", "left_anti").select(F.lit("unknown source 1 id").alias("kind"), F.col("source1_entity_id").alias("example"))
    twice = items.groupBy("source1_entity_id", "id").count().where("count > 1").select(F.lit("id twice in a list").alias("kind"), F.concat_ws(":", "source1_entity_id", "id").alias("example"))
    rows = strange.unionByName(unknown).unionByName(twice).distinct()
    return per_group(rows, ["kind"], most, "example")


def native_script(name: str) -> str:
    """Whether a name has a letter beyond ASCII."""
    return f"{name} rlike '[\\\\p{{L}}&&[^\\\\x00-\\\\x7F]]'"


def report(s1: DataFrame, s2: DataFrame, s3: DataFrame, truth: DataFrame) -> DataFrame:
    """section, item, value: the whole audit as one tall frame."""
    out = None

    def add(section: str, rows: DataFrame, item: str, value: str) -> None:
        nonlocal out
        got = rows.select(F.lit(section).alias("section"), F.expr(item).alias("item"), F.expr(f"cast({value} as string)").alias("value"))
        out = got if out is None else out.unionByName(got)

    for name, frame in (("S1", s1), ("S2", s2), ("S3", s3)):
        one = profile(frame, name)
        add(name, one.unpivot([], one.columns, "item", "value"), "item", "value")
        add(f"{name} countries", countries(frame), "country", "rows")
    add("truth", truth_anomalies(truth, s1, s2, s3), "anomaly", "n")
    add("matches", match_distribution(truth), "kind", "n")
    add("examples", anomaly_examples(truth, s1), "kind", "example")
    return out
