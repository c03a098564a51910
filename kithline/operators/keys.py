"""Blocking keys: for each record an array of (key, weight), to be exploded.

Families are the part of a key before the first colon. G1 keys are sets without
weights; weighted keys may repeat (one entry for each occurrence) until ``unique``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithline.functions import text as T
from kithline.functions.constants import ADDRESS_STOP, CAPS, NUMBER_WEIGHTS, OTHER_CAP, SHORT_NUMBER_CAP, WEIGHTS

_NONE = "cast(array() as array<struct<key: string, weight: double>>)"


def _of(family: str, values: str, weight: str | None = None) -> str:
    return f"transform({values}, v -> named_struct('key', concat('{family}:', v), 'weight', {weight or f'{WEIGHTS[family]}D'}))"


def _if(condition: str, family: str, value: str) -> str:
    return f"if({condition}, {_of(family, f'array({value})')}, {_NONE})"


def rule_keys(views: DataFrame) -> DataFrame:
    """G1: adds ``keys``, a set of key strings."""
    skeleton = f"if(is_ascii, {T.latin_skeleton('tokens')}, skeleton_all)"
    return views.withColumn("kith_sk", F.expr(skeleton)).withColumn("keys", F.expr(f"""array_distinct(concat(
        if(length(kith_sk) >= 5, array(concat('sk:', substring(kith_sk, 1, 10))), {T.EMPTY}),
        if(length(array_join(tokens, '')) >= 6, array(concat('c6:', substring(array_join(tokens, ''), 1, 8))), {T.EMPTY}),
        transform(tokens, t -> concat('t:', t)), transform(tokens, t -> concat('p4:', substring(t, 1, 4))),
        transform(filter(numbers, n -> length(n) >= 2), n -> concat('n:', n)),
        if(size(numbers) >= 2, array(concat('ns:', array_join(slice(numbers, 1, 4), '-'))), {T.EMPTY})))""")).drop("kith_sk")  # fmt: skip


def weighted_keys(views: DataFrame) -> DataFrame:
    """G2: adds ``keys``, repeats kept."""
    number_weight = f"case when length(v) >= 4 then {NUMBER_WEIGHTS[4]}D when length(v) >= 3 then {NUMBER_WEIGHTS[3]}D else {NUMBER_WEIGHTS[2]}D end"
    stop = T.quoted(ADDRESS_STOP)
    steps = {
        "kith_tokens": f"if(size(tokens) > 0, tokens, {T.rough_tokens('name_cf')})",
        "kith_long": "filter(kith_tokens, t -> length(t) >= 5)",
        "kith_sk": f"if(is_ascii, {T.latin_skeleton('kith_tokens')}, skeleton_all)",
        "kith_compact": "array_join(kith_tokens, '')",
        "kith_numbers": "filter(numbers, n -> length(n) >= 2)",
        "kith_aw": f"filter({T.words('address_cf')}, w -> length(w) >= 5 and w rlike '^[\\\\x00-\\\\x7F]+$' and not w rlike '^[0-9]+$' and w not in ({stop}))",
        "keys": f"""concat({_of('t', 'kith_tokens')}, {_of('p', 'transform(kith_long, t -> substring(t, 1, 4))')}, {_of('s', 'transform(kith_long, t -> right(t, 4))')},
            {_if('length(kith_sk) >= 5', 'sk', 'substring(kith_sk, 1, 8)')}, {_if('length(kith_compact) >= 6', 'c', 'substring(kith_compact, 1, 12)')},
            {_of('n', 'kith_numbers', number_weight)}, {_if('size(kith_numbers) >= 2', 'ns', "array_join(slice(kith_numbers, 1, 4), '-')")}, {_of('aw', 'kith_aw')})""",
    }
    for name, expr in steps.items():
        views = views.withColumn(name, F.expr(expr))
    return views.drop(*(k for k in steps if k != "keys"))


def _pairs(values: str) -> str:
    """Pairs (left|right) of a sorted list."""
    return f"flatten(transform({values}, (x, i) -> transform(slice({values}, i + 2, size({values})), y -> concat(x, '|', y))))"


def enhanced_keys(views: DataFrame) -> DataFrame:
    """G3: G2 and the folded, address-pair, number-pair and skeleton-gram families."""
    longest = lambda values, n: f"slice(array_sort({values}, (a, b) -> case when length(a) <> length(b) then length(b) - length(a) when a < b then -1 when a > b then 1 else 0 end), 1, {n})"
    steps = {
        "kith_words": longest("address_words", 6),
        "kith_nums": longest("filter(address_numbers, n -> length(n) >= 2)", 4),
        "kith_grams": f"if(length(substring(core_skeleton, 1, 40)) >= 5, transform(sequence(1, length(substring(core_skeleton, 1, 40)) - 3), i -> substring(core_skeleton, i, 4)), {T.EMPTY})",
        "keys": f"""concat(keys, {_of('f:t', "filter(split(name_core_folded, ' '), t -> length(t) >= 3)")},
            {_if('length(name_core_folded) >= 6', 'f:c', "substring(replace(name_core_folded, ' ', ''), 1, 16)")}, {_of('f:aw', 'address_words')},
            {_of('a2', _pairs('array_sort(kith_words)'))},
            {_of('an', "flatten(transform(kith_words, w -> transform(filter(kith_nums, n -> length(n) >= 3), n -> concat(w, '|', n))))")},
            {_of('n2', _pairs('array_sort(kith_nums)'))}, {_of('sg', 'kith_grams')})""",
    }
    out = weighted_keys(views)
    for name, expr in steps.items():
        out = out.withColumn(name, F.expr(expr))
    return out.drop(*(k for k in steps if k != "keys"))


def exploded(keyed: DataFrame) -> DataFrame:
    """entity_id, country, key, weight, mult: one row a record and key, the largest weight, and how often it came."""
    rows = keyed.select("entity_id", "country", F.explode("keys").alias("k")).select("entity_id", "country", "k.key", "k.weight")
    return rows.groupBy("entity_id", "country", "key").agg(F.max("weight").alias("weight"), F.count("*").alias("mult"))


def family(key: Column) -> Column:
    return F.substring_index(key, ":", 1)


def route(key: Column) -> Column:
    """The family with f: spelled f_."""
    return F.when(key.startswith("f:"), F.concat(F.lit("f_"), F.substring_index(F.expr("substring(key, 3)"), ":", 1))).otherwise(family(key))


def cap(key: str = "key") -> Column:
    """Most documents a key may be in; f: keys have the cap of the family after it."""
    plain = f"if({key} like 'f:%', substring({key}, 3), {key})"
    cases = " ".join(f"when '{f}' then {n}" for f, n in CAPS.items())
    return F.expr(f"if({plain} like 'n:%' and length({plain}) <= 4, {SHORT_NUMBER_CAP}, case substring_index({plain}, ':', 1) {cases} else {OTHER_CAP} end)")
