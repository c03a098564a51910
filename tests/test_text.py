"""Scalar functions and records against known values."""

import pytest
from pyspark.sql import functions as F

from kithline.functions import text as T
from kithline.functions.unicode import core, folded, normalized, scripts_of
from kithline.operators import keys, records


def one(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(F.expr(expr)).first()[0]


def test_normalized_forms():
    assert normalized(" Café & Fils42, S.A.S. ") == "café and fils 42 s a s"
    assert folded("École Française") == "ecole francaise"
    assert core(normalized("Example & Sons Pvt. Ltd.")) == "example and sons"
    assert core("limited") == "limited"
    assert scripts_of("Aक 1") == "DEVANAGARI,LATIN"


def test_core_tokens_can_be_emptied(spark):
    assert one(spark, T.core_tokens("n"), n="acme-bakery pvt. ltd.") == ["acme", "bakery"]
    assert one(spark, T.core_tokens("n"), n="private limited") == []


def test_numbers(spark):
    assert one(spark, T.numbers("a"), a="0141, 00 12-7 x9") == ["141", "12", "7"]


def test_skeletons(spark):
    assert spark.range(1).select(F.expr(T.latin_skeleton("array('abc123', 'xh')"))).first()[0] == "bk123ks"
    assert one(spark, T.consonant_skeleton("n"), n="hindustan") == "ndstn"
    assert one(spark, T.consonant_skeleton("n"), n=folded("हिंदुस्तान")) == "hndstn"


def test_address_parts(spark):
    rows = spark.createDataFrame([("S2-1", "x", a, "US") for a in ("0141 Longstreet Rd", "141 Longstreet Road", "142 Longstreet Road")] + [("S2-2", None, None, None)], "entity_id string, business_name string, business_address string, country string")
    got = [(sorted(r.address_words), sorted(r.address_numbers)) for r in records.with_views(rows).collect()]
    assert got[0] == got[1] == (["longstreet"], ["141"]) and got[2] != got[1] and got[3] == ([], [])


def test_grams_and_similarities(spark):
    assert one(spark, f"array_sort({T.grams('n')})", n="ab c d") == ["abc", "bcd"]
    assert one(spark, T.grams("n"), n="a") == ["a"] and one(spark, T.grams("n"), n=" ") == []
    e = T.EMPTY
    assert spark.range(1).select(F.expr(T.jaccard(e, e)), F.expr(T.jaccard(e, e, "1.0D")), F.expr(T.dice(e, e))).first()[:] == (0.0, 1.0, 0.0)


def test_simhash(spark):
    got = spark.range(1).select(F.expr(T.simhash(T.EMPTY)), F.expr(T.hamming("5L", "6L"))).first()
    assert got[0] == -1 and got[1] == 2


@pytest.mark.parametrize(("tp", "n", "t", "want"), [(2, 3, 2, 5 / 7), (0, 0, 0, 1.0), (0, 1, 0, 0.0), (0, 0, 1, 0.0), (1, 1, 2, 5 / 6)])
def test_f05(spark, tp, n, t, want):
    assert one(spark, T.f05("tp", "n", "t"), tp=tp, n=n, t=t) == pytest.approx(want)


def keyed(spark, make, rows):
    frame = spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string")
    return {r.entity_id: {k if isinstance(k, str) else k.key for k in r["keys"]} for r in make(records.with_views(frame)).collect()}


def test_key_families(spark):
    rows = [
        ("S1-1", "Krishna Exports Pvt Ltd", "0141 Main Road 55", "India"), ("S2-1", "कृष्णा एक्सपोर्ट्स", "", "India"),
        ("S1-2", "École Française SAS", "0141 Rue du Marché", "France"), ("S2-2", "Ecole Francaise", "141 rue du marche", "France"),
        ("S1-3", "Lotus Infotech", "", "India"), ("S2-3", "లోటస్ ఇన్ఫోటెక్", None, "India"), ("S2-4", None, None, None),
    ]
    two, three = keyed(spark, keys.weighted_keys, rows), keyed(spark, keys.enhanced_keys, rows)
    one_ = keyed(spark, keys.rule_keys, rows)
    assert {k for k in two["S1-1"] & two["S2-1"] if k.startswith("sk:")}
    assert {"n:141", "n:55", "ns:141-55", "t:krishna", "p:kris", "s:shna"} <= two["S1-1"]
    assert {"f:t:ecole", "an:marche|141"} <= three["S1-2"] & three["S2-2"]
    assert {k for k in three["S1-3"] & three["S2-3"] if k.startswith("sg:")}
    assert three["S2-4"] == set() and one_["S2-4"] == set()
    assert {"t:krishna", "p4:kris", "ns:141-55"} <= one_["S1-1"]


def test_caps(spark):
    got = spark.createDataFrame([("n:12",), ("n:123",), ("f:t:abc",), ("zz:1",), ("a2:x|y",)], "key string").select(keys.cap()).collect()
    assert [r[0] for r in got] == [400, 5000, 4000, 2000, 2500]


def test_indic_letters(spark):
    from kithline.functions.constants import INDIC_LETTERS, LATIN_LETTERS

    assert len(INDIC_LETTERS) == len(LATIN_LETTERS) == len(set(INDIC_LETTERS))
    assert not {chr(c) for c in (0x0CB1, 0x0C31, 0x0C81)} & set(INDIC_LETTERS)
    for name, skeleton in (("\u0cb1\u0c31\u0c81", ""), ("ಕರ್ನಾಟಕ", "krntk"), ("తెలుగు", "tlg"), ("फ़ोन", "fn"), ("कृष्ण", "krsn"), ("चंद्र", "kndr"), ("ऱ", "r")):
        assert one(spark, T.consonant_skeleton("n"), n=folded(name)) == skeleton


def test_letters_and_digits_apart():
    for text, want in (("a1b22c", "a 1 b 22 c"), ("x²y½", "x 2 y 1\u20442"), ("٣abc", "٣ abc"), ("a_1-b", "a 1 b"), ("1\t2\u00a03", "1 2 3"), ("Ⅷ9", "viii 9"), ("a\u0301\u0327 9", "\u00e1\u0327 9"), ("", "")):
        assert normalized(text) == want
