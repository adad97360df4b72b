import unicodedata

import pytest
from pyspark.sql import functions as F

from darwise import values as V
from darwise.functions import parsing as P, text as T


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn("x").alias("y")).first()["y"]


@pytest.mark.parametrize("given, wanted", [("١,١٥١,٠٠٠", "1,151,000"), ("۲۰۲۶", "2026"), ("٣٫٥٬٠", "3.5,0")])
def test_western_digits(spark, given, wanted):
    assert one(spark, given, T.to_western_digits) == wanted


@pytest.mark.parametrize(
    "given, wanted",
    [
        ("ما هي رسوم الحجز؟", ["رسوم", "حجز"]),
        ("أسعار الفلل", ["اسعار", "فلل"]),
        ("على إلى متى التي الذي", ["علي", "الي", "متي", "تي", "ذي"]),  # stop words that survive
        ("والبيت بالبيت الب وال", ["بيت", "بيت", "الب", "وال"]),
        ("How many villas, 3.5 or ١٢٫٥ m2?", ["villas", "3.5", "12.5", "m", "2"]),
        ("", []),
        ("5البيت", ["5", "بيت"]),
    ],
)
def test_tokenize(spark, given, wanted):
    assert one(spark, given, T.tokenize) == wanted


def test_tokenize_can_keep_stopwords(spark):
    assert one(spark, "What is the fee", lambda c: T.tokenize(c, drop_stopwords=False)) == ["what", "is", "the", "fee"]


def python_normalize(t):
    t = unicodedata.normalize("NFKC", t)
    for a, b in zip(V.ARABIC_INDIC_DIGITS + V.EASTERN_ARABIC_INDIC_DIGITS + V.ARABIC_SEPARATORS, V.WESTERN_DIGITS * 2 + V.WESTERN_SEPARATORS):
        t = t.replace(a, b)
    t = "".join(c for c in t if not any(lo <= ord(c) <= hi for lo, hi in V.DIACRITIC_RANGES) and c != V.TATWEEL)
    for a, b in zip(V.LETTER_VARIANTS, V.LETTER_TARGETS):
        t = t.replace(a, b)
    return t.lower()


@pytest.mark.parametrize(
    "given", ["ﻣﺮﺣﺒﺎ ﷺ", "مُحَمَّدٌ ـــ", "ﬁne ＡＢＣ ①", "été", "لآلئ مسؤول قراءة هدى", "Straße ÉTÉ", "½ … x²"]
)
def test_normalize_matches_unicodedata(spark, given):
    assert one(spark, given, T.normalize_arabic) == python_normalize(given)


def test_stable_class_is_stable():
    import re

    stable = re.compile("[" + V.NFKC_STABLE_CLASS + "]")
    for c in map(chr, range(0x20, 0x3000)):
        if stable.match(c):
            assert unicodedata.normalize("NFKC", c) == c, hex(ord(c))
    # No stable character completes another one to a composed character.
    for c in map(chr, range(0x80, 0x3000)):
        d = unicodedata.decomposition(c)
        if d and not d.startswith("<") and len(d.split()) == 2:
            assert not all(stable.match(chr(int(p, 16))) for p in d.split()), hex(ord(c))


@pytest.mark.parametrize(
    "given, wanted", [("كم عدد الفلل المتاحة؟", "ar"), ("How many villas are available?", "en"), ("123", "en"), ("ab فل", "ar")]
)
def test_language(spark, given, wanted):
    assert one(spark, given, T.detect_language) == wanted


def test_match_keys(spark):
    assert one(spark, "أبراج الشاطئ", T.normalize_for_match) == one(spark, "ابراج الشاطي", T.normalize_for_match)
    assert one(spark, " AUF-2026_0143 ", T.normalize_for_match) == "auf 2026 0143"
    assert one(spark, None, T.normalize_for_match) == ""


@pytest.mark.parametrize(
    "given, wanted, error",
    [
        ("١٤ مارس ٢٠٢٦", "2026-03-14", False),
        ("14/03/2026م", "2026-03-14", False),
        ("3 October 2025", "2025-10-03", False),
        ("3 ابريل 2025", "2025-04-03", False),
        ("March 5, 2026", "2026-03-05", False),
        ("2026-3-4 10:00", "2026-03-04", False),
        ("5.6.2024", "2024-06-05", False),
        ("3 Foo 2025", "3 Foo 2025", False),
        ("2026-02-31", None, True),
        ("31/04/2026", None, True),
        ("", None, False),
        (None, None, False),
    ],
)
def test_parse_date(spark, given, wanted, error):
    assert tuple(one(spark, given, P.parse_date)) == (wanted, error)


@pytest.mark.parametrize(
    "given, wanted, error",
    [("١,١٥١,٠٠٠ ريال", 1151000.0, False), ("1.2.3", None, True), ("-", None, False), ("-5.5", -5.5, False), ("x", None, False), (None, None, False)],
)
def test_parse_number(spark, given, wanted, error):
    assert tuple(one(spark, given, P.parse_number)) == (wanted, error)


def test_integers_are_cut(spark):
    assert tuple(one(spark, "12.9", P.parse_integer)) == (12, False)
    assert tuple(one(spark, "-12.9", P.parse_integer)) == (-12, False)


def test_aliases_and_banks(spark):
    assert tuple(one(spark, " شقة ", P.unit_type_alias)) == ("apartment", False)
    assert tuple(one(spark, "Castle", P.unit_type_alias)) == (None, True)
    assert tuple(one(spark, "تمويل بنكي", P.payment_alias)) == ("bank_financing", False)
    assert one(spark, " لا ينطبق ", P.bank_or_null) is None
    assert one(spark, " N/A", P.bank_or_null) is None
    assert one(spark, " بنك ", P.bank_or_null) == "بنك"


@pytest.mark.parametrize(
    "given, wanted",
    [
        ('Sure! ```json\n{"a": 1}\n```', '{"a":1}'),
        ('Here you go: {"sql": "SELECT 1"} thanks', '{"sql":"SELECT 1"}'),
        ("[1, 2]", "[1,2]"),
        ('[{"a":1}] x', '{"a":1}'),
        ('x [1] y', "[1]"),
        ('{"a":1}{"b":2}', None),
        ("no json here", None),
        (None, None),
    ],
)
def test_reply_json(spark, given, wanted):
    assert one(spark, given, lambda c: P.reply_json(c).cast("string")) == wanted


def test_months_back_overflows(spark):
    day = lambda c: T.months_back(F.to_date(c), 3).cast("string")
    assert one(spark, "2026-05-31", day) == "2026-03-03"
    assert one(spark, "2026-08-26", day) == "2026-05-26"
    assert one(spark, "2023-12-01", lambda c: T.month_index(F.to_date(c))) == -1
