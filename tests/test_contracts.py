import pytest
from pyspark.sql import functions as F

from darwise import values as V
from darwise.functions.parsing import reply_json
from darwise.functions.text import normalize_for_match, to_western_digits
from darwise.operators import contracts as C, evaluation as E

A = """عقد بيع

رقم العقد: TST-2025-0001
تاريخ العقد: 09/10/2025م

الطرف الثاني: السيد/ سالم العلي، هوية وطنية رقم 1181960013، جوال 0538908386.
الوحدة رقم X-110 من نوع فيلا في مشروع وادي السلام بمدينة المدينة المنورة، بمساحة إجمالية قدرها 360.5 متر مربع.
الثمن الإجمالي للوحدة هو 1,915,000 ريال سعودي.
يُسدد دفعة مقدمة قدرها 383,000 ريال عند التوقيع، ويُسدد المبلغ المتبقي على 12 أقساط متساوية قيمة كل قسط 127,666 ريال.
جاهزة في موعد أقصاه 30/01/2028م.
"""
B = """إنه في يوم ٩ مارس ٢٠٢٦ تم الاتفاق
ثانياً: فهد سعد، مقيم، بموجب الإقامة رقم ٢٥١١٦١٥٥٩٤، هاتف ٠٥٠٧٨١٦١٨٤، المشتري.
مرجع العقد: TST-2026-0002
مشروع واحة الكائن في الرياض، وقد رغب.
يبيع المطور للمشتري شقة رقم N-026 بمساحة ١٣٥ م٢ في مشروع واحة الورد.
قيمة البيع الإجمالية ٩٠٠,٠٠٠ ريال.
يُسدد المشتري كامل الثمن وقدره ٩٠٠,٠٠٠ ريال نقداً.
موعد تسليم الوحدة: ١ ديسمبر ٢٠٢٦.
"""
KEYED = """رقم العقد : TST-2025-0003
تاريخ التوقيع : 2025-02-16
اسم المشتري : نورة
رقم الهوية : 1131647525
رقم الجوال : 0553419283
المشروع : مرسى – الخبر
رقم الوحدة : K-1
نوع الوحدة : شقة
المساحة : 115 م²
إجمالي الثمن : 869,000 ر.س
طريقة السداد : أقساط
الدفعة المقدمة : 130,000 ر.س
عدد الأقساط : 12
قيمة القسط : 61,583 ر.س
جهة التمويل : لا ينطبق
تاريخ التسليم : 2024-09-01
رقم الوحدة : K-2
"""
D = """AGREEMENT
Agreement No.: TST-2025-0004
Date: 29 November 2025
Mr./Ms. Mona Ali, National ID No. 105641395, Mobile 0576724238 (the "Purchaser").
The Developer sells to the Purchaser Townhouse No. Q-113 in the Wadi Salam project, Madinah, with a gross area of 240 square metres.
The total Purchase Price is SAR 1,245,000, exclusive of tax.
a down payment of SAR 249,000 upon signing, and the balance of SAR 996,000 through mortgage financing provided by Bank One.
Handover no later than 1 January 2028, subject.
"""
OTHER = "عزيزنا العميل، تم بيع فيلا رقم Z-9 بمبلغ 5 ريال."


@pytest.fixture(scope="module")
def extracted(spark):
    rows = [("a", A), ("b", B), ("c", KEYED), ("d", D), ("e", OTHER)]
    df = C.extract_contracts(spark.createDataFrame(rows, "source string, text string")).persist()
    return df, {r["source"]: r for r in df.collect()}


def test_layout_a(extracted):
    r = extracted[1]["a"]
    assert r["record"].asDict() == dict(
        contract_no="TST-2025-0001", contract_date="2025-10-09", buyer_name="سالم العلي", buyer_national_id="1181960013",
        buyer_phone="0538908386", project_name="وادي السلام", city="المدينة المنورة", unit_no="X-110", unit_type="villa",
        area_sqm=360.5, total_price_sar=1915000.0, payment_method="installments", down_payment_sar=383000.0,
        installments_count=12, installment_amount_sar=127666.0, bank_name=None, delivery_date="2028-01-30",
    )
    assert r["issues"] == [] and not r["needs_review"] and r["error"] is None


def test_layout_b_cash_with_arabic_digits(extracted):
    r = extracted[1]["b"]["record"]
    assert (r["contract_date"], r["delivery_date"], r["city"], r["project_name"]) == ("2026-03-09", "2026-12-01", "الرياض", "واحة الورد")
    assert (r["payment_method"], r["down_payment_sar"], r["installments_count"], r["installment_amount_sar"]) == ("cash", 900000.0, 0, 0.0)
    assert r["buyer_national_id"] == "2511615594" and r["area_sqm"] == 135.0


def test_keyed_layout(extracted):
    r = extracted[1]["c"]
    assert (r["record"]["project_name"], r["record"]["city"], r["record"]["bank_name"]) == ("مرسى", "الخبر", None)
    assert r["record"]["unit_no"] == "K-2"  # the last line of a key counts
    assert r["record"]["area_sqm"] == 115.0 and r["record"]["payment_method"] == "installments"
    assert r["issues"] == [V.ISSUE_ORDER] and r["needs_review"]


def test_layout_d(extracted):
    r = extracted[1]["d"]
    assert r["record"]["bank_name"] == "Bank One" and r["record"]["installments_count"] == 1
    assert r["record"]["contract_date"] == "2025-11-29" and r["record"]["unit_type"] == "townhouse"
    assert r["issues"] == [V.ISSUE_NATIONAL_ID]


def test_unknown_layout(extracted):
    r = extracted[1]["e"]
    assert all(v is None for v in r["record"].asDict().values())
    assert r["issues"] == [V.ISSUE_MISSING + "contract_no, buyer_name, unit_no, total_price_sar"] and r["error"] is None


def test_one_bad_field_empties_the_record(spark):
    text = KEYED.replace("2025-02-16", "2025-02-31")
    r = C.extract_contracts(spark.createDataFrame([("x", text)], "source string, text string")).first()
    assert r["error"] and r["issues"] == [V.ISSUE_FAILED] and r["needs_review"]
    assert all(v is None for v in r["record"].asDict().values())


def record(spark, **fields):
    kinds = ", ".join(f"{f}: {C.RECORD_TYPES[f]}" for f in V.CONTRACT_FIELDS)
    row = tuple(fields.get(f) for f in V.CONTRACT_FIELDS)
    df = spark.createDataFrame([(row,)], f"record struct<{kinds}>")
    return df.select(C.business_issues("record").alias("i")).first()["i"]


def test_business_checks(spark):
    issues = record(
        spark, contract_no="Q-77", buyer_name="Lina", unit_no="7B", total_price_sar=640_000.0, payment_method="installments",
        down_payment_sar=40_000.0, installments_count=5, installment_amount_sar=100_000.0, buyer_national_id="98",
        contract_date="2025-11-30", delivery_date="2025-11-29",
    )
    assert issues == [
        V.ISSUE_NATIONAL_ID,
        "payments do not sum to price (expected 640,000, got 540,000)",
        V.ISSUE_ORDER,
    ]
    assert record(spark, contract_no="X", buyer_name="a", unit_no="U", total_price_sar=5.0, payment_method="cash", down_payment_sar=5.0) == []
    assert record(
        spark, contract_no="X", buyer_name="a", unit_no="U", total_price_sar=-5.0, payment_method="bank_financing",
        buyer_phone="+966 5 1234 5678", area_sqm=39.0, contract_date="soon",
    ) == [V.ISSUE_PRICE, V.ISSUE_AREA, V.ISSUE_BANK, "contract_date is not a valid ISO date: soon"]
    assert record(spark, contract_no="X", buyer_name="a", unit_no="U", total_price_sar=9.0, payment_method="cash", down_payment_sar=5.0) == [V.ISSUE_CASH]


def test_values_are_whole(spark):
    """A bracket too many after a value is text that follows it: then the outermost object or array counts, if that is whole."""
    cases = {
        '{"a":1}]': '{"a":1}', '"a"]': None, "[1]]": None, "1]": None, 'so {"a":[1]}] it is': '{"a":[1]}', '{"a":1}]{"b":2}': None,
        "null]": None, "1,2": None, "[1,2]": "[1,2]", "1": "1", "": None, "[]": "[]", "{}": "{}", '"],"': '"],"', '{"a":"]"} x': '{"a":"]"}',
    }
    df = spark.createDataFrame([(c,) for c in cases], "reply string")
    assert {r[0]: r[1] for r in df.select("reply", F.to_json(reply_json("reply"))).collect()} == cases


def test_replies(spark):
    rows = [
        ("ok", '```json\n{"contract_no": "T-1", "buyer_name": "a", "unit_no": "u", "total_price_sar": "١,٢٣٤,٠٠٠", "area_sqm": 1.5e2, "installments_count": 3, "other": 1}\n```'),
        ("array", "[1, 2]"),
        ("garbage", "I cannot do that"),
        ("typed", '{"buyer_name": 5}'),
    ]
    got = {r["source"]: r for r in C.records_from_replies(spark.createDataFrame(rows, "source string, reply string")).collect()}
    r = got["ok"]["record"]
    assert (r["total_price_sar"], r["area_sqm"], r["installments_count"]) == (1234000.0, 150.0, 3)
    assert got["ok"]["error"] is None and got["ok"]["extractor"] == "llm"
    for bad in ("array", "garbage", "typed"):
        assert got[bad]["error"] and got[bad]["needs_review"], bad


@pytest.mark.parametrize(
    "kind, p, t, ok",
    [
        ("number", None, None, True), ("number", None, "0", False), ("number", "100.4", "100", True), ("number", "100.6", "100", False),
        ("number", "10009", "10000", True), ("text", None, "", True), ("text", "A-1", "a 1", True), ("text", "أحمد", "احمد", True),
        ("text", "a", "b", False),
    ],
)
def test_field_match(spark, kind, p, t, ok):
    df = spark.createDataFrame([(p, t)], "p string, t string")
    assert df.select(E.field_match(kind, "p", "t").alias("x")).first()["x"] is ok


def test_evaluate(spark, extracted):
    df, _ = extracted
    truth = df.select("source", "record.*", F.lit("ar").alias("language"), F.upper("source").alias("template"), F.when(F.col("source") == "d", "id").alias("planted_issue"))
    truth = truth.withColumn("city", F.when(F.col("source") == "a", "elsewhere").otherwise(F.col("city")))
    ev = E.evaluate(df, truth)
    fields = {r["field"]: r["accuracy"] for r in ev.per_field.collect()}
    assert fields["city"] == 0.8 and fields["buyer_name"] == 1.0 and len(fields) == 17
    assert {r["template"]: round(r["accuracy"], 4) for r in ev.by_template.collect()}["A"] == round(16 / 17, 4)
    t = ev.totals.first()
    assert (t["n_contracts"], t["perfect_contracts"], t["flagged_for_review"]) == (5, 0.8, 3)
    assert (t["planted_issues_total"], t["planted_issues_caught"]) == (1, 1)
    assert [tuple(r) for r in ev.mismatches.collect()] == [("a", "city", "المدينة المنورة", "elsewhere")]
    assert E.evaluate(df, truth, limit=2).totals.first()["n_contracts"] == 2
    assert E.record_diff(E.compare_records(df, truth)).filter("source = 'a' and not ok").count() == 1


def test_missing_and_repeated_contracts(spark, extracted):
    df, _ = extracted
    truth = df.select("source", "record.*", F.lit("ar").alias("language"), F.upper("source").alias("template"), F.lit("id").alias("planted_issue"))
    t = E.evaluate(df.where("source <> 'a'"), truth).totals.first()
    whole = E.evaluate(df, truth).totals.first()
    assert t["n_contracts"] == whole["n_contracts"] == 5 and t["perfect_contracts"] == whole["perfect_contracts"] - 0.2
    assert t["planted_issues_caught"] <= whole["planted_issues_caught"] and t["flagged_for_review"] == whole["flagged_for_review"] + 1
    with pytest.raises(Exception, match="more than one row of source"):
        E.evaluate(df.unionByName(df), truth).totals.collect()


def test_marks_in_texts_shift_nothing(spark, extracted):
    df, _ = extracted
    truth = df.select("source", "record.*", F.lit("ar").alias("language"), F.upper("source").alias("template"), F.lit("").alias("planted_issue"))
    odd = truth.withColumn("buyer_name", F.concat("buyer_name", F.lit("\x01")))
    wrong = {f["field"]: f["accuracy"] for f in E.evaluate(df, odd).per_field.collect() if f["accuracy"] < 1}
    assert set(wrong) == {"buyer_name"}


def test_records_meet_their_truth_without_moving_again(spark, extracted):
    """each side is dealt out once by source, for the check of repeats and for the join"""
    df, _ = extracted
    truth = df.select("source", "record.*", F.lit("ar").alias("language"), F.lit("A").alias("template"), F.lit("").alias("planted_issue"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = E.compare_records(df, truth)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning(") == 2, plan


def test_texts_that_differ_go_to_python_together(spark, extracted):
    """one call for all fields of both sides, and verdicts as field by field, for characters NFKC changes, nulls and empty texts"""
    rows = [(None, None), (None, ""), ("ﻋﻘﺪ", "عقد"), ("ﻋﻘﺪ", None), ("A－1", "a-1"), ("ab", "AB"), ("ab", "ba"), ("ﬁ", "ﬁ"), ("٣", "3")]
    nothing = F.struct(*[F.lit(None).cast(C.RECORD_TYPES[f]).alias(f) for f in V.CONTRACT_FIELDS])
    both = spark.createDataFrame([(str(i), p, t) for i, (p, t) in enumerate(rows)], "source string, p string, t string")
    read = both.select("source", nothing.withField("buyer_name", F.col("p")).alias("record"), F.array().cast("array<string>").alias("issues"), F.lit(None).cast("string").alias("error"), F.lit(False).alias("needs_review"))
    truth = both.select("source", nothing.withField("buyer_name", F.col("t")).alias("r"), F.lit("ar").alias("language"), F.lit("A").alias("template"), F.lit("").alias("planted_issue")).select("source", "r.*", *V.TRUTH_LABELS)
    compared = E.compare_records(read, truth)
    got = {r["source"]: r["ok"] for r in compared.collect()}
    one = {r["source"]: r["k"] for r in both.select("source", E.field_match("text", "p", "t").alias("k")).collect()}
    plain = {r["source"]: r["k"] for r in both.select("source", (normalize_for_match("p") == normalize_for_match("t")).alias("k")).collect()}
    assert {s: r["buyer_name"] for s, r in got.items()} == one == plain
    assert [plain[str(i)] for i in range(len(rows))] == [True, True, True, False, True, True, False, True, True]
    assert all(r["city"] and r["area_sqm"] for r in got.values())
    plan = compared._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("to_nfkc(") == 1, plan


def test_clauses_are_searched_where_their_words_stand(spark):
    """the words asked for are in every match, and texts without them are not searched"""
    assert C.required_text(r"(?Ud)a(b+)cde[fk]gh?ij{2}") == "cde" and C.required_text(r"(x|y)") == ""
    for clauses, text in ((V.CLAUSES_A, A), (V.CLAUSES_B, B), (V.CLAUSES_D, D)):
        plain = spark.createDataFrame([(text,)], "t string").select(to_western_digits("t").alias("t"))
        for pattern, _ in clauses:
            piece, needed = plain.select(F.regexp_substr("t", F.lit(pattern))).first()[0], C.required_text(pattern)
            assert len(needed) > 4 and needed in piece, pattern
    plan = C.parse_layouts(spark.createDataFrame([(A,)], "text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Contains(_t") >= len(V.CLAUSES_A), plan  # a printed plan names the first columns only


def test_lines_of_a_keyed_contract_may_end_in_any_way(spark):
    ends = ["\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x85", " ", " "]
    df = spark.createDataFrame([(str(i), KEYED.replace("\n", e)) for i, e in enumerate(ends)], "source string, text string")
    read = C.extract_contracts(df).collect()
    assert len(read) == len(ends) and len({str(r["record"]) for r in read}) == 1 and read[0]["record"]["unit_no"] == "K-2"
