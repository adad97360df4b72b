"""Registered queries: every operator over the whole of the given tables."""

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from darwise import values as V
from darwise.functions.parsing import parse_date, parse_number
from darwise.functions.stages import compute_once
from darwise.functions.text import (
    detect_language,
    month_index,
    normalize_for_match,
    quarter_start,
    to_western_digits,
    tokenize,
)
from darwise.operators import absorption as A, bm25, chunking, clusters, contracts as C, evaluation as E, fusion, kpi, pricing
from darwise.operators import routing, sqlgate, vectors
from darwise.plans import contract_texts as CT, stand_in as S
from darwise.session import configure
from darwise.sources.files import split_by_length, spread
from darwise.sources.scratch import scratch_folder, stored

REGISTRY: dict = {}


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(configure(spark), sf_dir)

    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    REGISTRY[fn.__name__] = run
    return run


# --- figures -----------------------------------------------------------------
@query
def kpi_status_totals(spark, d):
    return kpi.status_totals(S.units(spark, d))


@query
def kpi_revenue(spark, d):
    return kpi.sales_totals(S.sales(spark, d))


@query
def kpi_recent_momentum(spark, d):
    return kpi.momentum(S.sales(spark, d))


@query
def kpi_by_project(spark, d):
    return kpi.by_project(*S.tables(spark, d))


@query
def kpi_inventory_series(spark, d):
    return kpi.inventory_series(kpi.by_project(*S.tables(spark, d)))


@query
def kpi_by_unit_type(spark, d):
    return kpi.by_unit_type(S.sales(spark, d), S.units(spark, d))


@query
def kpi_financing_mix(spark, d):
    return kpi.financing_mix(S.sales(spark, d))


@query
def kpi_snapshot(spark, d):
    """The nested snapshot, its lists as text."""
    snap = kpi.kpi_snapshot(*S.tables(spark, d))

    def listed(name, *fields):
        entry = lambda e: F.concat_ws("|", *[e[f].cast("bigint").cast("string") if n else e[f] for f, n in fields])
        return F.array_join(F.transform(name, entry), ";").alias(name)

    mix = F.transform(F.array_sort(F.map_entries("financing_mix")), lambda e: F.concat_ws("|", e["key"], e["value"].cast("string")))
    return snap.select(
        "as_of",
        "units.*",
        "revenue_sar_total",
        F.col("last_3_months.units_sold").alias("recent_units"),
        F.col("last_3_months.revenue_sar").alias("recent_revenue"),
        F.col("last_3_months.units_sold_previous").alias("previous_units"),
        "avg_discount_pct",
        listed("by_project", ("project", 0), ("total_units", 1), ("sold", 1), ("available", 1), ("avg_sale_price_sar", 1), ("avg_price_per_sqm", 1)),
        listed("by_unit_type", ("unit_type", 0), ("units_sold", 1), ("avg_sale_price_sar", 1)),
        F.array_join(mix, ";").alias("financing_mix"),
    )


@query
def quarterly_median_ppsqm(spark, d):
    units, sales, projects = S.tables(spark, d)
    medians = kpi.quarterly_median_ppsqm(kpi.sales_export(sales, units, projects))
    # Many medians end in a 5 after six digits; the offset takes them off the rounding border.
    return medians.withColumn("median_ppsqm", F.round(F.col("median_ppsqm") + 1e-9, 6))


@query
def unit_stats(spark, d):
    return kpi.unit_stats(S.units(spark, d))


@query
def remaining_units(spark, d):
    return kpi.remaining_units(S.units(spark, d))


@query
def sales_export(spark, d):
    units, sales, projects = S.tables(spark, d)
    return kpi.sales_export(sales, units, projects).withColumn("sale_price_sar", F.round("sale_price_sar", 4)).withColumn(
        "discount_pct", F.round("discount_pct", 4)
    )


# --- absorption -----------------------------------------------------------------
@query
def monthly_absorption(spark, d):
    return A.monthly_absorption(S.sales(spark, d), S.projects(spark, d))


@query
def absorption_backtest(spark, d):
    tested = A.backtest(A.monthly_absorption(S.sales(spark, d), S.projects(spark, d)))
    return tested.select(
        "project_id",
        *[F.round(f"mae_{m}", 6).alias(f"mae_{m}") for m in V.FORECAST_METHODS],
        A.best_method().alias("method"),
    )


@query
def absorption_forecast(spark, d):
    units, sales, projects = S.tables(spark, d)
    f = A.forecast_absorption(A.monthly_absorption(sales, projects), kpi.remaining_units(units))
    return f.select(
        "project_id",
        "method",
        "remaining_units",
        F.round("months_of_inventory", 6).alias("months_of_inventory"),
        F.array_join(F.transform("last_3_months", lambda x: x.cast("string")), ",").alias("last_3_months"),
        F.inline("forecast"),
    ).withColumn("units", F.round("units", 6))


# --- prices ------------------------------------------------------------------------
def _features(spark, d):
    units, sales, projects = S.tables(spark, d)
    return pricing.sales_features(sales, units, projects)


@query
def price_features(spark, d):
    return _features(spark, d).select(
        "sale_id", "project_id", "project_name", "city", "unit_type", "view", "payment_method", "bedrooms", "bathrooms",
        "area_sqm", "floor", "parking_spaces", "month", "month_index", F.round("sale_price_sar", 4).alias("sale_price_sar"),
    )


def _baseline(spark, d):
    train, test, _ = pricing.time_split(_features(spark, d))
    return pricing.predict_baseline(train, test)


@query
def price_baseline_metrics(spark, d):
    m = pricing.regression_metrics(_baseline(spark, d), ["baseline"])
    return m.select("predictor", *[F.round(c, 6).alias(c) for c in ("mae", "mape", "r2")])


@query
def price_baseline_by_project(spark, d):
    return pricing.project_mape(_baseline(spark, d), "baseline").withColumn("mape", F.round("mape", 6))


_MODELS: dict = {}


def _price_model(spark, d, past_only: bool):
    """The model of these tables, fitted once in an application, stored and loaded."""
    key = spark.sparkContext.applicationId, d, past_only
    if key not in _MODELS:
        rows = _features(spark, d)
        path = f"{scratch_folder(spark)}/price-model-{uuid.uuid4().hex}"  # outlives the scope of one query
        pricing.fit_price_model(pricing.time_split(rows)[0] if past_only else rows).write().save(f"{path}/model")
        _MODELS[key] = path
    return pricing.load_price_model(_MODELS[key])


@query
def price_gbt(spark, d):
    report = pricing.price_report(_price_model(spark, d, True), stored(_features(spark, d)))
    return report.metrics.withColumns({"n_train": F.lit(report.n_train), "n_test": F.lit(report.n_test)})


@query
def price_importance(spark, d):
    _, test, _ = pricing.time_split(_features(spark, d))
    return pricing.permutation_importance(_price_model(spark, d, True), test)


@query
def price_permutation(spark, d):
    """The place of every sale, and whose floor area it takes in the first shuffle."""
    rows = pricing.shuffled_index(_features(spark, d).select("sale_id", "area_sqm"))
    n, (a, b) = rows.count(), pricing.permutation("area_sqm", 0)
    donors = rows.select(F.col("_at").alias("_d"), F.col("sale_id").alias("donor_id"), F.col("area_sqm").alias("donor_area"))
    met = rows.withColumn("_d", F.pmod(F.col("_at") * a + b, F.lit(max(1, n)))).join(donors, "_d")
    return met.select("sale_id", F.col("_at").alias("place"), "donor_id", "donor_area")


@query
def price_scored_units(spark, d):
    """All unsold units priced by a model fitted on all sales."""
    unsold = S.units(spark, d).filter(F.col("status") != "sold")
    scored = pricing.score_units(_price_model(spark, d, False), unsold.drop("bathrooms"))
    return scored.select("unit_id", "estimated_price_sar", "price_per_sqm")


@query
def price_split(spark, d):
    """Sizes of the halves in time, by project."""
    train, test, start = pricing.time_split(_features(spark, d))
    both = train.withColumn("half", F.lit("train")).unionByName(test.withColumn("half", F.lit("test")))
    return both.groupBy("half", "project_name").agg(F.count(F.lit(1)).alias("n"), F.min("month").alias("first_month"), F.max("month").alias("last_month"), F.lit(start).alias("test_start"))


@query
def price_codes(spark, d):
    """Category codes learnt from sold units, given to all of them: frequent values first, unseen ones share a code."""
    train, test, _ = pricing.time_split(_features(spark, d))
    coded = pricing.category_codes(train).transform(pricing.as_model_input(_features(spark, d)))
    return coded.select("sale_id", *[F.col(f"_c_{c}").cast("int").alias(f"{c}_code") for c in V.PRICE_CATEGORICAL])


@query
def price_defaults(spark, d):
    """Unit descriptions with gaps, completed for scoring."""
    u = S.units(spark, d).withColumns(
        {
            "bathrooms": F.when(F.col("unit_id") % 3 == 0, F.col("bathrooms")),
            "month_index": F.lit(7),
            "payment_method": F.when(F.col("unit_id") % 4 == 0, "cash").when(F.col("unit_id") % 4 == 1, ""),
            "city": F.when(F.col("unit_id") % 5 == 0, "Somewhere"),
        }
    )
    return pricing.with_defaults(u).select("unit_id", "payment_method", "floor", "month_index", "city", "bathrooms")


# --- text ----------------------------------------------------------------------------
@query
def tokens(spark, d):
    docs = compute_once(spread(S.table(spark, d, "documents").select("doc_id", "text"), "doc_id"), {"_t": tokenize("text")}, ["doc_id"])
    return docs.select("doc_id", F.size("_t").alias("n_tokens"), F.array_join("_t", " ").alias("tokens"))


@query
def term_stats(spark, d):
    docs = spread(S.table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return bm25.term_statistics(bm25.index_terms(docs, chunk_id="doc_id"))


@query
def language_mix(spark, d):
    docs = S.table(spark, d, "documents").select("text", F.col("lang").alias("declared"))
    turns = S.table(spark, d, "conversations").select("text", F.col("role").alias("declared"))
    both = docs.unionByName(turns).withColumn("detected", detect_language("text"))
    return both.groupBy("declared", "detected").agg(F.count(F.lit(1)).alias("n"))


@query
def match_keys(spark, d):
    return S.table(spark, d, "conversations").select("conv_id", "turn", normalize_for_match("text").alias("match_key"))


@query
def western_digits(spark, d):
    """Order prices written in Arabic-Indic digits, read back as text and as numbers."""
    price = F.format_number("o_totalprice", 2)
    eastern = F.col("o_orderkey") % 2 == 0
    digits = F.when(eastern, F.translate(price, V.WESTERN_DIGITS, V.EASTERN_ARABIC_INDIC_DIGITS)).otherwise(
        F.translate(price, V.WESTERN_DIGITS + V.WESTERN_SEPARATORS, V.ARABIC_INDIC_DIGITS + V.ARABIC_SEPARATORS)
    )
    written = S.table(spark, d, "orders").select("o_orderkey", F.concat(digits, F.lit(" ريال")).alias("t"))
    parsed = compute_once(written, {"p": parse_number("t")})
    return parsed.select(
        "o_orderkey",
        F.replace(to_western_digits("t"), F.lit(" ريال"), F.lit("")).alias("western"),
        F.col("p.value").alias("price"),
        F.col("p.error").alias("is_error"),
    )


@query
def parsed_dates(spark, d):
    """Order dates written in five ways (one of them impossible), read back."""
    day = F.col("o_orderdate").cast("date")
    months = {k: F.element_at(F.array(*[F.lit(m) for m in v]), F.month(day)) for k, v in (("ar", V.MONTHS_AR), ("en", V.MONTHS_EN))}
    dom, year = F.dayofmonth(day).cast("string"), F.year(day).cast("string")
    kind = F.col("o_orderkey") % 5
    text = (
        F.when(kind == 0, F.date_format(day, "yyyy-M-d"))
        .when(kind == 1, F.concat(F.translate(F.date_format(day, "dd/MM/yyyy"), V.WESTERN_DIGITS, V.ARABIC_INDIC_DIGITS), F.lit("م")))
        .when(kind == 2, F.concat_ws(" ", dom, months["ar"], year))
        .when(kind == 3, F.concat(months["en"], F.lit(" "), dom, F.lit(", "), year))
        .otherwise(F.concat(year, F.lit("-02-3"), (F.dayofmonth(day) % 2).cast("string")))
    )
    parsed = compute_once(S.table(spark, d, "orders").select("o_orderkey", text.alias("t")), {"p": parse_date("t")})
    return parsed.select("o_orderkey", F.col("p.value").alias("iso"), F.col("p.error").alias("is_error"))


@query
def sale_periods(spark, d):
    lines = S.table(spark, d, "lineitem").withColumn("day", F.col("l_shipdate").cast("date"))
    return lines.groupBy(quarter_start("day").alias("quarter"), month_index("day").alias("month_index")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query
def length_guard(spark, d):
    accepted, rejected = split_by_length(S.table(spark, d, "conversations").select("role", "text"))
    both = accepted.withColumn("accepted", F.lit(True)).unionByName(rejected.withColumn("accepted", F.lit(False)))
    return both.groupBy("role", "accepted").agg(F.count(F.lit(1)).alias("n"))


# Words with diacritics, alef and other letter forms, articles, stretching, digits of both kinds, separators and stop words.
ARABIC_WORDS = [
    "الشُّقَّةُ", "والفِيلّا", "بالأرضِ", "إيجــار", "آخِر", "مؤجَّل", "قائم", "على", "الرِّياضُ", "٣٥٠", "۴۲٫۵", "عقار/بيت",
    "الـضـمـان", "بال", "والمبنى،الثاني", "رسوم", "ما", "الال", "شقة-دور", "Tower", "أُسرة", "١٬٢٥٠", "هذا", "ٱلدار",
]


def arabic_texts(spark, d, words):
    """Three words for each order, picked by its keys, with Latin letters behind every third."""
    listed = F.array(*[F.lit(w) for w in words])
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    picked = [F.element_at(listed, (x % len(words) + 1).cast("int")) for x in (k, c, k + 3 * c + 1)]
    tail = F.when(k % 3 == 0, F.concat(F.lit(" "), F.col("o_orderpriority"))).otherwise("")
    return S.table(spark, d, "orders").select("o_orderkey", F.concat(F.concat_ws("  ", *picked), tail).alias("text"))


@query
def arabic_tokens(spark, d):
    rows = compute_once(arabic_texts(spark, d, ARABIC_WORDS), {"_t": tokenize("text")}, ["o_orderkey"])
    return rows.select("o_orderkey", F.size("_t").alias("n_tokens"), F.array_join("_t", " ").alias("tokens"))


@query
def arabic_match_keys(spark, d):
    return arabic_texts(spark, d, ARABIC_WORDS).select("o_orderkey", normalize_for_match("text").alias("match_key"))


QUESTION_WORDS = [
    *V.INVENTORY_HINTS_AR, *V.DOCUMENT_HINTS_AR, *[w for words in V.PROJECT_PATTERNS.values() for w in words],
    "البيت", "مرحبا", "How Many", "Policy", "شكرا", "Narjis",
]


@query
def arabic_routes(spark, d):
    asked = routing.triage(arabic_texts(spark, d, QUESTION_WORDS))
    return asked.select("o_orderkey", "lang", "route", "project_id", "needs_documents", "needs_inventory")


# --- chunks and search -------------------------------------------------------------------
def _chunks(spark, d):
    docs = S.table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    return chunking.chunk_documents(spread(docs, "doc_id"))


def _lexical(corpus):
    """Index over a corpus for one query: terms, postings and statistics are written before they are read."""
    terms = stored(bm25.index_terms(corpus))
    postings = bm25.store_postings(bm25.postings_of(terms))
    index = bm25.lexical_index(terms, stored(bm25.statistics_of_postings(postings)), postings)
    return index._replace(totals=stored(index.totals))


@query
def chunks(spark, d):
    return _chunks(spark, d).select(
        "chunk_id",
        "doc_id",
        "text",
        F.col("metadata")["lang"].alias("lang"),
        F.col("metadata")["source"].alias("source"),
        F.col("metadata")["title"].alias("title"),
    )


@query
def markdown_chunks(spark, d):
    """Project sheets with front matter and headings, one per customer, cut into chunks."""
    text = F.format_string(
        "---\ndoc_type: brochure\nproject_id: P%s\nlang: en\nsource: sheet-%s\n---\n\n# %s\n\n## Balance\nThe balance is %s.\n"
        "#### Note\nnot a section\n\n### Segment: %s\n\n- nation %s\n",
        F.col("c_nationkey").cast("string"), F.col("c_custkey").cast("string"), F.col("c_name"),
        F.col("c_acctbal").cast("decimal(18,2)").cast("string"), F.col("c_mktsegment"), F.col("c_nationkey").cast("string"),
    )
    sheets = S.table(spark, d, "customer").select(F.concat(F.lit("/sheets/c"), F.col("c_custkey"), F.lit(".md")).alias("path"), text.alias("text"))
    return chunking.chunk_documents(sheets).select(
        "chunk_id",
        "doc_id",
        "text",
        F.col("metadata")["project_id"].alias("project_id"),
        F.col("metadata")["source"].alias("source"),
        F.col("metadata")["title"].alias("title"),
    )


def _item_queries(spark, d):
    return S.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query
def bm25_topk(spark, d):
    index = _lexical(_chunks(spark, d))
    top = bm25.bm25_topk(_item_queries(spark, d), index)
    return top.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "bm25_rank")


def _label_means(spark, d):
    vec = S.table(spark, d, "embeddings")
    means = (
        vec.select("label", F.posexplode("embedding").alias("i", "x"))
        .groupBy("label", "i")
        .agg(F.avg("x").alias("m"))
        .groupBy("label")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda e: e["m"]).alias("embedding"))
    )
    return means.withColumnRenamed("label", "query_id"), vec


@query
def dense_topk(spark, d):
    """Nearest vectors of each label's mean vector."""
    top = vectors.dense_topk(*_label_means(spark, d), V.CANDIDATES, 64, "vec_id", "embedding")
    return top.select("query_id", "vec_id", F.round("score", 6).alias("score"), "dense_rank")


@query
def clustered_topk(spark, d):
    """Nearest vectors of each label's mean vector, over clustered lists; with all lists looked into it is exact."""
    means, vec = _label_means(spark, d)
    made = clusters.cluster(vec, 16, "vec_id", "embedding")
    top = clusters.clustered_topk(means.withColumnRenamed("embedding", "vector"), made, V.CANDIDATES, 16, "vec_id")
    return top.select("query_id", "vec_id", F.round("score", 6).alias("score"), "dense_rank")


def _vector_corpus(spark, d):
    """All documents, with the stored vector some have, and benchmark items with vector, language and source of their number.

    Documents without a vector take part by their words.
    """
    vec = S.table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    docs = S.table(spark, d, "documents").join(vec, "doc_id", "left")
    corpus = docs.select(
        F.col("doc_id").cast("string").alias("chunk_id"),
        "doc_id",
        "text",
        F.create_map(F.lit("lang"), "lang", F.lit("project_id"), "source", F.lit("source"), "source").alias("metadata"),
        "vector",
    )
    asked = S.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text").join(
        docs.select(F.col("doc_id").alias("query_id"), "lang", F.col("source").alias("project_id"), "vector"), "query_id"
    )
    return corpus, asked


def _hybrid(spark, d):
    corpus, asked = _vector_corpus(spark, d)
    corpus = stored(corpus)
    index = _lexical(corpus)
    return corpus, fusion.hybrid_search(asked, corpus, index, corpus.select("chunk_id", "vector"), dim=64)


@query
def hybrid_rrf(spark, d):
    return _hybrid(spark, d)[1].withColumn("score", F.round("score", 6))


@query
def hybrid_sources(spark, d):
    corpus, hits = _hybrid(spark, d)
    listed = fusion.sources_in_order(fusion.hits_with_text(hits, corpus))
    return listed.select("query_id", F.array_join("sources", ",").alias("sources"))


@query
def hybrid_context(spark, d):
    corpus, hits = _hybrid(spark, d)
    return fusion.context_pack(fusion.hits_with_text(hits, corpus))


@query
def hybrid_ngrams(spark, d):
    """All chunks of all documents, ranked by BM25 and hashed n-gram vectors."""
    corpus = stored(_chunks(spark, d))
    index = _lexical(corpus)
    return fusion.hybrid_search(_item_queries(spark, d), corpus, index).withColumn("score", F.round("score", 6))


@query
def ngram_vectors(spark, d):
    v = vectors.hashed_ngrams(spread(S.table(spark, d, "documents").select("doc_id", "text"), "doc_id"))
    total = F.aggregate("vector.buckets", F.lit(0).cast("long"), lambda s, x: s + x)
    weighed = F.aggregate(F.arrays_zip("vector.weights", "vector.buckets"), F.lit(0.0), lambda s, x: s + x["weights"].cast("double") * (x["buckets"] % 7))
    return v.select("doc_id", F.size("vector.buckets").alias("n_buckets"), total.alias("bucket_sum"), F.round(weighed, 4).alias("weighed"))


# --- questions and SQL -----------------------------------------------------------------------
@query
def route_questions(spark, d):
    turns = S.table(spark, d, "conversations")
    return routing.triage(turns).select("conv_id", "turn", "role", "lang", "route", "project_id", "needs_documents", "needs_inventory")


@query
def recent_turns(spark, d):
    return routing.recent_turns(S.table(spark, d, "conversations")).select("conv_id", "turn", "role", "text")


@query
def sql_gate(spark, d):
    """Statements written around part rows, some of them unsafe or without a fitting limit."""
    kind = F.col("p_partkey") % 8
    size = F.col("p_size").cast("string")
    text = (
        F.when(kind == 0, F.concat(F.lit("select * from units where view = '"), F.col("p_brand"), F.lit("';")))
        .when(kind == 1, F.concat(F.lit("SELECT unit_id FROM units LIMIT "), (F.col("p_size") * 3).cast("string")))
        .when(kind == 2, F.concat(F.lit("with t as (select * from units limit "), (F.col("p_size") * 9).cast("string"), F.lit(") select * from t limit "), size))
        .when(kind == 3, F.concat(F.lit("select 1; delete from units where area_sqm = "), size))
        .when(kind == 4, F.concat(F.lit("  update units set view = '"), F.col("p_brand"), F.lit("'")))
        .when(kind == 5, F.concat(F.lit("select replace(view, 'a', '"), F.col("p_name"), F.lit("') from units")))
        .when(kind == 6, F.concat(F.lit("drop table part_"), size))
        .otherwise(F.concat(F.lit("select count(*) from units where unit_type = '"), F.col("p_type"), F.lit("' -- dropped")))
    )
    judged = compute_once(S.table(spark, d, "part").select("p_partkey", text.alias("t")), {"v": sqlgate.sql_verdict("t")})
    return judged.select("p_partkey", "v.*")


# --- contracts ----------------------------------------------------------------------------------
def _flat(df, *extra):
    return df.select("source", *[F.col("record")[f].alias(f) for f in V.CONTRACT_FIELDS], *extra)


@query
def contract_roundtrip(spark, d):
    fields = CT.contract_fields(spark, d)
    read = C.extract_contracts(CT.contract_texts(fields).drop("template"))
    return _flat(read, F.array_join("issues", "; ").alias("issues"), "needs_review")


@query
def reply_records(spark, d):
    read = C.records_from_replies(CT.replies(CT.contract_fields(spark, d)))
    return _flat(read, F.array_join("issues", "; ").alias("issues"), F.col("error").isNotNull().alias("is_error"))


def _evaluation(spark, d):
    fields = CT.contract_fields(spark, d)
    return E.evaluate(C.extract_contracts(CT.contract_texts(fields).drop("template")), CT.truth_with_slips(fields))


@query
def extraction_per_field(spark, d):
    return _evaluation(spark, d).per_field.withColumn("accuracy", F.round("accuracy", 6))


@query
def extraction_by_template(spark, d):
    return _evaluation(spark, d).by_template.withColumn("accuracy", F.round("accuracy", 6))


@query
def extraction_totals(spark, d):
    return _evaluation(spark, d).totals.withColumns(
        {"overall": F.round("overall", 6), "perfect_contracts": F.round("perfect_contracts", 6)}
    )


@query
def extraction_missing(spark, d):
    """The truth of all contracts, a third of them never extracted: these count as misses."""
    fields = CT.contract_fields(spark, d)
    read = C.extract_contracts(CT.contract_texts(fields.where("order_key % 3 <> 0")).drop("template"))
    totals = E.evaluate(read, CT.truth_with_slips(fields)).totals
    return totals.select("n_contracts", F.round("perfect_contracts", 6).alias("perfect_contracts"), "flagged_for_review")


@query
def document_contracts(spark, d):
    """Extraction over texts that are no contracts: no field is found, and each needs a review."""
    docs = S.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("source"), "text")
    read = C.extract_contracts(spread(docs, "source"))
    return read.select("source", F.array_join("issues", "; ").alias("issues"), "needs_review")


@query
def extraction_mismatches(spark, d):
    return _evaluation(spark, d).mismatches


@query
def validate_records(spark, d):
    """Business checks over records with odd values in every checked field."""
    k = F.col("order_key")
    fields = CT.contract_fields(spark, d).withColumns(
        {
            "buyer_national_id": F.when(k % 7 == 0, F.substring("buyer_national_id", 1, 9)).otherwise(F.col("buyer_national_id")),
            "buyer_phone": F.when(k % 6 == 0, F.concat(F.lit("+966 5"), F.substring("buyer_phone", 3, 8)))
            .when(k % 6 == 1, F.lit("12345"))
            .otherwise(F.col("buyer_phone")),
            "total_price_sar": F.when(k % 11 == 0, -F.col("total_price_sar")).otherwise(F.col("total_price_sar")),
            "area_sqm": F.when(k % 5 == 0, F.col("area_sqm") * 30).otherwise(F.col("area_sqm")),
            "bank_name": F.when(k % 3 != 0, F.col("bank_name")),
            "contract_date": F.when(k % 13 == 0, F.lit("soon")).otherwise(F.col("contract_date")),
            "buyer_name": F.when(k % 17 != 0, F.col("buyer_name")),
            "unit_no": F.when(k % 19 != 0, F.col("unit_no")).otherwise(F.lit("")),
        }
    )
    records = fields.select("order_key", F.struct(*V.CONTRACT_FIELDS).alias("record"))
    checked = compute_once(records, {"issues": C.business_issues("record")}, ["order_key"])
    return checked.select("order_key", F.size("issues").alias("n_issues"), F.array_join("issues", "; ").alias("issues"))
