"""Null branches, edge values and invariants on small frames."""

from datetime import date

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from offerlake.functions import text
from offerlake.operators import analytics, geometry, predicates, reconcile, rules, sorting, trends
from offerlake.sources import sinks

BASE = dict(
    id="a", leaflet_id=1, page_number=1, product_name="Red Apple 500 g", brand="Orchard", category="Fruit", regular_price=10.0, discounted_price=8.0, discount_percentage=20.0, confidence=0.95, bbox_x=0, bbox_y=0, bbox_width=100,
    bbox_height=100, review_status="pending", review_priority=10, validation_passed=True, organization_id=1, created_at=date(2026, 1, 20),
)
SCHEMA = (
    "id string, leaflet_id long, page_number long, product_name string, brand string, category string, regular_price double, discounted_price double, discount_percentage double, confidence double, bbox_x long, bbox_y long,"
    " bbox_width long, bbox_height long, review_status string, review_priority long, validation_passed boolean, organization_id long, created_at date"
)


def frame(spark, *changes):
    return spark.createDataFrame([tuple((BASE | c).values()) for c in changes], SCHEMA)


def test_summary_counts_and_empty(spark):
    counts = {"auto_approved": 8, "approved": 4, "pending": 5, "rejected": 2, "needs_correction": 1}
    made = frame(spark, *[{"review_status": s, "id": f"{s}{i}"} for s, n in counts.items() for i in range(n)])
    row = analytics.product_summary(made).first()
    assert (row.total, row.total_approved, row.awaiting_review, row.auto_rate) == (20, 12, 6, 40.0)
    nothing = analytics.product_summary(made.limit(0)).first()
    assert (nothing.total, nothing.auto_rate, nothing.mean_confidence) == (0, 0.0, 0.0)


def test_period_includes_both_days(spark):
    days = [date(2026, 1, d) for d in (15, 20, 25, 5)] + [date(2026, 2, 5)]
    made = frame(spark, *[{"created_at": d} for d in days])
    assert made.where(predicates.days("created_at", "2026-01-10", "2026-01-31")).count() == 3


def test_pages_are_disjoint_and_complete(spark):
    made = frame(spark, *[{"id": f"{i:03}"} for i in range(100)])
    pages = [{r.id for r in sorting.page(made, "created_at", "desc", k, 50).collect()} for k in (1, 2, 3)]
    assert not pages[0] & pages[1] and len(pages[0] | pages[1]) == 100 and not pages[2]
    assert sorting.page_facts(100, 2, 50) == {"total": 100, "pages": 2, "has_next": False, "has_prev": True}


def test_tenants_see_their_own(spark):
    made = frame(spark, {"organization_id": 1}, {"organization_id": 2})
    assert [predicates.tenant(made, o).count() for o in (1, 2, 3, None)] == [1, 1, 0, 2]


def test_growth_branches(spark):
    made = spark.createDataFrame([(1, 0), (2, 0), (3, 5), (4, 10)], "p int, v int")
    assert [r.growth for r in analytics.growth(made, "p", "v").orderBy("p").collect()] == [None, 0.0, 100.0, 100.0]


def test_validation(spark):
    made = frame(spark, {}, {"id": "b", "product_name": "test", "regular_price": 5.0, "discounted_price": 8.0}, {"id": "c", "product_name": None, "regular_price": None, "discounted_price": None, "brand": None, "confidence": 0.4})
    a, b, c = rules.validated(made, lists=True).orderBy("id").collect()
    assert a.is_valid and a.auto_approve and a.priority == 0
    assert set(b.errors) == {"discount", "product_name"}
    assert c.errors == ["product_name"] and set(c.warnings) == {"no_price", "confidence"} and c.priority == 20 + 10 + 30 + 10 + 5


def test_routing_order(spark):
    rows = spark.createDataFrame([(0.95, 0, 0, None, False), (0.95, 5, 0, None, False), (0.8, 0, 2, None, False), (0.5, 1, 0, None, False), (0.95, 0, 0, 0.5, False)], "confidence double, n_errors int, n_warnings int, image_score double, critical boolean")
    assert [r.path for r in rules.routed(rows).collect()] == ["auto_approve", "priority_review", "quick_review", "detailed_review", "quick_review"]


def test_sanitize_steps(spark):
    made = frame(
        spark, {"id": "a", "regular_price": None, "discount_percentage": None}, {"id": "b", "regular_price": None}, {"id": "c", "regular_price": 8.0}, {"id": "d", "discount_percentage": 50.0},
        {"id": "e", "product_name": "FRESH FRUIT", "regular_price": None, "discounted_price": None}, {"id": "f", "regular_price": 8.0, "discount_percentage": 100.0},
    )
    got = {r.id: r for r in reconcile.sanitized(made).collect()}
    assert (got["a"].regular_price, got["a"].discounted_price) == (8.0, None)
    assert got["b"].regular_price == got["c"].regular_price == 10.0
    assert got["d"].discount_percentage == 20.0 and "e" not in got
    assert got["f"].discounted_price is None and got["f"].discount_percentage is None


def test_dedup_is_idempotent_and_keeps_the_best(spark):
    made = frame(spark, {"id": "a", "confidence": 0.8}, {"id": "b", "confidence": 0.9}, {"id": "c", "confidence": 0.9}, {"id": "d", "page_number": 2})
    once = reconcile.best_on_page(made)
    assert {r.id for r in once.collect()} == {"b", "d"} == {r.id for r in reconcile.best_on_page(once).collect()}


def test_names(spark):
    pairs = spark.createDataFrame([("Red Apple", "red apple"), ("Red Apple", "Red Apple Juice"), ("the big red apple", "big green apple"), (None, "x")], "a string, b string")
    got = [r[0] for r in pairs.select(reconcile.name_similarity(F.col("a"), F.col("b"))).collect()]
    assert got[0] == 1.0 and got[1] == 0.9 and abs(got[2] - (2 / 5 + 0.2)) < 1e-9 and got[3] == 0.0
    row = frame(spark, {"product_name": "Orchard Red Apple 500 g"}).select(text.compared_name(F.col("product_name"), F.col("brand")).alias("n")).first()
    assert row.n == "red apple"


def test_model_answers(spark):
    answers = ['{"a": 1}', 'well:\n```json\n{"a": 2}\n```', 'x ```{"a": 3}``` y', 'so {"a": 4} it is', "none", None]
    got = spark.createDataFrame([(x,) for x in answers], "t string").select(text.model_json(F.col("t"), "a int").a).collect()
    assert [r[0] for r in got] == [1, 2, 3, 4, None, None]


def test_natural_order_and_sizes(spark):
    names = spark.createDataFrame([("p10.png",), ("p2.png",)], "n string")
    assert [r.n for r in names.orderBy(text.natural_key(F.col("n"))).collect()] == ["p2.png", "p10.png"]
    assert [r[0] for r in spark.createDataFrame([(500,), (2048,), (3 << 20,)], "n long").select(text.size_label(F.col("n"))).collect()] == ["500.0 B", "2.0 KB", "3.0 MB"]


def test_periods():
    day = date(2024, 3, 15)
    assert trends.preset("last_month", day) == (date(2024, 2, 1), date(2024, 2, 29)) and trends.preset("last_7", day)[0] == date(2024, 3, 9)
    assert trends.custom(date(2023, 3, 16), date(2024, 3, 15), day)
    with pytest.raises(ValueError):
        trends.custom(date(2024, 1, 1), date(2025, 1, 2), date(2025, 1, 2))


def test_greedy_boxes_and_similar_texts(spark):
    made = frame(spark, {"id": "a"}, {"id": "b", "bbox_x": 10, "confidence": 0.99}, {"id": "c", "bbox_x": 400}).withColumn("source", F.expr("case id when 'b' then 0 else 1 end"))
    assert {r.id for r in geometry.greedy_distinct(made, 0.5).collect()} == {"b", "c"}
    pairs = spark.createDataFrame([("abcd", "bcde"), (None, "")], "a string, b string")
    assert [r.similarity for r in geometry.similar_texts(pairs, "a", "b").collect()] == [0.75, 1.0]


def test_csv_quotes(spark, tmp_path):
    rows = spark.createDataFrame([Row(a='say "x", y', b="plain")])
    sinks.write_csv(rows, str(tmp_path / "c"))
    (line,) = [x for f in (tmp_path / "c").glob("part-*") for x in f.read_text().splitlines()[1:]]
    assert line == '"say ""x"", y",plain'
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).first() == rows.first()


OFFER = "id string, leaflet_id long, page_number long, product_name string, brand string, product_code string, category string, currency string, units string, regular_price double, discounted_price double, discount_percentage double, quantity long, confidence double, category_confidence double, bbox_x long, bbox_y long, bbox_width long, bbox_height long, flags string"


def offer(id_, page, y, height, name="milk", flags="", **other):
    row = {"brand": "B", "product_code": None, "category": "c", "currency": "EUR", "units": "kg", "regular_price": 2.0, "discounted_price": None, "discount_percentage": None, "quantity": 1, "confidence": 0.8, "category_confidence": None, "x": 10, "width": 100} | other
    return (id_, 1, page, name, *(row[k] for k in ("brand", "product_code", "category", "currency", "units", "regular_price", "discounted_price", "discount_percentage", "quantity", "confidence", "category_confidence", "x")), y, row["width"], height, flags)


def test_splits_merge_and_reconcile(spark):
    rows = [
        offer("a", 1, 800, 101, flags="continues_on_next_page", regular_price=0.0, confidence=0.6),  # ends below 900
        offer("edge", 1, 800, 100, flags="continues_on_next_page"),  # ends at 900, which is not in the lowest tenth
        offer("b", 3, 99, 50, "fresh milk", "continued_from_previous,price_unclear", x=20, width=200, discounted_price=1.5),  # page 2 is missing
        offer("top", 3, 100, 50, "cheese", flags="continued_from_previous"),
        offer("none", 3, None, None, x=None, width=None, flags="continued_from_previous"),
    ]
    offers = spark.createDataFrame(rows, OFFER)
    pairs = reconcile.split_candidates(offers, 1000).collect()
    assert [(r.first_id, r.second_id, r.points) for r in pairs] == [("a", "b", 100)]
    one = reconcile.merged(offers, spark.createDataFrame([("a", "b")], "first_id string, second_id string")).first()
    assert (one.id, one.product_name, one.regular_price, one.discounted_price, one.flags) == ("a+b", "milk fresh milk", 2.0, 1.5, "merged_from_split,price_unclear")
    assert (one.bbox_x, one.bbox_y, one.bbox_width, one.bbox_height) == (10, 800, 210, 151) and abs(one.confidence - 0.7) < 1e-9
    kept = {r.id for r in reconcile.reconciled(offers, 1000).collect()}
    assert kept == {"a+b", "edge", "top", "none"}


def test_weak_category_is_a_flag(spark):
    rows = [offer("w", 1, 0, 100, category_confidence=0.7, confidence=0.95, discounted_price=1.5, product_code="SKU1"), offer("s", 1, 0, 100, category_confidence=0.9, confidence=0.95, discounted_price=1.9, product_code="SKU1")]
    weak, strong = (rules.validated(spark.createDataFrame([r], OFFER), lists=True).first() for r in rows)
    assert weak.warnings == ["category", "CATEGORY_LOW_CONFIDENCE"] and weak.priority == 2 * 5 + 5 + 10 and not weak.auto_approve
    assert strong.warnings == [] and strong.priority == 0 and strong.auto_approve


def test_provider_pick_and_stored_files(spark, tmp_path):
    from offerlake.operators import sorting
    from offerlake.sources import files

    rows = [(1, 1, False, 5.0, 5.0), (2, 2, False, 1.0, None), (3, 2, True, 1.0, 2.0)]
    made = spark.createDataFrame(rows, "id int, priority int, is_default boolean, month_spent double, monthly_budget double")
    made = made.selectExpr("*", "true as is_active", "0.0 as day_spent", "cast(null as double) as daily_budget", "1 as hour_requests", "10 as max_requests_per_hour", "current_date() as created_at")
    assert sorting.within_budget(made).first().id == 3  # the first has spent its budget, the default comes before the other
    for name in ("a1.csv", "a2.csv", "b.csv"):
        (tmp_path / name).write_text("x")
    assert files.listed(spark, str(tmp_path), "a").count() == 2
    assert files.remove_older(spark, str(tmp_path), "2000-01-01", 1) == 0
    assert files.remove(spark, [str(tmp_path / "b.csv"), str(tmp_path / "b.csv")]) == 1
    assert files.remove_older(spark, str(tmp_path), "2100-01-01", 1) == 2 and not list(tmp_path.glob("*.csv"))


def test_rate_windows_end_with_their_state(spark, tmp_path):
    """Windows over several batches: state that the watermark ended opens a new window, as a plain loop has it."""
    from offerlake.streaming import usage

    times = [(u, e, f"2024-01-0{1 + e // 8} {e % 8 * 3:02d}:00:00") for u in range(3) for e in range(24)]
    whole = spark.createDataFrame([(u, u * 100 + e, t) for u, e, t in times], "user_id long, event_id long, t string").selectExpr("user_id", "event_id", "cast(t as timestamp_ntz) ts")
    for day in range(3):
        whole.where(f"event_id % 100 div 8 = {day}").coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    got = {r.event_id: r.nth for r in usage.replay(usage.rate_windows(usage.events(spark, str(tmp_path)), 5 * 3600, 2), "append").collect()}
    assert len(got) == 72 and all(got[u * 100 + e] == 1 + e % 2 for u, e, _ in times)


WHOLE_OFFER = "id string, leaflet_id long, page_number long, product_name string, brand string, product_code string, category string, currency string, units string, regular_price double, discounted_price double, discount_percentage double, quantity long, confidence double, category_confidence double, brand_confidence double, bbox_x long, bbox_y long, bbox_width long, bbox_height long, flags string"


def test_merged_fields_and_equal_rows(spark):
    def row(id_, page, name, y, brand_confidence=None, flags="", **k):
        return (id_, 1, page, name, "B", None, None, "EUR", None, k.get("price"), None, None, None, 0.8, None, brand_confidence, 10, y, 80, 60, flags)

    rows = [
        row("a", 1, "long bread", 950, 0.5, "continues_on_next_page"), row("a2", 1, "long bread", 950, 0.5, "continues_on_next_page"), row("b", 2, "long bread loaf", 5, 0.9, "continued_from_previous", price=3.0),
        row("b2", 2, "long bread loaf", 5, 0.9, "continued_from_previous", price=3.0), row("c", 2, "milk", 500, 0.0),
    ]
    df = spark.createDataFrame(rows, WHOLE_OFFER)
    (made,) = reconcile.merged(df, spark.createDataFrame([("a", "b")], "first_id string, second_id string")).collect()
    assert made.brand_confidence == 0.9 and made.regular_price == 3.0 and made.bbox_height == 120
    (none,) = reconcile.merged(df, spark.createDataFrame([("c", "c")], "first_id string, second_id string")).collect()
    assert none.brand_confidence is None  # 0 is none
    # equal parts are one product: every pair is merged, all parts go, and the merged ones are the same product
    assert sorted(x.id for x in reconcile.reconciled(df, 1000).collect()) == ["a+b", "c"]
    alone = df.where("id in ('a', 'a2', 'b', 'c')")
    assert sorted(x.id for x in reconcile.reconciled(alone, 1000).collect()) == ["a+b", "c"]
    boxless = df.withColumn("bbox_x", F.when(F.col("id") == "a", None).otherwise(F.col("bbox_x")))
    (kept,) = reconcile.merged(boxless, spark.createDataFrame([("a", "b")], "first_id string, second_id string")).collect()
    assert (kept.bbox_x, kept.bbox_height) == (10, 60)


def test_places_of_all_rows(spark):
    from offerlake.operators import sorting

    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.when(F.col("id") % 5 == 0, None).otherwise(F.col("id") % 3).alias("v"))
    expected = sorted(((r.v is not None, -(r.v or 0), r.k) for r in df.collect()))
    got = sorted((r.place, r.v is not None, -(r.v or 0), r.k) for r in sorting.numbered(df, F.desc_nulls_first("v"), F.col("k")).collect())
    assert [x[0] for x in got] == list(range(1, 1001)) and [x[1:] for x in got] == expected
    assert sorting.numbered(df.limit(0), F.col("k")).collect() == []


def test_numbers_among_texts_are_told_as_the_cast_does(spark):
    odd = ["1e5", "0x1p3", "inf", "-Infinity", "NaN", " 1 ", "1d", "2F", "abc", "1⁹⁹", "+5", ".5", "5.", "1_000", "\t7\n", "\x1f8", "12,99 EUR", "500 g", "in", "n", "-", "", None]
    df = spark.createDataFrame([(t,) for t in odd], "t string")
    rows = df.select(F.col("t").try_cast("double").alias("a"), sorting.client_key("t")[1].alias("b")).collect()
    assert [str(r.a) for r in rows] == [str(r.b) for r in rows]


def test_a_client_sort_compares_columns(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["b", "10", "9", None, "a"])], "k int, t string")
    made = sorting.client_numbered(df, "t", "k")
    assert made.columns == ["k", "t", "place"] and [r.k for r in made.orderBy("place").collect()] == [2, 1, 3, 4, 0]
    orders = []
    numbered, sorting.numbered = sorting.numbered, lambda rows, *order, keys: orders.extend([*order, *keys]) or rows
    try:
        sorting.client_numbered(df, "t", "k")
    finally:
        sorting.numbered = numbered
    assert [str(o) for o in orders[:4]] == [f"Column<'{c}'>" for c in ("_key0", "_key1", "_key2", "k")]


def test_reconciling_moves_products_by_document_once_for_both_choices(spark):
    products = spark.range(10).selectExpr("concat('a', id) AS id", "id AS leaflet_id", "id % 3 AS page_number", "'x' AS flags", "id * 100 AS bbox_x", "id * 100 AS bbox_y", "10L AS bbox_width", "10L AS bbox_height", "0.5D AS confidence", "0.5D AS category_confidence",
                                          *[f"'{c}' AS {c}" for c in reconcile.TEXTS], *[f"1.0D AS {c}" for c in reconcile.NUMBERS])
    plan = reconcile.reconciled(products.distinct(), 1000)._jdf.queryExecution().executedPlan().toString()
    ranked = plan[: plan.index("Union")]
    assert ranked.count("Exchange") == 1 and "hashpartitioning(leaflet_id" in ranked


def test_answers_are_parsed_once(spark):
    from offerlake.plans import catalog

    plan = catalog.QUERIES["n5_parsed_products"][0](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.lower().count("parsejson") + plan.lower().count("parse_json") <= 2  # for its columns, and for the filter on the name
