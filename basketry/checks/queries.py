"""One callable per job: ``(spark, sf_dir) -> DataFrame`` over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.operators import candidates as cand
from basketry.operators import cooccurrence as co
from basketry.operators import decisions as dec
from basketry.operators import experiments as ab
from basketry.operators import features as feat
from basketry.operators import increments as inc
from basketry.operators import ingest, quality, reports, sessions
from basketry.operators import requests as req
from basketry.operators import sketches
from basketry.operators.enrich import attach_category, enrich_events
from basketry.operators.tenancy import tenant_scope
from basketry.plans import feature_state as state
from basketry.plans import stored_lists
from basketry.plans.customer_features import customer_features
from basketry.plans.incremental import incremental_features
from basketry.plans.recommend import (
    STORED,
    invalidate_stored,
    precompute_recommendations,
    recommend,
    store_recommendations,
)
from basketry.plans.ingest import ingest_to_lake
from basketry.plans.refresh_cooccurrence import refresh_cooccurrence
from basketry.schemas import COOCCURRENCE, CUSTOMER, CUSTOMER_FEATURES, DECISIONS, FEATURE_JOB, MODEL_VERSION
from basketry.session import configure, materialize, shared_dir
from basketry.sources import bucketed, cells, lake, tables
from basketry.sources import testbed as tb
from basketry.streaming import jobs as stream
from basketry.streaming import event_log, rolling
from basketry.streaming import merged as merged_stream
from basketry.streaming.sources import decode_messages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

AS_OF = tb.AS_OF
EVENT_COLUMNS = ["id", "tenant_id", "customer_id", "event_type", "product_id", "timestamp"]


def query(fn: Query) -> Query:
    """Register under the function's name; times leave without a zone, dates as text."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = fn(configure(spark), sf_dir)
        plain = {"timestamp": "timestamp_ntz", "date": "string"}
        return out.withColumns({c: F.col(c).cast(plain[t]) for c, t in out.dtypes if t in plain})

    QUERIES[fn.__name__] = run
    return fn


def cents(name: str):
    return (F.col(name) * 100).cast("double").alias(f"{name}_cents")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/basketry/{name}-{uuid4().hex}"


def features_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_features(tb.events(spark, sf_dir), tb.products(spark, sf_dir), AS_OF)


def pairs_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.cooccurrence(tb.events(spark, sf_dir), AS_OF)


def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tenants t0 and t1 were last run 20 days after their first event; t2 never was."""
    return (
        tb.events(spark, sf_dir)
        .filter(F.col("tenant_id") != "t2")
        .groupBy("tenant_id")
        .agg((F.date_trunc("day", F.min("timestamp")) + F.expr("INTERVAL 20 DAYS")).alias("ts"))
        .select(
            "tenant_id",
            F.lit(FEATURE_JOB).alias("pipeline_name"),
            F.col("ts").alias("last_event_ts"),
            F.col("ts").alias("updated_at"),
        )
    )


# ---- tenant scope and ingestion


@query
def tenant_scoped_events(spark, sf_dir):
    return tenant_scope(tb.events(spark, sf_dir), "t1").select(*EVENT_COLUMNS)


@query
def ingest_accepted(spark, sf_dir):
    accepted, _ = ingest.ingest_events(tb.payloads(spark, sf_dir), uuid_ids=False)
    amount = F.get_json_object("properties", "$.revenue").cast("double")
    return accepted.select(*EVENT_COLUMNS[1:], amount.alias("revenue"))


@query
def ingest_rejected(spark, sf_dir):
    _, rejected = ingest.ingest_events(tb.payloads(spark, sf_dir), uuid_ids=False)
    return rejected


@query
def lake_round_trip(spark, sf_dir):
    path = new_folder(spark, "lake")
    lake.write_events(tb.events(spark, sf_dir), path)
    return lake.read_events(spark, path).select(*EVENT_COLUMNS)


@query
def lake_range(spark, sf_dir):
    path = new_folder(spark, "lake")
    lake.write_events(tb.events(spark, sf_dir), path)
    return lake.read_events(spark, path, "t1", "2024-01-10", "2024-01-20").select(*EVENT_COLUMNS)


@query
def ingest_twice(spark, sf_dir):
    """Bodies ingested twice are stored once."""
    path = new_folder(spark, "lake")
    for _ in range(2):
        ingest_to_lake(tb.payloads(spark, sf_dir), path, f"{path}-rejected", uuid_ids=False)
    return lake.read_events(spark, path).select(*EVENT_COLUMNS[1:])


@query
def ingest_canonical_ids(spark, sf_dir):
    """UUIDs made from the test ids, written in five ways, come out in one."""
    def spelled(name, turn):
        h = F.md5(F.col(name))
        long = F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
        forms = [long, F.upper(long), h, F.concat(F.lit("{"), long, F.lit("}")), F.concat(F.lit("urn:uuid:"), F.upper(long))]
        return F.when(h.isNotNull(), F.element_at(F.array(*forms), (turn % 5 + 1).cast("int")))

    number = F.col("id").cast("long")
    item = F.struct(
        "customer_id", "event_type", spelled("product_id", number).alias("product_id"),
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
    )
    bodies = (
        tb.events(spark, sf_dir)
        .groupBy("tenant_id", F.floor(number / 900).alias("batch"))
        .agg(F.to_json(F.struct(F.collect_list(item).alias("events"))).alias("body"))
        .select(F.concat_ws("-", "tenant_id", "batch").alias("batch_id"), spelled("tenant_id", F.col("batch")).alias("tenant_id"), "body")
    )
    accepted, _ = ingest.ingest_events(bodies)
    return accepted.select(*EVENT_COLUMNS[1:])


# ---- features


@query
def enriched_events(spark, sf_dir):
    rows = enrich_events(tb.events(spark, sf_dir), tb.products(spark, sf_dir))
    return rows.select(
        "id", "tenant_id", "customer_id", "product_id", "category",
        F.col("revenue").cast("double").alias("revenue"),
    )


@query
def activity_counts(spark, sf_dir):
    return feat.activity_counts(tb.events(spark, sf_dir))


@query
def distinct_counts(spark, sf_dir):
    return feat.distinct_counts(tb.events(spark, sf_dir), tb.products(spark, sf_dir))


@query
def recency_days(spark, sf_dir):
    return feat.recency_days(tb.events(spark, sf_dir), AS_OF)


@query
def category_affinity(spark, sf_dir):
    return feat.category_affinity_rows(tb.events(spark, sf_dir), tb.products(spark, sf_dir), AS_OF)


@query
def category_affinity_map(spark, sf_dir):
    scores = feat.category_affinity_rows(tb.events(spark, sf_dir), tb.products(spark, sf_dir), AS_OF)
    maps = feat.category_affinity_map(scores)
    return maps.select(
        *CUSTOMER,
        F.size("category_affinity").cast("bigint").alias("categories"),
        F.explode("category_affinity").alias("category", "affinity_score"),
    )


@query
def purchase_gaps(spark, sf_dir):
    return feat.purchase_gaps(tb.events(spark, sf_dir))


@query
def purchase_revenue(spark, sf_dir):
    rows = feat.purchase_revenue(tb.events(spark, sf_dir))
    return rows.select(*CUSTOMER, cents("total_revenue"), cents("avg_order_value"))


@query
def sessionized_events(spark, sf_dir):
    rows = sessions.sessionize(tb.events(spark, sf_dir))
    return rows.select("id", *CUSTOMER, "session_num")


@query
def session_stats(spark, sf_dir):
    return sessions.session_stats(tb.events(spark, sf_dir))


@query
def session_windows(spark, sf_dir):
    return sessions.session_windows(tb.events(spark, sf_dir))


def flat_features(rows: DataFrame) -> DataFrame:
    plain = [c for c in rows.columns
             if c not in ("category_affinity", "total_revenue", "avg_order_value")]
    return rows.select(
        *plain,
        F.size("category_affinity").cast("bigint").alias("categories"),
        F.coalesce(
            F.aggregate(F.map_values("category_affinity"), F.lit(0.0), lambda a, v: a + v),
            F.lit(0.0),
        ).alias("affinity_total"),
        cents("total_revenue"),
        cents("avg_order_value"),
    )


@query
def customer_feature_rows(spark, sf_dir):
    return flat_features(features_at(spark, sf_dir))


@query
def customer_feature_affinity(spark, sf_dir):
    return features_at(spark, sf_dir).select(
        *CUSTOMER, F.explode("category_affinity").alias("category", "affinity_score")
    )


@query
def basic_features(spark, sf_dir):
    return feat.basic_features(tb.events(spark, sf_dir), tb.products(spark, sf_dir), AS_OF)


# ---- sketches


@query
def distincts_sketched(spark, sf_dir):
    """Exact distinct counts of two weeks, and whether those from merged daily sketches are within three standard errors."""
    events, products = tb.events(spark, sf_dir), tb.products(spark, sf_dir)
    daily = materialize(sketches.daily_distincts(events, products), "sketches")
    about = sketches.distincts_between(daily, "2024-01-08", "2024-01-21")
    some = events.filter("timestamp >= timestamp '2024-01-08' AND timestamp < timestamp '2024-01-22'")
    exact = attach_category(some, products, "customer_id").groupBy("tenant_id", "category").agg(
        F.count_distinct("customer_id").alias("n_customers"), F.count_distinct("product_id").alias("n_products")
    ).withColumnsRenamed({"tenant_id": "t", "category": "c"})
    joined = about.join(exact, F.col("tenant_id").eqNullSafe(F.col("t")) & F.col("category").eqNullSafe(F.col("c")))

    def near(estimate: str, n: str):
        return (F.abs(F.col(estimate) - F.col(n)) <= F.ceil(3 * sketches.DISTINCT_ERROR * F.col(n))).alias(f"{estimate}_near")

    return joined.select(
        "tenant_id", "category", "events", "n_customers", "n_products", near("customers", "n_customers"), near("products", "n_products")
    )


@query
def distinct_counts_sketched(spark, sf_dir):
    """Exact distinct counts of every customer, and whether the approximate ones are within three standard errors."""
    events, products = tb.events(spark, sf_dir), tb.products(spark, sf_dir)
    about = feat.distinct_counts(events, products, approximate=True).withColumnsRenamed(
        {"distinct_products_viewed": "products", "distinct_categories_viewed": "categories"}
    )
    exact = F.col("distinct_products_viewed")
    near = F.abs(F.col("products") - exact) <= F.ceil(3 * sketches.DISTINCT_ERROR * exact)
    return feat.distinct_counts(events, products).join(about, CUSTOMER).select(
        *CUSTOMER, "distinct_products_viewed", "distinct_categories_viewed", near.alias("products_near"),
        (F.col("categories") == F.col("distinct_categories_viewed")).alias("categories_equal"),
    )


@query
def quantiles_sketched(spark, sf_dir):
    """Requests of two weeks, and whether quantiles from merged daily sketches lie within the rank error."""
    log = tb.latency_log(spark, sf_dir, with_time=True)
    daily = materialize(sketches.daily_quantiles(log), "sketches")
    about = sketches.quantiles_between(daily, [0.5, 0.9, 0.95, 0.99], "2024-01-08", "2024-01-21")
    some = log.filter("created_at >= timestamp '2024-01-08' AND created_at < timestamp '2024-01-22'")
    ranks = some.join(about, ["tenant_id", "surface"]).groupBy("tenant_id", "surface", "share").agg(
        F.any_value("requests").alias("requests"), F.count("*").alias("n"),
        F.count_if(F.col("latency_ms") < F.col("value")).alias("below"), F.count_if(F.col("latency_ms") <= F.col("value")).alias("upto"),
    )
    # Twice the stated error, which holds with a chance of 99 percent, and one place for its rounding.
    slack = 2 * sketches.RANK_ERROR * F.col("n") + 1
    goal = F.col("share") * F.col("n")
    return ranks.select(
        "tenant_id", "surface", "share", F.col("n").alias("requests"), (F.col("requests") == F.col("n")).alias("all_counted"),
        ((F.col("below") - slack <= goal) & (F.col("upto") + slack >= goal)).alias("near"),
    )


# ---- increments, upserts, checkpoints


@query
def new_event_bounds(spark, sf_dir):
    seen = inc.read_checkpoints(checkpoints(spark, sf_dir))
    return inc.new_event_bounds(tb.events(spark, sf_dir), seen)


@query
def affected_customers(spark, sf_dir):
    events = tb.events(spark, sf_dir)
    seen = inc.read_checkpoints(checkpoints(spark, sf_dir))
    return inc.affected_customers(events, seen, inc.new_event_bounds(events, seen))


@query
def advanced_checkpoints(spark, sf_dir):
    held = checkpoints(spark, sf_dir)
    bounds = inc.new_event_bounds(tb.events(spark, sf_dir), inc.read_checkpoints(held))
    return inc.advance_checkpoints(held, bounds, AS_OF)


@query
def upserted_counts(spark, sf_dir):
    """Stored counts of the first 20 days, replaced by full counts for later customers."""
    events = tb.events(spark, sf_dir)
    layout = (
        "tenant_id STRING, customer_id STRING, total_views BIGINT, total_cart_adds BIGINT,"
        " total_purchases BIGINT"
    )
    root = new_folder(spark, "counts")
    tables.publish(
        feat.activity_counts(events.filter("timestamp < timestamp '2024-01-21'")), root
    )
    late = events.filter("timestamp >= timestamp '2024-01-21'").select(*CUSTOMER).distinct()
    updates = feat.activity_counts(events).join(late, CUSTOMER, "left_semi")
    tables.upsert_table(updates, root, CUSTOMER, layout)
    return tables.current(spark, root, layout)


@query
def looked_up_counts(spark, sf_dir):
    """Stored counts of the customers that bought on the last day, from the cells that hold them."""
    events = tb.events(spark, sf_dir)
    layout = (
        "tenant_id STRING, customer_id STRING, total_views BIGINT, total_cart_adds BIGINT,"
        " total_purchases BIGINT"
    )
    root, by = new_folder(spark, "counts"), ["tenant_id"]
    cells.upsert(feat.activity_counts(events.filter("timestamp < timestamp '2024-01-21'")), root, CUSTOMER, layout, by)
    changed = events.filter("tenant_id = 't1' AND timestamp >= timestamp '2024-01-21'").select(*CUSTOMER).distinct()
    updates = feat.activity_counts(events).join(changed, CUSTOMER, "left_semi")
    cells.upsert(updates, root, CUSTOMER, layout, by)
    wanted = events.filter("event_type = 'purchase' AND timestamp >= timestamp '2024-01-29'")
    return cells.lookup(wanted, root, CUSTOMER, layout, by)


def _increment(spark, sf_dir):
    events, products = tb.events(spark, sf_dir), tb.products(spark, sf_dir)
    held = materialize(checkpoints(spark, sf_dir), "checkpoints")
    old = events.join(inc.read_checkpoints(held), "tenant_id").filter(
        F.col("timestamp") <= F.col("last_event_ts")
    ).drop("last_event_ts")
    stored = materialize(customer_features(old, products, "2024-01-21"), "features")
    return incremental_features(events, products, stored, held, AS_OF)


@query
def incremental_feature_rows(spark, sf_dir):
    return flat_features(_increment(spark, sf_dir).features)


@query
def incremental_report(spark, sf_dir):
    return _increment(spark, sf_dir).report


def stored_state(spark, sf_dir):
    """State and features of the events up to the checkpoints; (new events, products, both roots)."""
    events, products = tb.events(spark, sf_dir), tb.products(spark, sf_dir)
    held = materialize(inc.read_checkpoints(checkpoints(spark, sf_dir)), "checkpoints")
    roots = new_folder(spark, "state"), new_folder(spark, "features")
    old = events.join(held, "tenant_id").filter(F.col("timestamp") <= F.col("last_event_ts")).drop("last_event_ts")
    state.add_events(old, products, *roots, "2024-01-21", "history")
    return inc.new_events(events, held).drop("last_event_ts"), products, roots


@query
def merged_feature_rows(spark, sf_dir):
    """The rows of ``incremental_feature_rows``, from stored state to which only new events are added."""
    new, products, roots = stored_state(spark, sf_dir)
    state.add_events(new, products, *roots, AS_OF, "new")
    stored = tables.current(spark, roots[1], CUSTOMER_FEATURES)
    late = stored.select(*CUSTOMER).join(new.select(*CUSTOMER).distinct(), CUSTOMER, "left_semi")
    kept = stored.join(late, CUSTOMER, "left_anti").withColumn("updated_at", F.lit("2024-01-21").cast("timestamp"))
    return flat_features(kept.unionByName(stored.join(late, CUSTOMER, "left_semi")))


@query
def state_features(spark, sf_dir):
    """All features from a state that got its events in three batches out of order, one of them twice, and was compacted."""
    events, products = tb.events(spark, sf_dir), tb.products(spark, sf_dir)
    roots = new_folder(spark, "state"), new_folder(spark, "features")
    for part in (2, 0, 1, 0):
        batch = events.filter(F.crc32(F.col("id").cast("binary")) % 3 == part)
        state.add_events(batch, products, *roots, AS_OF, f"part {part}")
    state.compact_state(spark, roots[0], most=2)
    return flat_features(state.features_of(cells.read(spark, roots[0], state.STATE), products, AS_OF))


@query
def copartitioned_features(spark, sf_dir):
    """All features from state stored in buckets by customer: read, grouped and joined without a shuffle by customer."""
    events, products = tb.events(spark, sf_dir), tb.products(spark, sf_dir)
    path = new_folder(spark, "bucketed")
    name = f"state_{uuid4().hex}"
    held = bucketed.write_bucketed(state.folded(events), name, path, 16, sort_by=["slot"])
    return flat_features(state.features_of(held, products, AS_OF))


# ---- co-occurrence


@query
def product_support(spark, sf_dir):
    return co.product_support(tb.events(spark, sf_dir))


@query
def candidate_pairs(spark, sf_dir):
    return co.candidate_pairs(tb.events(spark, sf_dir))


@query
def pair_counts(spark, sf_dir):
    return co.pair_counts(co.candidate_pairs(tb.events(spark, sf_dir)))


@query
def cooccurrence(spark, sf_dir):
    return pairs_at(spark, sf_dir)


@query
def cooccurrence_wide_path(spark, sf_dir):
    """The same rules with most customers treated as wide."""
    return co.cooccurrence(tb.events(spark, sf_dir), AS_OF, wide=2, chunk=2)


@query
def replaced_tenants(spark, sf_dir):
    """All pairs stored; then t0 and t2 refreshed after t0 lost its clicks of product 3 and t2 all events."""
    events = tb.events(spark, sf_dir)
    path = new_folder(spark, "pairs")
    refresh_cooccurrence(events, tb.tenants(spark, sf_dir).select(F.col("id").alias("tenant_id")), path, AS_OF)
    left = events.filter("tenant_id <> 't2' AND NOT (tenant_id = 't0' AND product_id <=> '3')")
    changed = spark.createDataFrame([("t0",), ("t2",)], "tenant_id STRING")
    refresh_cooccurrence(left, changed, path, AS_OF)
    return tables.current(spark, path, COOCCURRENCE).select(
        "tenant_id", "product_a_id", "product_b_id", "co_count", "confidence"
    )


@query
def related_products(spark, sf_dir):
    return co.related_products(pairs_at(spark, sf_dir), 10)


@query
def related_for_anchors(spark, sf_dir):
    anchors = cand.recent_anchors(tb.events(spark, sf_dir), AS_OF)
    return co.related_for_anchors(
        anchors.select(*CUSTOMER, "product_id"), pairs_at(spark, sf_dir)
    )


@query
def related_for_anchors_top3(spark, sf_dir):
    anchors = cand.recent_anchors(tb.events(spark, sf_dir), AS_OF)
    return co.related_for_anchors(
        anchors.select(*CUSTOMER, "product_id"), pairs_at(spark, sf_dir), k=3
    )


# ---- recommendation


@query
def recent_anchors(spark, sf_dir):
    return cand.recent_anchors(tb.events(spark, sf_dir), AS_OF)


@query
def affinity_candidates(spark, sf_dir):
    return cand.affinity_candidates(features_at(spark, sf_dir), tb.products(spark, sf_dir))


@query
def popularity(spark, sf_dir):
    return cand.popularity(tb.events(spark, sf_dir), tb.products(spark, sf_dir), AS_OF, 50)


@query
def feature_lookup(spark, sf_dir):
    found = req.feature_lookup(tb.requests(spark, sf_dir), features_at(spark, sf_dir))
    return found.select(
        *CUSTOMER, "surface", "limit", F.col("total_views").cast("double").alias("total_views"),
        F.col("total_purchases").cast("double").alias("total_purchases"),
        "avg_days_between_purchases", "avg_session_duration_seconds",
        "avg_products_viewed_per_session", cents("total_revenue"), cents("avg_order_value"),
    )


def _related(spark, sf_dir, asked):
    anchors = cand.recent_anchors(tb.events(spark, sf_dir), AS_OF).select(*CUSTOMER, "product_id")
    rows = asked.select(*CUSTOMER, "request_id").join(anchors, CUSTOMER)
    return co.related_for_anchors(rows, materialize(pairs_at(spark, sf_dir), "pairs"))


@query
def excluded_products(spark, sf_dir):
    asked = tb.requests(spark, sf_dir, exclude=True)
    kept = req.exclude_products(_related(spark, sf_dir, asked), asked)
    return kept.select(*CUSTOMER, "anchor_product_id", "product_id", "confidence")


@query
def blended_candidates(spark, sf_dir):
    asked = materialize(tb.requests(spark, sf_dir), "requests")
    known = req.feature_lookup(asked, features_at(spark, sf_dir))
    affinity = cand.affinity_candidates(
        known, tb.products(spark, sf_dir), keys=req.REQUEST
    )
    return cand.blend_candidates(affinity, _related(spark, sf_dir, asked))


def _recommend(spark, sf_dir, exclude):
    return recommend(
        materialize(tb.requests(spark, sf_dir, exclude=exclude), "requests"),
        tb.events(spark, sf_dir),
        tb.products(spark, sf_dir),
        materialize(features_at(spark, sf_dir), "features"),
        materialize(pairs_at(spark, sf_dir), "pairs"),
        AS_OF,
    )


@query
def recommendations(spark, sf_dir):
    return _recommend(spark, sf_dir, exclude=False)


@query
def recommendations_with_exclusions(spark, sf_dir):
    return _recommend(spark, sf_dir, exclude=True)


@query
def popularity_fallback(spark, sf_dir):
    """Every request answered from popularity, as if no candidate had been found."""
    asked = tb.requests(spark, sf_dir, exclude=True)
    popular = cand.popularity(tb.events(spark, sf_dir), tb.products(spark, sf_dir), AS_OF, 150)
    none = asked.filter(F.lit(False))
    return cand.rank_candidates(cand.popularity_fallback(asked, none, popular), asked)


def _decisions(spark, sf_dir):
    asked = materialize(tb.requests(spark, sf_dir), "requests")
    recs = _recommend(spark, sf_dir, exclude=False)
    return dec.log_decisions(recs, asked, AS_OF, latency_ms=F.lit(0.0))


@query
def decision_log(spark, sf_dir):
    path = new_folder(spark, "decisions")
    for _ in range(2):  # a retry adds nothing
        dec.append_decisions(_decisions(spark, sf_dir), path)
    log = spark.read.schema(f"{DECISIONS}, log_date DATE").parquet(path)
    ids = F.transform("response_items", lambda i: i["product_id"])
    return log.select(
        *CUSTOMER, "surface", "model_version",
        F.size("response_items").cast("bigint").alias("items"),
        F.array_join(ids, ",").alias("products"),
        "created_at",
    )


@query
def latency_summary(spark, sf_dir):
    return dec.latency_summary(tb.latency_log(spark, sf_dir))


@query
def fallback_report(spark, sf_dir):
    return dec.fallback_report(_recommend(spark, sf_dir, exclude=True))


@query
def precomputed_recommendations(spark, sf_dir):
    events, products = tb.events(spark, sf_dir), tb.products(spark, sf_dir)
    features = materialize(customer_features(events, products, tb.LAST_DAY), "features")
    pairs = materialize(co.cooccurrence(events, tb.LAST_DAY), "pairs")
    return precompute_recommendations(events, products, features, pairs, tb.LAST_DAY)


@query
def invalidated_recommendations(spark, sf_dir):
    """Stored lists that survive an update of every product of size 1."""
    updated = (
        spark.read.parquet(f"{sf_dir}/part.parquet").filter("p_size = 1")
        .select(F.col("p_partkey").cast("string").alias("id"))
        .join(tb.products(spark, sf_dir), "id")
    )
    root = new_folder(spark, "lists")
    recs = materialize(_recommend(spark, sf_dir, exclude=False), "recs")
    store_recommendations(recs.filter("tenant_id <> 't0'"), root)
    store_recommendations(recs, root)
    invalidate_stored(spark, root, updated)
    return tables.current(spark, root, STORED)


@query
def invalidated_by_index(spark, sf_dir):
    """The same survivors, found through the index from products to lists."""
    updated = (
        spark.read.parquet(f"{sf_dir}/part.parquet").filter("p_size = 1")
        .select(F.col("p_partkey").cast("string").alias("id"))
        .join(tb.products(spark, sf_dir), "id")
    )
    roots = new_folder(spark, "lists"), new_folder(spark, "list-index")
    recs = materialize(_recommend(spark, sf_dir, exclude=False), "recs")
    stored_lists.store_lists(recs.filter("tenant_id <> 't0'"), *roots)
    stored_lists.store_lists(recs, *roots)
    stored_lists.compact_index(spark, roots[1], most=1)
    stored_lists.drop_lists_naming(spark, updated, *roots)
    return cells.read(spark, roots[0], STORED)


# ---- reports, experiments, quality


@query
def daily_activity(spark, sf_dir):
    return reports.daily_activity(tb.events(spark, sf_dir))


@query
def last_5m_features(spark, sf_dir):
    return reports.last_5m_features(tb.events(spark, sf_dir), "2024-01-15 12:00:00")


@query
def sliding_5m_features(spark, sf_dir):
    return reports.sliding_5m_features(tb.events(spark, sf_dir))


@query
def rolling_5m_features(spark, sf_dir):
    return reports.rolling_5m_features(tb.events(spark, sf_dir))


@query
def merged_features(spark, sf_dir):
    newest = reports.latest_5m_features(reports.sliding_5m_features(tb.events(spark, sf_dir)))
    merged = reports.merge_features(features_at(spark, sf_dir), newest)
    counts = ["last_5m_views", "last_5m_clicks", "last_5m_product_views"]
    return merged.select(
        *CUSTOMER, "total_views", "streaming.window_start",
        *(F.col(f"streaming.{c}").cast("double").alias(c) for c in counts),
    )


@query
def tenant_tiers(spark, sf_dir):
    return reports.tenant_tiers(tb.events(spark, sf_dir))


@query
def retained_events(spark, sf_dir):
    return reports.retained(tb.events(spark, sf_dir), AS_OF, days=20).select(*EVENT_COLUMNS)


@query
def storage_layers(spark, sf_dir):
    rows = reports.storage_layer(tb.events(spark, sf_dir), AS_OF, hot_days=30)
    return rows.groupBy("tenant_id", "layer").agg(F.count("*").alias("events"))


@query
def daily_snapshot(spark, sf_dir):
    """All features, kept for two days and read for the second."""
    path = new_folder(spark, "snapshots")
    rows = flat_features(features_at(spark, sf_dir)).drop("updated_at")
    reports.write_snapshot(rows.filter("tenant_id = 't0'"), path, "2024-02-04 00:00:00")
    reports.write_snapshot(rows, path, AS_OF)
    return reports.read_snapshot(spark, path, AS_OF)


@query
def rules_snapshot(spark, sf_dir):
    path = new_folder(spark, "snapshots")
    rows = pairs_at(spark, sf_dir)
    reports.write_snapshot(rows, path, AS_OF)
    kept = reports.read_snapshot(spark, path, AS_OF)
    return kept.select(
        "tenant_id", "product_a_id", "product_b_id", "co_count", "confidence", "snapshot_date"
    )


@query
def assigned_variants(spark, sf_dir):
    people = tb.events(spark, sf_dir).select(*CUSTOMER).distinct()
    return ab.assign_variant(people)


@query
def ab_results(spark, sf_dir):
    """Everybody is answered on 20 January; tenant t1 was on the 10th already."""
    asked = materialize(tb.requests(spark, sf_dir), "requests")
    popular = cand.popularity(tb.events(spark, sf_dir), tb.products(spark, sf_dir), AS_OF, 150)
    shown = cand.popularity_fallback(asked, asked.filter(F.lit(False)), popular)
    recs = materialize(cand.rank_candidates(shown, asked), "recs")
    path = new_folder(spark, "decisions")
    early = asked.filter("tenant_id = 't1'")
    dec.append_decisions(dec.log_decisions(recs, early, "2024-01-10 00:00:00"), path)
    dec.append_decisions(dec.log_decisions(recs, asked, "2024-01-20 00:00:00"), path)
    log = spark.read.schema(f"{DECISIONS}, log_date DATE").parquet(path)
    root = new_folder(spark, "ab")
    results = ab.ab_results(log, tb.events(spark, sf_dir))
    tables.publish(results, root)
    return tables.current(spark, root, results.schema)


def _gone(name: str, test: str, value: str = "NULL"):
    """The column with another value where the test holds."""
    return F.expr(f"if(coalesce({test}, false), {value}, {name})").alias(name)


def _repeated(rows: DataFrame, test: str) -> DataFrame:
    return rows.unionByName(rows.filter(test))


def faulty_tables(spark, sf_dir) -> dict[str, DataFrame]:
    """All eight tables, with faults planted by rules on their ids; the SQL counts them anew."""
    events = tb.events(spark, sf_dir)
    number = "cast(id AS bigint)"
    people = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.col("c_custkey").cast("string").alias("id"),
        F.expr("'t' || (c_custkey % 7)").alias("tenant_id"),
        F.expr("if(c_custkey % 50 = 9, 'shared@example.org', c_name)").alias("email"),
        F.expr("if(c_custkey % 30 = 4, NULL, 'x')").alias("password_hash"),
        F.col("c_name").alias("display_name"),
        F.expr("if(c_custkey % 25 = 6, 'boss', 'viewer')").alias("role"),
    )
    held = checkpoints(spark, sf_dir)
    decided = tb.requests(spark, sf_dir).select(
        "tenant_id", F.expr("nullif(customer_id, 'cold')").alias("customer_id"),
        F.expr("if(tenant_id = 't2', repeat('s', 101), surface)").alias("surface"),
        F.expr("if(customer_id = 'cold', 'one', request_id)").alias("decision_id"),
        F.lit(MODEL_VERSION).alias("model_version"),
    )
    rules = materialize(pairs_at(spark, sf_dir), "pairs")
    return {
        "tenant": _repeated(
            tb.tenants(spark, sf_dir).withColumn("name", _gone("name", "id = 't3'")), "id = 't1'"
        ),
        "user": people,
        "product": _repeated(
            tb.products(spark, sf_dir).withColumns({
                "category": _gone("category", f"{number} % 40 = 1"),
                "tenant_id": _gone("tenant_id", f"{number} % 40 = 5", "'t9'"),
            }),
            f"{number} % 50 = 3",
        ),
        "interactionevent": _repeated(
            events.withColumns({
                "customer_id": _gone("customer_id", f"{number} % 97 = 0"),
                "event_type": _gone("event_type", f"{number} % 101 = 0", "'jump'"),
            }),
            f"{number} % 500 = 7",
        ),
        "customer_features": _repeated(
            materialize(features_at(spark, sf_dir), "features").withColumn("total_revenue", _gone("total_revenue", "customer_id LIKE '%3'")),
            "customer_id LIKE '%7'",
        ),
        "pipeline_checkpoints": _repeated(
            held.withColumn("pipeline_name", _gone("pipeline_name", "tenant_id = 't1'", "repeat('p', 101)")),
            "tenant_id = 't0'",
        ),
        "product_cooccurrence": _repeated(
            rules.withColumns({
                "co_count": _gone("co_count", "product_a_id LIKE '%1'", "2"),
                "confidence": _gone("confidence", "product_b_id LIKE '%2'", "1.5D"),
            }),
            "product_a_id LIKE '%4'",
        ),
        "recommendation_decisions": decided,
    }


@query
def integrity_report(spark, sf_dir):
    return quality.integrity_report(
        faulty_tables(spark, sf_dir), partitions=[("2024-01-01", "2024-01-16")]
    )


@query
def checked_requests(spark, sf_dir):
    """Requests whose limit is the customer's event count, split by the allowed range."""
    asked = (
        tb.events(spark, sf_dir)
        .groupBy(*CUSTOMER)
        .agg(F.count("*").cast("int").alias("limit"))
        .select(
            F.concat_ws("/", *CUSTOMER).alias("request_id"), *CUSTOMER,
            F.lit("home").alias("surface"),
            F.when(F.col("limit") > 22, F.col("limit") + 20).alias("limit"),
            F.lit(None).cast("array<string>").alias("exclude_product_ids"),
        )
    )
    valid, invalid = req.check_requests(asked)
    columns = [*CUSTOMER, "limit"]
    return valid.select(*columns, F.lit(True).alias("valid")).unionByName(
        invalid.select(*columns, F.lit(False).alias("valid"))
    )


# ---- streams, run to the end of the files


@query
def stream_ingested_events(spark, sf_dir):
    stream.configure_streaming(spark)
    path = new_folder(spark, "stream-lake")
    stream.start_ingest(
        tb.event_stream(spark, sf_dir), path, f"{path}-checkpoint"
    ).awaitTermination()
    return lake.read_events(spark, path).select(*EVENT_COLUMNS)


@query
def stream_deduplicated_events(spark, sf_dir):
    """Every event sent twice arrives once."""
    stream.configure_streaming(spark)
    path = new_folder(spark, "stream-dedup")
    twice = tb.event_stream(spark, sf_dir).unionByName(tb.event_stream(spark, sf_dir))
    stream.start_append(
        stream.deduplicate_stream(twice), path, f"{path}-checkpoint"
    ).awaitTermination()
    return spark.read.parquet(path).select(*EVENT_COLUMNS)


def _upserted(spark, rows, name, keys):
    path = new_folder(spark, name)
    stream.start_upserts(rows, path, f"{path}-checkpoint").awaitTermination()
    return stream.latest_upserts(spark, path, keys)


@query
def stream_5m_features(spark, sf_dir):
    stream.configure_streaming(spark)
    rows = stream.stream_5m_features(tb.event_stream(spark, sf_dir))
    return _upserted(spark, rows, "stream-5m", [*CUSTOMER, "window_start"])


@query
def stream_merged_features(spark, sf_dir):
    """The rows of ``merged_features`` from a stream that joins the stored features at every batch."""
    stream.configure_streaming(spark)
    root, path = new_folder(spark, "features"), new_folder(spark, "stream-merged")
    tables.upsert_table(features_at(spark, sf_dir), root, CUSTOMER, CUSTOMER_FEATURES, ["tenant_id"])
    counts = stream.stream_5m_features(tb.event_stream(spark, sf_dir))
    merged_stream.start_merged_features(counts, root, path, f"{path}-checkpoint").awaitTermination()
    names = ["last_5m_views", "last_5m_clicks", "last_5m_product_views"]
    return merged_stream.latest_merged(spark, path, ["total_views", "streaming"]).select(
        *CUSTOMER, "total_views", "streaming.window_start",
        *(F.col(f"streaming.{c}").cast("double").alias(c) for c in names),
    )


@query
def stream_log_ingest(spark, sf_dir):
    """Events written to the log in two halves, each read in bounded batches by a stream that is then restarted."""
    log, out = new_folder(spark, "log"), new_folder(spark, "log-lake")
    for half in (0, 1):
        events = tb.events(spark, sf_dir).filter(F.crc32(F.col("id").cast("binary")) % 2 == half)
        event_log.append(event_log.event_records(events), log)
        records = event_log.log_records(spark, log, f"{out}-progress/at.json", most=max(500, events.count() // 20))
        query = stream.start_ingest(decode_messages(records), out, f"{out}-checkpoint", interval="0 seconds")
        query.processAllAvailable()
        query.stop()
    return lake.read_events(spark, out).select(*EVENT_COLUMNS)


@query
def stream_rolling_5m(spark, sf_dir):
    """Per-event counts from keyed state; those of slots still open at the end by the batch pass."""
    stream.configure_streaming(spark)
    path = new_folder(spark, "stream-rolling")
    stream.start_append(
        rolling.stream_rolling_5m(tb.event_stream(spark, sf_dir)), path, f"{path}-checkpoint"
    ).awaitTermination()
    emitted = spark.read.parquet(path)
    return emitted.unionByName(rolling.rolling_left(tb.events(spark, sf_dir), emitted))


@query
def stream_daily_activity(spark, sf_dir):
    stream.configure_streaming(spark)
    rows = stream.stream_daily_activity(tb.event_stream(spark, sf_dir))
    return _upserted(spark, rows, "stream-days", ["tenant_id", "day"])


@query
def stream_sessions(spark, sf_dir):
    stream.configure_streaming(spark)
    path = new_folder(spark, "stream-sessions")
    stream.start_append(
        stream.stream_sessions(tb.event_stream(spark, sf_dir)), path, f"{path}-checkpoint"
    ).awaitTermination()
    emitted = spark.read.parquet(path)
    return emitted.unionByName(stream.sessions_left(tb.events(spark, sf_dir), emitted))
