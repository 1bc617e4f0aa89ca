"""Table schemas as DDL. Ids are strings everywhere and the natural key is the key."""

from __future__ import annotations

TENANT = ["tenant_id"]
# Customer first: it tells rows apart sooner when sorting.
CUSTOMER = ["customer_id", "tenant_id"]
PAIR = ["tenant_id", "product_a_id", "product_b_id"]

# Names and limits that results and stored rows depend on.
EVENT_TYPES = ("page_view", "product_view", "add_to_cart", "purchase", "click", "dismiss")
VIEW_TYPES = ("page_view", "product_view")
AFFINITY_TYPES = ("page_view", "product_view", "add_to_cart", "purchase")
ANCHOR_TYPES = ("product_view", "add_to_cart", "purchase")
POPULARITY_TYPES = ("product_view", "purchase")
USER_ROLES = ("admin", "power_user", "operator", "viewer")
FEATURE_JOB = "customer_features_v1"
MODEL_VERSION = "v1-blended-heuristic"
MAX_BATCH_EVENTS = 1000
DEFAULT_LIMIT = 8
MAX_LIMIT = 50
MAX_CUSTOMER_ID = 200
MAX_SURFACE = 100
MIN_PAIR_SUPPORT = 3
CATEGORY_WEIGHT = 0.6
COOCCURRENCE_WEIGHT = 0.4


TENANTS = "id STRING, name STRING, slug STRING, plan_tier STRING, created_at TIMESTAMP"

USERS = (
    "id STRING, tenant_id STRING, email STRING, password_hash STRING, display_name STRING,"
    " role STRING, created_at TIMESTAMP"
)

PRODUCTS = (
    "id STRING, tenant_id STRING, external_id STRING, title STRING, description STRING,"
    " price DOUBLE, currency STRING, category STRING, tags ARRAY<STRING>, metadata STRING,"
    " active BOOLEAN, created_at TIMESTAMP"
)

EVENTS = (
    "id STRING, tenant_id STRING, customer_id STRING, event_type STRING, product_id STRING,"
    " properties STRING, timestamp TIMESTAMP"
)

CUSTOMER_FEATURES = (
    "tenant_id STRING, customer_id STRING, total_views INT, total_cart_adds INT,"
    " total_purchases INT, distinct_products_viewed INT, distinct_categories_viewed INT,"
    " days_since_first_seen INT, days_since_last_activity INT,"
    " category_affinity MAP<STRING, DOUBLE>, avg_days_between_purchases DOUBLE,"
    " total_revenue DECIMAL(12,2), avg_order_value DECIMAL(12,2),"
    " avg_session_duration_seconds DOUBLE, avg_products_viewed_per_session DOUBLE,"
    " updated_at TIMESTAMP"
)

CHECKPOINTS = (
    "tenant_id STRING, pipeline_name STRING, last_event_ts TIMESTAMP, updated_at TIMESTAMP"
)

COOCCURRENCE = (
    "tenant_id STRING, product_a_id STRING, product_b_id STRING, co_count INT,"
    " confidence DOUBLE, last_updated TIMESTAMP"
)

REQUESTS = (
    "request_id STRING, tenant_id STRING, customer_id STRING, surface STRING, limit INT,"
    " exclude_product_ids ARRAY<STRING>"
)

DECISIONS = (
    "tenant_id STRING, customer_id STRING, surface STRING, decision_id STRING,"
    " model_version STRING,"
    " response_items ARRAY<STRUCT<product_id: STRING, score: DOUBLE, reason: STRING>>,"
    " latency_ms DOUBLE, created_at TIMESTAMP"
)

RAW_BATCHES = "batch_id STRING, tenant_id STRING, body STRING"
