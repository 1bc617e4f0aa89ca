"""ANSI SQL for the same results, straight from the definitions: no bucketing, no pruning.

Fragments are chained as common table expressions. ``EV`` and ``PR`` bind the generated
tables (FIXTURES.md, section 3).
"""

from __future__ import annotations

AS_OF = "TIMESTAMP '2024-02-05 00:00:00'"
LAST_DAY = "TIMESTAMP '2024-01-31 00:00:00'"

EV = """raw AS (
  SELECT *, event_id % 3 AS t, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k
  FROM events),
ev AS (
  SELECT CAST(event_id AS VARCHAR) AS id, 't' || t AS tenant_id, 'c' || user_id AS customer_id,
    CASE event_type WHEN 'view' THEN 'product_view' WHEN 'signup' THEN 'page_view'
      WHEN 'error' THEN 'dismiss' WHEN 'purchase' THEN 'purchase'
      ELSE CASE WHEN k % 2 = 0 THEN 'click' ELSE 'add_to_cart' END END AS event_type,
    CASE WHEN event_type IN ('signup', 'error') THEN NULL
      WHEN k % 40 = 39 THEN CAST((k % 40) * 3 + (t + 1) % 3 AS VARCHAR)
      ELSE CAST((k % 40) * 3 + t AS VARCHAR) END AS product_id,
    CASE WHEN event_type = 'purchase' AND k % 10 <> 0
      THEN CAST(round(value * 100) AS BIGINT) ELSE 0 END AS cents,
    ts, event_id
  FROM raw)"""

PR = """pr AS (
  SELECT CAST(p_partkey AS VARCHAR) AS id, 't' || (p_partkey % 3) AS tenant_id,
    p_type AS category, p_size % 5 <> 0 AS active, p_size FROM part)"""

ENR = """enr AS (
  SELECT ev.*, pr.category FROM ev LEFT JOIN pr
    ON pr.id = ev.product_id AND pr.tenant_id = ev.tenant_id)"""


def features(src: str, as_of: str, p: str = "") -> str:
    """Feature CTEs over ``src`` (shaped like ``enr``); the row CTE is ``{p}feat``."""
    return f"""{p}agg AS (
  SELECT tenant_id, customer_id,
    count(*) FILTER (WHERE event_type IN ('page_view', 'product_view')) AS total_views,
    count(*) FILTER (WHERE event_type = 'add_to_cart') AS total_cart_adds,
    count(*) FILTER (WHERE event_type = 'purchase') AS total_purchases,
    count(DISTINCT product_id) AS distinct_products_viewed,
    count(DISTINCT category) AS distinct_categories_viewed,
    CAST(CAST({as_of} AS DATE) - min(CAST(ts AS DATE)) AS INTEGER) AS days_since_first_seen,
    CAST(CAST({as_of} AS DATE) - max(CAST(ts AS DATE)) AS INTEGER) AS days_since_last_activity
  FROM {src} GROUP BY 1, 2),
{p}aff AS (
  SELECT tenant_id, customer_id, category,
    CAST(sum(CASE WHEN ts >= {as_of} - INTERVAL 7 DAY THEN 3
      WHEN ts >= {as_of} - INTERVAL 30 DAY THEN 1 ELSE 0 END) AS DOUBLE) AS affinity_score
  FROM {src}
  WHERE category IS NOT NULL
    AND event_type IN ('page_view', 'product_view', 'add_to_cart', 'purchase')
  GROUP BY 1, 2, 3),
{p}buy AS (
  SELECT tenant_id, customer_id,
    CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS DOUBLE) / nullif(count(*) - 1, 0)
      / 86400000000.0::DOUBLE AS avg_days_between_purchases,
    CAST(sum(cents) AS DOUBLE) AS total_revenue_cents,
    CAST((2 * sum(CASE WHEN cents > 0 THEN cents END) + count(*) FILTER (WHERE cents > 0))
      // (2 * nullif(count(*) FILTER (WHERE cents > 0), 0)) AS DOUBLE) AS avg_order_value_cents
  FROM {src} WHERE event_type = 'purchase' GROUP BY 1, 2),
{p}opening AS (
  SELECT DISTINCT tenant_id, customer_id, ts AS opened FROM {src} e
  WHERE NOT EXISTS (SELECT 1 FROM {src} o WHERE o.tenant_id = e.tenant_id
    AND o.customer_id = e.customer_id AND o.ts < e.ts AND o.ts >= e.ts - INTERVAL 30 MINUTE)),
{p}num AS (
  SELECT e.*, (SELECT count(*) FROM {p}opening s WHERE s.tenant_id = e.tenant_id
      AND s.customer_id = e.customer_id AND s.opened <= e.ts) AS session_num
  FROM {src} e),
{p}win AS (
  SELECT tenant_id, customer_id, session_num, min(ts) AS session_start, max(ts) AS session_end,
    count(*) AS events, count(product_id) AS product_events
  FROM {p}num GROUP BY 1, 2, 3),
{p}ses AS (
  SELECT tenant_id, customer_id,
    CAST(sum(epoch_us(session_end) - epoch_us(session_start)) AS DOUBLE) / count(*)
      / 1000000.0::DOUBLE AS avg_session_duration_seconds,
    CAST(sum(product_events) AS DOUBLE) / count(*) AS avg_products_viewed_per_session
  FROM {p}win GROUP BY 1, 2),
{p}affsum AS (
  SELECT tenant_id, customer_id, count(*) AS categories, sum(affinity_score) AS affinity_total
  FROM {p}aff GROUP BY 1, 2),
{p}feat AS (
  SELECT a.*, buy.avg_days_between_purchases, avg_session_duration_seconds,
    avg_products_viewed_per_session, coalesce(categories, 0) AS categories,
    coalesce(affinity_total, 0.0::DOUBLE) AS affinity_total,
    coalesce(total_revenue_cents, 0.0::DOUBLE) AS total_revenue_cents, avg_order_value_cents
  FROM {p}agg a LEFT JOIN {p}affsum USING (tenant_id, customer_id)
    LEFT JOIN {p}buy buy USING (tenant_id, customer_id)
    LEFT JOIN {p}ses USING (tenant_id, customer_id))"""


FEATURE_COLUMNS = """tenant_id, customer_id,
  CAST(total_views AS INTEGER) AS total_views, CAST(total_cart_adds AS INTEGER) AS total_cart_adds,
  CAST(total_purchases AS INTEGER) AS total_purchases,
  CAST(distinct_products_viewed AS INTEGER) AS distinct_products_viewed,
  CAST(distinct_categories_viewed AS INTEGER) AS distinct_categories_viewed,
  days_since_first_seen, days_since_last_activity, avg_days_between_purchases,
  avg_session_duration_seconds, avg_products_viewed_per_session, categories, affinity_total,
  total_revenue_cents, avg_order_value_cents"""


def pairs(src: str = "ev", p: str = "") -> str:
    """Co-occurrence CTEs; the rule CTE is ``{p}cooc``.

    A buyer has one row per product with all times, and two products pair if some time of one
    is followed by some time of the other soon enough.
    """
    return f"""{p}bought AS (
  SELECT tenant_id, customer_id, product_id, list(ts) AS times FROM {src}
  WHERE event_type = 'purchase' AND product_id IS NOT NULL GROUP BY ALL),
{p}support AS (
  SELECT tenant_id, product_id, count(*) AS customer_support FROM {p}bought GROUP BY ALL),
{p}cpairs AS (
  SELECT f.tenant_id, f.customer_id, f.product_id AS product_a_id, g.product_id AS product_b_id
  FROM {p}bought f, {p}bought g
  WHERE (f.tenant_id, f.customer_id) = (g.tenant_id, g.customer_id) AND f.product_id <> g.product_id
    AND list_bool_or(list_transform(f.times, lambda x: list_bool_or(list_transform(g.times,
      lambda y: y BETWEEN x AND x + INTERVAL 30 DAY))))),
{p}pcounts AS (
  SELECT tenant_id, product_a_id, product_b_id, count(*) AS co_count
  FROM {p}cpairs GROUP BY ALL HAVING co_count >= 3),
{p}cooc AS (
  SELECT c.tenant_id, product_a_id, product_b_id, CAST(co_count AS INTEGER) AS co_count,
    CAST(co_count AS DOUBLE) / CAST(customer_support AS DOUBLE) AS confidence
  FROM {p}pcounts c JOIN {p}support s
    ON s.tenant_id = c.tenant_id AND s.product_id = c.product_a_id)"""


def reqs(exclude: bool) -> str:
    low = "CAST(pr.id AS BIGINT) < 30" if exclude else "FALSE"
    return f"""people AS (SELECT DISTINCT tenant_id, customer_id FROM ev),
asked AS (
  SELECT tenant_id || '/' || customer_id AS request_id, tenant_id, customer_id,
    'home' AS surface, 8 AS "limit"
  FROM (SELECT * FROM people UNION ALL
    SELECT DISTINCT tenant_id, 'cold' AS customer_id FROM people)),
excl AS (SELECT tenant_id, id AS product_id FROM pr WHERE {low})"""


def anchors(as_of: str) -> str:
    return f"""seen AS (
  SELECT tenant_id, customer_id, product_id, max(ts) AS last_seen FROM ev
  WHERE product_id IS NOT NULL AND event_type IN ('product_view', 'add_to_cart', 'purchase')
    AND ts >= {as_of} - INTERVAL 30 DAY
  GROUP BY 1, 2, 3),
anchor AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY tenant_id, customer_id
      ORDER BY last_seen DESC, product_id) AS INTEGER) AS rank
  FROM seen QUALIFY rank <= 5)"""


AFFINE = """affine AS (
  SELECT aff.tenant_id, aff.customer_id, pr.id AS product_id, max(affinity_score) AS category_score,
    CAST(row_number() OVER (PARTITION BY aff.tenant_id, aff.customer_id
      ORDER BY max(affinity_score) DESC, pr.id) AS INTEGER) AS rank
  FROM aff JOIN pr ON pr.tenant_id = aff.tenant_id AND pr.category = aff.category
  WHERE pr.active GROUP BY 1, 2, 3 QUALIFY rank <= 100)"""

RELATED = """related AS (
  SELECT a.tenant_id, a.customer_id, a.product_id AS anchor_product_id,
    c.product_b_id AS product_id, c.confidence, c.co_count
  FROM anchor a JOIN cooc c ON c.tenant_id = a.tenant_id AND c.product_a_id = a.product_id)"""


def popular(as_of: str) -> str:
    return f"""pop AS (
  SELECT e.tenant_id, e.product_id,
    count(*) FILTER (WHERE event_type = 'product_view') * 1.0::DOUBLE
      + count(*) FILTER (WHERE event_type = 'purchase') * 5.0::DOUBLE AS score
  FROM ev e JOIN pr ON pr.id = e.product_id AND pr.tenant_id = e.tenant_id
  WHERE event_type IN ('product_view', 'purchase') AND ts >= {as_of} - INTERVAL 30 DAY
    AND pr.active
  GROUP BY 1, 2),
popr AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY tenant_id ORDER BY score DESC, product_id)
    AS INTEGER) AS rank FROM pop)"""


BLEND = """both_sides AS (
  SELECT tenant_id, customer_id, product_id, category_score, NULL::DOUBLE AS confidence
  FROM affine
  UNION ALL
  SELECT tenant_id, customer_id, product_id, NULL, confidence FROM related),
blend AS (
  SELECT tenant_id, customer_id, product_id,
    coalesce(max(category_score), 0.0::DOUBLE) AS category_score,
    coalesce(max(confidence), 0.0::DOUBLE) AS cooccurrence_score,
    CASE WHEN max(category_score) IS NULL THEN 'cooccurrence'
      WHEN max(category_score) > 0 AND max(confidence) IS NOT NULL THEN 'blended'
      ELSE 'category_affinity' END AS reason
  FROM both_sides GROUP BY 1, 2, 3)"""

RECS = """kept AS (
  SELECT b.* FROM blend b JOIN asked USING (tenant_id, customer_id)
  WHERE NOT EXISTS (SELECT 1 FROM excl x
    WHERE x.tenant_id = b.tenant_id AND x.product_id = b.product_id)),
scored AS (
  SELECT tenant_id, customer_id, product_id, reason,
    round(0.6::DOUBLE * category_score + 0.4::DOUBLE * cooccurrence_score, 4) AS score
  FROM kept
  UNION ALL
  SELECT a.tenant_id, a.customer_id, p.product_id, 'global_popularity', round(p.score, 4)
  FROM asked a JOIN popr p ON p.tenant_id = a.tenant_id AND p.rank <= 3 * a."limit"
  WHERE NOT EXISTS (SELECT 1 FROM kept k
      WHERE k.tenant_id = a.tenant_id AND k.customer_id = a.customer_id)
    AND NOT EXISTS (SELECT 1 FROM excl x
      WHERE x.tenant_id = a.tenant_id AND x.product_id = p.product_id)),
recs AS (
  SELECT s.tenant_id, a.request_id, s.customer_id, a.surface,
    CAST(row_number() OVER (PARTITION BY s.tenant_id, s.customer_id
      ORDER BY s.score DESC, s.product_id) AS INTEGER) AS rank,
    s.product_id, s.score, s.reason
  FROM scored s JOIN asked a USING (tenant_id, customer_id)
  QUALIFY rank <= a."limit")"""


def full(as_of: str, exclude: bool) -> list[str]:
    return [EV, PR, ENR, features("enr", as_of), pairs(), reqs(exclude), anchors(as_of),
            AFFINE, RELATED, popular(as_of), BLEND, RECS]


def sql(parts: list[str], select: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select


FEATS = [EV, PR, ENR, features("enr", AS_OF)]
COOC = [EV, pairs()]
HELD = """held AS (
  SELECT tenant_id, date_trunc('day', min(ts)) + INTERVAL 20 DAY AS last_event_ts
  FROM ev WHERE tenant_id <> 't2' GROUP BY 1),
fresh AS (
  SELECT ev.* FROM ev LEFT JOIN held USING (tenant_id)
  WHERE last_event_ts IS NULL OR ts > last_event_ts),
bounds AS (
  SELECT tenant_id, max(ts) AS max_ts, count(*) AS new_events FROM fresh GROUP BY 1)"""

BODIES = """bodies AS (
  SELECT *, tenant_id || '-' || CAST(CASE WHEN (event_id // 2400) % 3 = 2
      THEN event_id // 2400 - 1 ELSE event_id // 2400 END AS VARCHAR) AS batch_id FROM ev),
verdict AS (
  SELECT batch_id, tenant_id, CASE WHEN count(*) > 1000 THEN 'too many events'
      WHEN count(*) FILTER (WHERE event_id % 5000 = 4999) > 0 THEN 'bad customer_id' END AS reason
  FROM bodies GROUP BY 1, 2)"""

COUNT_5M = """count(*) FILTER (WHERE event_type IN ('page_view', 'product_view')) {w} AS last_5m_views,
  count(*) FILTER (WHERE event_type = 'click') {w} AS last_5m_clicks,
  count(*) FILTER (WHERE event_type = 'product_view') {w} AS last_5m_product_views"""

# The text of a UUID whose digits are the MD5 of an id.
UUID_OF = "regexp_replace(md5({}), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')"

SLIDING = """spread AS (
  SELECT ev.*, date_trunc('minute', ts) - to_minutes(n) AS window_start
  FROM ev, (SELECT unnest([0, 1, 2, 3, 4]) AS n))"""

EVENT_COLUMNS = "id, tenant_id, customer_id, event_type, product_id, ts AS \"timestamp\""

SLIDING_ROWS = f"""SELECT tenant_id, customer_id, window_start,
  window_start + INTERVAL 5 MINUTE AS window_end, {COUNT_5M.format(w='')}
FROM spread GROUP BY 1, 2, 3"""

DAYS = """SELECT tenant_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day,
  count(*) FILTER (WHERE event_type IN ('page_view', 'product_view')) AS views,
  count(*) FILTER (WHERE event_type = 'purchase') AS purchases,
  count(*) FILTER (WHERE event_type = 'add_to_cart') AS cart_adds
FROM ev GROUP BY 1, 2"""

VARIANT = """variant AS (
  SELECT tenant_id, customer_id, CAST(CAST('0x' || substr(md5(tenant_id || ':' || customer_id), 1, 8)
    AS BIGINT) % 100 AS INTEGER) AS bucket
  FROM {src})"""

RULE_COLUMNS = "tenant_id, product_a_id, product_b_id, co_count, confidence"

FAULTY = """f_tenant AS (
  SELECT 't' || r_regionkey AS id, CASE WHEN r_regionkey <> 3 THEN r_name END AS name,
    lower(r_name) AS slug, 'pro' AS plan_tier, 1 AS created_at
  FROM region, (SELECT unnest([0, 1]) AS copy) WHERE copy = 0 OR r_regionkey = 1),
f_user AS (
  SELECT c_custkey AS id, 't' || (c_custkey % 7) AS tenant_id,
    CASE WHEN c_custkey % 50 = 9 THEN 'shared@example.org' ELSE c_name END AS email,
    CASE WHEN c_custkey % 30 <> 4 THEN 'x' END AS password_hash, c_name AS display_name,
    CASE WHEN c_custkey % 25 = 6 THEN 'boss' ELSE 'viewer' END AS role FROM customer),
f_product AS (
  SELECT CAST(p_partkey AS VARCHAR) AS id,
    CASE WHEN p_partkey % 40 = 5 THEN 't9' ELSE 't' || (p_partkey % 3) END AS tenant_id,
    'ext' AS external_id, p_name AS title, p_retailprice AS price,
    CASE WHEN p_partkey % 40 <> 1 THEN p_type END AS category, TRUE AS active
  FROM part, (SELECT unnest([0, 1]) AS copy) WHERE copy = 0 OR p_partkey % 50 = 3),
f_event AS (
  SELECT event_id, id, tenant_id, CASE WHEN event_id % 97 <> 0 THEN customer_id END AS customer_id,
    CASE WHEN event_id % 101 = 0 THEN 'jump' ELSE event_type END AS event_type, product_id, ts
  FROM ev, (SELECT unnest([0, 1]) AS copy) WHERE copy = 0 OR event_id % 500 = 7),
f_features AS (
  SELECT tenant_id, customer_id, 'map' AS category_affinity,
    CASE WHEN customer_id NOT LIKE '%3' THEN 1 END AS total_revenue
  FROM agg, (SELECT unnest([0, 1]) AS copy) WHERE copy = 0 OR customer_id LIKE '%7'),
f_check AS (
  SELECT tenant_id, CASE WHEN tenant_id = 't1' THEN repeat('p', 101) ELSE 'job' END AS pipeline_name
  FROM held, (SELECT unnest([0, 1]) AS copy) WHERE copy = 0 OR tenant_id = 't0'),
f_rule AS (
  SELECT tenant_id, product_a_id, product_b_id,
    CASE WHEN product_a_id LIKE '%1' THEN 2 ELSE co_count END AS co_count,
    CASE WHEN product_b_id LIKE '%2' THEN 1.5 ELSE confidence END AS confidence
  FROM cooc, (SELECT unnest([0, 1]) AS copy) WHERE copy = 0 OR product_a_id LIKE '%4'),
f_decision AS (
  SELECT tenant_id, nullif(customer_id, 'cold') AS customer_id,
    CASE WHEN tenant_id = 't2' THEN repeat('s', 101) ELSE surface END AS surface,
    CASE WHEN customer_id = 'cold' THEN 'one' ELSE request_id END AS decision_id,
    'v' AS model_version FROM asked)"""


def _faults() -> str:
    """One row per rule: the table, the rule's name, and how many rows or keys break it."""
    tables = {
        "tenant": ("f_tenant", "id name slug plan_tier created_at", ["id", "slug"]),
        "user": ("f_user", "id tenant_id email password_hash display_name role", ["id", "email"]),
        "product": ("f_product", "id tenant_id external_id title price category active", ["id"]),
        "interactionevent": ("f_event", "tenant_id customer_id event_type ts", ["id,ts"]),
        "customer_features": ("f_features", "tenant_id customer_id category_affinity total_revenue",
                              ["customer_id,tenant_id"]),
        "pipeline_checkpoints": ("f_check", "tenant_id pipeline_name", ["tenant_id,pipeline_name"]),
        "product_cooccurrence": ("f_rule", "tenant_id product_a_id product_b_id co_count confidence",
                                 ["tenant_id,product_a_id,product_b_id"]),
        "recommendation_decisions": ("f_decision", "tenant_id customer_id surface decision_id",
                                     ["decision_id"]),
    }
    row = "SELECT '{}' AS table_name, '{}' AS check_name, count(*) AS violations FROM {}"
    out = []
    for name, (source, required, keys) in tables.items():
        for c in required.split():
            out.append(row.format(name, f"not_null:{c}".replace(":ts", ":timestamp"), f"{source} WHERE {c} IS NULL"))
        for key in keys:
            repeats = f"(SELECT 1 FROM {source} GROUP BY {key} HAVING count(*) > 1)"
            out.append(row.format(name, f"unique:{key}".replace(",ts", ",timestamp"), repeats))
    tests = [
        ("interactionevent", "domain:event_type", "f_event WHERE event_type = 'jump'"),
        ("interactionevent", "partition:timestamp",
         "f_event WHERE NOT (ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-16')"),
        ("user", "domain:role", "f_user WHERE role NOT IN ('admin', 'power_user', 'operator', 'viewer')"),
        ("pipeline_checkpoints", "length:pipeline_name", "f_check WHERE length(pipeline_name) > 100"),
        *(("recommendation_decisions", f"length:{c}", f"f_decision WHERE length({c}) > 100")
          for c in ("surface", "decision_id", "model_version")),
        ("product_cooccurrence", "range:co_count", "f_rule WHERE co_count < 3"),
        ("product_cooccurrence", "range:confidence", "f_rule WHERE NOT (confidence > 0 AND confidence <= 1)"),
        ("product", "foreign:tenant_id", "f_product WHERE tenant_id NOT IN (SELECT id FROM f_tenant)"),
        ("user", "foreign:tenant_id", "f_user WHERE tenant_id NOT IN (SELECT id FROM f_tenant)"),
        ("interactionevent", "foreign:product_id,tenant_id",
         "f_event WHERE product_id IS NOT NULL AND (product_id, tenant_id) NOT IN (SELECT (id, tenant_id) FROM f_product)"),
    ]
    return "\nUNION ALL ".join([*out, *(row.format(*(x.replace("'", "''") if k < 2 else x for k, x in enumerate(t))) for t in tests)])


FAULTS = _faults()

ORACLE: dict[str, str] = {
    "tenant_scoped_events": sql([EV], f"SELECT {EVENT_COLUMNS} FROM ev WHERE tenant_id = 't1'"),
    "ingest_accepted": sql(
        [EV, BODIES],
        """SELECT b.tenant_id, customer_id, event_type, product_id, ts AS "timestamp",
          CASE WHEN event_type = 'purchase' AND k % 10 <> 0 THEN value END AS revenue
        FROM bodies b JOIN verdict v USING (batch_id)
          JOIN (SELECT event_id, k, value FROM raw) r USING (event_id)
        WHERE v.reason IS NULL""",
    ),
    "ingest_rejected": sql([EV, BODIES], "SELECT * FROM verdict WHERE reason IS NOT NULL"),
    "lake_round_trip": sql([EV], f"SELECT {EVENT_COLUMNS} FROM ev"),
    "lake_range": sql(
        [EV],
        f"""SELECT {EVENT_COLUMNS} FROM ev WHERE tenant_id = 't1'
          AND ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20'""",
    ),
    "ingest_twice": sql(
        [EV, BODIES],
        """SELECT tenant_id, customer_id, event_type, product_id, ts AS "timestamp"
        FROM bodies JOIN verdict USING (batch_id, tenant_id) WHERE reason IS NULL""",
    ),
    "ingest_canonical_ids": sql(
        [EV],
        f"""SELECT {UUID_OF.format('tenant_id')} AS tenant_id, customer_id, event_type,
          {UUID_OF.format('product_id')} AS product_id, ts AS "timestamp" FROM ev""",
    ),
    "enriched_events": sql(
        [EV, PR, ENR],
        """SELECT id, tenant_id, customer_id, product_id, category,
          CASE WHEN event_type = 'purchase' AND k % 10 <> 0 THEN value ELSE 0.0::DOUBLE END AS revenue
        FROM enr JOIN (SELECT event_id, k, value FROM raw) r USING (event_id)""",
    ),
    "activity_counts": sql(
        FEATS, "SELECT tenant_id, customer_id, total_views, total_cart_adds, total_purchases FROM agg"
    ),
    "distinct_counts": sql(
        FEATS,
        """SELECT tenant_id, customer_id, distinct_products_viewed, distinct_categories_viewed
        FROM agg""",
    ),
    "recency_days": sql(
        FEATS,
        "SELECT tenant_id, customer_id, days_since_first_seen, days_since_last_activity FROM agg",
    ),
    "category_affinity": sql(FEATS, "SELECT * FROM aff"),
    "category_affinity_map": sql(
        FEATS, "SELECT *, count(*) OVER (PARTITION BY tenant_id, customer_id) AS categories FROM aff"
    ),
    "purchase_gaps": sql(
        FEATS, "SELECT tenant_id, customer_id, avg_days_between_purchases FROM buy"
    ),
    "purchase_revenue": sql(
        FEATS, "SELECT tenant_id, customer_id, total_revenue_cents, avg_order_value_cents FROM buy"
    ),
    "sessionized_events": sql(FEATS, "SELECT id, tenant_id, customer_id, session_num FROM num"),
    "session_stats": sql(FEATS, "SELECT * FROM ses"),
    "session_windows": sql(FEATS, "SELECT * FROM win"),
    "customer_feature_rows": sql(
        FEATS, f"SELECT {FEATURE_COLUMNS}, {AS_OF} AS updated_at FROM feat"
    ),
    "customer_feature_affinity": sql(FEATS, "SELECT * FROM aff"),
    "basic_features": sql(FEATS, "SELECT * FROM agg"),
    "new_event_bounds": sql([EV, HELD], "SELECT * FROM bounds"),
    "affected_customers": sql([EV, HELD], "SELECT DISTINCT tenant_id, customer_id FROM fresh"),
    "advanced_checkpoints": sql(
        [EV, HELD],
        f"""SELECT tenant_id, 'customer_features_v1' AS pipeline_name,
          coalesce(max_ts, last_event_ts) AS last_event_ts,
          CASE WHEN max_ts IS NULL THEN last_event_ts ELSE {AS_OF} END AS updated_at
        FROM held FULL JOIN bounds USING (tenant_id)""",
    ),
    "upserted_counts": sql(
        [EV],
        """SELECT tenant_id, customer_id,
          count(*) FILTER (WHERE event_type IN ('page_view', 'product_view')) AS total_views,
          count(*) FILTER (WHERE event_type = 'add_to_cart') AS total_cart_adds,
          count(*) FILTER (WHERE event_type = 'purchase') AS total_purchases
        FROM ev GROUP BY 1, 2""",
    ),
    "looked_up_counts": sql(
        [EV],
        """SELECT tenant_id, customer_id,
          count(*) FILTER (WHERE event_type IN ('page_view', 'product_view')) AS total_views,
          count(*) FILTER (WHERE event_type = 'add_to_cart') AS total_cart_adds,
          count(*) FILTER (WHERE event_type = 'purchase') AS total_purchases
        FROM ev
        WHERE (tenant_id = 't1' OR ts < TIMESTAMP '2024-01-21') AND (tenant_id, customer_id) IN (
          SELECT (tenant_id, customer_id) FROM ev WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-29')
        GROUP BY 1, 2""",
    ),
    "incremental_feature_rows": sql(
        [EV, PR, ENR, HELD,
         "hit AS (SELECT DISTINCT tenant_id, customer_id FROM fresh)",
         """past AS (SELECT enr.* FROM enr JOIN held USING (tenant_id) WHERE ts <= last_event_ts)""",
         "now_ev AS (SELECT enr.* FROM enr JOIN hit USING (tenant_id, customer_id))",
         features("past", "TIMESTAMP '2024-01-21'", "o_"),
         features("now_ev", AS_OF, "n_")],
        f"""SELECT {FEATURE_COLUMNS}, max_ts AS updated_at FROM n_feat JOIN bounds USING (tenant_id)
        UNION ALL
        SELECT {FEATURE_COLUMNS}, TIMESTAMP '2024-01-21' AS updated_at
        FROM o_feat ANTI JOIN hit USING (tenant_id, customer_id)""",
    ),
    "incremental_report": sql(
        [EV, HELD,
         """hits AS (SELECT tenant_id, count(DISTINCT customer_id) AS n FROM fresh GROUP BY 1)"""],
        """SELECT tenant_id, last_event_ts AS checkpoint_before,
          coalesce(max_ts, last_event_ts) AS checkpoint_after,
          coalesce(n, 0) AS affected_customers, coalesce(n, 0) AS upserted_rows,
          coalesce(new_events, 0) AS processed_events
        FROM held FULL JOIN bounds USING (tenant_id) LEFT JOIN hits USING (tenant_id)""",
    ),
    "product_support": sql(COOC, "SELECT * FROM support"),
    "candidate_pairs": sql(COOC, "SELECT * FROM cpairs"),
    "pair_counts": sql(COOC, "SELECT * FROM pcounts"),
    "cooccurrence": sql(COOC, f"SELECT {RULE_COLUMNS}, {AS_OF} AS last_updated FROM cooc"),
    "cooccurrence_wide_path": sql(
        COOC, f"SELECT {RULE_COLUMNS}, {AS_OF} AS last_updated FROM cooc"
    ),
    "replaced_tenants": sql(
        [EV, pairs(),
         "early AS (SELECT * FROM ev WHERE tenant_id = 't0' AND product_id IS DISTINCT FROM '3')",
         pairs("early", "e_")],
        f"""SELECT {RULE_COLUMNS} FROM cooc WHERE tenant_id = 't1'
        UNION ALL SELECT {RULE_COLUMNS} FROM e_cooc""",
    ),
    "related_products": sql(
        COOC,
        """SELECT tenant_id, product_a_id, product_b_id AS product_id, co_count, confidence,
          CAST(row_number() OVER (PARTITION BY tenant_id, product_a_id
            ORDER BY confidence DESC, co_count DESC, product_b_id) AS INTEGER) AS rank
        FROM cooc QUALIFY rank <= 10""",
    ),
    "related_for_anchors": sql(COOC + [anchors(AS_OF), RELATED], "SELECT * FROM related"),
    "related_for_anchors_top3": sql(
        COOC + [anchors(AS_OF), RELATED],
        """SELECT * FROM related QUALIFY row_number() OVER (
          PARTITION BY tenant_id, customer_id, anchor_product_id
          ORDER BY confidence DESC, co_count DESC, product_id) <= 3""",
    ),
    "recent_anchors": sql([EV, anchors(AS_OF)], "SELECT * FROM anchor"),
    "affinity_candidates": sql(FEATS + [AFFINE], "SELECT * FROM affine"),
    "popularity": sql([EV, PR, popular(AS_OF)], "SELECT * FROM popr WHERE rank <= 50"),
    "feature_lookup": sql(
        FEATS + [reqs(False)],
        """SELECT a.tenant_id, a.customer_id, surface, "limit",
          CAST(total_views AS DOUBLE) AS total_views,
          CAST(total_purchases AS DOUBLE) AS total_purchases, avg_days_between_purchases,
          avg_session_duration_seconds, avg_products_viewed_per_session, total_revenue_cents,
          avg_order_value_cents
        FROM asked a LEFT JOIN feat USING (tenant_id, customer_id)""",
    ),
    "excluded_products": sql(
        [EV, PR, pairs(), reqs(True), anchors(AS_OF), RELATED],
        """SELECT tenant_id, customer_id, anchor_product_id, product_id, confidence FROM related
        WHERE (tenant_id, product_id) NOT IN (SELECT (tenant_id, product_id) FROM excl)""",
    ),
    "blended_candidates": sql(
        FEATS + [pairs(), anchors(AS_OF), AFFINE, RELATED, BLEND],
        """SELECT tenant_id, tenant_id || '/' || customer_id AS request_id, product_id,
          category_score, cooccurrence_score, reason FROM blend""",
    ),
    "recommendations": sql(full(AS_OF, False), "SELECT * FROM recs"),
    "recommendations_with_exclusions": sql(full(AS_OF, True), "SELECT * FROM recs"),
    "popularity_fallback": sql(
        [EV, PR, reqs(True), popular(AS_OF)],
        """SELECT a.tenant_id, request_id, a.customer_id, surface,
          CAST(row_number() OVER (PARTITION BY a.tenant_id, a.customer_id
            ORDER BY p.score DESC, p.product_id) AS INTEGER) AS rank,
          p.product_id, p.score, 'global_popularity' AS reason
        FROM asked a JOIN popr p ON p.tenant_id = a.tenant_id AND p.rank <= 3 * a."limit"
        WHERE (p.tenant_id, p.product_id) NOT IN (SELECT (tenant_id, product_id) FROM excl)
        QUALIFY row_number() OVER (PARTITION BY a.tenant_id, a.customer_id
            ORDER BY p.score DESC, p.product_id) <= a."limit\"""",
    ),
    "decision_log": sql(
        full(AS_OF, False),
        f"""SELECT a.tenant_id, a.customer_id, a.surface, 'v1-blended-heuristic' AS model_version,
          count(product_id) AS items,
          coalesce(string_agg(product_id, ',' ORDER BY rank), '') AS products,
          {AS_OF} AS created_at
        FROM asked a LEFT JOIN recs r USING (tenant_id, customer_id) GROUP BY 1, 2, 3""",
    ),
    "latency_summary": """WITH log AS (
  SELECT 't' || (event_id % 3) AS tenant_id, event_type AS surface, value FROM events),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY tenant_id, surface ORDER BY value) - 1 AS place,
    count(*) OVER (PARTITION BY tenant_id, surface) AS n FROM log)
SELECT tenant_id, surface, count(*) AS requests, min(value) AS fastest, max(value) AS slowest,
  CAST(sum(CAST(value AS DECIMAL(38,12))) AS DOUBLE) / count(*) AS average,
  max(value) FILTER (WHERE place = least(CAST(floor(n * 0.50::DOUBLE) AS BIGINT), n - 1)) AS p50,
  max(value) FILTER (WHERE place = least(CAST(floor(n * 0.90::DOUBLE) AS BIGINT), n - 1)) AS p90,
  max(value) FILTER (WHERE place = least(CAST(floor(n * 0.95::DOUBLE) AS BIGINT), n - 1)) AS p95,
  max(value) FILTER (WHERE place = least(CAST(floor(n * 0.99::DOUBLE) AS BIGINT), n - 1)) AS p99
FROM placed GROUP BY 1, 2""",
    "fallback_report": sql(
        full(AS_OF, True),
        """SELECT tenant_id, surface, reason, count(*) AS items,
          count(DISTINCT request_id) AS requests FROM recs GROUP BY 1, 2, 3""",
    ),
    "precomputed_recommendations": sql(
        [EV, PR, ENR, features("enr", LAST_DAY), pairs(),
         f"""asked AS (SELECT DISTINCT tenant_id, customer_id, 'home' AS surface, 8 AS "limit",
           '' AS request_id FROM ev WHERE ts >= {LAST_DAY} - INTERVAL 24 HOUR),
         excl AS (SELECT tenant_id, id AS product_id FROM pr WHERE FALSE)""",
         anchors(LAST_DAY), AFFINE, RELATED, popular(LAST_DAY), BLEND, RECS],
        """SELECT tenant_id, customer_id, surface, rank, product_id, score, reason FROM recs""",
    ),
    "invalidated_recommendations": sql(
        full(AS_OF, False)
        + ["""stale AS (SELECT DISTINCT r.tenant_id, r.customer_id FROM recs r
             JOIN pr ON pr.id = r.product_id AND pr.tenant_id = r.tenant_id WHERE p_size = 1)"""],
        "SELECT recs.* EXCLUDE (request_id) FROM recs ANTI JOIN stale USING (tenant_id, customer_id)",
    ),
    "daily_activity": sql([EV], DAYS),
    "stream_daily_activity": sql([EV], DAYS),
    "last_5m_features": sql(
        [EV],
        f"""SELECT tenant_id, customer_id, {COUNT_5M.format(w='')} FROM ev
        WHERE ts > TIMESTAMP '2024-01-15 11:55:00' AND ts <= TIMESTAMP '2024-01-15 12:00:00'
        GROUP BY 1, 2""",
    ),
    "sliding_5m_features": sql([EV, SLIDING], SLIDING_ROWS),
    "stream_5m_features": sql([EV, SLIDING], SLIDING_ROWS),
    "rolling_5m_features": sql(
        [EV],
        f"""SELECT id, tenant_id, customer_id, ts AS "timestamp", {COUNT_5M.format(w='OVER w')}
        FROM ev WINDOW w AS (PARTITION BY tenant_id, customer_id ORDER BY epoch_us(ts)
          RANGE BETWEEN 299999999 PRECEDING AND CURRENT ROW)""",
    ),
    "merged_features": sql(
        FEATS
        + ["""newest AS (SELECT tenant_id, customer_id, date_trunc('minute', max(ts)) AS window_start
             FROM ev GROUP BY 1, 2)""",
           f"""recent AS (SELECT ev.tenant_id, ev.customer_id, any_value(window_start) AS window_start,
             {COUNT_5M.format(w='')} FROM ev JOIN newest USING (tenant_id, customer_id)
             WHERE ts >= window_start AND ts < window_start + INTERVAL 5 MINUTE GROUP BY 1, 2)"""],
        """SELECT f.tenant_id, f.customer_id, CAST(f.total_views AS INTEGER) AS total_views,
          window_start, CAST(last_5m_views AS DOUBLE) AS last_5m_views,
          CAST(last_5m_clicks AS DOUBLE) AS last_5m_clicks,
          CAST(last_5m_product_views AS DOUBLE) AS last_5m_product_views
        FROM feat f LEFT JOIN recent c USING (tenant_id, customer_id)""",
    ),
    "tenant_tiers": sql(
        [EV],
        """SELECT tenant_id, count(DISTINCT customer_id) AS customers,
          CASE WHEN count(DISTINCT customer_id) <= 10000 THEN 'light' ELSE 'heavy' END AS tier
        FROM ev GROUP BY 1""",
    ),
    "retained_events": sql(
        [EV], f"SELECT {EVENT_COLUMNS} FROM ev WHERE ts >= {AS_OF} - INTERVAL 20 DAY"
    ),
    "storage_layers": sql(
        [EV],
        f"""SELECT tenant_id, CASE WHEN ts >= {AS_OF} - INTERVAL 30 DAY THEN 'hot' ELSE 'cold' END
          AS layer, count(*) AS events FROM ev GROUP BY 1, 2""",
    ),
    "daily_snapshot": sql(
        FEATS, f"SELECT {FEATURE_COLUMNS}, '2024-02-05' AS snapshot_date FROM feat"
    ),
    "rules_snapshot": sql(COOC, f"SELECT {RULE_COLUMNS}, '2024-02-05' AS snapshot_date FROM cooc"),
    "assigned_variants": sql(
        [EV, VARIANT.format(src="(SELECT DISTINCT tenant_id, customer_id FROM ev)")],
        """SELECT tenant_id, customer_id, bucket,
          CASE WHEN bucket < 50 THEN 'A' ELSE 'B' END AS variant FROM variant""",
    ),
    "ab_results": sql(
        [EV, PR, reqs(False), VARIANT.format(src="asked"),
         """buyer AS (SELECT tenant_id, customer_id, count(*) AS n FROM ev
           WHERE event_type = 'purchase' AND ts >= CASE WHEN tenant_id = 't1'
             THEN TIMESTAMP '2024-01-10' ELSE TIMESTAMP '2024-01-20' END GROUP BY 1, 2)"""],
        """SELECT v.tenant_id, CASE WHEN bucket < 50 THEN 'A' ELSE 'B' END AS variant,
          count(*) AS customers,
          count(*) * CASE WHEN v.tenant_id = 't1' THEN 2 ELSE 1 END AS exposures, count(n) AS buyers,
          CAST(coalesce(sum(n), 0) AS BIGINT) AS purchases,
          CAST(count(n) AS DOUBLE) / count(*) AS conversion
        FROM variant v LEFT JOIN buyer USING (tenant_id, customer_id) GROUP BY 1, 2""",
    ),
    "integrity_report": sql([EV, PR, ENR, features("enr", AS_OF), pairs(), reqs(False), HELD, FAULTY], FAULTS),
    "checked_requests": sql(
        [EV],
        """SELECT tenant_id, customer_id,
          CAST(CASE WHEN count(*) > 22 THEN count(*) + 20 ELSE 8 END AS INTEGER) AS "limit",
          CASE WHEN count(*) > 22 THEN count(*) + 20 <= 50 ELSE TRUE END AS valid
        FROM ev GROUP BY 1, 2""",
    ),
    "stream_ingested_events": sql([EV], f"SELECT {EVENT_COLUMNS} FROM ev"),
    "stream_deduplicated_events": sql([EV], f"SELECT {EVENT_COLUMNS} FROM ev"),
    "stream_sessions": sql(
        FEATS,
        """SELECT tenant_id, customer_id, session_start, session_end, events, product_events
        FROM win""",
    ),
}

# Other ways to the same rows.
ORACLE["merged_feature_rows"] = ORACLE["incremental_feature_rows"]
ORACLE["state_features"] = ORACLE["customer_feature_rows"]
ORACLE["stream_rolling_5m"] = ORACLE["rolling_5m_features"]
ORACLE["stream_log_ingest"] = ORACLE["stream_ingested_events"]

# Estimates are compared with the exact values by the queries; SQL gives these, and that all are near.
_WEEKS = "ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-22'"
ORACLE["distincts_sketched"] = sql(
    [EV, PR, ENR],
    f"""SELECT tenant_id, category, CAST(count(*) AS BIGINT) AS events, count(DISTINCT customer_id) AS n_customers,
      count(DISTINCT product_id) AS n_products, TRUE AS customers_near, TRUE AS products_near
    FROM enr WHERE {_WEEKS} GROUP BY 1, 2""",
)
ORACLE["distinct_counts_sketched"] = sql(
    [EV, PR, ENR],
    """SELECT tenant_id, customer_id, count(DISTINCT product_id) AS distinct_products_viewed,
      count(DISTINCT category) AS distinct_categories_viewed, TRUE AS products_near, TRUE AS categories_equal
    FROM enr GROUP BY 1, 2""",
)
ORACLE["quantiles_sketched"] = f"""SELECT 't' || (event_id % 3) AS tenant_id, event_type AS surface, share,
  count(*) AS requests, TRUE AS all_counted, TRUE AS near
FROM events, (VALUES (0.5::DOUBLE), (0.9::DOUBLE), (0.95::DOUBLE), (0.99::DOUBLE)) s(share)
WHERE {_WEEKS} GROUP BY 1, 2, 3"""
ORACLE["invalidated_by_index"] = ORACLE["invalidated_recommendations"]
ORACLE["stream_merged_features"] = ORACLE["merged_features"]
ORACLE["copartitioned_features"] = ORACLE["customer_feature_rows"]
