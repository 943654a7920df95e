"""SQL for what the streams put out. A last row of the far future closes all windows, so they are those of the batch."""

from __future__ import annotations

from ..oracles import ORACLES as BATCH

_RESULT = BATCH["ledger_results"]
_ORDERS = BATCH["top3_products_hop"].split(",\n  hops AS")[0] + """,
  placed AS (SELECT *, ['PENDING', 'CONFIRMED', 'SHIPPED', 'DELIVERED'][order_id % 4 + 1] AS status, 'region-' || (customer_id % 5) AS region FROM bought)"""

ORACLES: dict[str, str] = {
    "stream_tumble": """SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total,
          count(DISTINCT user_id) AS users FROM events GROUP BY ALL""",
    "stream_top3": BATCH["top3_products_hop"],
    "stream_sessions": """WITH cut AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w + INTERVAL '6 hours' < ts THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
          numbered AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM cut)
        SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '6 hours' AS session_end, count(*) AS n FROM numbered GROUP BY user_id, s""",
    "stream_long_rides": BATCH["long_ride_alerts"],
    "stream_ledger_late": BATCH["ledger_late_duplicates"],
    "stream_generated_orders": BATCH["generated_orders"],
    "stream_enrich": """WITH v AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view'), o AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
          b AS (SELECT o.event_id, arg_max(v.event_id, v.ts) AS view_id FROM o JOIN v ON v.user_id = o.user_id AND v.ts <= o.ts GROUP BY o.event_id),
          a AS (SELECT o.event_id, arg_min(v.event_id, v.ts) AS view_id FROM o JOIN v ON v.user_id = o.user_id AND v.ts > o.ts GROUP BY o.event_id)
        SELECT o.event_id AS order_id, user_id AS customer_id, CASE WHEN b.view_id IS NOT NULL THEN 'direct' WHEN a.view_id IS NOT NULL THEN 'delayed' ELSE 'unknown' END AS match,
          coalesce('user/' || coalesce(b.view_id, a.view_id), 'Unknown') AS name, CASE WHEN coalesce(b.view_id, a.view_id) IS NULL THEN 'Unknown' ELSE 'GOLD' END AS tier
        FROM o LEFT JOIN b USING (event_id) LEFT JOIN a USING (event_id)""",
    "stream_sql_tumble": _ORDERS + """ SELECT time_bucket(INTERVAL '1 hour', order_time) AS window_start, category, count(*) AS orders, CAST(sum(quantity) AS BIGINT) AS total_sold FROM placed GROUP BY ALL""",
    "stream_hypertable": "SELECT event_id, user_id, ts, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-15'",
    "stream_product_messages": """WITH v AS (SELECT event_id, user_id % 13 AS product_id, ts FROM events WHERE event_type = 'signup'),
          o AS (SELECT event_id, user_id % 13 AS product_id, ts, CAST(round(value * 100) AS BIGINT) AS c FROM events WHERE event_type = 'purchase'),
          b AS (SELECT o.event_id, arg_max(v.event_id, v.ts) AS version FROM o JOIN v ON v.product_id = o.product_id AND v.ts <= o.ts GROUP BY o.event_id)
        SELECT event_id AS order_id, product_id, CASE WHEN version IS NULL THEN printf('Order %d: %dx product %d (catalog pending) = $%d.%02d', event_id, event_id % 5 + 1, product_id, c // 100, c % 100)
          ELSE printf('Order %d: %dx v%d (General) @ $%d.%02d each = $%d.%02d', event_id, event_id % 5 + 1, version, version % 100 // 4, version % 100 % 4 * 25, c // 100, c % 100) END AS message
        FROM o LEFT JOIN b USING (event_id)""",
    "stream_dashboard_orders_by_region": _ORDERS + """ SELECT time_bucket(INTERVAL '1 hour', order_time) AS window_start, time_bucket(INTERVAL '1 hour', order_time) + INTERVAL '1 hour' AS window_end,
          region, count(*) AS order_count, CAST(sum(total_amount) AS DOUBLE) AS revenue FROM placed GROUP BY ALL""",
    "stream_dashboard_top_products": BATCH["top3_products_hop"],
    "stream_dashboard_revenue_by_category": _ORDERS + """, sums AS (SELECT time_bucket(INTERVAL '1 hour', order_time) AS window_start, category, count(DISTINCT customer_id) AS unique_customers,
          count(*) AS orders, CAST(sum(total_amount) * 100 AS BIGINT) AS c FROM placed WHERE status IN ('CONFIRMED', 'DELIVERED') GROUP BY ALL)
        SELECT category, window_start, unique_customers, orders, printf('%d.%02d', c // 100, c % 100) AS revenue,
          printf('%d.%02d', (2 * c + orders) // (2 * orders) // 100, (2 * c + orders) // (2 * orders) % 100) AS avg_order_value FROM sums""",
    "stream_dashboard_high_value_alerts": _ORDERS + " SELECT order_id, customer_id, product_name, region, CAST(total_amount AS VARCHAR) AS total_amount, order_time FROM placed WHERE total_amount > 150",
    "stream_ledger": _RESULT,
    "stream_ride_fare": """SELECT event_id // 2 AS ride_id, user_id AS driver_id, CASE WHEN event_type = 'purchase' THEN value ELSE 0.0::DOUBLE END AS tip FROM events WHERE event_id % 2 = 0""",
    "stream_interval_join": BATCH["interval_join"],
    "stream_dedup": "SELECT event_id, user_id, ts FROM events",
    "stream_upsert": "SELECT user_id, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY user_id",
    "stream_cdc_routes": "SELECT t AS output, event_id AS position, t AS table_name FROM (SELECT event_id, ['customers', 'orders', 'products', 'inventory'][user_id % 4 + 1] AS t FROM events)",
    "stream_last_record": """WITH c AS (SELECT CAST(user_id AS VARCHAR) AS record, event_id AS position, event_id % 20 AS k, props FROM events)
        SELECT record, position, CASE WHEN k < 8 THEN 'INSERT' WHEN k < 17 THEN 'UPDATE' ELSE 'DELETE' END AS operation,
          lag(CASE WHEN k < 17 THEN props END) OVER w AS last_data, row_number() OVER w > 1 AS seen_before FROM c WINDOW w AS (PARTITION BY record ORDER BY position)""",
}
