"""SQL that states the result of each query over the same tables."""

from __future__ import annotations

_STAR = """
  star AS (
    SELECT l_orderkey AS order_id, o_custkey AS customer_id, l_partkey AS product_id, CAST(l_quantity AS INTEGER) AS quantity,
           CAST(l_extendedprice AS DECIMAL(18,2)) AS total_amount, o_orderdate AS order_time,
           CASE o_orderstatus WHEN 'O' THEN 'CONFIRMED' WHEN 'F' THEN 'DELIVERED' ELSE 'PENDING' END AS status,
           r_name AS region, p_name AS product_name, p_type AS category
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey
  )"""
_BY_REGION = (
    _STAR
    + """,
  by_region AS (
    SELECT time_bucket(INTERVAL '1 minute', order_time) AS window_start, time_bucket(INTERVAL '1 minute', order_time) + INTERVAL '1 minute' AS window_end,
           region, count(*) AS order_count, CAST(sum(total_amount) AS DOUBLE) AS revenue FROM star GROUP BY ALL
  )"""
)
_BY_CATEGORY = (
    _STAR
    + """,
  by_category AS (
    SELECT *, revenue / orders AS avg_order_value FROM (
      SELECT time_bucket(INTERVAL '1 minute', order_time) AS window_start, category, count(DISTINCT customer_id) AS unique_customers, count(*) AS orders,
             CAST(sum(total_amount) AS DOUBLE) AS revenue FROM star WHERE status = 'CONFIRMED' OR status = 'DELIVERED' GROUP BY ALL)
  )"""
)
_PURCHASES = """
  bought AS (
    SELECT event_id AS order_id, user_id AS customer_id, user_id % 13 AS product_id, 'product-' || (user_id % 13) AS product_name,
           'category-' || (user_id % 13 % 4) AS category, CAST(event_id % 5 + 1 AS INTEGER) AS quantity, CAST(value AS DECIMAL(18,2)) AS total_amount, ts AS order_time
    FROM events WHERE event_type = 'purchase'
  )"""
_TOP = (
    _PURCHASES
    + """,
  hops AS (
    SELECT time_bucket(INTERVAL '30 minutes', order_time) - k * INTERVAL '30 minutes' AS window_start, product_name, category,
           CAST(sum(quantity) AS BIGINT) AS total_sold, CAST(sum(total_amount) AS DOUBLE) AS total_revenue
    FROM bought, range(2) r(k) GROUP BY ALL
  ),
  top3 AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY window_start ORDER BY total_sold DESC, product_name, category) AS rank_num FROM hops) WHERE rank_num <= 3
  )"""
)
_RIDES = """
  ride AS (
    SELECT event_id // 2 AS ride_id, user_id AS driver_id, event_id % 2 = 0 AS is_start,
           ts + to_hours(CASE WHEN event_id % 2 = 0 THEN 0 ELSE event_id // 2 % 4 END) AS event_time,
           CAST((-74200 + event_id * 7 % 650) / 1000.0::DOUBLE AS FLOAT) AS start_lon, CAST((40400 + event_id * 11 % 700) / 1000.0::DOUBLE AS FLOAT) AS start_lat,
           CAST((-74200 + event_id * 13 % 650) / 1000.0::DOUBLE AS FLOAT) AS end_lon, CAST((40400 + event_id * 17 % 700) / 1000.0::DOUBLE AS FLOAT) AS end_lat
    FROM events
  )"""
_FARES = """
  fare AS (
    SELECT event_id // 2 AS ride_id, user_id AS driver_id, CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(18,2)) ELSE 0 END AS tip, ts AS start_time
    FROM events WHERE event_id % 2 = 0
  ),
  hourly AS (SELECT time_bucket(INTERVAL '1 hour', start_time) + INTERVAL '1 hour' AS window_end, driver_id, sum(tip) AS tips FROM fare GROUP BY ALL)"""
_SESSIONS = """
  typed AS (
    SELECT event_id, user_id, user_id || '_' || (event_id // 100) AS session_id, ts,
           CASE event_type WHEN 'click' THEN 'ADD' WHEN 'error' THEN 'REMOVE' WHEN 'purchase' THEN 'PURCHASE' ELSE 'VIEW' END AS kind, CAST(value AS DECIMAL(18,2)) AS v
    FROM events
  ),
  cut AS (SELECT *, CASE WHEN lag(ts) OVER w + INTERVAL '6 hours' < ts THEN 1 ELSE 0 END AS new FROM typed WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  numbered AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM cut),
  placed AS (SELECT *, row_number() OVER (PARTITION BY user_id, s ORDER BY ts, event_id) AS n FROM numbered),
  cart AS (
    WITH RECURSIVE f(user_id, s, n, c) AS (
      SELECT user_id, s, CAST(0 AS BIGINT), CAST(0 AS DECIMAL(18,2)) FROM placed WHERE n = 1
      UNION ALL
      SELECT p.user_id, p.s, p.n, CAST(CASE kind WHEN 'ADD' THEN c + v WHEN 'REMOVE' THEN greatest(0, c - v) ELSE c END AS DECIMAL(18,2))
      FROM f JOIN placed p ON p.user_id = f.user_id AND p.s = f.s AND p.n = f.n + 1
    )
    SELECT user_id, s, CAST(arg_max(c, n) AS DOUBLE) AS total_cart_value FROM f GROUP BY ALL
  ),
  stats AS (
    SELECT user_id, arg_min(session_id, n) AS session_id, count(*) FILTER (kind = 'VIEW') AS page_views, count(*) FILTER (kind = 'ADD') AS add_to_cart_count,
           count(*) FILTER (kind = 'PURCHASE') AS purchase_count, any_value(total_cart_value) AS total_cart_value, min(ts) AS session_start,
           max(ts) + INTERVAL '6 hours' AS session_end, (epoch_us(max(ts) + INTERVAL '6 hours') - epoch_us(min(ts))) // 1000 AS session_duration_ms
    FROM placed JOIN cart USING (user_id, s) GROUP BY user_id, s
  )"""
_CHANGES = """
  change AS (
    SELECT CASE WHEN event_id % 20 < 8 THEN 'INSERT' WHEN event_id % 20 < 17 THEN 'UPDATE' ELSE 'DELETE' END AS operation,
           ['customers', 'orders', 'products', 'inventory'][user_id % 4 + 1] AS table_name, CAST(user_id AS VARCHAR) AS primary_key, event_id AS position, ts,
           CASE WHEN event_id % 20 >= 17 THEN NULL WHEN user_id % 4 = 3 THEN '{"product_id":"p","quantity":' || (event_id % 7) || '}'
                ELSE '{"id":"k","status":"' || ['shipped', 'inactive', 'active'][event_id % 3 + 1] || '"}' END AS after_data
    FROM events
  )"""
_VERSIONS = """
  version AS (
    SELECT c_custkey AS customer_id, c_name || '/' || k AS name, c_mktsegment AS tier,
           TIMESTAMP '2023-12-20 00:00:00' + to_hours(CAST((c_custkey * 37) % 720 + k * 240 AS BIGINT)) AS update_time FROM customer, range(3) r(k)
  )"""
_AS_OF = (
    _PURCHASES
    + ","
    + _VERSIONS
    + """,
  before AS (SELECT order_id, name, tier FROM bought b ASOF JOIN version v ON b.customer_id = v.customer_id AND b.order_time >= v.update_time),
  after AS (
    SELECT order_id, arg_min(name, update_time) AS name, arg_min(tier, update_time) AS tier FROM bought b JOIN version v
    ON b.customer_id = v.customer_id AND v.update_time > b.order_time AND v.update_time <= b.order_time + INTERVAL '48 hours' GROUP BY order_id
  ),
  enriched AS (
    SELECT b.order_id, customer_id, order_time, CASE WHEN x.name IS NOT NULL THEN 'direct' WHEN y.name IS NOT NULL THEN 'delayed' ELSE 'unknown' END AS match,
           coalesce(x.name, y.name, 'Unknown') AS name, coalesce(x.tier, y.tier, 'Unknown') AS tier
    FROM bought b LEFT JOIN before x USING (order_id) LEFT JOIN after y USING (order_id)
  )"""
)
_TXNS = """
  base AS (SELECT o_orderkey AS transaction_id, o_custkey % 1000 AS account_from, CAST(floor(o_totalprice) AS BIGINT) AS cents, o_orderdate AS ts, 0 AS seq FROM orders),
  txn AS (SELECT * FROM base UNION ALL SELECT transaction_id, account_from, cents, ts + INTERVAL '1 second', 1 FROM base WHERE transaction_id % 50 = 0)"""
_LEDGER = (
    _TXNS
    + """,
  numbered AS (SELECT *, row_number() OVER (PARTITION BY account_from ORDER BY ts, seq, transaction_id) AS n FROM txn),
  fold AS (
    WITH RECURSIVE f(account_from, n, transaction_id, seq, status, balance, cents, done) AS (
      SELECT DISTINCT account_from, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), 0, '', CAST(1000000 AS BIGINT), CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM numbered
      UNION ALL
      SELECT account_from, n, transaction_id, seq, status, CASE WHEN status = 'COMPLETED' THEN balance - cents ELSE balance END, cents,
             CASE WHEN status = 'COMPLETED' THEN list_append(done, transaction_id) ELSE done END
      FROM (
        SELECT t.account_from, t.n, t.transaction_id, t.seq, t.cents, f.balance, f.done,
               CASE WHEN list_contains(f.done, t.transaction_id) THEN 'DUPLICATE' WHEN f.balance >= t.cents THEN 'COMPLETED' ELSE 'FAILED' END AS status
        FROM f JOIN numbered t ON t.account_from = f.account_from AND t.n = f.n + 1)
    )
    SELECT * FROM f
  ),
  result AS (
    SELECT transaction_id, account_from, seq, status, CASE WHEN status = 'COMPLETED' THEN balance / 100 END AS new_balance_from,
           CASE WHEN status = 'COMPLETED' THEN CAST(0 AS DOUBLE) END AS new_balance_to,
           CASE WHEN status = 'FAILED' THEN printf('Insufficient funds: needed %d.%02d, available %d.%02d', cents // 100, cents % 100, balance // 100, balance % 100) END AS error_message
    FROM fold WHERE n > 0
  )"""
)
_LATE = """
  base AS (
    SELECT o_orderkey AS transaction_id, o_custkey % 100 AS account_from, CAST(o_orderkey % 97 + 1 AS BIGINT) AS cents, o_orderdate AS ts, 0 AS seq FROM orders
  ),
  txn AS (
    SELECT * FROM base UNION ALL
    SELECT transaction_id, account_from, cents, ts + to_hours([0, 23, 24, 24, 40][transaction_id % 5 + 1]) + to_seconds(CASE WHEN transaction_id % 5 IN (0, 3) THEN 1 ELSE 0 END), 1 FROM base
  ),
  numbered AS (SELECT *, row_number() OVER (PARTITION BY account_from ORDER BY ts, seq, transaction_id) AS n FROM txn),
  fold AS (
    WITH RECURSIVE f(account_from, n, transaction_id, seq, status, balance, cents, done) AS (
      SELECT DISTINCT account_from, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), 0, '', CAST(1000000 AS BIGINT), CAST(0 AS BIGINT), CAST([] AS STRUCT(id BIGINT, ts TIMESTAMP)[]) FROM numbered
      UNION ALL
      SELECT account_from, n, transaction_id, seq, status, CASE WHEN status = 'COMPLETED' THEN balance - cents ELSE balance END, cents,
             CASE WHEN status = 'COMPLETED' THEN list_append(kept, {'id': transaction_id, 'ts': ts}) ELSE kept END
      FROM (
        SELECT *, CASE WHEN list_contains(list_transform(kept, lambda x: x.id), transaction_id) THEN 'DUPLICATE' WHEN balance >= cents THEN 'COMPLETED' ELSE 'FAILED' END AS status
        FROM (
          SELECT t.account_from, t.n, t.transaction_id, t.seq, t.cents, t.ts, f.balance, list_filter(f.done, lambda x: x.ts >= t.ts - INTERVAL '24 hours') AS kept
          FROM f JOIN numbered t ON t.account_from = f.account_from AND t.n = f.n + 1))
    )
    SELECT * FROM f
  )"""


def _u(key: str, salt: int) -> str:
    """A generator's number in [0, 1)."""
    return f"(CAST('0x' || substr(md5(CAST({key} AS VARCHAR) || ':{salt}'), 1, 10) AS BIGINT) / 1099511627776.0::DOUBLE)"


def _p(key: str, salt: int, n: int) -> str:
    """A generator's whole number in [0, n)."""
    return f"CAST(CAST('0x' || substr(md5(CAST({key} AS VARCHAR) || ':{salt}'), 1, 10) AS BIGINT) % {n} AS INTEGER)"


def _w(u: str, weights: dict[str, float]) -> str:
    """A generator's weighted choice: edges are sums in double precision, from the left."""
    names, edges = list(weights), []
    for k in range(1, len(weights)):
        edges.append(" + ".join(["0.0::DOUBLE", *(f"{w!r}::DOUBLE" for w in list(weights.values())[:k])]))
    return "CASE " + " ".join(f"WHEN {u} < {e} THEN '{n}'" for e, n in zip(edges, names, strict=False)) + f" ELSE '{names[-1]}' END"


def _at(ms: str) -> str:
    return f"TIMESTAMP '2024-01-01' + to_milliseconds({ms})"


def _cents(x: str) -> str:
    return f"floor(({x}) * 100 + 0.5) / 100"


_REGIONS = {"North America": 0.35, "Europe": 0.25, "Asia Pacific": 0.25, "Latin America": 0.10, "Middle East": 0.05}
_STATUSES = {"PENDING": 0.40, "CONFIRMED": 0.30, "SHIPPED": 0.20, "DELIVERED": 0.10}
#: The product catalogue.
_CATALOGUE = """['ELEC-001', 'ELEC-002', 'ELEC-003', 'ELEC-004', 'CLTH-001', 'CLTH-002', 'CLTH-003', 'HOME-001', 'HOME-002', 'SPRT-001', 'SPRT-002', 'BOOK-001', 'BOOK-002']"""
_NAMES = """['Laptop', 'Smartphone', 'Headphones', 'Tablet', 'T-Shirt', 'Jeans', 'Sneakers', 'Lamp', 'Office Chair', 'Running Shoes', 'Yoga Mat', 'Programming Book', 'Novel']"""
_PRICES = "CAST([1299.99, 799.99, 199.99, 649.99, 29.99, 79.99, 109.99, 49.99, 299.99, 119.99, 39.99, 59.99, 19.99] AS DOUBLE[])"


def _coordinate(salt: int, lo: float, hi: float) -> str:
    return f"CAST({lo!r}::DOUBLE + {_u('i // 2', salt)} * ({hi!r}::DOUBLE - {lo!r}::DOUBLE) AS FLOAT)"


def _orders(ids: str) -> str:
    return f"""SELECT 'ORD-' || CASE WHEN length(CAST(i AS VARCHAR)) >= 8 THEN CAST(i AS VARCHAR) ELSE lpad(CAST(i AS VARCHAR), 8, '0') END AS order_id,
          'C' || lpad(CAST(c AS VARCHAR), 3, '0') AS customer_id, product_id, {_NAMES}[p] AS product_name,
          CASE substr(product_id, 1, 4) WHEN 'ELEC' THEN 'Electronics' WHEN 'CLTH' THEN 'Clothing' WHEN 'HOME' THEN 'Home & Garden' WHEN 'SPRT' THEN 'Sports' ELSE 'Books' END AS category,
          {_w(_u("i", 34), _REGIONS)} AS region, quantity, {_PRICES}[p] AS unit_price, {_cents(f"quantity * {_PRICES}[p]")} AS total_amount,
          {_at(f"i * 100 + {_p('i', 35, 50)}")} AS order_time, {_w(_u("i", 36), _STATUSES)} AS status
        FROM (SELECT i, {_p("i", 31, 13)} + 1 AS p, {_CATALOGUE}[{_p("i", 31, 13)} + 1] AS product_id, {_p("i", 32, 5)} + 1 AS quantity, {_p("i", 33, 100)} + 1 AS c FROM ({ids}))"""


def _payload(salt: int) -> str:
    return f"""CASE table_name
          WHEN 'customers' THEN printf('{{"id":"%s","name":"Customer %s","email":"%s@example.com","status":"%s"}}', k, k, lower(k), ['active', 'inactive'][{_p("i", salt, 2)} + 1])
          WHEN 'orders' THEN printf('{{"id":"%s","customer_id":"CUST%05d","total":%d,"status":"%s"}}', k, {_p("i", salt + 1, 1000)}, {_p("i", salt + 2, 1000)}, ['pending', 'confirmed', 'shipped', 'delivered'][{_p("i", salt, 4)} + 1])
          WHEN 'products' THEN printf('{{"id":"%s","name":"Product %s","price":%d,"category":"Electronics"}}', k, k, {_p("i", salt + 1, 500)})
          ELSE printf('{{"product_id":"%s","warehouse":"WH%d","quantity":%d}}', k, {_p("i", salt + 1, 5)}, {_p("i", salt + 2, 20)}) END"""


_IDS = "SELECT range AS i FROM range(1000)"
_GENERATED: dict[str, str] = {
    "rides": f"""SELECT i // 2 AS ride_id, CAST({_p("i // 2", 1, 10_000)} + 1 AS BIGINT) AS taxi_id, CAST({_p("i // 2", 2, 5_000)} + 1 AS BIGINT) AS driver_id, i % 2 = 0 AS is_start,
          {_at(f"i // 2 * 1000 - CASE WHEN i % 2 = 0 THEN {_p('i', 3, 60)} ELSE 0 END * 1000")} AS event_time,
          {_coordinate(4, -74.05, -73.7)} AS start_lon, {_coordinate(5, 40.5, 41.0)} AS start_lat, {_coordinate(6, -74.05, -73.7)} AS end_lon, {_coordinate(7, 40.5, 41.0)} AS end_lat,
          CAST({_p("i // 2", 8, 4)} + 1 AS SMALLINT) AS passenger_cnt FROM ({_IDS})""",
    "fares": f"""SELECT i AS ride_id, CAST({_p("i", 1, 10_000)} + 1 AS BIGINT) AS taxi_id, CAST({_p("i", 2, 5_000)} + 1 AS BIGINT) AS driver_id,
          {_at(f"i * 1000 - {_p('i', 16, 300)} * 1000")} AS start_time, CASE WHEN card THEN 'CARD' ELSE 'CASH' END AS payment_type,
          CAST(tip AS FLOAT) AS tip, CAST(tolls AS FLOAT) AS tolls, CAST(base + tip + tolls AS FLOAT) AS total_fare
        FROM (SELECT *, CASE WHEN card THEN base * (0.10::DOUBLE + {_u("i", 13)} * 0.15::DOUBLE) ELSE 0.0::DOUBLE END AS tip,
                CASE WHEN {_u("i", 14)} < 0.2::DOUBLE THEN 5 + {_u("i", 15)} * 10 ELSE 0.0::DOUBLE END AS tolls
              FROM (SELECT i, 2.5::DOUBLE + {_u("i", 11)} * 50 AS base, {_p("i", 12, 2)} = 1 AS card FROM ({_IDS})))""",
    "user_events": f"""SELECT user_id, user_id || '_session_' || (i // 100) AS session_id, event_type, '/page/' || {_p("i", 26, 6)} AS page_url,
          CASE WHEN buys THEN {_CATALOGUE}[{_p("i", 23, 13)} + 1] END AS product_id,
          CASE WHEN buys THEN {_cents(f"{_PRICES}[{_p('i', 23, 13)} + 1] * ({_p('i', 27, 3)} + 1)")} ELSE 0.0::DOUBLE END AS cart_value,
          {_at(f"i * 20 + {_p('i', 28, 100)} - CASE WHEN {_u('i', 24)} < 0.05::DOUBLE THEN {_p('i', 25, 3000)} ELSE 0 END")} AS event_time
        FROM (SELECT *, event_type IN ('ADD_TO_CART', 'PURCHASE') AS buys FROM (
          SELECT i, 'user_' || ({_p("i // 8", 21, 3)} + 1) AS user_id, {_w(_u("i", 22), {"PAGE_VIEW": 0.70, "ADD_TO_CART": 0.15, "PURCHASE": 0.10, "REMOVE_FROM_CART": 0.05})} AS event_type FROM ({_IDS})))""",
    "orders": _orders(_IDS),
    "change_events": f"""SELECT operation, table_name, k AS primary_key, CASE WHEN operation <> 'INSERT' THEN {_payload(50)} END AS before_data,
          CASE WHEN operation <> 'DELETE' THEN {_payload(60)} END AS after_data, {_at("i * 50")} AS ts, i // 3 AS transaction_id, i AS position
        FROM (SELECT *, CASE table_name WHEN 'customers' THEN printf('CUST%05d', {_p("i", 43, 1000)}) WHEN 'orders' THEN printf('ORD%08d', {_p("i", 43, 10_000)}) ELSE printf('PROD%04d', {_p("i", 43, 500)}) END AS k
          FROM (SELECT i, ['customers', 'orders', 'products', 'inventory'][{_p("i", 41, 4)} + 1] AS table_name, {_w(_u("i", 42), {"INSERT": 0.40, "UPDATE": 0.45, "DELETE": 0.15})} AS operation FROM ({_IDS})))""",
    "join_orders": f"""SELECT printf('O%06d', i) AS order_id, printf('C%03d', {_p("i", 71, 50)} + 1) AS customer_id, printf('P%03d', {_p("i", 72, 20)} + 1) AS product_id,
          {_p("i", 73, 5)} + 1 AS quantity, {_cents(f"10 + {_u('i', 74)} * 490")} AS amount, {_at("i * 100")} AS order_time FROM ({_IDS})""",
    "join_customers": f"""SELECT k AS customer_id, 'Customer ' || k AS name, lower(k) || '@example.com' AS email, ['BRONZE', 'SILVER', 'GOLD', 'PLATINUM'][{_p("i", 81, 4)} + 1] AS tier,
          {_w(_u("i", 82), _REGIONS)} AS region, {_at("i * 500")} AS update_time FROM (SELECT i, printf('C%03d', i % 50 + 1) AS k FROM ({_IDS}))""",
    "join_products": f"""SELECT k AS product_id, 'Product ' || k AS name, 'General' AS category, {_cents(f"5 + {_u('i', 91)} * 195")} AS price, {_p("i", 92, 100)} AS stock_level,
          {_at("i * 2000")} AS update_time FROM (SELECT i, printf('P%03d', i % 20 + 1) AS k FROM ({_IDS}))""",
    "transactions": f"""SELECT printf('TXN%08d', i - CASE WHEN {_u("i", 105)} < 0.02::DOUBLE AND i > 0 THEN 1 ELSE 0 END) AS transaction_id, printf('ACC%03d', source) AS account_from,
          printf('ACC%03d', (source + 1 + {_p("i", 102, 9)}) % 10) AS account_to,
          {_cents(f"CASE WHEN {_u('i', 103)} < 0.9::DOUBLE THEN 10 + {_u('i', 104)} * 990 ELSE 1000 + {_u('i', 104)} * 9000 END")} AS amount,
          ['USD', 'EUR', 'GBP'][{_p("i", 106, 3)} + 1] AS currency, {_at("i * 200")} AS ts, 'PENDING' AS status FROM (SELECT i, {_p("i", 101, 10)} AS source FROM ({_IDS}))""",
}
_RATE = """0.3::DOUBLE + greatest(CASE WHEN {0} BETWEEN 4 AND 14 THEN sin(pi() * ({0} - 4) / 10) ELSE 0.0::DOUBLE END,
          CASE WHEN {0} BETWEEN 14 AND 24 THEN sin(pi() * ({0} - 14) / 10) ELSE 0.0::DOUBLE END, 0.0::DOUBLE)"""
_BEGIN = _u("i // 600", 37) + " * 120.0::DOUBLE"
_GENERATED["paced_orders"] = _orders(f"""SELECT i * 1000 + unnest(range(1, n + 1)) AS i FROM (SELECT i, CAST(floor(10.0::DOUBLE * ({_RATE.format("(i % 86400 / 3600.0::DOUBLE)")})
          * CASE WHEN i % 600 >= {_BEGIN} AND i % 600 < {_BEGIN} + 30 THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END + 0.5) AS BIGINT) AS n FROM ({_IDS}))""")

_W, _S, _N = "CAST('-74.05' AS FLOAT)", "CAST('40.5' AS FLOAT)", "CAST(100 AS FLOAT)"
_IN = "{0}_lon > CAST('-74.05' AS FLOAT) AND {0}_lon < CAST('-73.7' AS FLOAT) AND {0}_lat > CAST('40.5' AS FLOAT) AND {0}_lat < CAST('41.0' AS FLOAT)"

ORACLES: dict[str, str] = {
    "orders_by_region_tumble": f"WITH {_BY_REGION} SELECT * FROM by_region",
    "top3_products_hop": f"WITH {_TOP} SELECT * FROM top3",
    "revenue_by_category_tumble": f"WITH {_BY_CATEGORY} SELECT * FROM by_category",
    "high_value_alerts": f"WITH {_STAR} SELECT order_id, customer_id, product_name, region, CAST(total_amount AS DOUBLE) AS total_amount, order_time FROM star WHERE total_amount > 500",
    "serving_region_recent": f"WITH {_BY_REGION} SELECT * FROM by_region WHERE window_start >= TIMESTAMP '1998-01-02' - INTERVAL '1440 minutes' ORDER BY window_start DESC, region LIMIT 1000",
    "serving_products_recent": f"WITH {_TOP} SELECT * FROM top3 WHERE window_start >= TIMESTAMP '2024-01-15' - INTERVAL '1440 minutes' ORDER BY window_start DESC, rank_num LIMIT 300",
    "serving_category_recent": f"WITH {_BY_CATEGORY} SELECT * FROM by_category WHERE window_start >= TIMESTAMP '1998-01-02' - INTERVAL '1440 minutes' ORDER BY window_start DESC, category LIMIT 500",
    "serving_alerts_recent": f"""WITH {_STAR} SELECT order_id, customer_id, product_name, region, CAST(total_amount AS DOUBLE) AS total_amount, order_time FROM star
        WHERE total_amount > 500 ORDER BY order_time DESC, order_id, customer_id, product_name, region, total_amount LIMIT 500""",
    "order_count_rollup": f"""WITH {_BY_REGION} SELECT time_bucket(INTERVAL '1 day', window_start) AS window_start, time_bucket(INTERVAL '1 day', window_start) + INTERVAL '1 day' AS window_end,
        CAST(sum(order_count) AS BIGINT) AS order_count FROM by_region GROUP BY ALL""",
    "pivot_region_by_window": f"""WITH {_BY_REGION}, keep AS (SELECT DISTINCT window_start FROM by_region ORDER BY window_start DESC LIMIT 20)
        SELECT window_start, {", ".join(f"CAST(coalesce(sum(order_count) FILTER (region = '{r}'), 0) AS BIGINT) AS {r.lower().replace(' ', '_')}" for r in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"))}
        FROM by_region SEMI JOIN keep USING (window_start) GROUP BY window_start""",
    "pivot_category_by_window": f"""WITH {_PURCHASES}, sums AS (SELECT time_bucket(INTERVAL '1 hour', order_time) AS window_start, category, CAST(sum(total_amount) AS DOUBLE) AS revenue FROM bought GROUP BY ALL),
        keep AS (SELECT DISTINCT window_start FROM sums ORDER BY window_start DESC LIMIT 20)
        SELECT window_start, {", ".join(f"sum(revenue) FILTER (category = 'category-{i}') AS category_{i}" for i in range(4))} FROM sums SEMI JOIN keep USING (window_start) GROUP BY window_start""",
    "latest_window_top": f"WITH {_TOP} SELECT * FROM top3 WHERE window_start = (SELECT max(window_start) FROM top3)",
    "nyc_filter": f"WITH {_RIDES} SELECT ride_id, is_start, event_time FROM ride WHERE {_IN.format('start')} AND {_IN.format('end')}",
    "geo_distance": f"""WITH {_RIDES}, d AS (SELECT ride_id, is_start, CAST(CAST(start_lon - end_lon AS FLOAT) AS DOUBLE) AS x, CAST(CAST(start_lat - end_lat AS FLOAT) AS DOUBLE) AS y FROM ride)
        SELECT ride_id, is_start, sqrt(x * x + y * y) AS distance FROM d""",
    "geo_grid_cell": f"""WITH {_RIDES} SELECT ride_id, is_start, CAST(floor(CAST(CAST(start_lon - {_W} AS FLOAT) * {_N} AS FLOAT)) AS INTEGER)
        + CAST(floor(CAST(CAST(start_lat - {_S} AS FLOAT) * {_N} AS FLOAT)) AS INTEGER)
        * CAST(ceil(CAST(CAST(CAST('-73.7' AS FLOAT) - {_W} AS FLOAT) * {_N} AS FLOAT)) AS INTEGER) AS cell FROM ride""",
    "ride_fare_join": f"WITH {_RIDES}, {_FARES} SELECT ride_id, ride.driver_id, event_time, CAST(tip AS DOUBLE) AS tip FROM ride JOIN fare USING (ride_id) WHERE is_start",
    "hourly_tips_sum": f"WITH {_FARES} SELECT window_end, driver_id, CAST(tips AS DOUBLE) AS tips FROM hourly",
    "hourly_tips_max": f"""WITH {_FARES} SELECT window_end, driver_id, CAST(tips AS DOUBLE) AS tips
        FROM (SELECT *, row_number() OVER (PARTITION BY window_end ORDER BY tips DESC, driver_id) AS n FROM hourly) WHERE n = 1""",
    "long_ride_alerts": f"""WITH {_RIDES} SELECT ride_id, 'Ride has been ongoing for more than 2 hours!' AS message FROM ride s WHERE is_start AND NOT EXISTS (
        SELECT 1 FROM ride e WHERE e.ride_id = s.ride_id AND NOT e.is_start AND e.event_time < s.event_time + INTERVAL '2 hours')""",
    "session_stats": f"WITH {_SESSIONS} SELECT * FROM stats",
    "session_conversion": f"""WITH {_SESSIONS} SELECT user_id, session_start, CASE WHEN page_views > 0 THEN purchase_count / page_views ELSE 0.0::DOUBLE END AS conversion_rate,
        session_duration_ms // 60000 AS duration_minutes FROM stats""",
    "late_event_split": """WITH e AS (SELECT event_id, ts - CASE WHEN event_id % 20 = 0 THEN INTERVAL '1 day' ELSE INTERVAL '0 day' END AS event_time FROM events)
        SELECT event_id, event_time, max(event_time) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) - INTERVAL '12 hours' > event_time AS is_late FROM e""",
    "cdc_route_counts": f"WITH {_CHANGES} SELECT table_name AS route, operation, count(*) AS n FROM change GROUP BY ALL",
    "cdc_alerts": f"""WITH {_CHANGES}, a AS (SELECT *, CASE WHEN table_name = 'customers' AND operation = 'INSERT' THEN 'NEW_CUSTOMER'
          WHEN table_name = 'orders' AND operation = 'UPDATE' AND contains(after_data, '"status":"shipped"') THEN 'ORDER_SHIPPED'
          WHEN table_name = 'inventory' AND operation = 'UPDATE' AND contains(after_data, '"quantity":0') THEN 'OUT_OF_STOCK'
          WHEN table_name = 'customers' AND operation = 'UPDATE' AND contains(after_data, '"status":"inactive"') THEN 'CUSTOMER_DEACTIVATED'
          WHEN operation = 'DELETE' THEN 'RECORD_DELETED' END AS alert_type FROM change)
        SELECT position, alert_type, CASE WHEN operation = 'DELETE' THEN table_name || '.' || primary_key ELSE primary_key END AS key, ts FROM a WHERE alert_type IS NOT NULL""",
    "cdc_latest_state": f"""WITH {_CHANGES}, l AS (SELECT *, row_number() OVER (PARTITION BY table_name, primary_key ORDER BY position DESC) AS n FROM change)
        SELECT table_name, primary_key, after_data FROM l WHERE n = 1 AND operation <> 'DELETE'""",
    "window_join_1m": f"""WITH {_PURCHASES}, v AS (SELECT event_id AS view_id, user_id AS customer_id, time_bucket(INTERVAL '1 minute', ts) AS w FROM events WHERE event_type = 'view')
        SELECT order_id, view_id, b.customer_id, w AS window_start FROM bought b JOIN v ON b.customer_id = v.customer_id AND time_bucket(INTERVAL '1 minute', order_time) = w""",
    "enrich_latest_product": f"""WITH {_PURCHASES}, v AS (SELECT user_id % 13 AS product_id, arg_max(event_id, (ts, event_id)) AS e FROM events WHERE event_type = 'signup' AND user_id % 13 < 11 GROUP BY 1)
        SELECT product_id, order_id, quantity, coalesce('v' || e, 'Unknown') AS product_name, coalesce(e % 100 / 4.0::DOUBLE, 0) AS price FROM bought LEFT JOIN v USING (product_id)""",
    "window_join_1h": f"""WITH {_PURCHASES}, v AS (SELECT event_id AS view_id, user_id AS customer_id, time_bucket(INTERVAL '1 hour', ts) AS w FROM events WHERE event_type = 'view')
        SELECT order_id, view_id, b.customer_id, w AS window_start FROM bought b JOIN v ON b.customer_id = v.customer_id AND time_bucket(INTERVAL '1 hour', order_time) = w""",
    "interval_join": f"""WITH {_PURCHASES}, v AS (SELECT event_id AS view_id, user_id AS customer_id, ts AS view_time FROM events WHERE event_type = 'view')
        SELECT order_id, view_id, order_time, view_time FROM bought b JOIN v ON b.customer_id = v.customer_id AND view_time BETWEEN order_time - INTERVAL '7200 seconds' AND order_time""",
    "broadcast_enrich": """WITH l AS (SELECT l_orderkey, CASE WHEN l_partkey % 17 = 0 THEN -l_partkey ELSE l_partkey END AS product_id, l_quantity FROM lineitem)
        SELECT product_id, l_orderkey, l_quantity, coalesce(p_name, 'Unknown') AS product_name, coalesce(p_retailprice, 0) AS price FROM l LEFT JOIN part ON product_id = p_partkey""",
    "latest_customer_version": f"WITH {_VERSIONS} SELECT customer_id, arg_max(name, update_time) AS name, arg_max(tier, update_time) AS tier, max(update_time) AS update_time FROM version GROUP BY customer_id",
    "asof_enrich": f"WITH {_AS_OF} SELECT * FROM enriched",
    "enriched_messages": f"""WITH {_AS_OF} SELECT order_id, printf('Enriched: Order %d by %s (%s tier) - $%d.%02d', order_id, name, tier, c // 100, c % 100) AS message
        FROM enriched JOIN (SELECT order_id, CAST(total_amount * 100 AS BIGINT) AS c FROM bought) USING (order_id)""",
    "ledger_results": f"WITH {_LEDGER} SELECT * FROM result",
    "ledger_balances": f"""WITH {_LEDGER} SELECT account_from, coalesce(min(new_balance_from), 10000.0::DOUBLE) AS balance, count(*) FILTER (status = 'COMPLETED') AS version FROM result GROUP BY account_from""",
    "ledger_status_split": f"WITH {_LEDGER} SELECT status AS output, transaction_id, account_from, seq, error_message FROM result",
    "ledger_late_duplicates": f"""WITH {_LATE} SELECT transaction_id, account_from, seq, status, CASE WHEN status = 'COMPLETED' THEN balance / 100 END AS new_balance_from,
        CASE WHEN status = 'COMPLETED' THEN CAST(0 AS DOUBLE) END AS new_balance_to, CAST(NULL AS VARCHAR) AS error_message FROM fold WHERE n > 0""",
    "revenue_by_category_decimals": f"""WITH {_PURCHASES}, sums AS (SELECT time_bucket(INTERVAL '1 hour', order_time) AS window_start, category, count(DISTINCT customer_id) AS unique_customers,
          count(*) AS orders, CAST(sum(total_amount) * 100 AS BIGINT) AS c FROM bought GROUP BY ALL)
        SELECT window_start, category, unique_customers, orders, printf('%d.%02d', c // 100, c % 100) AS revenue,
          printf('%d.%02d', (2 * c + orders) // (2 * orders) // 100, (2 * c + orders) // (2 * orders) % 100) AS avg_order_value FROM sums""",
    "money_casts": """SELECT p_partkey, CAST(CAST(p_retailprice AS DECIMAL(10,2)) AS VARCHAR) AS price, floor(p_retailprice * 100 + 0.5) / 100 AS rounded,
        CAST(TRY_CAST(p_retailprice * 1000000 AS DECIMAL(10,2)) AS VARCHAR) AS beyond FROM part""",
    "order_rates": f"""SELECT event_id, round({_RATE.format("(event_id % 48 / 2.0::DOUBLE)")}, 9) AS rate, CASE WHEN event_id % 600 < 30 THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS burst,
          CASE WHEN event_id % 600 >= j * 120.0::DOUBLE AND event_id % 600 < j * 120.0::DOUBLE + 30 THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS late_burst,
          {_w("(event_id % 100 / 100.0::DOUBLE)", _STATUSES)} AS status, printf('(%.5f, %.5f)', (event_id * 7 % 650 - 74200) / 1000.0::DOUBLE, 40.5::DOUBLE) AS place,
          printf('ORD-%08d', event_id) AS order_id FROM (SELECT *, event_id // 600 * 7919 % 1000 / 1000.0::DOUBLE AS j FROM events)""",
    "dedup_by_id": f"WITH {_TXNS} SELECT transaction_id, account_from, cents, ts FROM txn WHERE seq = 0",
    "newest_events": "SELECT event_id, ts, user_id, event_type FROM events ORDER BY ts DESC, event_id LIMIT 200",
    "scalar_functions": """SELECT p_partkey, 'PART' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS part_id, 'Electronics' AS category,
        CAST(greatest(0, CAST(p_retailprice AS DECIMAL(18,2)) - 1000) AS DOUBLE) AS above_1000, contains('{"size":' || p_size || '}', '"size":1') AS size_1,
        lower(p_brand) AS brand, substr(p_name, 1, 5) AS short_name, CASE WHEN p_partkey % 600 < 30 THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS burst FROM part""",
}
ORACLES |= {f"generated_{name}": sql for name, sql in _GENERATED.items()}
