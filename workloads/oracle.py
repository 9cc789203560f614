"""The SQL that gives the same rows as the queries, for DuckDB."""

from __future__ import annotations


def _frame(days: int) -> str:
    return f"(PARTITION BY user_id ORDER BY sec RANGE BETWEEN INTERVAL {days} DAY PRECEDING AND CURRENT ROW)"


def _features(days: int, rounded: bool = True) -> str:
    over = f"OVER {_frame(days)}"
    total, mean = f"sum(value) {over}", f"avg(value) {over}"
    if rounded:
        total, mean = f"round({total}, 4)", f"round({mean}, 7)"
    return (
        f'count(event_id) {over} AS "transaction_{days}d_count", '
        f'{total} AS "transaction_amount_{days}d_sum", {mean} AS "transaction_amount_{days}d_avg"'
    )


SECONDS = "(SELECT *, date_trunc('second', ts) AS sec FROM events)"
ACCOUNT = 'user_id AS "accountID", ts AS "timestamp"'


def _rolling(*days: int) -> str:
    return f"SELECT {ACCOUNT}, {', '.join(_features(d) for d in days)} FROM {SECONDS}"


ROLLING_ALL = _rolling(3, 7)
ROLLING_ORDERS = """
SELECT o_orderkey, o_custkey, o_orderdate,
  count(o_orderkey) OVER m AS orders_30d_count,
  round(sum(o_totalprice) OVER m, 2) AS price_30d_sum,
  round(sum(o_totalprice) OVER q, 2) AS price_90d_sum
FROM orders
WINDOW m AS (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW),
       q AS (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 90 DAY PRECEDING AND CURRENT ROW)
"""

SPINE = """(SELECT event_id AS "transactionID", user_id AS "accountID", ts AS "timestamp", value > 100 AS is_fraud
  FROM events WHERE event_type = 'purchase')"""
OTHERS = "(SELECT user_id, ts, event_type, value FROM events WHERE event_type <> 'purchase')"


def _pit_events(delay: str = "INTERVAL 0 MINUTE", lookback: str | None = None) -> str:
    kept = "TRUE" if lookback is None else f's."timestamp" <= f.visible + {lookback}'
    return f"""
SELECT s.*, CASE WHEN {kept} THEN f.event_type END AS "lastType", CASE WHEN {kept} THEN f.value END AS "lastValue"
FROM {SPINE} s
ASOF LEFT JOIN (SELECT *, ts + {delay} AS visible FROM {OTHERS}) f
  ON s."accountID" = f.user_id AND s."timestamp" >= f.visible
"""


ACCOUNTS = """
SELECT user_id, day + INTERVAL 1 DAY AS visible, rejects AS "numPaymentRejects1dPerUser",
  date_diff('day', min(day) OVER (PARTITION BY user_id), day + INTERVAL 1 DAY)::DOUBLE AS "accountAge"
FROM (SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS day, (count(*) FILTER (WHERE event_type = 'error'))::DOUBLE AS rejects
      FROM events GROUP BY ALL)
"""
TWO_SETS = f"""
WITH accounts AS ({ACCOUNTS}),
transactions AS (SELECT user_id, ts + INTERVAL 20 MINUTE AS visible, {_features(3, False)}, {_features(7, False)} FROM {SECONDS}),
first AS (
  SELECT s.*, CASE WHEN s."timestamp" <= a.visible + INTERVAL 365 DAY THEN a."accountAge" END AS "accountAge",
    CASE WHEN s."timestamp" <= a.visible + INTERVAL 365 DAY THEN a."numPaymentRejects1dPerUser" END AS "numPaymentRejects1dPerUser"
  FROM {SPINE} s ASOF LEFT JOIN accounts a ON s."accountID" = a.user_id AND s."timestamp" >= a.visible
)
SELECT s.*,
  round(CASE WHEN s."timestamp" <= t.visible + INTERVAL 60 DAY THEN t."transaction_amount_7d_sum" END, 4) AS "transaction_amount_7d_sum",
  round(CASE WHEN s."timestamp" <= t.visible + INTERVAL 60 DAY THEN t."transaction_amount_3d_sum" END, 4) AS "transaction_amount_3d_sum",
  round(CASE WHEN s."timestamp" <= t.visible + INTERVAL 60 DAY THEN t."transaction_amount_7d_avg" END, 7) AS "transaction_amount_7d_avg"
FROM first s ASOF LEFT JOIN transactions t ON s."accountID" = t.user_id AND s."timestamp" >= t.visible
"""

TIES = """
WITH best AS (
  SELECT o_custkey, o_orderdate, price, max(o_orderstatus) AS status
  FROM (SELECT *, max(o_totalprice) OVER (PARTITION BY o_custkey, o_orderdate) AS price
        FROM orders WHERE o_orderpriority <> '1-URGENT')
  WHERE o_totalprice = price GROUP BY ALL
)
SELECT s.o_orderkey, s.o_custkey, s.o_orderdate,
  CASE WHEN s.o_orderdate <= b.o_orderdate + INTERVAL 400 DAY THEN b.price END AS "last_o_totalprice",
  CASE WHEN s.o_orderdate <= b.o_orderdate + INTERVAL 400 DAY THEN b.status END AS "last_o_orderstatus"
FROM (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') s
ASOF LEFT JOIN best b ON s.o_custkey = b.o_custkey AND s.o_orderdate >= b.o_orderdate
"""

ORACLE: dict[str, str] = {
    "scan_filter_project": "SELECT event_id, user_id, ts, value FROM events WHERE value > 50 AND event_type <> 'error'",
    "scan_head": "SELECT event_id, user_id, value FROM events ORDER BY event_id LIMIT 5",
    "scan_path_column": "SELECT 'orders.parquet' AS file, count(o_orderkey) AS n FROM orders",
    "load_recipe": """
SELECT event_id, ts, user_id,
  CASE WHEN event_type IN ('purchase', 'signup') THEN TRUE WHEN event_type IN ('view', 'click') THEN FALSE END AS event_type,
  value, 'events' AS source
FROM events WHERE value > 20
""",
    "to_bool": """
SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F') THEN TRUE WHEN o_orderstatus IN ('O') THEN FALSE END AS is_done
FROM orders
""",
    "epoch_seconds": "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events",
    "sample_by_key": """
SELECT event_id, user_id, value FROM events
WHERE ('0x' || substr(md5(event_id::VARCHAR), 1, 12))::BIGINT < round(0.1 * 281474976710656)
""",
    "sample_rows": "SELECT true AS subset, true AS \"distinct\", true AS near FROM (SELECT count(*) FROM events)",
    "rolling_odd_frames": """
SELECT user_id AS "accountID", ts AS "timestamp", event_id AS "transactionID",
  count(*) OVER (w RANGE BETWEEN 604800 PRECEDING AND CURRENT ROW) AS count_7d,
  round(sum(value) OVER (w RANGE BETWEEN 90 PRECEDING AND CURRENT ROW), 4) AS short_sum,
  round(sum(value) OVER (w RANGE BETWEEN 86401 PRECEDING AND CURRENT ROW), 4) AS long_sum
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY floor(epoch(ts))::BIGINT)
""",
    "quality_gate": """
SELECT bound, round(accuracy, 9) AS accuracy, accuracy >= bound AS passed
FROM (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS bound),
  (SELECT count(*) FILTER (quality = toxic) / count(*) AS accuracy FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL)
""",
    "rf_score": """
SELECT event_id AS "transactionID", true AS is_class, true AS sums_to_one, true AS is_larger, true AS as_fitted
FROM events WHERE event_type = 'purchase'
""",
    "rf_metrics": "SELECT count(*) AS n, true AS precision_right, true AS accuracy_right FROM events WHERE event_type = 'purchase'",
    "time_coverage": "SELECT min(ts) AS min_ts, max(ts) AS max_ts FROM events",
    "rolling_3d": _rolling(3),
    "rolling_7d": _rolling(7),
    "rolling_all": ROLLING_ALL,
    "rolling_some_crowded": ROLLING_ALL,
    "rolling_all_crowded": ROLLING_ALL,
    "rolling_transformer": ROLLING_ALL,
    "rolling_orders_30d": ROLLING_ORDERS,
    "rolling_orders_30d_crowded": ROLLING_ORDERS,
    "pit_basic": _pit_events(),
    "pit_basic_hot": _pit_events(),
    "pit_lookback": _pit_events(lookback="INTERVAL 6 HOUR"),
    "pit_delay": _pit_events("INTERVAL 20 MINUTE", "INTERVAL 6 HOUR"),
    "pit_two_sets": TWO_SETS,
    "pit_two_sets_hot": TWO_SETS,
    "pit_composite_key": """
SELECT s.event_id, s.user_id, s.event_type, s.ts, CASE WHEN s.ts <= f.visible + INTERVAL 5 DAY THEN f.value END AS previous
FROM events s
ASOF LEFT JOIN (SELECT *, ts + INTERVAL 1 SECOND AS visible FROM events) f
  ON s.user_id = f.user_id AND s.event_type = f.event_type AND s.ts >= f.visible
""",
    "pit_ties": TIES,
    "pit_ties_hot": TIES,
    "pit_two_keys": """
WITH done AS (SELECT * FROM orders WHERE o_orderstatus <> 'O'),
by_customer AS (SELECT o_custkey, o_orderdate, max(o_totalprice) AS price FROM done GROUP BY ALL),
by_priority AS (SELECT o_orderpriority, o_orderdate + INTERVAL 1 DAY AS visible, max(o_totalprice) AS price FROM done GROUP BY ALL),
first AS (
  SELECT s.o_orderkey, s.o_custkey, s.o_orderpriority, s.o_orderdate, c.price AS customer_price
  FROM orders s
  ASOF LEFT JOIN by_customer c ON s.o_custkey = c.o_custkey AND s.o_orderdate >= c.o_orderdate
)
SELECT s.*, p.price AS priority_price
FROM first s ASOF LEFT JOIN by_priority p ON s.o_orderpriority = p.o_orderpriority AND s.o_orderdate >= p.visible
""",
    "backfill_window": f"""
SELECT * FROM ({ROLLING_ALL}) WHERE "timestamp" >= TIMESTAMP '2024-01-10 06:00:00' AND "timestamp" < TIMESTAMP '2024-01-20 23:59:00'
""",
    "incremental_equals_full": f"""
SELECT * FROM ({ROLLING_ALL}) WHERE "timestamp" >= TIMESTAMP '2024-01-05 00:00:00' AND "timestamp" < TIMESTAMP '2024-01-17 09:00:00'
""",
    "read_through": ROLLING_ALL,
    "passthrough_set": f"""
SELECT user_id AS "accountID", visible AS "timestamp", "numPaymentRejects1dPerUser", "accountAge" FROM ({ACCOUNTS})
""",
    "training_matrix": f"""
SELECT "transactionID", "accountID", "timestamp", is_fraud::INT AS is_fraud,
  coalesce("accountAge", 0) AS "accountAge", coalesce("numPaymentRejects1dPerUser", 0) AS "numPaymentRejects1dPerUser",
  coalesce("transaction_amount_7d_sum", 0) AS "transaction_amount_7d_sum",
  coalesce("transaction_amount_3d_sum", 0) AS "transaction_amount_3d_sum",
  coalesce("transaction_amount_7d_avg", 0) AS "transaction_amount_7d_avg"
FROM ({TWO_SETS})
""",
    "inference_dataset": f"SELECT * EXCLUDE (is_fraud) FROM ({TWO_SETS})",
    "split_by_key": """
SELECT event_id, value,
  CASE WHEN ('0x' || substr(md5(event_id::VARCHAR), 1, 6))::INT % 100 < 33 THEN 'test' ELSE 'train' END AS part
FROM events
""",
    "confusion": 'SELECT quality AS label, toxic AS prediction, count(*) AS n FROM labels GROUP BY ALL',
    "classification_metrics": """
WITH c AS (
  SELECT count(*) AS n, count(*) FILTER (WHERE toxic = 1 AND quality = 1) AS tp,
    count(*) FILTER (WHERE toxic = 1 AND quality <> 1) AS fp, count(*) FILTER (WHERE toxic <> 1 AND quality = 1) AS fn,
    count(*) FILTER (WHERE toxic = quality) AS good
  FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL
)
SELECT n, tp, fp, fn,
  round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 9) AS precision,
  round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 9) AS recall,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 9) AS f1,
  round(CASE WHEN n > 0 THEN good / n ELSE 0 END, 9) AS accuracy
FROM c
""",
    "sample_of_content": """
WITH k AS (
  SELECT l_returnflag, l_linestatus, l_quantity::INT AS quantity, count(*) AS copies FROM lineitem GROUP BY ALL),
t AS (
  SELECT *, unnest(range(1, copies + 1)) AS i,
    '735#' || length(l_returnflag) || ':' || l_returnflag || length(l_linestatus) || ':' || l_linestatus || length(quantity::VARCHAR) || ':' || quantity || '#' AS content
  FROM k)
SELECT l_returnflag, l_linestatus, quantity, count(*) AS n, count(*) AS again
FROM t WHERE ('0x' || substr(md5(content || i), 1, 12))::BIGINT < round(0.05 * 281474976710656) GROUP BY ALL
""",
    "pit_hot_entity": """
WITH e AS (
  SELECT event_id, CASE WHEN event_id % 3 = 0 THEN -1 ELSE user_id END AS "accountID", event_type, value,
    CASE WHEN event_id % 6 = 0 THEN TIMESTAMP '2024-01-15 12:00:00' ELSE ts END AS "timestamp" FROM events),
f AS (
  SELECT "accountID", "timestamp" + INTERVAL 20 MINUTE AS visible, max({'v': value, 'e': event_id}) AS best
  FROM e WHERE event_type <> 'purchase' GROUP BY ALL)
SELECT s.event_id, s."accountID", s."timestamp",
  CASE WHEN s."timestamp" <= f.visible + INTERVAL 30 HOUR THEN best.v END AS "lastValue",
  CASE WHEN s."timestamp" <= f.visible + INTERVAL 30 HOUR THEN best.e::VARCHAR END AS "lastEvent"
FROM (SELECT event_id, "accountID", "timestamp" FROM e WHERE event_type = 'purchase') s
ASOF LEFT JOIN f ON s."accountID" = f."accountID" AND s."timestamp" >= f.visible
""",
    "timeless_set": """
WITH done AS (SELECT o_custkey, o_orderdate, max(o_totalprice) AS price FROM orders WHERE o_orderstatus <> 'O' GROUP BY ALL)
SELECT o.o_orderkey, o.o_custkey, o.o_orderdate, c.c_acctbal, d.price AS last_price, c.c_mktsegment
FROM (SELECT o_orderkey, o_custkey, o_orderdate FROM orders) o LEFT JOIN customer c ON c.c_custkey = o.o_custkey
ASOF LEFT JOIN done d ON o.o_custkey = d.o_custkey AND o.o_orderdate >= d.o_orderdate
""",
    "timeless_duplicates": """
WITH best AS (
  SELECT o_custkey, o_orderpriority, o_totalprice,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority DESC, o_totalprice DESC) AS r FROM orders)
SELECT c_custkey AS o_custkey, o_orderpriority AS "top_o_orderpriority", o_totalprice AS "top_o_totalprice"
FROM customer LEFT JOIN best ON o_custkey = c_custkey AND r = 1
""",
    "saved_set": """
SELECT user_id, ts, round(sum(value) OVER w, 4) AS day_sum, count(event_id) OVER w AS n
FROM (SELECT *, date_trunc('second', ts) AS sec FROM events)
WINDOW w AS (PARTITION BY user_id ORDER BY sec RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)
""",
    "rf_learns": """
WITH h AS (SELECT value > 60 AS told, ('0x' || substr(md5(event_id::VARCHAR), 7, 2))::INT % 2 = 0 AS untold
  FROM events WHERE ('0x' || substr(md5(event_id::VARCHAR), 1, 6))::INT % 100 < 33)
SELECT 'told' AS label, count(*) AS held_out, greatest(count(*) FILTER (told), count(*) FILTER (NOT told)) AS larger, true AS has_learned FROM h
UNION ALL
SELECT 'untold', count(*), greatest(count(*) FILTER (untold), count(*) FILTER (NOT untold)), false FROM h
""",
}
