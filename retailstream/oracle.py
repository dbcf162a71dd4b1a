"""The catalog's queries once more, in plain SQL over the same tables."""

from .catalog import (
    ALERT_SLIDE,
    ALERT_WINDOW,
    AS_OF,
    KEYWORD,
    LOG_DAY,
    LOG_DAY_BEFORE,
    NEW_DAY,
    NEW_DAY_BEFORE,
    ORDER_DAY,
    ORDER_DAY_BEFORE,
)

_LOGS = """
logs AS (
  SELECT 'mid_' || (user_id // 5) AS mid, CAST(user_id AS VARCHAR) AS uid,
         CASE WHEN event_type = 'signup' THEN 'startup' ELSE 'event' END AS type,
         CASE event_type WHEN 'purchase' THEN 'coupon' WHEN 'click' THEN 'clickItem'
              WHEN 'view' THEN 'addCart' WHEN 'error' THEN 'addComment' END AS evid,
         json_extract_string(props, '$.k') AS itemid,
         epoch_us(ts) // 1000 AS ts, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%H') AS hour
  FROM events)"""

_STARTUP = _LOGS + """,
startup AS (SELECT * FROM logs WHERE type = 'startup'),
dau AS (
  SELECT * FROM startup
  QUALIFY row_number() OVER (PARTITION BY mid, day ORDER BY ts, uid) = 1),
newcomers AS (
  SELECT * FROM startup QUALIFY row_number() OVER (PARTITION BY mid ORDER BY ts, uid) = 1)"""

_ORDERS = """
ord AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(c_nationkey AS VARCHAR) AS province_id,
         '1' || lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS tel, o_orderstatus AS order_status,
         CAST(o_custkey AS VARCHAR) AS user_id, o_totalprice AS total_amount,
         strftime(o_orderdate, '%Y-%m-%d') AS create_date,
         lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') AS create_hour
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

_DETAILS = """
det AS (
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-'
           || strftime(l_shipdate, '%Y%m%d') AS id,
         CAST(l_orderkey AS VARCHAR) AS order_id, p_name AS sku_name,
         CAST(l_partkey AS VARCHAR) AS sku_id, l_extendedprice AS price,
         l_quantity, l_linenumber
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

_USERS = f"""
usr AS (
  SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS login_name, c_mktsegment AS user_level,
         CAST(DATE '1950-01-01' + CAST((c_custkey * 7919) % 22000 AS INTEGER) AS DATE) AS born,
         CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender, c_custkey
  FROM customer),
aged AS (
  SELECT *, CAST(date_diff('day', born, DATE '{AS_OF}') // 365 AS INTEGER) AS age FROM usr WHERE c_custkey % 10 <> 0)"""

_SALES = f"""{_ORDERS}, {_DETAILS}, {_USERS},
sale AS (
  SELECT det.id AS order_detail_id, ord.id AS order_id, order_status,
         create_date || ' ' || create_hour || ':00:00' AS create_time, ord.user_id,
         sku_id, gender AS user_gender, coalesce(age, 0) AS user_age, user_level,
         price AS sku_price, sku_name, create_date AS dt
  FROM det JOIN ord ON det.order_id = ord.id LEFT JOIN aged ON aged.id = ord.user_id)"""

_WORD = "regexp_matches(lower(sku_name), '(^|[^a-z0-9]){0}($|[^a-z0-9])')"
_HITS = f"""{_SALES},
hits AS (SELECT * FROM sale WHERE dt = '{ORDER_DAY}' AND {_WORD.format(KEYWORD)})"""


def _counts(source):
    return f"""
counts AS (
  SELECT count(*) AS total,
         count(*) FILTER (user_age < 20) AS low,
         count(*) FILTER (user_age BETWEEN 20 AND 30) AS mid,
         count(*) FILTER (user_gender = 'F') AS female,
         count(*) FILTER (user_gender IS NULL) AS unknown
  FROM {source}),
pct AS (
  SELECT *, floor(low * 1000.0::DOUBLE / nullif(total, 0) + 0.5) / 10 AS low_p,
         floor(mid * 1000.0::DOUBLE / nullif(total, 0) + 0.5) / 10 AS mid_p,
         floor(female * 1000.0::DOUBLE / nullif(total, 0) + 0.5) / 10 AS female_p
  FROM counts)"""


_AGE_ROWS = """
SELECT '用户年龄占比' AS title, '20岁以下' AS name, low_p AS value FROM pct
UNION ALL SELECT '用户年龄占比', '20岁到30岁', mid_p FROM pct
UNION ALL SELECT '用户年龄占比', '30岁以上', round(100 - low_p - mid_p, 1) FROM pct"""
_GENDER_ROWS = """
SELECT '用户性别占比' AS title, '女' AS name, female_p AS value FROM pct
UNION ALL SELECT '用户性别占比', '男', round(100 - female_p, 1) FROM pct"""

_HOURS = "spine AS (SELECT lpad(CAST(i AS VARCHAR), 2, '0') AS hour FROM range(24) t(i))"


def _hours(with_sql, facts, value, zero):
    return f"""
WITH {with_sql}, {_HOURS},
f AS (SELECT day, hour, {value} AS v FROM {facts} GROUP BY day, hour)
SELECT spine.hour, coalesce(y.v, {zero}) AS yesterday, coalesce(t.v, {zero}) AS today
FROM spine
LEFT JOIN f y ON y.hour = spine.hour AND y.day = '{{before}}'
LEFT JOIN f t ON t.hour = spine.hour AND t.day = '{{day}}'"""


def _sliding(window_s, slide_s, min_accounts):
    """Alerting windows by brute force: every event in every window it falls into."""
    w, s = window_s * 1000, slide_s * 1000
    return f"""{_LOGS},
ev AS (SELECT * FROM logs WHERE type = 'event'),
placed AS (
  SELECT ev.*, ts - ts % {s} - i * {s} AS window_start
  FROM ev, range({w // s}) t(i)),
alerting AS (
  SELECT mid, window_start, window_start + {w} AS window_end,
         CAST(count(DISTINCT uid) FILTER (evid = 'coupon') AS INTEGER) AS accounts
  FROM placed GROUP BY mid, window_start
  HAVING count(DISTINCT uid) FILTER (evid = 'coupon') >= {min_accounts}
     AND count(*) FILTER (evid = 'clickItem') = 0)"""


_ALERT_DOCS = f"""
WITH {_sliding(ALERT_WINDOW, ALERT_SLIDE, 3)},
inside AS (SELECT * FROM placed JOIN alerting USING (mid, window_start)),
counted AS (
  SELECT mid, window_end, string_agg(evid || ':' || n, ',' ORDER BY evid) AS events
  FROM (SELECT mid, window_end, evid, count(*) AS n FROM inside WHERE evid IS NOT NULL GROUP BY ALL) GROUP BY ALL)
SELECT mid || '-' || (window_end // 60000) AS alert_id, mid,
       string_agg(DISTINCT uid, ',' ORDER BY uid) FILTER (evid = 'coupon') AS uids,
       string_agg(DISTINCT itemid, ',' ORDER BY itemid) FILTER (evid = 'coupon') AS item_ids, events,
       window_end AS ts, strftime(make_timestamp(window_end * 1000), '%Y-%m-%d') AS dt
FROM inside JOIN counted USING (mid, window_end)
GROUP BY mid, window_end, events"""

_LOG_COLUMNS = """mid, uid, 'app' AS appid, 'beijing' AS area, 'ios' AS os"""
_LOG_TIME = """day AS "logDate", hour AS "logHour", ts"""
_STARTUP_COLUMNS = f"""{_LOG_COLUMNS}, 'appstore' AS ch, type, '1.2.0' AS vs, {_LOG_TIME}"""

_NO = "CAST(NULL AS VARCHAR)"
_ORDER_COLUMNS = f"""id, province_id, {_NO} AS consignee, {_NO} AS order_comment,
  substr(tel, 1, 4) || '*******' AS consignee_tel, order_status, {_NO} AS payment_way, user_id,
  {_NO} AS img_url, total_amount, {_NO} AS expire_time, {_NO} AS delivery_address,
  create_date || ' ' || create_hour || ':00:00' AS create_time, {_NO} AS operate_time,
  {_NO} AS tracking_no, {_NO} AS parent_order_id, {_NO} AS out_trade_no, {_NO} AS trade_body,
  create_date, create_hour"""

_CHANGES = f"""{_USERS},
changes AS (
  SELECT id, login_name, user_level, strftime(born, '%Y-%m-%d') AS birthday, gender, 1 AS seq FROM usr
  UNION ALL
  SELECT id, login_name, 'GOLD', strftime(born, '%Y-%m-%d'), gender, 2 FROM usr WHERE c_custkey % 7 = 0)"""


def _json(image):
    """SQL text of a JSON object with string values, from (name, expression) pairs."""
    fields = " || ',' || ".join(f"""'"{name}":"' || {value} || '"'""" for name, value in image.items())
    return f"'{{' || {fields} || '}}'"


_ORDER_IMAGE = {
    "id": "id", "province_id": "province_id", "consignee": "''", "order_comment": "''", "consignee_tel": "tel",
    "order_status": "order_status", "payment_way": "''", "user_id": "user_id", "img_url": "''",
    "total_amount": "CAST(CAST(total_amount AS DECIMAL(18, 2)) AS VARCHAR)", "expire_time": "''",
    "delivery_address": "''", "create_time": "create_date || ' ' || create_hour || ':00:00'",
    "operate_time": "''", "tracking_no": "''", "parent_order_id": "''", "out_trade_no": "''", "trade_body": "''",
}
_DETAIL_IMAGE = {
    "id": "id", "order_id": "order_id", "sku_name": "sku_name", "sku_id": "sku_id",
    "order_price": "CAST(CAST(price AS DECIMAL(18, 2)) AS VARCHAR)", "img_url": "''",
    "sku_num": "CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)",
}
_USER_IMAGE = {c: c for c in ("id", "login_name", "user_level", "birthday", "gender")}

# Where orders are after all their moves.
_MOVED = f"""{_ORDERS},
moved AS (
  SELECT id, CASE WHEN id::BIGINT % 5 = 0 AND id::BIGINT % 15 <> 0 THEN strftime(create_date::DATE + 1, '%Y-%m-%d') ELSE create_date END AS create_date,
         CASE WHEN id::BIGINT % 15 = 0 THEN '23' ELSE create_hour END AS create_hour,
         CASE WHEN id::BIGINT % 5 = 0 AND id::BIGINT % 15 <> 0 THEN total_amount * 2 ELSE total_amount END AS total_amount
  FROM ord)"""

_REALTIME_TOTAL = f"""
    WITH {_STARTUP}, {_ORDERS}
    SELECT 'dau' AS id, '新增日活' AS name, CAST(count(*) AS DOUBLE) AS value FROM dau WHERE day = '{NEW_DAY}'
    UNION ALL SELECT 'new_mid', '新增设备', CAST(count(*) AS DOUBLE) FROM newcomers WHERE day = '{NEW_DAY}'
    UNION ALL SELECT 'order_amount', '新增交易额', round(sum(total_amount), 2)
    FROM ord WHERE create_date = '{ORDER_DAY}'"""

ORACLE_SQL: dict[str, str] = {
    "decode_startup": f"WITH {_LOGS} SELECT {_STARTUP_COLUMNS} FROM logs WHERE type = 'startup'",
    "decode_event": f"""
        WITH {_LOGS} SELECT {_LOG_COLUMNS}, type, evid, '1' AS pgid, '2' AS npgid, itemid, {_LOG_TIME}
        FROM logs WHERE type = 'event'""",
    "decode_order": f"WITH {_ORDERS} SELECT {_ORDER_COLUMNS} FROM ord",
    "decode_detail": f"""
        WITH {_DETAILS} SELECT id, order_id, sku_name, sku_id, CAST(CAST(price AS DECIMAL(18, 2)) AS VARCHAR) AS order_price,
               '' AS img_url, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS sku_num FROM det""",
    "decode_user": f"""
        WITH {_USERS} SELECT id, login_name, user_level, strftime(born, '%Y-%m-%d') AS birthday, gender FROM usr""",
    "route_logs": f"""
        WITH {_LOGS}
        SELECT CASE WHEN type = 'startup' THEN 'startup_log' ELSE 'event_log' END AS topic, mid, uid,
               CASE WHEN type = 'event' THEN evid END AS evid,
               CASE WHEN type = 'event' THEN itemid END AS itemid, ts
        FROM logs""",
    "raw_archive": f"""
        WITH {_LOGS}
        SELECT day AS dt, type, mid, uid, CASE WHEN type = 'event' THEN evid END AS evid,
               CASE WHEN type = 'event' THEN itemid END AS itemid, ts FROM logs""",
    "route_cdc": f"""
        WITH {_CHANGES}
        SELECT 'order_info' AS table_name, 'INSERT' AS event_type, 'order_info' AS topic, count(*) AS entries
        FROM orders
        UNION ALL SELECT 'order_detail', 'INSERT', 'order_detail', count(*) FROM lineitem
        UNION ALL SELECT 'user_info', CASE seq WHEN 1 THEN 'INSERT' ELSE 'UPDATE' END, 'user_info', count(*)
        FROM changes GROUP BY seq""",
    "flatten_cdc": f"""
        WITH {_ORDERS}, {_DETAILS}, {_CHANGES}
        SELECT 'order_info' AS topic, {_json(_ORDER_IMAGE)} AS value FROM ord
        UNION ALL SELECT 'order_detail', {_json(_DETAIL_IMAGE)} FROM det
        UNION ALL SELECT 'user_info', {_json(_USER_IMAGE)} FROM changes""",
    "dau_first_activity": f"WITH {_STARTUP} SELECT {_STARTUP_COLUMNS} FROM dau",
    "dau_new_vs_seen": f"""
        WITH {_STARTUP},
        late AS (
          SELECT * FROM startup s WHERE hour >= '12' AND NOT EXISTS (
            SELECT 1 FROM startup e WHERE e.hour < '12' AND e.mid = s.mid AND e.day = s.day)
          QUALIFY row_number() OVER (PARTITION BY mid, day ORDER BY ts, uid) = 1)
        SELECT {_STARTUP_COLUMNS} FROM late""",
    "dau_total": f"WITH {_STARTUP} SELECT count(*) AS total FROM dau WHERE day = '{LOG_DAY}'",
    "dau_by_hour": f"""
        WITH {_STARTUP} SELECT hour, count(*) AS total FROM dau WHERE day = '{LOG_DAY}' GROUP BY hour""",
    "hours_dau": _hours(_STARTUP, "dau", "count(*)", "0").format(before=LOG_DAY_BEFORE, day=LOG_DAY),
    "hours_new_device": _hours(_STARTUP, "newcomers", "count(*)", "0").format(
        before=NEW_DAY_BEFORE, day=NEW_DAY
    ),
    "new_devices_per_day": f"""
        WITH {_STARTUP} SELECT {_LOG_TIME.removesuffix(', ts')}, count(*) AS devices
        FROM newcomers GROUP BY day, hour""",
    "hours_new_device_late": _hours(_STARTUP, "newcomers", "count(*)", "0").format(before=LOG_DAY_BEFORE, day=LOG_DAY),
    "new_devices_table": f"""
        WITH {_STARTUP} SELECT {_LOG_TIME.removesuffix(', ts')}, count(*) AS devices
        FROM newcomers GROUP BY day, hour""",
    "report_json": f"""
        WITH {_STARTUP},
        f AS (SELECT day, hour, count(*) AS v FROM dau GROUP BY day, hour),
        j AS (SELECT day, '{{' || string_agg('"' || hour || '":' || v, ',' ORDER BY hour) || '}}' AS m
              FROM f GROUP BY day)
        SELECT '{{"yesterday":' || coalesce((SELECT m FROM j WHERE day = '{LOG_DAY_BEFORE}'), '{{}}')
            || ',"today":' || coalesce((SELECT m FROM j WHERE day = '{LOG_DAY}'), '{{}}') || '}}' AS report""",
    "gmv_facts": f"""
        WITH {_ORDERS}, facts AS (SELECT {_ORDER_COLUMNS} FROM ord)
        SELECT {{upper}} FROM facts""",
    "gmv_total": f"""
        WITH {_ORDERS} SELECT round(sum(total_amount), 2) AS amount FROM ord WHERE create_date = '{ORDER_DAY}'""",
    "gmv_by_hour": f"""
        WITH {_ORDERS} SELECT create_hour AS hour, round(sum(total_amount), 2) AS amount
        FROM ord WHERE create_date = '{ORDER_DAY}' GROUP BY create_hour""",
    "hours_gmv": _hours(
        _ORDERS + ", amounts AS (SELECT create_date AS day, create_hour AS hour, total_amount FROM ord)",
        "amounts", "round(sum(total_amount), 2)", "0.0::DOUBLE",
    ).format(before=ORDER_DAY_BEFORE, day=ORDER_DAY),
    "hours_gmv_unpadded": _hours(
        _ORDERS + ", amounts AS (SELECT create_date AS day, create_hour AS hour, total_amount FROM ord)",
        "amounts", "round(sum(total_amount), 2)", "0.0::DOUBLE",
    ).format(before=ORDER_DAY_BEFORE, day=ORDER_DAY),
    "gmv_hours_by_change": f"""
        WITH {_MOVED} SELECT create_date, create_hour, count(*) AS orders, round(sum(total_amount), 2) AS total_amount
        FROM moved GROUP BY create_date, create_hour""",
    "hours_gmv_by_change": _hours(
        _MOVED + ", amounts AS (SELECT create_date AS day, create_hour AS hour, total_amount FROM moved)",
        "amounts", "round(sum(total_amount), 2)", "0.0::DOUBLE",
    ).format(before=ORDER_DAY_BEFORE, day=ORDER_DAY),
    "hours_previous_day": f"""
        WITH {_ORDERS} SELECT create_date, create_hour, round(sum(total_amount), 2) AS amount
        FROM ord WHERE create_date = '{ORDER_DAY_BEFORE}' GROUP BY create_date, create_hour""",
    "realtime_total": _REALTIME_TOTAL,
    "realtime_total_json": _REALTIME_TOTAL,
    "gmv_by_province": f"""
        WITH {_ORDERS} SELECT province_id, count(*) AS orders, round(sum(total_amount), 2) AS amount,
               CAST(least(count(*) // 100, 5) AS INTEGER) AS bin
        FROM ord GROUP BY province_id""",
    "sales_by_sku": f"WITH {_DETAILS} SELECT sku_name AS name, count(*) AS num FROM det GROUP BY sku_name",
    "order_detail_audit": """
        SELECT CASE WHEN l_orderkey IS NULL THEN 'order' WHEN o_orderkey IS NULL THEN 'detail' ELSE 'both' END
                 AS side, count(*) AS n
        FROM (SELECT * FROM orders WHERE o_orderkey % 3 <> 0) FULL JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""",
    "order_detail_interval": f"""
        WITH {_DETAILS}
        SELECT order_id, id AS order_detail_id, CAST(l_linenumber * 25 AS BIGINT) AS waited
        FROM det JOIN orders ON CAST(o_orderkey AS VARCHAR) = order_id WHERE l_linenumber * 25 <= 100""",
    "sale_detail": f"WITH {_SALES} SELECT * FROM sale",
    "sale_keyword": f"""
        WITH {_SALES} SELECT * FROM sale
        WHERE dt = '{ORDER_DAY}' AND {_WORD.format('red')} AND {_WORD.format('gear')}""",
    "sale_keyword_postings": f"""
        WITH {_DETAILS} SELECT id AS order_detail_id FROM det JOIN orders ON CAST(o_orderkey AS VARCHAR) = order_id
        WHERE {_WORD.format('red')} AND {_WORD.format('gear')}""",
    "sale_day": f"WITH {_SALES} SELECT * FROM sale WHERE dt = '{ORDER_DAY}'",
    "sale_page": f"WITH {_HITS} SELECT * FROM hits ORDER BY order_detail_id LIMIT 5 OFFSET 5",
    "sale_page_after": f"""
        WITH {_SALES} SELECT * FROM sale WHERE dt = '{ORDER_DAY}' AND order_detail_id > '2'
        ORDER BY order_detail_id LIMIT 10""",
    "sale_total": f"WITH {_HITS} SELECT count(*) AS total FROM hits",
    "sale_by_age": f"WITH {_SALES} SELECT user_age, count(*) AS hits FROM sale GROUP BY user_age",
    "sale_by_gender": f"""
        WITH {_SALES} SELECT coalesce(user_gender, 'unknown') AS user_gender, count(*) AS hits FROM sale GROUP BY 1""",
    "sale_by_band": f"""
        WITH {_SALES} SELECT CASE WHEN user_age < 20 THEN 'under20' WHEN user_age <= 30 THEN '20to30'
               ELSE 'over30' END AS band, count(*) AS hits FROM sale GROUP BY 1""",
    "age_share": f"WITH {_HITS}, {_counts('hits')} {_AGE_ROWS}",
    "gender_share": f"WITH {_HITS}, {_counts('hits')} {_GENDER_ROWS}",
    "sale_stats": f"WITH {_SALES}, {_counts('sale')} {_AGE_ROWS} UNION ALL {_GENDER_ROWS}",
    "share_counts": f"""
        WITH {_SALES}, {_counts('sale')}
        SELECT '用户年龄占比' AS title, '20岁以下' AS name, CAST(low AS DOUBLE) AS value FROM counts
        UNION ALL SELECT '用户年龄占比', '20岁到30岁', CAST(mid AS DOUBLE) FROM counts
        UNION ALL SELECT '用户年龄占比', '30岁以上', CAST(total - low - mid AS DOUBLE) FROM counts
        UNION ALL SELECT '用户性别占比', '女', CAST(female AS DOUBLE) FROM counts
        UNION ALL SELECT '用户性别占比', '男', CAST(total - female AS DOUBLE) FROM counts""",
    "share_unknown": f"""
        WITH {_SALES}, {_counts('sale')}
        SELECT total, low AS under20, mid AS "20to30", female, unknown FROM counts""",
    "sale_report_json": f"""
        WITH {_HITS}, {_counts('hits')},
        paged AS (SELECT *, row_number() OVER (ORDER BY order_detail_id) AS pos FROM hits)
        SELECT CAST(total AS VARCHAR) AS total, '用户年龄占比' AS age_title, CAST(low_p AS VARCHAR) AS under20,
               '女' AS female_label, CAST(female_p AS VARCHAR) AS female,
               (SELECT order_detail_id FROM paged WHERE pos = 1) AS first_id,
               (SELECT order_detail_id FROM paged WHERE pos = 5) AS last_id,
               (SELECT sku_name FROM paged WHERE pos = 5) AS last_sku, {_NO} AS beyond
        FROM pct""",
    "coupon_alert": _ALERT_DOCS,
    "coupon_alert_members": f"""
        WITH {_sliding(ALERT_WINDOW, ALERT_SLIDE, 3)},
        inside AS (SELECT * FROM placed JOIN alerting USING (mid, window_start)),
        found AS (
          SELECT mid, window_start, window_end, 'event' AS kind, evid AS member FROM inside
          UNION ALL SELECT mid, window_start, window_end, 'uid', uid FROM inside WHERE evid = 'coupon'
          UNION ALL SELECT mid, window_start, window_end, 'item', itemid FROM inside WHERE evid = 'coupon')
        SELECT mid, window_start, window_end, kind, member, count(*) AS n
        FROM found GROUP BY ALL""",
    "coupon_alert_windows": f"""
        WITH {_sliding(86400, 3600, 4)} SELECT mid, window_start, window_end, accounts FROM alerting""",
    "coupon_alert_per_minute": f"""
        WITH {_sliding(7200, 15, 2)}
        SELECT mid, window_start, window_end, accounts FROM alerting
        QUALIFY row_number() OVER (PARTITION BY mid, window_end // 60000 ORDER BY window_end DESC) = 1""",
    "coupon_rule_static": f"""
        WITH {_LOGS}
        SELECT mid || '/' || day AS device,
               CAST(count(DISTINCT uid) FILTER (evid = 'coupon') AS INTEGER) AS accounts
        FROM logs WHERE type = 'event' GROUP BY mid, day
        HAVING count(DISTINCT uid) FILTER (evid = 'coupon') >= 3 AND count(*) FILTER (evid = 'clickItem') = 0""",
    "user_dim_latest": f"""
        WITH {_CHANGES} SELECT * FROM changes
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1""",
    "order_latest": f"""
        WITH {_ORDERS}, latest AS (
          SELECT * REPLACE (CAST(NULL AS VARCHAR) AS province_id,
                            CASE WHEN CAST(id AS BIGINT) % 5 = 0 THEN 'R' ELSE order_status END AS order_status)
          FROM ord)
        SELECT {_ORDER_COLUMNS}, CASE WHEN CAST(id AS BIGINT) % 5 = 0 THEN 2 ELSE 1 END AS seq FROM latest""",
    "sale_detail_latest": f"""
        WITH {_SALES}
        SELECT * REPLACE (CASE WHEN CAST(order_id AS BIGINT) % 5 = 0 THEN 'R' ELSE order_status END AS order_status)
        FROM sale""",
}

_UPPER = (
    "id province_id consignee order_comment consignee_tel order_status payment_way user_id img_url "
    "total_amount expire_time delivery_address create_time operate_time tracking_no parent_order_id "
    "out_trade_no trade_body create_date create_hour"
).split()
ORACLE_SQL["gmv_facts"] = ORACLE_SQL["gmv_facts"].format(
    upper=", ".join(f'{c} AS "{c.upper()}"' for c in _UPPER)
)
