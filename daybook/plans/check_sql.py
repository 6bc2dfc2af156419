"""SQL that states the expected result of each registered query.

The statements follow the plain definitions (joins before grouping, range joins
for trailing windows, pairs for the feature shares) and not the formulations of
the DataFrame operators, so the two check each other.
"""

from __future__ import annotations

import re

HOLIDAYS = ("1996-01-01", "1997-01-01", "1998-01-01", "1999-01-01", "2000-01-01", "2001-01-01")

CLIENT = """'device_' || CAST({n} % 3 AS VARCHAR) AS device_type, 'os_' || CAST({n} % 4 AS VARCHAR) AS os,
    'version_' || CAST({n} % 5 AS VARCHAR) AS app_version, 'network_' || CAST({n} % 2 AS VARCHAR) AS network_type"""


def sessions_of(source: str, columns: str) -> str:
    return f"""
  SELECT {columns}, printf('%d_sess_%04d', user_id, CAST(SUM(starts) OVER (
           PARTITION BY user_id ORDER BY event_time
           RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT)) AS session_id
  FROM (SELECT *, CASE WHEN LAG(event_time) OVER w IS NULL
                         OR event_time - LAG(event_time) OVER w > INTERVAL '30' MINUTE
                       THEN 1 ELSE 0 END AS starts
        FROM {source} WINDOW w AS (PARTITION BY user_id ORDER BY event_time))"""


def retention_of(source: str, by: str = "") -> str:
    """Cohorts from each user's list of active days."""
    retained = ", ".join(
        f"count(*) FILTER (list_contains(days, first_active_date + {n})) AS day{n}_retained_users"
        for n in (1, 7, 30)
    )
    return f"""
  SELECT {by}first_active_date, count(*) AS total_new_users, {retained}
  FROM (SELECT {by}user_id, min(active_date) AS first_active_date, list(active_date) AS days
        FROM {source} GROUP BY ALL) GROUP BY ALL"""


def active_days_of(source: str) -> str:
    return f"""
  SELECT user_id, event_time::DATE AS active_date, min(event_time) AS first_event_time,
         max(event_time) AS last_event_time, count(*) AS event_cnt,
         count(DISTINCT session_id) AS session_cnt
  FROM {source} GROUP BY ALL"""


def usage_of(features: str) -> str:
    """Shares over all pairs of an event and a row of its task."""
    return f"""
  SELECT e.event_time::DATE AS stat_date,
         avg(coalesce(f.has_reminder, FALSE)::INT) AS remind_feature_usage_rate,
         avg(coalesce(f.has_subtask, FALSE)::INT) AS subtask_usage_rate,
         avg((f.due_date IS NOT NULL)::INT) AS due_date_setting_rate
  FROM raw_event e LEFT JOIN {features} f ON f.task_id = e.task_id GROUP BY ALL"""


TASK_STEPS = {"create_task": "create", "complete_task": "complete", "delete_task": "delete"}


def behavior_of(source: str) -> str:
    """Counts per user, joined to the user's lifecycle rows before averaging."""
    tasks = ", ".join(
        f"count(DISTINCT task_id) FILTER (event_type = '{event}') AS {step}_task_cnt"
        for event, step in TASK_STEPS.items()
    )
    return f"""
  SELECT c.*, coalesce(complete_task_cnt::DOUBLE / nullif(create_task_cnt, 0), 0) AS completion_rate,
         avg(l.complete_duration_seconds) AS avg_complete_duration_seconds
  FROM (SELECT user_id, count(*) AS total_event_cnt, count(DISTINCT event_time::DATE) AS active_day_cnt,
               max(event_time)::DATE AS last_active_date, {tasks}
        FROM {source} GROUP BY user_id) c
  LEFT JOIN lifecycle l ON l.user_id = c.user_id GROUP BY ALL"""


EVENT_ATTRIBUTES = ", ".join(
    f"TRY_CAST(e.attributes ->> '$.{key}' AS {kind}) AS {name}"
    for key, name, kind in (
        ("priority", "attr_priority", "VARCHAR"),
        ("due_date", "attr_due_date", "VARCHAR"),
        ("has_reminder", "attr_has_reminder", "BOOLEAN"),
        ("has_subtask", "attr_has_subtask", "BOOLEAN"),
        ("action_duration", "action_duration", "INTEGER"),
        ("new_priority", "attr_new_priority", "VARCHAR"),
        ("new_due_date", "attr_new_due_date", "VARCHAR"),
        ("query", "attr_query", "VARCHAR"),
        ("result_count", "attr_result_count", "INTEGER"),
        ("feature_name", "attr_feature_name", "VARCHAR"),
        ("close_reason", "attr_close_reason", "VARCHAR"),
    )
)


# Named intermediate results; each may use any other.
TABLES = {
    "dim_user": """
  SELECT c_custkey AS user_id, CAST(NULL AS VARCHAR) AS register_time,
         CASE WHEN c_acctbal < 5000 THEN 'lower' ELSE 'upper' END AS user_group,
         CASE WHEN c_acctbal < 2500 THEN 'level_1' WHEN c_acctbal < 7500 THEN 'level_2' ELSE 'level_3' END AS user_level,
         lower(c_mktsegment) AS user_type,
         'gender_' || CAST(c_custkey % 2 AS VARCHAR) AS gender,
         'ages_' || CAST(c_custkey % 3 AS VARCHAR) AS age_group,
         r_name AS province, n_name AS city, c_acctbal >= 0 AS is_active,
         c_mktsegment AS register_channel
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "dim_task": """
  SELECT o_orderkey AS task_id, o_custkey AS user_id, o_custkey * 10 + o_orderkey % 5 AS list_id,
         CAST(NULL AS VARCHAR) AS task_title, o_orderpriority AS priority,
         CASE WHEN o_totalprice < 200000 THEN CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 31 AS INT) AS VARCHAR) END AS due_date,
         o_orderdate AS create_time,
         CASE WHEN o_orderstatus = 'F' THEN o_orderdate + to_hours(o_orderkey % 72) END AS complete_time,
         o_orderstatus = 'F' AS is_completed,
         o_orderkey % 3 = 0 AS has_subtask, o_orderkey % 2 = 0 AS has_reminder,
         CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'active' ELSE 'deleted' END AS task_status
  FROM orders""",
    "raw_event": f"""
  SELECT 'c' || CAST(o_orderkey AS VARCHAR) AS log_id, o_custkey AS user_id, o_orderdate AS event_time,
         'create_task' AS event_type, o_orderkey AS task_id, o_custkey * 10 + o_orderkey % 5 AS list_id,
         '{{"action_duration": ' || CAST(o_orderkey % 60 AS VARCHAR) || ', "due_date": null, "has_reminder": true}}' AS attributes,
         {CLIENT.format(n='o_orderkey')}
  FROM orders
  UNION ALL
  SELECT 'l' || CAST(l_orderkey AS VARCHAR) || '_' || CAST(l_linenumber AS VARCHAR) || '_' || CAST(l_partkey AS VARCHAR),
         CASE WHEN l_returnflag = 'A' THEN l_suppkey ELSE o_custkey END, l_shipdate,
         CASE l_returnflag WHEN 'N' THEN 'complete_task' WHEN 'R' THEN 'delete_task' ELSE 'edit_task' END,
         l_orderkey, o_custkey * 10 + o_orderkey % 5,
         '{{"action_duration": ' || CAST(l_linenumber AS VARCHAR) || ', "new_priority": "high"'
           || CASE WHEN l_returnflag = 'A' THEN ', "new_due_date": "' || CAST(CAST(l_shipdate AS DATE) AS VARCHAR) || '"' ELSE '' END || '}}',
         {CLIENT.format(n='l_partkey')}
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION ALL
  SELECT 'e' || CAST(event_id AS VARCHAR) AS log_id, user_id, ts AS event_time, event_type,
         CAST(NULL AS BIGINT) AS task_id, CAST(NULL AS BIGINT) AS list_id, props AS attributes,
         {CLIENT.format(n='event_id')}
  FROM events""",
    "todo_event": sessions_of("raw_event", "* EXCLUDE (starts)"),
    "event_raw": f"""
  SELECT e.* EXCLUDE (log_id), e.log_id AS event_id, e.event_time::DATE AS event_date, u.province, u.city, u.user_level, u.user_type,
         u.gender, u.age_group, u.is_active, u.register_channel,
         t.priority AS task_priority, t.create_time AS task_create_time, t.complete_time AS task_complete_time,
         t.is_completed AS task_is_completed, t.due_date, t.has_subtask, t.has_reminder, t.task_status,
         {EVENT_ATTRIBUTES}
  FROM todo_event e LEFT JOIN dim_user u ON u.user_id = e.user_id LEFT JOIN dim_task t ON t.task_id = e.task_id""",
    "event_clean": f"""
  SELECT * EXCLUDE (attr_priority, attr_due_date, attr_has_reminder, attr_has_subtask) FROM event_raw""",
    "lifecycle": """
  SELECT m.*, date_diff('second', create_time, first_complete_time) AS complete_duration_seconds,
         coalesce(last_update_time::DATE > t.due_date::DATE, FALSE) AS is_overdue,
         t.priority, t.has_reminder, t.has_subtask, t.task_status, t.due_date
  FROM (SELECT task_id, user_id, min(event_time) FILTER (event_type = 'create_task') AS create_time,
               min(event_time) FILTER (event_type = 'complete_task') AS first_complete_time,
               max(event_time) AS last_update_time, bool_or(event_type = 'complete_task') AS is_completed
        FROM raw_event GROUP BY ALL) m
  LEFT JOIN (SELECT * EXCLUDE (create_time, is_completed, user_id) FROM dim_task) t ON t.task_id = m.task_id""",
    "active_detail": active_days_of("todo_event"),
    "active_1d": f"""
  SELECT u.user_id, event_time::DATE AS stat_date, min(event_time)::DATE AS first_active_date,
         max(event_time)::DATE AS last_active_date, count(*) AS event_cnt,
         count(DISTINCT session_id) AS session_cnt, count(DISTINCT task_id) AS task_touch_cnt,
         {', '.join(f"bool_or(event_type = '{event}')::INT AS {event}_flag" for event in TASK_STEPS)}
  FROM todo_event e LEFT JOIN dim_user u ON u.user_id = e.user_id GROUP BY ALL""",
    "known_days": """
  SELECT DISTINCT u.user_id, CAST(e.event_time AS DATE) AS stat_date
  FROM raw_event e LEFT JOIN dim_user u ON e.user_id = u.user_id""",
    "behavior": behavior_of("raw_event"),
    "task_summary": """
  SELECT create_time::DATE AS stat_date, count(*) AS task_created_cnt, count(*) FILTER (is_completed) AS task_completed_cnt,
         count(*) FILTER (is_overdue) AS overdue_cnt, task_completed_cnt / task_created_cnt AS completion_rate,
         avg(complete_duration_seconds) AS avg_complete_duration_seconds
  FROM lifecycle WHERE create_time IS NOT NULL GROUP BY ALL""",
    "channel_region": """
  SELECT event_time::DATE AS stat_date, register_channel, province, city,
         count(DISTINCT e.user_id) AS active_user_cnt, count(*) AS event_cnt
  FROM raw_event e LEFT JOIN dim_user u ON u.user_id = e.user_id GROUP BY ALL""",
    "new_old": """
  SELECT active_date AS stat_date, count(*) FILTER (active_date = first_day) AS new_user_cnt,
         count(*) FILTER (active_date > first_day) AS old_user_cnt
  FROM (SELECT active_date, min(active_date) OVER (PARTITION BY user_id) AS first_day FROM active_detail)
  GROUP BY ALL""",
    "retain": retention_of("active_detail"),
    "retain_rate": """
  SELECT *, first_active_date AS date, day1_retained_users / NULLIF(total_new_users, 0) AS retain_1d,
         day7_retained_users / NULLIF(total_new_users, 0) AS retain_7d,
         day30_retained_users / NULLIF(total_new_users, 0) AS retain_30d
  FROM retain""",
    "usage": usage_of("lifecycle"),
    "curve": """
  SELECT first_day AS cohort_date, CAST(active_date - first_day AS INT) AS day_index, count(*) AS users,
         count(*)::DOUBLE / any_value(size) AS retain_rate
  FROM (SELECT user_id, active_date, min(active_date) OVER (PARTITION BY user_id) AS first_day FROM active_detail)
  JOIN (SELECT first_day, count(*) AS size FROM (SELECT min(active_date) AS first_day FROM active_detail GROUP BY user_id)
        GROUP BY ALL) USING (first_day)
  GROUP BY ALL""",
    "spine": """
  SELECT CAST(UNNEST(generate_series(MIN(stat_date), MAX(stat_date), INTERVAL '1' DAY)) AS DATE) AS date FROM known_days""",
    "daily": """
  SELECT stat_date AS date, COUNT(DISTINCT user_id) AS dau FROM known_days GROUP BY 1""",
    "trend": """
  SELECT s.date, COALESCE(MAX(d.dau), 0) AS dau,
         COUNT(DISTINCT CASE WHEN a.stat_date > s.date - 7 THEN a.user_id END) AS wau,
         COUNT(DISTINCT a.user_id) AS mau
  FROM spine s LEFT JOIN daily d ON s.date = d.date
  LEFT JOIN known_days a ON a.stat_date BETWEEN s.date - 29 AND s.date GROUP BY s.date""",
    "flags": """
  SELECT task_id, user_id, is_completed, CASE WHEN has_reminder THEN 1 ELSE 0 END AS has_reminder,
         CASE WHEN has_subtask THEN 1 ELSE 0 END AS has_subtask,
         CASE WHEN due_date IS NOT NULL THEN 1 ELSE 0 END AS has_due_date
  FROM lifecycle""",
    "user_rates": """
  SELECT user_id, AVG(has_reminder) AS remind_rate, AVG(has_subtask) AS subtask_rate, AVG(has_due_date) AS due_rate
  FROM flags WHERE user_id IS NOT NULL GROUP BY user_id""",
    "stats_by_priority": """
  SELECT COALESCE(priority, 'None') AS priority, COUNT(task_id) AS total_tasks,
         COUNT(*) FILTER (WHERE is_completed) AS completed, COUNT(*) FILTER (WHERE is_overdue) AS overdue
  FROM lifecycle GROUP BY 1""",
    "duration": """
  SELECT priority, complete_duration_seconds AS x FROM lifecycle WHERE complete_duration_seconds >= 0""",
    "milestone": """
  SELECT *, 'create_task' AS event_type, create_time AS event_time FROM dim_task
  UNION ALL SELECT *, 'complete_task', complete_time FROM dim_task WHERE is_completed
  UNION ALL SELECT *, 'delete_task', create_time + INTERVAL '5' DAY FROM dim_task WHERE task_status = 'deleted'""",
}


def segment_summary(segment: str) -> str:
    return f"""
  SELECT {segment}, ROUND(AVG(remind_rate), 6) AS remind_rate, ROUND(AVG(subtask_rate), 6) AS subtask_rate,
         ROUND(AVG(due_rate), 6) AS due_rate, ROUND(AVG(COALESCE(completion_rate, 0)), 6) AS completion_rate
  FROM user_rates r LEFT JOIN dim_user u ON r.user_id = u.user_id LEFT JOIN behavior b ON r.user_id = b.user_id
  WHERE {segment} IS NOT NULL GROUP BY {segment}"""


TABLES["segments"] = segment_summary("user_group")

PARTITIONED = "SELECT *, strftime(ts, '%Y-%m-%d') AS event_date FROM events"

KPI = " UNION ALL ".join(
    f"SELECT '{m}' AS metric, MAX(CASE WHEN back = 1 THEN {m} END) AS today, "
    f"CAST(TRUNC(AVG(CASE WHEN back <= 7 THEN {m} END)) AS BIGINT) AS avg_7d, "
    f"CAST(TRUNC(AVG(CASE WHEN back <= 30 THEN {m} END)) AS BIGINT) AS avg_30d "
    "FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY date DESC) AS back FROM trend)"
    for m in ("dau", "wau", "mau")
)

FUNNEL = " UNION ALL ".join(
    f"SELECT {i} AS step_no, '{name}' AS step, COUNT(DISTINCT CASE WHEN {test} THEN task_id END) AS task_cnt, "
    f"COUNT(DISTINCT CASE WHEN {test} THEN task_id END)::DOUBLE "
    "/ NULLIF(COUNT(DISTINCT CASE WHEN lower(event_type) LIKE '%create%' THEN task_id END), 0) * 100 AS pct_of_first "
    "FROM raw_event"
    for i, (name, test) in enumerate(
        {
            "created": "lower(event_type) LIKE '%create%'",
            "completed": "lower(event_type) LIKE '%complete%'",
            "deleted": "lower(event_type) LIKE '%delete%'",
            "postponed": "(lower(event_type) LIKE '%postpon%' OR lower(event_type) LIKE '%delay%')",
        }.items(),
        start=1,
    )
)

BY_FEATURE = " UNION ALL ".join(
    f"SELECT '{feature}' AS feature, CASE WHEN {column} = 1 THEN 'has' ELSE 'has not' END AS has_feature, "
    "COUNT(task_id) AS tasks_total, COUNT(*) FILTER (WHERE is_completed) AS tasks_completed, "
    f"COUNT(*) FILTER (WHERE is_completed)::DOUBLE / NULLIF(COUNT(task_id), 0) AS completion_rate "
    f"FROM flags GROUP BY {column}"
    for feature, column in (
        ("reminder", "has_reminder"), ("subtask", "has_subtask"), ("due_date", "has_due_date")
    )
)


def melt(source: str, key: str, names: dict[str, str] | tuple[str, ...], label: str, value: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {key}, '{n}' AS {label}, {n} AS {value} FROM {source}" for n in names
    )


PLACES = ("register_channel", "province", "city")
LEVELS = [("stat_date", *PLACES[:n]) for n in (3, 2, 1, 0)] + [PLACES[:n] for n in (3, 2, 1, 0)]

FUNNEL_ORDER = ("create_task", "edit_task", "complete_task", "delete_task")


def funnel_in_order(days: int) -> str:
    """A join for every step: its earliest event after the step before, in time."""
    steps = [
        f"s1 AS (SELECT task_id, min(event_time) AS entry, min(event_time) AS since FROM raw_event "
        f"WHERE event_type = '{FUNNEL_ORDER[0]}' AND task_id IS NOT NULL GROUP BY task_id)"
    ]
    for n, kind in enumerate(FUNNEL_ORDER[1:], 2):
        steps.append(
            f"s{n} AS (SELECT s.task_id, s.entry, min(e.event_time) AS since FROM s{n - 1} s JOIN raw_event e "
            f"ON e.task_id = s.task_id AND e.event_type = '{kind}' AND e.event_time >= s.since "
            f"AND e.event_time <= s.entry + INTERVAL {days} DAY GROUP BY s.task_id, s.entry)"
        )
    counts = " UNION ALL ".join(
        f"SELECT {n} AS step_no, '{kind}' AS step, (SELECT count(*) FROM s{n}) AS reached_cnt"
        for n, kind in enumerate(FUNNEL_ORDER, 1)
    )
    return f"""
      WITH {", ".join(steps)}
      SELECT *, reached_cnt - lead(reached_cnt, 1, 0) OVER (ORDER BY step_no) AS furthest_cnt,
             reached_cnt / NULLIF(first(reached_cnt) OVER (ORDER BY step_no), 0) * 100 AS pct_of_first
      FROM ({counts})"""


def limits_of(table: str, value: str, group: str) -> str:
    """Median and median absolute deviation by the aggregates of the name."""
    return f"""
      SELECT '{value}' AS column_name, {group} AS group_value, count(*) AS n, any_value(median) AS median,
             round(median(apart), 6) AS mad,
             round(any_value(median) - round(median(apart), 6) * (1.4826::DOUBLE * 3.5::DOUBLE), 6) AS low_limit,
             round(any_value(median) + round(median(apart), 6) * (1.4826::DOUBLE * 3.5::DOUBLE), 6) AS high_limit
      FROM (SELECT {group}, median, round(abs({value} - median), 6) AS apart
            FROM {table} JOIN (SELECT {group}, round(median({value}), 6) AS median FROM {table} GROUP BY ALL) USING ({group})
            WHERE {value} IS NOT NULL AND {group} IS NOT NULL) GROUP BY {group}"""


MEASURED = (
    ("orders", "o_totalprice", "o_orderpriority"), ("lineitem", "l_quantity", "l_returnflag"),
    ("lineitem", "l_extendedprice", "l_returnflag"), ("lineitem", "l_discount", "l_linestatus"),
    ("lineitem", "l_tax", "l_linestatus"), ("events", "value", "event_type"),
)

ROWS_OF = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}"
    for t in ("events", "customer", "orders", "lineitem", "nation", "region")
)

# Table, then column, declared type and type of DuckDB.
STORED_TYPES = """
events event_id bigint BIGINT, ts timestamp_ntz TIMESTAMP, user_id bigint BIGINT, event_type string VARCHAR,
  value double DOUBLE, props string VARCHAR
customer c_custkey bigint BIGINT, c_name string VARCHAR, c_nationkey int INTEGER, c_acctbal double DOUBLE,
  c_mktsegment string VARCHAR
orders o_orderkey bigint BIGINT, o_custkey bigint BIGINT, o_orderstatus string VARCHAR, o_totalprice double DOUBLE,
  o_orderdate timestamp_ntz TIMESTAMP, o_orderpriority string VARCHAR
lineitem l_orderkey bigint BIGINT, l_partkey bigint BIGINT, l_suppkey bigint BIGINT, l_linenumber int INTEGER,
  l_quantity double DOUBLE, l_extendedprice double DOUBLE, l_discount double DOUBLE, l_tax double DOUBLE,
  l_returnflag string VARCHAR, l_linestatus string VARCHAR, l_shipdate timestamp_ntz TIMESTAMP
nation n_nationkey int INTEGER, n_name string VARCHAR, n_regionkey int INTEGER
region r_regionkey int INTEGER, r_name string VARCHAR"""


def schema_report() -> str:
    """Whether the type that DuckDB finds stored is the one meant by the declared type."""
    parts = []
    for line in STORED_TYPES.replace(",\n ", ",").strip().splitlines():
        table, rest = line.split(" ", 1)
        for name, declared, stored in (column.split() for column in rest.split(",")):
            parts.append(
                f"SELECT '{table}' AS table_name, '{name}' AS column_name, '{declared}' AS data_type, "
                f"'{declared}' AS expected_type, coalesce(min(typeof({name})), '{stored}') = '{stored}' AS matches, "
                f"count(*) - count({name}) AS null_cnt FROM {table}"
            )
    return " UNION ALL ".join(parts)


NULL_COLUMNS = ("task_id", "create_time", "first_complete_time", "complete_duration_seconds", "due_date")

STATEMENTS = {
    "scan_events": "SELECT * FROM events",
    "read_or_empty": "SELECT * FROM events",
    "scan_events_partitioned": PARTITIONED + " WHERE ts >= DATE '2024-01-08' AND ts < DATE '2024-01-15'",
    "read_flat_log": """
      SELECT * EXCLUDE (ts), ts AS event_time, strftime(ts, '%Y-%m-%d') AS event_date FROM events
      WHERE ts::DATE BETWEEN DATE '2024-01-08' AND DATE '2024-01-14'""",
    "write_table": "SELECT * FROM orders",
    "publish_table": "SELECT * FROM task_summary",
    "csv_round_trip": """
      SELECT * EXCLUDE (props, mark), CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 7 = 0 THEN '' ELSE mark || props || mark END AS props
      FROM (SELECT *, ([' ', '', chr(10), chr(13), '"', chr(92), ',', chr(92) || 'N'])[event_id % 8 + 1] AS mark FROM events)""",
    "catalog_external": "SELECT * FROM orders",
    "catalog_partitions": "SELECT DISTINCT 'event_date=' || strftime(ts, '%Y-%m-%d') AS partition FROM events",
    "publish_views": "SELECT o_orderpriority, COUNT(*) AS cnt FROM orders GROUP BY 1",
    "catalog_partitioned": PARTITIONED,
    "catalog_repair": "SELECT strftime(ts, '%Y-%m-%d') AS event_date, COUNT(*) AS row_count FROM events GROUP BY 1",
    "preview_limit": "SELECT * FROM events ORDER BY ts, event_id LIMIT 10",
    "dim_user": "SELECT * FROM dim_user",
    "dim_task": "SELECT * FROM dim_task",
    "event_raw": "SELECT * FROM event_raw",
    "event_clean": "SELECT * FROM event_clean",
    "dwd_todo_event_detail": "SELECT * FROM event_clean",
    "dwd_task_lifecycle": "SELECT * FROM lifecycle",
    "dwd_user_active_detail": "SELECT * FROM active_detail",
    "dws_user_active_1d": "SELECT * FROM active_1d",
    "dws_user_behavior_summary": "SELECT * FROM behavior",
    "dws_task_summary_1d": "SELECT * FROM task_summary",
    "dws_event_type_summary_1d": """
      SELECT stat_date, event_type, event_cnt, round(event_cnt / of_day, 4) AS event_ratio,
             round(event_cnt * 100 / of_day, 2) AS event_ratio_pct
      FROM (SELECT event_time::DATE AS stat_date, event_type, count(*) AS event_cnt FROM raw_event GROUP BY ALL)
      JOIN (SELECT event_time::DATE AS stat_date, count(*)::DOUBLE AS of_day FROM raw_event GROUP BY ALL) USING (stat_date)""",
    "dws_hour_active_summary": """
      SELECT event_time::DATE AS stat_date, hour(event_time) AS active_hour, count(*) AS event_cnt,
             count(DISTINCT user_id) AS active_user_cnt
      FROM raw_event GROUP BY ALL""",
    "dws_channel_region_summary": "SELECT * FROM channel_region",
    "dws_new_old_user_summary": "SELECT * FROM new_old",
    "dws_user_retain_summary": "SELECT * FROM retain",
    "dws_user_feature_usage_summary": "SELECT * FROM usage",
    "feature_usage_by_task": usage_of("dim_task"),
    "dau": "SELECT * FROM daily",
    "dau_filled": "SELECT s.date, COALESCE(d.dau, 0) AS dau FROM spine s LEFT JOIN daily d ON s.date = d.date",
    "wau_mau": "SELECT * FROM trend",
    "activity_kpis": KPI,
    "new_old_structure": "SELECT stat_date AS date, new_user_cnt, old_user_cnt FROM new_old",
    "new_old_share": """
      SELECT stat_date AS date, new_user_cnt, old_user_cnt,
             new_user_cnt::DOUBLE / NULLIF(new_user_cnt + old_user_cnt, 0) * 100 AS new_pct,
             old_user_cnt::DOUBLE / NULLIF(new_user_cnt + old_user_cnt, 0) * 100 AS old_pct
      FROM new_old WHERE stat_date = (SELECT MAX(stat_date) FROM new_old)""",
    "activity_frequency": """
      SELECT last_active_date AS date, CASE WHEN active_day_cnt >= 15 THEN 'high' WHEN active_day_cnt >= 5 THEN 'medium'
             WHEN active_day_cnt > 0 THEN 'low' ELSE 'none' END AS freq_bucket, COUNT(DISTINCT user_id) AS cnt
      FROM behavior GROUP BY 1, 2""",
    "active_share": """
      SELECT 'active' AS label, COUNT(DISTINCT CASE WHEN active_day_cnt > 0 THEN user_id END) AS cnt FROM behavior
      UNION ALL SELECT 'inactive', COUNT(DISTINCT user_id) - COUNT(DISTINCT CASE WHEN active_day_cnt > 0 THEN user_id END) FROM behavior""",
    "active_share_of_all": """
      SELECT 'active' AS label, COUNT(DISTINCT user_id) AS cnt FROM raw_event
      UNION ALL SELECT 'inactive', COUNT(*) FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM raw_event WHERE user_id IS NOT NULL)""",
    "retention_rates": "SELECT * FROM retain_rate",
    "retention_long": melt("retain_rate", "date", ("retain_1d", "retain_7d", "retain_30d"), "period", "rate"),
    "retention_censored": "SELECT first_active_date, total_new_users, " + ", ".join(
        f"CASE WHEN first_active_date + {n} <= (SELECT MAX(active_date) FROM active_detail) "
        f"THEN day{n}_retained_users END AS day{n}_retained_users"
        for n in (1, 7, 30)
    ) + " FROM retain",
    "retention_curve": "SELECT * FROM curve",
    "cohort_retention_matrix": "SELECT cohort_date, CAST(day_index - day_index % 31 AS INT) AS first_day_index, "
    + ", ".join(f"MAX(retain_rate) FILTER (day_index % 31 = {n}) AS day_{n}" for n in range(31))
    + " FROM curve GROUP BY 1, 2",
    "catalog_tables": ROWS_OF,
    "csv_all_tables": ROWS_OF,
    "incremental_build": """
      SELECT 'e' || event_id::VARCHAR AS event_id, e.user_id::VARCHAR AS user_id, e.ts AS event_time, e.event_type,
             u.province, u.register_channel
      FROM events e LEFT JOIN dim_user u ON u.user_id = e.user_id""",
    "replace_table": """
      SELECT *, CASE WHEN o_totalprice < 100000 THEN 'low' ELSE 'high' END AS price_class FROM orders""",
    "table_versions": """
      SELECT 1 AS version, FALSE AS is_current, count(*) AS row_cnt FROM orders WHERE o_orderstatus = 'F'
      UNION ALL SELECT 2, TRUE, count(*) FROM orders UNION ALL SELECT 3, FALSE, count(*) FROM orders""",
    "ordered_table": """
      SELECT event_time::DATE AS stat_date, hour(event_time) AS active_hour, count(*) AS event_cnt,
             count(DISTINCT user_id) AS active_user_cnt
      FROM raw_event GROUP BY ALL""",
    "channel_region_rollup": f"""
      SELECT GROUPING(stat_date, register_channel, province, city) AS level, stat_date, register_channel, province, city,
             count(DISTINCT user_id) AS active_user_cnt, count(*) AS event_cnt
      FROM (SELECT e.event_time::DATE AS stat_date, e.user_id, u.register_channel, u.province, u.city
            FROM raw_event e LEFT JOIN dim_user u ON u.user_id = e.user_id)
      GROUP BY GROUPING SETS ({", ".join("(" + ", ".join(level) + ")" for level in LEVELS)})""",
    "wau_mau_bitmaps": """
      SELECT t.*, (SELECT count(DISTINCT a.user_id) FROM known_days a WHERE a.stat_date BETWEEN t.date - 89 AND t.date) AS qau
      FROM trend t""",
    "monthly_users": """
      SELECT m.month_no, count(*) AS users, count(p.user_id) AS kept_users
      FROM (SELECT DISTINCT user_id, year(stat_date) * 12 + month(stat_date) AS month_no FROM known_days WHERE user_id IS NOT NULL) m
      LEFT JOIN (SELECT DISTINCT user_id, year(stat_date) * 12 + month(stat_date) + 1 AS month_no FROM known_days) p
        ON p.user_id = m.user_id AND p.month_no = m.month_no
      GROUP BY m.month_no""",
    "activity_by_day_kind": f"""
      SELECT CASE WHEN strftime(d, '%Y-%m-%d') IN {HOLIDAYS} THEN 'holiday'
                  WHEN EXTRACT(ISODOW FROM d) >= 6 THEN 'weekend' ELSE 'workday' END AS kind, count(*) AS day_cnt,
             coalesce(sum(users), 0)::BIGINT AS users_total, coalesce(sum(events), 0)::BIGINT AS events_total,
             coalesce(sum(completed), 0)::BIGINT AS completed_total, round(avg(coalesce(users, 0)), 6) AS users_per_day,
             round(avg(coalesce(events, 0)), 6) AS events_per_day, round(avg(coalesce(completed, 0)), 6) AS completed_per_day
      FROM (SELECT UNNEST(generate_series(min(event_time::DATE), max(event_time::DATE), INTERVAL '1' DAY))::DATE AS d FROM raw_event)
      LEFT JOIN (SELECT event_time::DATE AS d, count(DISTINCT user_id) AS users, count(*) AS events,
                        count(*) FILTER (event_type = 'complete_task') AS completed FROM raw_event GROUP BY ALL) USING (d)
      GROUP BY ALL""",
    "weekend_events": PARTITIONED + """
      WHERE EXTRACT(ISODOW FROM ts) >= 6 AND strftime(ts, '%Y-%m-%d') NOT IN ('2024-01-01', '2024-01-15', '2024-02-19')""",
    "duration_box_sketch": """
      SELECT priority, quantile, count(*) AS n, TRUE AS within FROM duration,
             (VALUES ('min_seconds'), ('q1_seconds'), ('median_seconds'), ('q3_seconds'), ('max_seconds')) q(quantile)
      WHERE priority IS NOT NULL GROUP BY ALL""",
    "ordered_funnel": funnel_in_order(60),
    "frequent_sequences": """
      WITH RECURSIVE placed AS (
        SELECT session_id, event_type, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY event_time, log_id) AS pos FROM todo_event
      ), chains AS (
        SELECT session_id, event_type AS sequence, 1 AS length, pos FROM placed
        UNION ALL
        SELECT c.session_id, c.sequence || ' > ' || p.event_type, c.length + 1, p.pos
        FROM chains c JOIN placed p ON p.session_id = c.session_id AND p.pos > c.pos WHERE c.length < 4
      )
      SELECT sequence, length, count(DISTINCT session_id) AS session_cnt FROM chains
      GROUP BY sequence, length HAVING count(DISTINCT session_id) >= 5""",
    "missing_days": """
      WITH days AS (
        SELECT UNNEST(generate_series(min(event_time::DATE), max(event_time::DATE), INTERVAL '1' DAY))::DATE AS d FROM raw_event
      ), kinds AS (
        SELECT DISTINCT event_type, device_type FROM raw_event
      ), absent AS (
        SELECT event_type, device_type, d, d - ROW_NUMBER() OVER (PARTITION BY event_type, device_type ORDER BY d)::INT AS island
        FROM kinds, days WHERE NOT EXISTS (
          SELECT 1 FROM raw_event e WHERE e.event_type = kinds.event_type AND e.device_type = kinds.device_type
            AND e.event_time::DATE = d)
      )
      SELECT event_type, device_type, min(d) AS gap_start, max(d) AS gap_end, count(*) AS missing_day_cnt
      FROM absent GROUP BY event_type, device_type, island""",
    "value_limits": " UNION ALL ".join(limits_of(*m) for m in MEASURED),
    "unreasonable_events": f"""
      SELECT e.*, low_limit, high_limit FROM events e JOIN ({limits_of("events", "value", "event_type")}) l
      ON l.group_value = e.event_type WHERE e.value < low_limit OR e.value > high_limit""",
    "duplicate_users": """
      SELECT 'e' || event_id::VARCHAR AS log_id, user_id
      FROM (SELECT *, COUNT(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE n > 1""",
    "channel_totals": "SELECT COALESCE(register_channel, 'None') AS channel, CAST(SUM(active_user_cnt) AS BIGINT) AS new_user_cnt FROM channel_region GROUP BY 1",
    "channel_region_totals": """
      SELECT COALESCE(register_channel, 'None') AS channel, province, CAST(SUM(active_user_cnt) AS BIGINT) AS new_user_cnt
      FROM channel_region WHERE province IS NOT NULL GROUP BY 1, 2""",
    "channel_quality": f"""
      SELECT c.channel, c.new_user_cnt, r.retain_7d FROM
        (SELECT COALESCE(register_channel, 'None') AS channel, CAST(SUM(active_user_cnt) AS BIGINT) AS new_user_cnt FROM channel_region GROUP BY 1) c
      LEFT JOIN (SELECT channel, ROUND(AVG(day7_retained_users / NULLIF(total_new_users, 0)), 6) AS retain_7d
                 FROM ({retention_of('(SELECT a.*, u.register_channel AS channel FROM active_detail a JOIN dim_user u ON a.user_id = u.user_id)', 'channel, ')})
                 GROUP BY channel) r ON c.channel = r.channel""",
    "completion_kpis": """
      SELECT CAST(SUM(task_created_cnt) AS BIGINT) AS total_created, CAST(SUM(task_completed_cnt) AS BIGINT) AS total_completed,
             CAST(SUM(overdue_cnt) AS BIGINT) AS total_overdue, ROUND(AVG(completion_rate), 6) AS avg_completion_rate,
             CAST(TRUNC(AVG(avg_complete_duration_seconds)) AS BIGINT) AS avg_duration_seconds FROM task_summary""",
    "completion_trend": """
      SELECT stat_date AS date, task_created_cnt::DOUBLE AS created, task_completed_cnt::DOUBLE AS completed,
             COALESCE(completion_rate, 0) AS rate FROM task_summary""",
    "completion_overall": """
      SELECT CAST(SUM(task_created_cnt) AS BIGINT) AS total_created, CAST(SUM(task_completed_cnt) AS BIGINT) AS total_completed,
             CASE WHEN SUM(task_created_cnt) > 0 THEN SUM(task_completed_cnt)::DOUBLE / SUM(task_created_cnt)::DOUBLE * 100 ELSE 0 END AS completion_pct
      FROM task_summary""",
    "priority_stats": "SELECT * FROM stats_by_priority",
    "priority_long": """
      SELECT priority, metric, cnt, CASE metric WHEN 'total_tasks' THEN 'total tasks' ELSE metric END AS metric_label FROM (
      """ + melt("stats_by_priority", "priority", ("total_tasks", "completed", "overdue"), "metric", "cnt") + ")",
    "duration_histogram": """
      SELECT bin, lo + bin * w AS bin_start, lo + (bin + 1) * w AS bin_end, COUNT(*) AS cnt
      FROM (SELECT lo, w, CAST(LEAST(FLOOR((x - lo)::DOUBLE / w), 39) AS BIGINT) AS bin
            FROM duration, (SELECT MIN(x) AS lo, (MAX(x) - MIN(x))::DOUBLE / 40 AS w FROM duration))
      GROUP BY bin, lo, w""",
    "duration_box": """
      SELECT priority, COUNT(*) AS n, MIN(x)::DOUBLE AS min_seconds, quantile_cont(x, 0.25)::DOUBLE AS q1_seconds,
             quantile_cont(x, 0.5)::DOUBLE AS median_seconds, quantile_cont(x, 0.75)::DOUBLE AS q3_seconds, MAX(x)::DOUBLE AS max_seconds
      FROM duration WHERE priority IS NOT NULL GROUP BY priority""",
    "task_funnel": FUNNEL,
    "feature_trend": melt(
        "usage", "stat_date",
        ("remind_feature_usage_rate", "subtask_usage_rate", "due_date_setting_rate"), "feature", "rate",
    ),
    "latest_feature_kpi": "SELECT * FROM usage WHERE stat_date = (SELECT MAX(stat_date) FROM usage)",
    "feature_flags": "SELECT task_id, user_id, has_reminder, has_subtask, has_due_date FROM flags",
    "completion_by_feature": BY_FEATURE,
    "user_feature_rates": "SELECT * FROM user_rates",
    "segment_feature_summary": "SELECT * FROM segments",
    "segment_feature_by_level": segment_summary("user_level"),
    "segment_feature_by_type": segment_summary("user_type"),
    "segment_feature_long": melt(
        "segments", "user_group", ("remind_rate", "subtask_rate", "due_rate"), "feature", "rate"
    ),
    "segment_feature_matrix": "SELECT user_group, remind_rate, subtask_rate, due_rate FROM segments",
    "sessionize": "SELECT log_id AS event_id, user_id, event_time, session_id, strftime(event_time, '%Y-%m-%d') AS event_date FROM todo_event",
    "dim_date": f"""
      SELECT strftime(d, '%Y%m%d') AS date_key, strftime(d, '%Y-%m-%d') AS date_str,
             CAST(EXTRACT(YEAR FROM d) AS INT) AS year, CAST(EXTRACT(MONTH FROM d) AS INT) AS month,
             CAST(EXTRACT(DAY FROM d) AS INT) AS day, CAST(EXTRACT(WEEK FROM d) AS INT) AS week_of_year,
             CAST(EXTRACT(ISODOW FROM d) AS INT) AS day_of_week,
             CASE WHEN EXTRACT(ISODOW FROM d) >= 6 THEN 1 ELSE 0 END AS is_weekend,
             CASE WHEN strftime(d, '%Y-%m-%d') IN {HOLIDAYS} THEN 1 ELSE 0 END AS is_holiday
      FROM (SELECT UNNEST(generate_series(MIN(CAST(o_orderdate AS DATE)), MAX(CAST(o_orderdate AS DATE)), INTERVAL '1' DAY)) AS d FROM orders)""",
    "milestone_events": "SELECT user_id, task_id, list_id, event_type, event_time FROM milestone",
    "pack_attributes": """
      SELECT task_id, event_type, CAST(CASE WHEN event_type = 'create_task'
        THEN json_object('priority', priority, 'due_date', due_date, 'has_reminder', has_reminder,
                         'has_subtask', has_subtask, 'action_duration', task_id % 60)
        ELSE json_object('priority', priority, 'due_date', due_date, 'action_duration', task_id % 60) END AS VARCHAR) AS attributes
      FROM milestone""",
    "postponed_tasks": """
      SELECT task_id, due_date, MAX(CAST(attr_new_due_date AS DATE)) AS latest_due_date, COUNT(*) AS postpone_cnt
      FROM event_raw WHERE task_id IS NOT NULL AND CAST(attr_new_due_date AS DATE) > CAST(due_date AS DATE)
      GROUP BY task_id, due_date""",
    "event_transitions": """
      SELECT event_type AS from_event, to_event, COUNT(*) AS transition_cnt
      FROM (SELECT event_type, LEAD(event_type) OVER (PARTITION BY session_id ORDER BY event_time, log_id) AS to_event
            FROM todo_event)
      WHERE to_event IS NOT NULL GROUP BY 1, 2""",
    "parse_dates": """
      SELECT CASE WHEN o_orderkey % 3 < 2 THEN CAST(o_orderdate AS DATE) END AS day, COUNT(*) AS cnt
      FROM orders GROUP BY 1""",
    "row_counts": """
      SELECT 'dim_user' AS table_name, COUNT(*) AS row_count FROM dim_user
      UNION ALL SELECT 'dim_date', DATE_DIFF('day', MIN(o_orderdate), MAX(o_orderdate)) + 1 FROM orders
      UNION ALL SELECT 'dim_task', COUNT(*) FROM dim_task
      UNION ALL SELECT 'ods_todo_event_log', COUNT(*) FROM raw_event""",
    "require_row_count": "SELECT COUNT(*) AS order_cnt, (SELECT COUNT(*) FROM lineitem) AS line_cnt FROM orders",
    "require_parts_within": """
      SELECT COUNT(*) AS total, COUNT(*) FILTER (event_type NOT IN ('create_task', 'delete_task')) AS left_cnt FROM raw_event""",
    "top_event_types": "SELECT event_type, COUNT(*) AS cnt FROM raw_event GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "duplicate_sessions": """
      SELECT log_id AS event_id, user_id, session_id, event_time, event_type
      FROM (SELECT *, COUNT(*) OVER (PARTITION BY session_id) AS n FROM todo_event) WHERE n > 1""",
    "schema_report": schema_report(),
    "run_metrics": """
      SELECT user_cnt, day_cnt, (SELECT COUNT(*) FROM dim_task) / user_cnt AS tasks_per_user,
             (SELECT AVG(CASE WHEN is_completed THEN 1 ELSE 0 END) FROM dim_task) AS completion_rate,
             event_cnt / (user_cnt * day_cnt) AS events_per_user_day
      FROM (SELECT (SELECT COUNT(DISTINCT user_id) FROM dim_user) AS user_cnt, COUNT(*) AS event_cnt,
                   DATE_DIFF('day', CAST(MIN(event_time) AS DATE), CAST(MAX(event_time) AS DATE)) + 1 AS day_cnt FROM raw_event)""",
    "event_type_distribution": """
      SELECT event_type, ROUND(COUNT(*) * 1.0 / SUM(COUNT(*)) OVER (), 4) AS share FROM raw_event GROUP BY event_type""",
    "null_ratios": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, AVG(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS null_ratio FROM lifecycle"
        for c in NULL_COLUMNS
    ),
    "value_counts": "SELECT CAST(has_reminder AS VARCHAR) AS value, COUNT(*) AS cnt FROM lifecycle GROUP BY 1",
    "orphan_events": """
      SELECT 'unknown_user' AS "check", COUNT(*) AS event_cnt FROM raw_event
      WHERE user_id IS NOT NULL AND user_id NOT IN (SELECT user_id FROM dim_user)
      UNION ALL SELECT 'unknown_task', COUNT(*) FROM raw_event
      WHERE task_id IS NOT NULL AND task_id NOT IN (SELECT task_id FROM dim_task)
      UNION ALL SELECT 'outside_period', COUNT(*) FROM raw_event
      WHERE CAST(event_time AS DATE) < DATE '1995-06-01' OR CAST(event_time AS DATE) > DATE '2001-06-30'""",
}


def _uses(text: str) -> list[str]:
    return [n for n in TABLES if re.search(rf"\b(FROM|JOIN)\s+{n}\b", text)]


def _ordered(names: list[str], seen: dict[str, None]) -> dict[str, None]:
    for name in names:
        if name not in seen:
            _ordered(_uses(TABLES[name]), seen)
            seen[name] = None
    return seen


def statement(key: str) -> str:
    body = STATEMENTS[key]
    # sources inside parentheses or comma lists are found by name as well
    parts = _ordered(_uses(body.replace(", (", " FROM (")), {})
    if not parts:
        return body
    named = ",\n".join(f"{n} AS ({TABLES[n]})" for n in parts)
    own = re.match(r"\s*WITH( RECURSIVE)?\b", body)
    if own:  # the statement's own names follow the shared ones
        return f"WITH{own[1] or ''} {named},\n{body[own.end():]}"
    return f"WITH {named}\n{body}"


def statements() -> dict[str, str]:
    return {key: statement(key) for key in STATEMENTS}
