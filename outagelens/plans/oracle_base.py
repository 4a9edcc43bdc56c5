"""DuckDB renderings of the fixture adapters (FIXTURES.md), shared by all oracle SQL.

These only exist to check the Spark operators; the formulas are the same as
in ``outagelens.sources.fixtures``.
"""

ADAPTERS = """
ev AS (
  SELECT event_id, user_id, CAST(ts AS TIMESTAMP) AS ts, value, event_type,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events),
dim AS (
  SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey),
oev AS (
  SELECT lpad(CAST(user_id AS VARCHAR), 5, '0') AS county_fips, c_name AS county_name, n_name AS state,
         ts AS start_time, ts AS event_began, 'cause_' || CAST(k % 7 AS VARCHAR) AS event_type,
         value * 100.0 AS max_customers, CAST(k AS DOUBLE) AS duration_hours
  FROM ev JOIN dim ON user_id = c_custkey WHERE ev.event_type = 'error'),
sev AS (
  SELECT lpad(CAST(user_id AS VARCHAR), 5, '0') AS county_fips, n_name AS state,
         CASE WHEN k % 5 <> 0 THEN 'C' ELSE 'Z' END AS cz_type, ts AS begin_date,
         'storm_' || CAST(k % 9 AS VARCHAR) AS event_type, value AS damage_property,
         CAST(k AS DOUBLE) / 10.0 AS magnitude, CAST(k % 3 AS DOUBLE) AS injuries, CAST(0.0 AS DOUBLE) AS deaths
  FROM ev JOIN dim ON user_id = c_custkey WHERE ev.event_type IN ('click', 'view')),
ocal AS (
  SELECT lpad(CAST(o_custkey AS VARCHAR), 5, '0') AS county_fips, c_name AS county_name, n_name AS state,
         CAST(o_orderdate AS TIMESTAMP) AS start_time, CAST(o_orderdate AS TIMESTAMP) AS event_began,
         o_orderpriority AS event_type, o_totalprice AS max_customers, q.qty AS duration_hours
  FROM orders JOIN dim ON o_custkey = c_custkey
  LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS qty FROM lineitem GROUP BY l_orderkey) q
    ON o_orderkey = q.l_orderkey),
regions AS (
  SELECT n_name AS state, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey),
pop AS (
  SELECT lpad(CAST(c_custkey AS VARCHAR), 5, '0') AS county_fips, c_name AS county_name,
         n_name AS state_name, round(abs(c_acctbal) * 100.0) AS latest_population
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
gens AS (
  SELECT p_type AS state, p_brand AS county, CAST(p_size AS DOUBLE) AS nameplate_capacity_mw,
         p_retailprice / 100.0 AS age_years FROM part),
pev AS (
  SELECT lpad(CAST(user_id AS VARCHAR), 5, '0') AS county_fips, c_name AS county_name, n_name AS state,
         ts AS prediction_time, CAST([1, 3, 6, 12, 24][k % 5 + 1] AS INTEGER) AS window_hours,
         least(value / 150.0, 1.0) AS outage_probability,
         CAST(least(value / 150.0, 1.0) >= 0.5 AS INTEGER) AS predicted_outage,
         CASE WHEN least(value / 150.0, 1.0) > -0.01 AND least(value / 150.0, 1.0) <= 0.5 THEN 'Low'
              WHEN least(value / 150.0, 1.0) <= 0.7 THEN 'Elevated'
              WHEN least(value / 150.0, 1.0) <= 0.8 THEN 'High'
              WHEN least(value / 150.0, 1.0) <= 1.0 THEN 'Critical' ELSE 'nan' END AS risk_level,
         'fixture' AS model_used, 'fixture_v1' AS model_version
  FROM ev JOIN dim ON user_id = c_custkey),
scores AS (
  SELECT l.doc_id, CAST(toxic AS INTEGER) AS target,
         floor(least(CAST(n_chars AS DOUBLE), 4000.0) / 4.0) / 1000.0 AS p
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
o1 AS (
  SELECT county_fips, coalesce(nullif(county_name, ''), 'Unknown') AS county_name,
         coalesce(state, '') AS state, start_time,
         coalesce(max_customers, 0.0) AS max_customers, coalesce(duration_hours, 0.0) AS duration_hours
  FROM oev WHERE county_fips IS NOT NULL AND start_time IS NOT NULL),
oc1 AS (
  SELECT county_fips, coalesce(nullif(county_name, ''), 'Unknown') AS county_name,
         coalesce(state, '') AS state, start_time,
         coalesce(max_customers, 0.0) AS max_customers, coalesce(duration_hours, 0.0) AS duration_hours
  FROM ocal WHERE county_fips IS NOT NULL AND start_time IS NOT NULL),
s1 AS (
  SELECT county_fips, coalesce(state, '') AS state, begin_date AS storm_time,
         coalesce(nullif(event_type, ''), 'Unknown') AS storm_event_type,
         coalesce(damage_property, 0.0) AS damage_property, coalesce(magnitude, 0.0) AS magnitude
  FROM sev WHERE county_fips IS NOT NULL AND cz_type = 'C' AND begin_date IS NOT NULL),
oraw AS (
  SELECT county_fips, state, event_began, CAST(event_began AS DATE) AS date, max_customers,
         duration_hours, event_type FROM oev WHERE county_fips IS NOT NULL AND event_began IS NOT NULL),
wraw AS (
  SELECT county_fips, begin_date, CAST(begin_date AS DATE) AS date, event_type, damage_property,
         magnitude, injuries, deaths FROM sev WHERE county_fips IS NOT NULL AND begin_date IS NOT NULL),
popl AS (
  SELECT county_fips, max(latest_population) AS latest_population FROM pop GROUP BY county_fips)
"""


def with_adapters(body: str) -> str:
    """Prefix a query body with the adapter CTEs. ``body`` may start with more CTEs."""
    body = body.strip()
    if body.upper().startswith("WITH "):
        return "WITH " + ADAPTERS.strip() + ",\n" + body[5:]
    return "WITH " + ADAPTERS.strip() + "\n" + body


def rounded(body: str, cols: list[tuple[str, int]]) -> str:
    """Round the named double columns (float sums differ in the last bits between engines)."""
    if not cols:
        return body
    repl = ", ".join(f"round({c}, {d}) AS {c}" for c, d in cols)
    return f"SELECT * REPLACE ({repl}) FROM (\n{body}\n) AS _q"
