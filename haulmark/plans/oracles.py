"""Reference results as plain SQL over the same tables, one statement per registered query.

Written independently of the DataFrame operators: row-level joins and textbook aggregates instead of
pre-aggregated cells, so that agreement means something.
"""

from __future__ import annotations

import re

from haulmark.params import Network

NET = Network()
ORACLES: dict[str, str] = {}


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def R(expr: str, places: int = 6) -> str:
    return f"CASE WHEN round({expr},{places})=0 THEN 0.0 ELSE round({expr},{places}) END"


def rounded(names: str, places: int = 6) -> str:
    """``a, b:4`` as rounded output columns."""
    out = []
    for item in names.split(","):
        name, _, p = item.strip().partition(":")
        out.append(f"CAST({R(name, int(p or places))} AS DOUBLE) AS {name}")
    return ", ".join(out)


def km(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (f"(2*6371.0088*asin(sqrt(least(1.0,greatest(0.0,pow(sin(radians(({lat2})-({lat1}))/2),2)"
            f"+cos(radians({lat1}))*cos(radians({lat2}))*pow(sin(radians(({lon2})-({lon1}))/2),2))))))")


M = 2147483647


def U(a: str, b: str) -> str:
    x = f"((CAST({a} AS BIGINT)%{M})*48271+(CAST({b} AS BIGINT)%{M})*69621+42)%{M}"
    return f"(CAST(((({x})*48271)%{M}*48271)%{M} AS DOUBLE)/CAST({M} AS DOUBLE))"


_SITES = ",".join(f"({i},{lit(s.name)},CAST({s.lat!r} AS DOUBLE),CAST({s.lon!r} AS DOUBLE),"
                  f"CAST({s.setup_cost!r} AS DOUBLE))" for i, s in enumerate(NET.sites))

BASE = f"""fac(idx,factory,flat,flon,setup) AS (VALUES {_SITES}),
pm AS (SELECT b, 'Brand - '||b AS product_name, 'div_'||(b%3) AS division, factory
       FROM range(1,23) t(b) JOIN fac ON idx=(2*(b%3)+b%2)%5),
modal AS (SELECT division, factory, products FROM (
  SELECT division, factory, count(*) AS products,
         row_number() OVER (PARTITION BY division ORDER BY count(*) DESC, factory) AS rn
  FROM pm GROUP BY division, factory) WHERE rn=1),
modes(ship_mode,ship_mode_rank,multiplier) AS (VALUES ('1-URGENT',1,CAST(0.1 AS DOUBLE)),
  ('2-HIGH',2,CAST(1 AS DOUBLE)),('3-MEDIUM',3,CAST(1.5 AS DOUBLE)),
  ('4-NOT SPECIFIED',4,CAST(2 AS DOUBLE)),('5-LOW',5,CAST(2 AS DOUBLE))),
prt AS (SELECT p_partkey, p_retailprice, 'Brand - '||bn AS product_name, 'div_'||(bn%3) AS division
        FROM (SELECT *, CAST(replace(p_brand,'Brand#','') AS INTEGER) AS bn FROM part)),
st AS (SELECT n_nationkey, n_name AS state, n_regionkey, CAST(25+(n_nationkey*7)%25 AS DOUBLE) AS lat,
              CAST(-125+(n_nationkey*13)%55 AS DOUBLE) AS lon FROM nation),
dst AS (SELECT c_custkey, state, lat, lon, r_name AS region, r_regionkey AS region_rank
        FROM customer JOIN st ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey),
ol AS (SELECT l_orderkey AS order_id, l_partkey*10+l_linenumber AS line_key, o_custkey AS customer_id,
  CAST(o_orderdate AS DATE) AS order_date, CAST(l_shipdate AS DATE) AS ship_date,
  o_orderpriority AS ship_mode, CAST(substr(o_orderpriority,1,1) AS INTEGER) AS ship_mode_rank,
  state, region, region_rank, lat, lon, prt.division, prt.product_name,
  coalesce(pm.factory, modal.factory) AS current_factory,
  CASE WHEN pm.factory IS NOT NULL THEN 'explicit' WHEN modal.factory IS NOT NULL
       THEN 'division-fallback' ELSE 'unmapped' END AS factory_provenance,
  l_quantity AS units, l_extendedprice*(1-l_discount) AS sales, l_quantity*p_retailprice AS cost,
  l_extendedprice*(1-l_discount)-l_quantity*p_retailprice AS gross_profit,
  CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS INTEGER)
    AS lead_time_days,
  {km('fac.flat', 'fac.flon', 'lat', 'lon')} AS distance_km
  FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN dst ON o_custkey=c_custkey
  JOIN prt ON l_partkey=p_partkey LEFT JOIN pm ON pm.product_name=prt.product_name
  LEFT JOIN modal ON modal.division=prt.division
  LEFT JOIN fac ON fac.factory=coalesce(pm.factory, modal.factory))"""

RAW_COLS = ["order_id", "order_date", "ship_date", "ship_mode", "customer_id", "country", "city",
            "state", "postal_code", "division", "region", "product_id", "product_name", "sales",
            "units", "gross_profit", "cost"]
HEADER = ["Row ID", "Order ID", "Order Date", "Ship Date", "Ship Mode", "Customer ID",
          "Country/Region", "City", "State/Province", "Postal Code", "Division", "Region",
          "Product ID", "Product Name", "Sales", "Units", "Gross Profit", "Cost"]
_CONTENT = ", ".join(RAW_COLS)
RAW = f"""typed AS (SELECT (o_orderkey%1000000000)*1000000+(l_partkey*10+l_linenumber)%1000000 AS rid,
  o_orderkey AS o, CAST(o_orderkey AS VARCHAR) AS order_id,
  CASE WHEN o_orderkey%101=0 AND o_orderkey%2=0 THEN '31-02-1998'
       ELSE strftime(o_orderdate,'%d-%m-%Y') END AS order_date,
  CASE WHEN o_orderkey%101=0 AND o_orderkey%2=1 THEN 'n/a'
       ELSE strftime(l_shipdate,'%d-%m-%Y') END AS ship_date,
  o_orderpriority AS ship_mode, CAST(o_custkey AS VARCHAR) AS customer_id, 'Home' AS country,
  'City '||(o_custkey%100) AS city,
  CASE WHEN o_orderkey%499=0 THEN 'Atlantis' ELSE dst.state END AS state,
  lpad(CAST(o_custkey%1000 AS VARCHAR),5,'0') AS postal_code, prt.division, dst.region,
  CAST(l_partkey AS VARCHAR) AS product_id,
  CASE WHEN o_orderkey%7=0 THEN replace(prt.product_name,' - ',' -') ELSE prt.product_name END
    AS product_name,
  CASE WHEN o_orderkey%103=0 THEN 'abc' ELSE CAST(s AS VARCHAR) END AS sales,
  CAST(q AS VARCHAR) AS units, CAST(CAST(s-c AS DECIMAL(18,4)) AS VARCHAR) AS gross_profit,
  CASE WHEN o_orderkey%89=0 THEN '' ELSE CAST(c AS VARCHAR) END AS cost
  FROM (SELECT *, CAST(CAST(l_extendedprice AS DECIMAL(16,2))
                *(CAST(1 AS DECIMAL(3,2))-CAST(l_discount AS DECIMAL(3,2))) AS DECIMAL(18,4)) AS s,
               CAST(CAST(l_quantity AS DECIMAL(12,0))*CAST(p_retailprice AS DECIMAL(12,2))
                 AS DECIMAL(18,4)) AS c, CAST(l_quantity AS DECIMAL(12,0)) AS q
        FROM lineitem JOIN part ON l_partkey=p_partkey) l
  JOIN prt USING (p_partkey) JOIN orders ON l_orderkey=o_orderkey JOIN dst ON o_custkey=c_custkey),
raw AS (SELECT CAST(rid AS VARCHAR) AS row_id, {_CONTENT} FROM typed
  UNION ALL SELECT CAST(rid+1000000000000000 AS VARCHAR), {_CONTENT} FROM typed WHERE o%97=0
  UNION ALL SELECT {", ".join(lit(h) for h in HEADER)} FROM orders WHERE o_orderkey%1000=0
  UNION ALL SELECT {", ".join(["''"] * 18)} FROM orders WHERE o_orderkey%1500=0),
dat AS (SELECT * FROM raw WHERE row_id<>'Row ID' AND trim(concat(row_id, {_CONTENT}))<>''),
ded AS (SELECT min(CAST(row_id AS BIGINT)) AS row_id, {_CONTENT}, count(*) AS copies
        FROM dat GROUP BY {_CONTENT}),
typ AS (SELECT *, try_strptime(order_date,'%d-%m-%Y') AS od, try_strptime(ship_date,'%d-%m-%Y') AS sd,
  TRY_CAST(sales AS DOUBLE) AS sales_n, TRY_CAST(units AS DOUBLE) AS units_n,
  TRY_CAST(gross_profit AS DOUBLE) AS profit_n, TRY_CAST(cost AS DOUBLE) AS cost_n,
  od IS NULL AS bad_o, sd IS NULL AS bad_s,
  (sales_n IS NULL OR units_n IS NULL OR profit_n IS NULL
   OR (trim(cost)<>'' AND cost_n IS NULL)) AS bad_f,
  NOT (bad_o OR bad_s OR bad_f) AS valid,
  array_to_string([trim(x) for x in string_split(product_name,'-')],' - ') AS canonical,
  CAST(date_diff('day', od, sd) AS INTEGER) AS lead FROM ded)"""


def scenarios(rows: str) -> str:
    """The scenario table ``prm`` and the scored candidates ``sc`` under it."""
    return f"""prm AS ({rows}),
hold AS (SELECT *, {U('order_id', 'line_key')} >= 0.8 AS h FROM ol),
tm AS (SELECT ship_mode, avg(lead_time_days) AS mode_mean FROM hold WHERE NOT h GROUP BY ship_mode),
res AS (SELECT product_name, lead_time_days, lead_time_days-mode_mean AS r
        FROM hold JOIN tm USING (ship_mode) WHERE h),
resid AS (SELECT product_name, CASE WHEN count(*)<2 THEN (SELECT stddev_samp(r) FROM res)
            ELSE stddev_samp(r) END AS residual_std, count(*) AS holdout_count
          FROM res GROUP BY product_name),
fit AS (SELECT 1-sum(r*r)/(count(*)*var_pop(lead_time_days)) AS r2 FROM res),
prod AS (SELECT product_name, division, current_factory, count(*) AS lines, sum(units) AS units,
  sum(gross_profit) AS gross_profit, count(DISTINCT order_id) AS orders,
  avg(lead_time_days) AS baseline_lead_days, coalesce(stddev_samp(lead_time_days),0) AS lead_std
  FROM ol GROUP BY product_name, division, current_factory),
pf AS (SELECT product_name, factory, setup,
  sum(greatest(units,1)*{km('flat', 'flon', 'lat', 'lon')})/sum(greatest(units,1)) AS dist
  FROM ol, fac GROUP BY product_name, factory, setup),
cand0 AS (SELECT prod.*, c.factory AS candidate_factory, c.setup AS candidate_setup_cost,
  i.dist AS current_distance_km, c.dist AS candidate_distance_km, c.dist-i.dist AS delta_distance_km,
  c.setup-i.setup AS setup_net, NOT EXISTS (SELECT 1 FROM ol WHERE ol.division=prod.division
    AND ol.current_factory=c.factory) AS capability_gap,
  coalesce(residual_std, (SELECT stddev_samp(r) FROM res)) AS residual_std
  FROM prod JOIN pf c ON c.product_name=prod.product_name AND c.factory<>prod.current_factory
  JOIN pf i ON i.product_name=prod.product_name AND i.factory=prod.current_factory
  LEFT JOIN resid ON resid.product_name=prod.product_name),
rates AS (SELECT 0.05+0.25*{U('d', '7')} AS rate FROM range(0,300) t(d)),
cand AS (SELECT cand0.*,
  (SELECT count(*) FROM rates WHERE units*delta_distance_km/1000*rates.rate+setup_net
    +CASE WHEN capability_gap THEN greatest(candidate_setup_cost,0)*1.0 ELSE 0 END>0)/300.0
    AS neg_profit,
  residual_std/(SELECT max(residual_std) FROM cand0) AS pred_variance,
  abs(delta_distance_km)/(SELECT max(abs(delta_distance_km)) FROM cand0) AS distance_shift
  FROM cand0),
pr AS (SELECT *, delta_distance_km/speed AS delta_lead_days, -delta_distance_km/speed AS lead_gain_days,
  units*delta_distance_km/1000*rate AS freight_delta,
  units*delta_distance_km/1000*rate+setup_net AS delta_cost,
  -(units*delta_distance_km/1000*rate+setup_net) AS profit_impact,
  baseline_lead_days+delta_distance_km/speed AS new_lead_days,
  gross_profit-(units*delta_distance_km/1000*rate+setup_net) AS new_profit,
  orders>=min_orders AS sufficient_evidence, -delta_distance_km/speed>=min_days AS materially_better,
  CASE WHEN orders>=min_orders AND -delta_distance_km/speed>=min_days THEN 'actionable'
       WHEN orders>=min_orders THEN 'materiality_only'
       WHEN -delta_distance_km/speed>=min_days THEN 'evidence_only' ELSE 'both' END AS gate_result,
  -delta_distance_km/speed-min_days AS material_gap_days,
  -delta_distance_km/nullif(min_days,0) AS breakeven_speed_km_day,
  greatest(0,1-orders/CAST(min_orders AS DOUBLE)) AS low_support,
  0.4*neg_profit+0.3*pred_variance+0.2*greatest(0,1-orders/CAST(min_orders AS DOUBLE))
    +0.1*distance_shift AS risk_score
  FROM cand, prm),
mm AS (SELECT *,
  least(0,min(lead_gain_days) OVER g) AS l0, greatest(0,max(lead_gain_days) OVER g) AS l1,
  least(0,min(profit_impact) OVER g) AS p0, greatest(0,max(profit_impact) OVER g) AS p1,
  least(0,min(-risk_score) OVER g) AS r0, greatest(0,max(-risk_score) OVER g) AS r1
  FROM pr WINDOW g AS (PARTITION BY trial, product_name)),
ob AS (SELECT *, (1-rw)*(w*coalesce((lead_gain_days-l0)/nullif(l1-l0,0),0)
     +(1-w)*coalesce((profit_impact-p0)/nullif(p1-p0,0),0))
     +rw*coalesce((-risk_score-r0)/nullif(r1-r0,0),0) AS objective,
  CASE WHEN risk_score>0.5 THEN 'High' WHEN risk_score>0.25 THEN 'Medium' ELSE 'Low' END AS risk_level,
  least(1,ln(1+orders)/ln(101)) AS evidence_score,
  CASE WHEN baseline_lead_days=0 THEN 0 ELSE 1/(1+lead_std/abs(baseline_lead_days)) END
    AS stability_score FROM mm),
cf AS (SELECT *, 100*(0.65*evidence_score+0.35*stability_score)
  -CASE WHEN capability_gap THEN 20 ELSE 0 END AS confidence FROM ob),
sc AS (SELECT *, objective*confidence/100*CASE WHEN capability_gap THEN 1-gap_pen ELSE 1 END AS score
  FROM cf),
pk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trial, product_name
  ORDER BY score DESC, candidate_factory) AS pos FROM sc)),
rec0 AS (SELECT *, delta_distance_km>=0 AS is_retain, row_number() OVER (PARTITION BY trial,
  product_name ORDER BY CASE WHEN delta_distance_km<0 THEN 0 ELSE 1 END, score DESC,
  candidate_factory) AS n FROM sc),
rec AS (SELECT trial, product_name, current_factory, orders, units, baseline_lead_days, gate_result,
  is_retain, CASE WHEN is_retain THEN current_factory ELSE candidate_factory END AS candidate_factory,
  CASE WHEN is_retain THEN 0 ELSE lead_gain_days END AS lead_gain_days,
  CASE WHEN is_retain THEN 0 ELSE profit_impact END AS profit_impact,
  CASE WHEN is_retain THEN 0 ELSE delta_distance_km END AS delta_distance_km,
  CASE WHEN is_retain THEN 0 ELSE risk_score END AS risk_score,
  CASE WHEN is_retain THEN 0 ELSE score END AS score,
  CASE WHEN is_retain THEN 'Low' ELSE risk_level END AS risk_level,
  CASE WHEN is_retain THEN false ELSE capability_gap END AS capability_gap FROM rec0 WHERE n=1)"""


FIELDS = {"freight_speed_km_day": "speed", "freight_cost_per_unit_per_1000km": "rate",
          "min_orders_for_recommendation": "min_orders", "min_material_days": "min_days",
          "capability_gap_penalty": "gap_pen", "speed_weight": "w", "risk_weight": "rw"}
DEFAULTS = {"speed": "CAST(900 AS DOUBLE)", "rate": "CAST(0.15 AS DOUBLE)", "min_orders": "2200",
            "min_days": "CAST(0.25 AS DOUBLE)", "gap_pen": "CAST(0.2 AS DOUBLE)",
            "w": "CAST(0.5 AS DOUBLE)", "rw": "CAST(0.3 AS DOUBLE)"}


def one(trial: str = "0", source: str = "", extra: str = "", **changes: str) -> str:
    columns = {**DEFAULTS, **changes}
    return (f"SELECT {trial} AS trial{extra}, "
            + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + source)


DEFAULT = scenarios(one())


def add(name: str, ctes: str, body: str) -> None:
    ORACLES[name] = f"WITH {ctes} {body}"


# ---- sources, cleaning, audit -------------------------------------------------------------------

_D = "strftime({0},'%Y-%m-%d') AS {0}"
add("order_lines", BASE, f"""SELECT order_id, line_key, customer_id, {_D.format('order_date')},
  {_D.format('ship_date')}, ship_mode, ship_mode_rank, state, region, region_rank, division,
  product_name, current_factory, factory_provenance, lead_time_days,
  {rounded('units, sales:4, cost:4, gross_profit:4, distance_km')} FROM ol""")
add("dedup_orders", BASE + "," + RAW, f"SELECT row_id, {_CONTENT}, copies FROM ded")
_KEEP = ", ".join(c for c in RAW_COLS if c not in ("order_date", "ship_date", "product_name", "sales",
                                                   "units", "gross_profit", "cost"))
add("clean_orders", BASE + "," + RAW, f"""SELECT row_id, {_KEEP}, copies,
  strftime(od,'%Y-%m-%d') AS order_date, strftime(sd,'%Y-%m-%d') AS ship_date,
  canonical AS product_name, lead AS lead_time_days, cost_n IS NULL AS cost_imputed,
  {R('sales_n', 4)} AS sales, {R('units_n', 4)} AS units, {R('profit_n', 4)} AS gross_profit,
  {R('coalesce(cost_n, sales_n-profit_n)', 4)} AS cost FROM typ WHERE valid""")
add("rejected_rows", BASE + "," + RAW, """SELECT row_id, order_id, concat_ws('+',
  CASE WHEN bad_o THEN 'order_date' END, CASE WHEN bad_s THEN 'ship_date' END,
  CASE WHEN bad_f THEN 'finance' END) AS reasons FROM typ WHERE NOT valid""")
add("audit_summary", BASE + "," + RAW, f"""SELECT
  (SELECT count(*) FROM raw) AS input_rows,
  (SELECT count(*) FROM raw WHERE row_id='Row ID') AS stray_header_rows,
  (SELECT count(*) FROM raw WHERE trim(concat(row_id, {_CONTENT}))='') AS blank_rows,
  (SELECT count(*) FROM dat)-(SELECT count(*) FROM ded) AS duplicate_rows,
  count(*) AS rows_after_dedup, count(*) FILTER (WHERE bad_o) AS unparseable_order_dates,
  count(*) FILTER (WHERE bad_s) AS unparseable_ship_dates, count(*) FILTER (WHERE bad_f) AS unparseable_financial_rows,
  count(*) FILTER (WHERE valid) AS rows_after_valid, count(*) FILTER (WHERE NOT valid) AS dropped_parse_errors,
  count(*) FILTER (WHERE valid AND trim(cost)='') AS cost_imputed,
  count(*) FILTER (WHERE valid AND ship_mode NOT IN (SELECT ship_mode FROM modes)) AS unmapped_ship_modes,
  count(*) FILTER (WHERE valid AND region NOT IN (SELECT r_name FROM region)) AS unmapped_regions,
  count(*) FILTER (WHERE valid AND canonical NOT IN (SELECT product_name FROM pm)
    AND division NOT IN (SELECT division FROM modal)) AS unmapped_products,
  count(*) FILTER (WHERE valid AND canonical NOT IN (SELECT product_name FROM pm)
    AND division IN (SELECT division FROM modal)) AS fallback_products,
  count(*) FILTER (WHERE valid AND state NOT IN (SELECT state FROM st)) AS unresolved_centroids,
  count(*) FILTER (WHERE valid AND lead<0) AS lead_negative,
  count(DISTINCT canonical) FILTER (valid) AS product_count,
  coalesce(bool_or(canonical LIKE 'Product\\_%' ESCAPE '\\') FILTER (valid), false)
    AS synthetic_products_present,
  min(lead) FILTER (valid) AS lead_min, max(lead) FILTER (valid) AS lead_max,
  round(avg(lead) FILTER (valid),6) AS lead_mean,
  round(100.0*count(*) FILTER (WHERE valid AND lead>=365)/count(*) FILTER (WHERE valid),6) AS long_lead_pct,
  round(count(*) FILTER (WHERE valid)/CAST(count(*) AS DOUBLE),6) AS valid_fraction FROM typ""")
add("lead_summary", BASE, """SELECT min(lead_time_days) AS lead_min, round(avg(lead_time_days),6)
  AS lead_mean, max(lead_time_days) AS lead_max, count(*) FILTER (WHERE lead_time_days<0) AS lead_negative,
  round(100.0*count(*) FILTER (WHERE lead_time_days>=365)/count(*),6) AS long_lead_pct FROM ol""")
add("repaired_lead", BASE, """SELECT order_id, line_key, CAST(year(ship_date)-year(order_date) AS INTEGER) AS year_gap,
  lead_time_days, lead_time_days-min(lead_time_days) OVER (PARTITION BY
  year(ship_date)-year(order_date)) AS repaired_lead_days FROM ol""")
_Q = """q AS (SELECT quantile_cont(value,0.25) AS q1, quantile_cont(value,0.75) AS q3 FROM events),
f AS (SELECT q1-3*(q3-q1) AS lo, q3+3*(q3-q1) AS hi FROM q)"""
add("iqr_fence_events", _Q, """SELECT event_id, event_type, value FROM events, f
  WHERE value BETWEEN lo AND hi OR value IS NULL""")
add("iqr_fence_counts", _Q, """SELECT count(*) AS rows, count(*) FILTER (WHERE value<lo OR value>hi) AS removed_value,
  count(*) FILTER (WHERE value<lo OR value>hi) AS removed_total,
  round(100.0*count(*) FILTER (WHERE value<lo OR value>hi)/count(*),6) AS removed_pct,
  count(*)-count(*) FILTER (WHERE value<lo OR value>hi) AS rows_after FROM events, f""")
add("iqr_bounds_lines", BASE, f"""SELECT "column", n, {rounded('q1, q3')},
  {R('q1-3*(q3-q1)')} AS lo, {R('q3+3*(q3-q1)')} AS hi FROM ("""
    + " UNION ALL ".join(f"""SELECT '{c}' AS "column", count({c}) AS n, quantile_cont({c},0.25) AS q1,
  quantile_cont({c},0.75) AS q3 FROM ol""" for c in ("sales", "units", "gross_profit", "cost")) + ")")
_FENCED = ("sales", "units", "gross_profit", "cost")


def fences(source: str) -> str:
    """Half-range fences of the money columns of ``source`` and the rows outside each."""
    quartiles = ", ".join(f"quantile_cont({c},0.25) AS {c}1, quantile_cont({c},0.75) AS {c}3"
                          for c in _FENCED)
    out = ", ".join(f"({c}<{c}1-0.5*({c}3-{c}1) OR {c}>{c}3+0.5*({c}3-{c}1)) AS o_{c}" for c in _FENCED)
    return f"fq AS (SELECT {quartiles} FROM {source}), fo AS (SELECT {out} FROM {source}, fq)"


_ANY = " OR ".join(f"o_{c}" for c in _FENCED)
add("iqr_fence_finance", BASE + "," + fences("ol"), "SELECT count(*) AS rows, " + ", ".join(
    f"count(*) FILTER (WHERE o_{c}) AS removed_{c}" for c in _FENCED) + f""",
  count(*) FILTER (WHERE {_ANY}) AS removed_total,
  round(100.0*count(*) FILTER (WHERE {_ANY})/count(*),6) AS removed_pct,
  count(*)-count(*) FILTER (WHERE {_ANY}) AS rows_after FROM fo""")
add("audit_record", BASE + "," + RAW + """, cl AS (SELECT state, sales_n AS sales, units_n AS units,
  profit_n AS gross_profit, coalesce(cost_n, sales_n-profit_n) AS cost FROM typ WHERE valid), """
    + fences("cl"), f"""SELECT (SELECT count(*) FROM raw) AS input_rows,
  (SELECT count(*) FROM typ WHERE valid) AS rows_after_valid,
  (SELECT round(avg(lead),6) FROM typ WHERE valid) AS lead_mean, 17 AS "columns", 'city' AS missing,
  st.state, n AS observed, coalesce(n=0,false) AS pass,
  (SELECT count(*) FILTER (WHERE o_sales) FROM fo) AS removed_sales,
  (SELECT count(*) FILTER (WHERE {_ANY}) FROM fo) AS removed_total
  FROM st LEFT JOIN (SELECT state, count(*) AS n FROM cl GROUP BY 1) c ON c.state=st.state""")
add("field_count_drift", BASE + "," + RAW, """SELECT count(*) AS rows, count(*) FILTER (WHERE
  TRY_CAST(order_id AS BIGINT)%211=0 OR TRY_CAST(order_id AS BIGINT)%223=0) AS drifted_rows FROM raw""")
add("strict_dates", BASE + "," + RAW, """SELECT strftime(od,'%Y-%m-%d') AS order_date, count(*) AS rows,
  strftime(max(sd),'%Y-%m-%d') AS last_shipped FROM (
  SELECT try_strptime(order_date,'%d-%m-%Y') AS od, try_strptime(ship_date,'%d-%m-%Y') AS sd FROM dat)
  WHERE od IS NOT NULL AND sd IS NOT NULL GROUP BY od""")
add("unmapped_products", BASE, """SELECT product_name, division, count(*) AS rows FROM prt
  WHERE CAST(replace(product_name,'Brand - ','') AS INTEGER)>=12 AND division='div_1' GROUP BY 1,2""")
add("pinned_assertions", BASE + "," + RAW, """SELECT e.order_id, expected, observed,
  expected IS NOT DISTINCT FROM observed AS pass FROM (
  SELECT CAST(o_orderkey AS VARCHAR) AS order_id,
    CAST(min(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) AS INTEGER)
    AS expected
  FROM orders JOIN lineitem ON o_orderkey=l_orderkey GROUP BY o_orderkey) e
  LEFT JOIN (SELECT order_id, min(lead) AS observed FROM typ WHERE valid GROUP BY order_id) o
  ON e.order_id=o.order_id""")
add("unexpected_members", BASE + "," + RAW, """SELECT product_name,
  coalesce(regexp_matches(product_name,'^Product_'),false) AS synthetic,
  product_name NOT IN (SELECT product_name FROM pm) AS unexpected FROM (SELECT DISTINCT
  array_to_string([trim(x) for x in string_split(product_name,'-')],' - ')
  AS product_name FROM raw)""")

# ---- derivation ---------------------------------------------------------------------------------

add("normalized_products", BASE + "," + RAW, """SELECT product_name, array_to_string(
  [trim(x) for x in string_split(product_name,'-')],' - ') AS canonical_name, count(*) AS rows
  FROM dat GROUP BY 1,2""")
add("factory_resolution", BASE, """SELECT product_name, division, current_factory, factory_provenance,
  count(*) AS rows FROM ol GROUP BY 1,2,3,4""")
add("modal_factory", BASE, "SELECT division, factory, products FROM modal")
GEO = """pc AS (SELECT code, lat+(code%100-50)/100.0 AS lat, lon+(code%70-35)/100.0 AS lon FROM (
  SELECT c_custkey%1000 AS code, min(c_nationkey) AS nk FROM customer WHERE (c_custkey%1000)%10<>0
  GROUP BY 1) JOIN st ON nk=n_nationkey),
geo AS (SELECT o_orderkey AS order_id, lpad(CAST(o_custkey%1000 AS VARCHAR),5,'0') AS postal_code,
  dst.state, coalesce(pc.lat,dst.lat) AS lat, coalesce(pc.lon,dst.lon) AS lon,
  CASE WHEN pc.lat IS NOT NULL THEN 'postal' WHEN dst.lat IS NOT NULL THEN 'state'
       ELSE 'unresolved' END AS geo_source
  FROM orders JOIN dst ON o_custkey=c_custkey LEFT JOIN pc ON pc.code=o_custkey%1000)"""
add("geocoded_orders", BASE + "," + GEO, f"""SELECT order_id, postal_code, state, geo_source,
  {rounded('lat, lon')} FROM geo""")
add("geocode_coverage", BASE + "," + GEO, """SELECT geo_source, count(*) AS rows,
  round(100.0*count(*)/(SELECT count(*) FROM geo),6) AS share_pct FROM geo GROUP BY 1""")
add("unresolved_places", BASE + "," + RAW, """SELECT DISTINCT state FROM dat
  WHERE state NOT IN (SELECT state FROM st)""")
add("order_distance", BASE, f"""SELECT order_id, line_key, state, current_factory,
  {rounded('distance_km')} FROM ol""")
_MATRIX = f"""mx AS (SELECT DISTINCT state, factory, idx, {km('flat', 'flon', 'lat', 'lon')}
  AS distance_km FROM ol, fac)"""
add("factory_distance_matrix", BASE + "," + _MATRIX, f"""SELECT state, factory,
  {rounded('distance_km')} FROM mx""")
add("factory_distance_wide", BASE + "," + _MATRIX, "SELECT state, " + ", ".join(
    f"round(max(CASE WHEN idx={i} THEN distance_km END),6) AS site_{i}_km" for i in range(5))
    + " FROM mx GROUP BY state")
add("transit_proxy", BASE, f"""SELECT order_id, line_key, ship_mode, CAST(greatest(1,
  round_even(distance_km/800*multiplier+({U('order_id', 'line_key')}-0.5),0)) AS INTEGER)
  AS transit_days FROM ol JOIN modes USING (ship_mode)""")
add("calendar_profile", BASE, """SELECT CAST(month(order_date) AS INTEGER) AS month,
  CAST(quarter(order_date) AS INTEGER) AS quarter, CAST(isodow(order_date)-1 AS INTEGER) AS weekday, isodow(order_date)>=6 AS weekend, count(*) AS rows,
  round(avg(lead_time_days),6) AS mean_lead FROM ol GROUP BY 1,2,3,4""")
add("ordinal_ranks", BASE + "," + RAW, """SELECT dat.ship_mode, ship_mode_rank, dat.region,
  r_regionkey AS region_rank, count(*) AS rows FROM dat LEFT JOIN modes ON
  modes.ship_mode=dat.ship_mode LEFT JOIN region ON r_name=dat.region GROUP BY 1,2,3,4""")
add("country_flag", BASE, """SELECT state, state IN ('NATION_3','NATION_12','NATION_20') AS canadian,
  count(*) AS rows FROM ol GROUP BY 1,2""")
add("utc_calendar_days", "x AS (SELECT 1)", """SELECT user_id, CAST(date_diff('day', CAST(min(ts) AS DATE),
  CAST(max(ts) AS DATE)) AS INTEGER) AS days FROM events GROUP BY user_id""")

# ---- slices, lanes, statistics ------------------------------------------------------------------

add("sliced_orders", BASE, """SELECT order_id, line_key, product_name, region, ship_mode, units,
  lead_time_days FROM ol WHERE product_name='Brand - 7' AND region IN ('ASIA','EUROPE')
  AND ship_mode IN ('1-URGENT','2-HIGH','5-LOW')""")
add("product_domain", BASE, "SELECT DISTINCT product_name FROM ol ORDER BY 1")
add("value_counts", BASE, "SELECT current_factory, count(*) AS rows FROM ol GROUP BY 1")


def profile(keys: str) -> str:
    return f"""SELECT {keys}, count(DISTINCT order_id) AS order_count, avg(lead_time_days) AS mean_lead,
  quantile_cont(lead_time_days,0.9) AS p90_lead, coalesce(stddev_samp(lead_time_days),0) AS lead_std,
  avg(distance_km) AS mean_distance, avg(units) AS mean_units, avg(gross_profit) AS mean_profit
  FROM ol GROUP BY {keys}"""


LANE = BASE + ", lp AS (" + profile("current_factory, region, ship_mode") + """),
sr AS (SELECT *, (SELECT avg(mean_lead) FROM lp) AS avg_lead FROM lp),
sl AS (SELECT *, order_count>=320 AND (mean_lead>avg_lead OR p90_lead>avg_lead) AS slow_route,
  order_count>=320 AND mean_lead>avg_lead AS slow_by_mean,
  greatest(0,greatest(mean_lead,p90_lead)-avg_lead)*order_count AS exposure FROM sr)"""
PAIR = BASE + ", pp AS (" + profile("region, product_name") + ")"
_L = "current_factory, region, ship_mode, order_count"
add("lane_profile", LANE, f"""SELECT {_L}, {rounded(
    'mean_lead, p90_lead, lead_std, mean_distance, mean_units, mean_profit:2')} FROM lp""")
add("slow_routes", LANE, f"""SELECT {_L}, slow_route, slow_by_mean, 320 AS min_orders_threshold,
  {rounded('mean_lead, p90_lead, avg_lead, exposure:4')} FROM sl""")
add("top_exposure", LANE, f"""SELECT {_L}, {rounded('mean_lead, exposure:4')} FROM sl WHERE slow_route
  ORDER BY sl.exposure DESC, {_L} LIMIT 5""")
add("region_product_profile", PAIR, f"""SELECT region, product_name, order_count, {rounded(
    'mean_lead, p90_lead, mean_units, mean_profit:2')} FROM pp""")
add("congested_pairs", PAIR + """, cg AS (SELECT *, (SELECT quantile_cont(order_count,0.75) FROM pp)
  AS volume_threshold, (SELECT avg(lead_time_days) FROM ol) AS overall_mean_lead FROM pp)""",
    f"""SELECT region, product_name, order_count, order_count>volume_threshold
  AND mean_lead>overall_mean_lead AS congested, {rounded('mean_lead, p90_lead, mean_units, '
    'mean_profit:2, volume_threshold, overall_mean_lead')} FROM cg""")
_P = ("0.319381530", "-0.356563782", "1.781477937", "-1.821255978", "1.330274429")
add("mode_slopes", BASE + """, g AS (SELECT ship_mode, regr_slope(lead_time_days,distance_km) AS slope,
  regr_r2(lead_time_days,distance_km) AS r2, regr_count(lead_time_days,distance_km) AS n FROM ol
  GROUP BY 1), t AS (SELECT *, sign(slope)*sqrt(r2*(n-2)/(1-r2)) AS t_stat FROM g),
  k AS (SELECT *, 1/(1+0.2316419*abs(t_stat)) AS k FROM t),
  p AS (SELECT *, 2*exp(-t_stat*t_stat/2)/sqrt(2*pi())*(""" + "+".join(
    f"({c})*pow(k,{i + 1})" for i, c in enumerate(_P)) + ") AS p_value FROM k)",
    f"""SELECT ship_mode, CAST(n AS BIGINT) AS n, {rounded('slope:9, r2:9, t_stat, p_value')} FROM p""")
add("distance_bins", BASE + """, m AS (SELECT ship_mode, avg(lead_time_days) AS mm FROM ol GROUP BY 1),
  e AS (SELECT quantile_cont(round(distance_km,6),[0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]) AS e
        FROM ol),
  b AS (SELECT lead_time_days-mm AS r, e, CASE """ + " ".join(
    f"WHEN round(distance_km,6)<=e[{i + 2}] THEN {i}" for i in range(9)) + """ ELSE 9 END AS bin
  FROM ol JOIN m USING (ship_mode), e)""", f"""SELECT bin, round(min(e[bin+1]),6) AS lo,
  round(min(e[bin+2]),6) AS hi, count(*) AS n, {R('avg(r)')} AS mean_residual_days FROM b
  GROUP BY bin""")
add("value_histogram", "s AS (SELECT min(value) AS lo, max(value) AS hi FROM events)", """SELECT
  CAST(b AS INTEGER) AS bin, round(lo+b*(hi-lo)/20,6) AS from_value, count(value) AS n
  FROM range(0,20) t(b), s LEFT JOIN events ON least(19, floor((value-lo)/((hi-lo)/20)))=b
  GROUP BY b, lo, hi""")
add("lead_box_quartiles", BASE, """SELECT ship_mode, CAST(min(lead_time_days) AS DOUBLE) AS least,
  quantile_cont(lead_time_days,0.25) AS q1, quantile_cont(lead_time_days,0.5) AS median,
  quantile_cont(lead_time_days,0.75) AS q3, CAST(max(lead_time_days) AS DOUBLE) AS greatest
  FROM ol GROUP BY 1""")
add("lane_measures_long", LANE, " UNION ALL ".join(
    f"""SELECT current_factory, region, ship_mode, '{m}' AS measure,
  CAST({R(m)} AS DOUBLE) AS value FROM lp""" for m in
    ("order_count", "mean_lead", "p90_lead", "lead_std", "mean_distance", "mean_units")))

MOVES = BASE + "," + DEFAULT
_PC = "product_name, candidate_factory"
add("collinearity_check", MOVES, """SELECT product_name, round(corr(lead_gain_days,profit_impact),6)
  AS correlation, count(DISTINCT round(profit_impact/nullif(lead_gain_days,0),6)) AS distinct_ratios,
  count(DISTINCT round(profit_impact/nullif(lead_gain_days,0),6))<=1 AS collinear
  FROM sc GROUP BY 1""")

# ---- moves --------------------------------------------------------------------------------------

add("candidate_moves", MOVES, f"""SELECT {_PC}, division, current_factory, orders, lines,
  {rounded('units, gross_profit:4, current_distance_km, candidate_distance_km, delta_distance_km, '
           'baseline_lead_days')} FROM cand""")
add("move_costs", MOVES, f"""SELECT {_PC}, {rounded('delta_lead_days, lead_gain_days, new_lead_days, '
    'freight_delta:4, setup_net, delta_cost:4, profit_impact:4, new_profit:2')} FROM sc""")
add("capability_gap", MOVES, f"SELECT {_PC}, division, capability_gap FROM cand")
add("move_gates", MOVES, f"""SELECT {_PC}, orders, sufficient_evidence, materially_better, gate_result,
  {rounded('lead_gain_days, material_gap_days')} FROM sc""")
add("reducing_moves", MOVES, f"""SELECT {_PC}, {rounded('delta_distance_km, lead_gain_days')} FROM sc
  WHERE sc.delta_distance_km<0""")
add("breakeven_shortlist", MOVES, f"""SELECT {_PC}, current_factory, orders,
  {rounded('lead_gain_days, breakeven_speed_km_day')} FROM sc WHERE sufficient_evidence
  AND NOT materially_better AND sc.lead_gain_days>0""")
add("qualifying_moves", MOVES, f"""SELECT {_PC}, capability_gap, pos=1 AS is_top_scored_pick,
  {rounded('lead_gain_days, profit_impact:4, score')} FROM pk WHERE sufficient_evidence
  AND materially_better""")
add("negative_impact", MOVES, f"SELECT {_PC}, {rounded('profit_impact:4')} FROM sc "
    "WHERE sc.profit_impact<0")
add("priority_ranking", MOVES, f"""SELECT {_PC},
  {R('0.5*lead_gain_days+0.5*profit_impact', 4)} AS priority_score FROM sc""")
add("best_priority_move", MOVES, f"""SELECT product_name||' > '||candidate_factory AS move,
  {R('0.5*lead_gain_days+0.5*profit_impact', 4)} AS priority_score FROM sc
  ORDER BY 0.5*lead_gain_days+0.5*profit_impact DESC, 1 LIMIT 1""")


def days(weight: str) -> str:
    return f"""fd AS (SELECT product_name, current_factory, factory, factory=current_factory
  AS is_incumbent, sum({weight}*multiplier*{km('flat', 'flon', 'lat', 'lon')}/800)/sum({weight}) AS days,
  sum({weight}*{km('flat', 'flon', 'lat', 'lon')})/sum({weight}) AS distance_km, sum(units) AS units,
  sum(gross_profit) AS gross_profit
  FROM ol JOIN modes USING (ship_mode), fac GROUP BY 1,2,3,4)"""


_W = BASE + "," + days("greatest(units,1)")
add("all_factory_days", _W, f"""SELECT product_name, current_factory, factory, is_incumbent,
  {rounded('days, distance_km')} FROM fd""")
add("all_factory_days_by_line", BASE + "," + days("1"), f"""SELECT product_name, factory, is_incumbent,
  {rounded('days')} FROM fd""")
add("whatif_profit", _W + """, x AS (SELECT a.product_name, a.factory AS candidate_factory,
  i.days AS baseline_days, a.days AS new_days, i.days-a.days AS days_reduced, a.gross_profit,
  -a.units*(a.distance_km-i.distance_km)/1000*0.15 AS profit_impact,
  a.gross_profit-a.units*(a.distance_km-i.distance_km)/1000*0.15 AS whatif_profit
  FROM fd a JOIN fd i ON a.product_name=i.product_name AND i.is_incumbent AND NOT a.is_incumbent)""",
    f"""SELECT {_PC}, {rounded('baseline_days, new_days, days_reduced, gross_profit:4, '
    'profit_impact:4, whatif_profit:2')} FROM x""")
_VALUES = "|".join(f"{v:.6f}" for v in (900, 0.15, 0.2, 2, 2200, 0.25, 1.5))
add("assumption_version", BASE + "," + scenarios(one("'base'") + " UNION ALL " + one(
    "'slow'", speed="CAST(450 AS DOUBLE)")), f"""SELECT {_PC}, trial AS scenario,
  {rounded('lead_gain_days')}, sha256(CASE trial WHEN 'base' THEN {lit(_VALUES)}
    ELSE {lit(_VALUES.replace('900.0', '450.0', 1))} END||'|'||(SELECT string_agg(
  factory||'='||printf('%.6f',setup),'|' ORDER BY factory) FROM fac)) AS assumption_version
  FROM sc""")

# ---- risk, ranking, capacity --------------------------------------------------------------------

add("residual_std_baseline", MOVES, f"""SELECT product_name, holdout_count, {rounded('residual_std')}
  FROM resid""")
_RC = "neg_profit, pred_variance, low_support, distance_shift"
add("risk_components", MOVES, f"SELECT {_PC}, {rounded(_RC + ', risk_score')} FROM sc")
add("risk_levels", MOVES, "SELECT risk_level, count(*) AS rows FROM sc GROUP BY 1")
add("risk_json", MOVES, f"""SELECT {_PC}, {R('neg_profit')} AS "negProfit", {R('pred_variance')}
  AS "predVariance", {R('low_support')} AS "lowSupport", {R('distance_shift')} AS "distanceShift",
  true AS complete FROM sc""")
add("scored_moves", MOVES, f"""SELECT {_PC}, current_factory, orders, capability_gap, risk_level,
  gate_result, {rounded('lead_gain_days, profit_impact:4, risk_score, objective, evidence_score, '
    'stability_score, confidence, score')} FROM sc""")
add("moves_with_incumbents", MOVES, f"""SELECT {_PC}, current_factory, false AS is_incumbent,
  {rounded('lead_gain_days, profit_impact:4, risk_score')} FROM sc UNION ALL SELECT product_name,
  current_factory, current_factory, true, 0.0, 0.0, 0.0 FROM prod""")
add("retain_products", MOVES, """SELECT product_name, current_factory FROM prod WHERE product_name
  NOT IN (SELECT product_name FROM cand WHERE delta_distance_km<0)""")
add("movable_products", MOVES, """SELECT product_name, current_factory FROM prod WHERE product_name
  IN (SELECT product_name FROM cand WHERE delta_distance_km<0)""")
add("recommendations", MOVES, f"""SELECT {_PC}, current_factory, is_retain, risk_level,
  {rounded('lead_gain_days, profit_impact:4, score')} FROM rec""")
_TOP = "top AS (SELECT * FROM rec WHERE NOT is_retain AND lead_gain_days>0 " \
       "ORDER BY score DESC, product_name LIMIT 10)"
add("top_recommendations", MOVES + "," + _TOP, f"""SELECT {_PC}, current_factory, orders, risk_level,
  capability_gap, {rounded('lead_gain_days, delta_distance_km, risk_score, score')} FROM top""")
add("recommended_factories", MOVES + "," + _TOP, """SELECT count(DISTINCT candidate_factory)
  AS factories, count(*) AS rows FROM top""")
add("top_pick_flag", MOVES, f"SELECT {_PC}, pos=1 AS is_top_scored_pick, {rounded('score')} FROM pk")
add("gate_summary", MOVES, """SELECT count(*) AS product_count,
  count(*) FILTER (WHERE gate_result='actionable') AS actionable_count,
  count(*) FILTER (WHERE gate_result='materiality_only') AS materiality_only_count,
  count(*) FILTER (WHERE gate_result='evidence_only') AS evidence_only_count,
  count(*) FILTER (WHERE gate_result='both') AS both_gates_fail_count FROM pk WHERE pos=1""")
add("gate_products", MOVES, f"SELECT {_PC}, gate_result FROM pk WHERE pos=1")
add("actionable_products", MOVES, f"""SELECT {_PC}, orders, {rounded('lead_gain_days, profit_impact:4')}
  FROM pk WHERE pos=1 AND gate_result='actionable'""")
add("picks_by_factory", MOVES, """SELECT candidate_factory, gate_result, count(*) AS products,
  string_agg(product_name,'; ' ORDER BY product_name) AS product_names FROM pk WHERE pos=1
  GROUP BY 1,2""")
_NOW = "now AS (SELECT current_factory, sum(units) AS u FROM ol GROUP BY 1)"
add("factory_load", MOVES + "," + _NOW + """, ld AS (SELECT factory, coalesce(u,0) AS current_units,
  coalesce(u,0)*1.5 AS capacity, coalesce((SELECT sum(units) FROM rec WHERE candidate_factory=factory
    AND candidate_factory<>current_factory),0) AS units_in,
  coalesce((SELECT sum(units) FROM rec WHERE current_factory=factory
    AND candidate_factory<>current_factory),0) AS units_out FROM fac LEFT JOIN now
  ON now.current_factory=factory)""", """SELECT factory, round(current_units,6) AS current_units,
  round(capacity,6) AS capacity, round(units_in,6) AS units_in, round(units_out,6) AS units_out,
  round(current_units+units_in-units_out,6) AS new_units,
  round(capacity-(current_units+units_in-units_out),6) AS headroom FROM ld""")
add("assignment_audit", _W + "," + _NOW + """, np AS (SELECT * FROM (SELECT *, row_number() OVER
  (PARTITION BY product_name ORDER BY distance_km, factory) AS rn FROM fd) WHERE rn=1),
  al AS (SELECT factory, sum(units) AS assigned_units, count(*) AS products,
    count(*) FILTER (WHERE factory<>current_factory) AS moved_products FROM np GROUP BY 1)""", """SELECT f.factory,
  round(coalesce(u,0),6) AS current_units, round(coalesce(u,0)*1.5,6) AS capacity,
  round(coalesce(assigned_units,0),6) AS assigned_units, coalesce(products,0) AS products,
  coalesce(moved_products,0) AS moved_products,
  coalesce(assigned_units,0)>coalesce(u,0)*1.5 AS over_capacity FROM fac f
  LEFT JOIN now ON now.current_factory=f.factory LEFT JOIN al ON al.factory=f.factory""")

# ---- key figures and sweeps ---------------------------------------------------------------------

_CAT = "(SELECT count(DISTINCT p_brand) FROM part)"


def kpis(source: str, by: str, catalogue: str, covered: str) -> str:
    return f"""SELECT {by}100*sum(lead_gain_days*orders)/nullif(sum(baseline_lead_days*orders),0)
  AS lead_time_reduction_pct, 100.0*count(*) FILTER (WHERE profit_impact>=0)/count(*) AS profit_stability_pct,
  (SELECT r2 FROM fit) AS scenario_confidence, 100.0*{covered}/{catalogue} AS coverage_pct
  FROM {source}"""


def long(source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS kpi, {R(k)} AS point FROM {source}" for k in (
        "lead_time_reduction_pct", "profit_stability_pct", "scenario_confidence", "coverage_pct"))


add("kpi_point", MOVES + ", kp AS (" + kpis("rec", "", _CAT, "count(*)") + ")", long("kp"))
add("kpi_point_gated", MOVES + ", kp AS (" + kpis("rec", "", _CAT, "count(*) FILTER (WHERE gate_result='actionable')")
    + ")", long("kp"))
add("kpi_bootstrap", MOVES + f""", nb AS (SELECT *, row_number() OVER (ORDER BY md5(product_name))-1
  AS slot, count(*) OVER () AS total FROM rec),
  dr AS (SELECT replicate, CAST(floor((('0x'||substr(md5('11:'||replicate||':'||slot),1,12))::BIGINT
    +0.5)/281474976710656.0*total) AS BIGINT) AS pick FROM nb,
    range(1,501) t(replicate)),
  rs AS (SELECT * FROM dr JOIN nb ON nb.slot=dr.pick),
  kr AS ({kpis('rs', 'replicate, ', _CAT, 'count(DISTINCT product_name)')} GROUP BY replicate),
  kp AS ({kpis('rec', '', _CAT, 'count(*)')})""", " UNION ALL ".join(
    f"""SELECT '{k}' AS kpi, {R('(SELECT ' + k + ' FROM kp)', 5)} AS point,
  {R(f'quantile_cont({k},0.05)', 5)} AS lo, {R(hi, 5)} AS hi FROM kr""" for k, hi in (
        *((k, f"quantile_cont({k},0.95)") for k in (
            "lead_time_reduction_pct", "profit_stability_pct", "scenario_confidence")),
        ("coverage_pct", "(SELECT coverage_pct FROM kp)"))))  # no resample covers more than all
DRAWS = BASE + "," + scenarios(one("t.d", " FROM range(0,300) t(d)",
                                   speed=f"400+1200*{U('t.d', '13')}",
                                   rate=f"0.05+0.25*{U('t.d', '17')}"))
for _name, _counted in (("sensitivity_draws", "count(*)"),
                        ("sensitivity_gated", "count(*) FILTER (WHERE gate_result='actionable')")):
    add(_name, DRAWS + ", kp AS (" + kpis("rec", "trial, ", _CAT, _counted) + " GROUP BY trial)",
        f"""SELECT CAST(trial AS INTEGER) AS iteration, {rounded(
            'lead_time_reduction_pct:5, profit_stability_pct:5, scenario_confidence:5, coverage_pct:5')},
  round(400+1200*{U('trial', '13')},5) AS speed_km_day,
  round(0.05+0.25*{U('trial', '17')},5) AS freight_rate FROM kp""")
STAB = BASE + "," + scenarios(
    one("-1") + " UNION ALL " + one("t.d", " FROM range(0,300) t(d)",
                                    speed=f"400+1200*{U('t.d', '13')}",
                                    rate=f"0.05+0.25*{U('t.d', '17')}")) + """,
  cs AS (SELECT r.product_name, d.candidate_factory AS default_factory,
    100.0*count(*) FILTER (WHERE r.candidate_factory=d.candidate_factory)/count(*) AS choice_agreement_pct,
    count(DISTINCT r.candidate_factory) AS distinct_factories FROM rec r JOIN rec d
    ON d.trial=-1 AND r.trial>=0 AND r.product_name=d.product_name GROUP BY 1,2)"""
add("choice_stability", STAB, f"""SELECT product_name, default_factory, distinct_factories,
  {rounded('choice_agreement_pct')} FROM cs""")
add("stability_summary", STAB, """SELECT round(avg(choice_agreement_pct),6)
  AS mean_choice_agreement_pct, count(*) AS products FROM cs""")

WEIGHT = BASE + "," + scenarios(one() + " UNION ALL " + one("t.i+1", " FROM range(0,21) t(i)",
                                                            w="t.i/20.0")) + """,
  ws AS (SELECT s.w AS speed_weight, s.product_name, s.candidate_factory, s.gate_result='actionable' AS go,
    d.gate_result='actionable' AS was, s.candidate_factory<>d.candidate_factory AS flip
    FROM pk s JOIN pk d ON s.pos=1 AND d.pos=1 AND d.trial=0 AND s.trial>0
    AND s.product_name=d.product_name)"""
add("weight_sweep", WEIGHT, """SELECT speed_weight, count(*) FILTER (WHERE go) AS actionable_count,
  count(*) FILTER (WHERE flip) AS flip_count, count(*) FILTER (WHERE go AND NOT was) AS entering_count,
  count(*) FILTER (WHERE was AND NOT go) AS leaving_count,
  count(*) FILTER (WHERE go)=5 AS matches_target FROM ws GROUP BY 1""")
add("weight_sweep_products", WEIGHT, " UNION ALL ".join(
    f"""SELECT speed_weight, product_name, candidate_factory, '{change}' AS change FROM ws WHERE {where}"""
    for change, where in (("actionable", "go"), ("flipped", "flip"), ("entering", "go AND NOT was"),
                          ("leaving", "was AND NOT go"))))
_GO = "gate_result='actionable'"
add("speed_sweep", BASE + "," + scenarios(one("t.i", " FROM range(0,25) t(i)",
                                              speed="CAST(400+50*t.i AS DOUBLE)")),
    f"""SELECT speed AS freight_speed_km_day, count(*) FILTER (WHERE {_GO}) AS actionable_count,
  count(*) FILTER (WHERE {_GO})=5 AS matches_target FROM pk WHERE pos=1 GROUP BY 1""")
_GRID = (("freight_speed_km_day", "speed", 25, "400+50*t.i", "dashboard_slider"),
         ("freight_cost_per_unit_per_1000km", "rate", 26, "(5+t.i)/100.0", "dashboard_slider"),
         ("min_orders_for_recommendation", "min_orders", 20, "1+t.i", "config_gate_assumption"),
         ("min_material_days", "min_days", 31, "t.i/20.0", "config_gate_assumption"),
         ("capability_gap_penalty", "gap_pen", 21, "t.i/20.0", "config_scoring_assumption"))


def grid() -> str:
    parts, start = [], 0
    for name, column, count, expr, kind in _GRID:
        parts.append(one(f"t.i+{start}", f" FROM range(0,{count}) t(i)",
                         f", '{name}' AS assumption, CAST({expr} AS DOUBLE) AS value, "
                         f"'{kind}' AS category", **{column: f"CAST({expr} AS DOUBLE)"}))
        start += count
    return " UNION ALL ".join(parts)


add("assumption_sweep", BASE + "," + scenarios(grid()) + f""", ts AS (SELECT CAST(trial AS INTEGER)
  AS trial, assumption, value, category, count(*) FILTER (WHERE {_GO}) AS actionable_count,
  count(*) FILTER (WHERE {_GO})=5 AS matches_target
  FROM pk WHERE pos=1 GROUP BY ALL)""", """SELECT *, coalesce(trial=(SELECT min(trial) FROM ts
  WHERE matches_target),false) AS first_hit FROM ts""")
add("assumption_sweep_products", BASE + "," + scenarios(grid()), f"""SELECT CAST(trial AS INTEGER)
  AS trial, assumption, {R('value')} AS value, category, {_PC}, orders,
  {rounded('lead_gain_days, profit_impact:4')} FROM pk WHERE pos=1 AND {_GO}""")


def suffixed(text: str, names: list[str], suffix: str) -> str:
    for name in names:
        text = re.sub(rf"\b{name}\b", name + suffix, text)
    return text


_CTES = ["prm", "hold", "tm", "res", "resid", "fit", "prod", "pf", "cand0", "rates", "cand", "pr", "mm",
         "ob", "cf", "sc", "pk", "rec0", "rec"]
_REGIONAL = """rc AS (SELECT r_name AS region, avg(lat) AS rlat, avg(lon) AS rlon FROM st JOIN region
  ON n_regionkey=r_regionkey GROUP BY 1),
olx AS (SELECT ol.* REPLACE (rlat AS lat, rlon AS lon) FROM ol JOIN rc ON rc.region=ol.region)"""
_SECOND = suffixed(DEFAULT, _CTES, "_r")
_SECOND = suffixed(_SECOND, ["ol"], "x")
add("alt_distance_gates", MOVES + "," + _REGIONAL + "," + _SECOND, f"""SELECT a.product_name,
  a.candidate_factory, {R('a.delta_distance_km')} AS delta_km_state, a.gate_result AS gate_state,
  {R('a.score')} AS score_state, a.pos=1 AS top_state, {R('b.delta_distance_km')} AS delta_km_region,
  b.gate_result AS gate_region, {R('b.score')} AS score_region, b.pos=1 AS top_region,
  a.gate_result<>b.gate_result AS gate_changed FROM pk a JOIN pk_r b
  ON a.product_name=b.product_name AND a.candidate_factory=b.candidate_factory""")

TWO = (one("0", w="CAST(1 AS DOUBLE)", rw="CAST(0 AS DOUBLE)") + " UNION ALL "
       + one("1", w="CAST(0 AS DOUBLE)", rw="CAST(1 AS DOUBLE)"))
add("scenario_flips", BASE + "," + scenarios(TWO), """SELECT a.product_name,
  a.candidate_factory AS left_pick, b.candidate_factory AS right_pick FROM pk a JOIN pk b
  ON a.trial=0 AND b.trial=1 AND a.pos=1 AND b.pos=1 AND a.product_name=b.product_name
  WHERE a.candidate_factory<>b.candidate_factory""")
STORED = BASE + "," + scenarios(one("0") + " UNION ALL " + one(
    "1", rate="CAST(0.30 AS DOUBLE)", w="CAST(0.25 AS DOUBLE)")) + """,
  rr AS (SELECT a.product_name, true AS present, a.candidate_factory AS computed_candidate_factory,
    b.candidate_factory AS stored_candidate_factory, a.lead_gain_days AS computed_lead_gain_days,
    b.lead_gain_days AS stored_lead_gain_days, a.profit_impact AS computed_profit_impact,
    b.profit_impact AS stored_profit_impact, a.candidate_factory=b.candidate_factory AS labels_match,
    abs(a.lead_gain_days-b.lead_gain_days)<1e-6 AS gain_ok,
    abs(a.profit_impact-b.profit_impact)<1e-6 AS impact_ok FROM pk a JOIN pk b ON a.trial=0
    AND b.trial=1 AND a.pos=1 AND b.pos=1 AND a.product_name=b.product_name)"""
add("reconcile_picks", STORED, f"""SELECT product_name, present, computed_candidate_factory,
  stored_candidate_factory, labels_match, gain_ok AND impact_ok AS within_tolerance,
  {rounded('computed_lead_gain_days:4, stored_lead_gain_days:4, computed_profit_impact:4, '
           'stored_profit_impact:4')} FROM rr""")
add("reconcile_verdict", STORED, """SELECT count(*) AS keys, count(*) FILTER (WHERE present) AS present,
  count(*) FILTER (WHERE labels_match) AS labels_match, count(*) FILTER (WHERE gain_ok) AS within_tolerance,
  bool_and(labels_match AND gain_ok) AS all_match FROM rr""")
SLOW = BASE + "," + scenarios(one("0") + " UNION ALL " + one("1", speed="CAST(450 AS DOUBLE)"))
_ACT = "SELECT product_name FROM pk WHERE pos=1 AND gate_result='actionable' AND trial="
add("actionable_set_change", SLOW, f"""SELECT product_name, 'entering' AS change FROM (
  {_ACT}1 EXCEPT {_ACT}0) UNION ALL SELECT product_name, 'leaving' FROM ({_ACT}0 EXCEPT {_ACT}1)""")

# ---- models and clusters over a predictor or centres that SQL can follow --------------------------

MODEL = BASE + f""", ml AS (SELECT *, lead_time_days AS y, {U('order_id', 'line_key')}>=0.8 AS h,
  CAST(floor({U('order_id*5', 'line_key')}*5) AS INTEGER) AS fold FROM ol),
trained AS (SELECT ship_mode, avg(y) AS p FROM ml WHERE NOT h GROUP BY 1),
tested AS (SELECT * FROM ml JOIN trained USING (ship_mode) WHERE h)"""


def scores(source: str, by: str = "") -> str:
    return f"""SELECT {by}1-sum((y-p)*(y-p))/(count(*)*var_pop(y)) AS r2,
  sqrt(avg((y-p)*(y-p))) AS rmse, avg(abs(y-p)) AS mae FROM {source}"""


_SCORES = rounded("r2, rmse, mae")
add("mode_mean_holdout", MODEL, f"SELECT {_SCORES} FROM ({scores('tested')})")


def folds(name: str, keys: str) -> str:
    """Every line with the mean of its group over the other folds; scores per fold."""
    match = " AND ".join(f"b.{k}=a.{k}" for k in keys.split(", "))
    return f"""SELECT '{name}' AS model, * FROM ({scores(f"""(SELECT a.fold, a.y, b.p FROM ml a JOIN (
  SELECT f.k, {', '.join(f'ml.{k}' for k in keys.split(', '))}, avg(y) AS p FROM ml, range(0,5) f(k)
  WHERE fold<>f.k GROUP BY ALL) b ON b.k=a.fold AND {match})""", 'fold, ')} GROUP BY fold)"""


CV = MODEL + f""", fs AS ({folds('Mode mean', 'ship_mode')} UNION ALL
  {folds('Mode and product mean', 'ship_mode, product_name')}),
cv AS (SELECT model, """ + ", ".join(
    f"avg({m}) AS cv_{m}_mean, stddev_samp({m}) AS cv_{m}_std" for m in ("r2", "rmse", "mae")) + """
  FROM fs GROUP BY model)"""
add("mode_mean_cv", CV, "SELECT model, " + rounded(", ".join(
    f"cv_{m}_mean, cv_{m}_std" for m in ("r2", "rmse", "mae"))) + " FROM cv")
add("mean_model_selection", CV, f"""SELECT model, interpretability_tier, {rounded('cv_r2_mean, best_score')}
  FROM (SELECT *, CASE WHEN model='Mode mean' THEN 0 ELSE 1 END AS interpretability_tier,
    (SELECT max(cv_r2_mean) FROM cv) AS best_score FROM cv) s
  WHERE s.cv_r2_mean>=s.best_score-0.02 ORDER BY interpretability_tier LIMIT 1""")
add("mode_mean_temporal", BASE + """, dl AS (SELECT *, lead_time_days AS y,
    date_diff('day', DATE '1970-01-01', order_date) AS day FROM ol),
  lt AS (SELECT *, day>(SELECT quantile_cont(day,0.8) FROM dl) AS late FROM dl),
  em AS (SELECT ship_mode, avg(y) AS p FROM lt WHERE NOT late GROUP BY 1),
  lm AS (SELECT * FROM lt JOIN em USING (ship_mode) WHERE late)""",
    f"SELECT {_SCORES} FROM ({scores('lm')})")
add("mode_mean_residuals", MODEL, f"""SELECT product_name, holdout_count, {rounded('residual_std')} FROM (
  SELECT product_name, count(*) AS holdout_count, CASE WHEN count(*)<2
    THEN (SELECT stddev_samp(y-p) FROM tested) ELSE stddev_samp(y-p) END AS residual_std
  FROM tested GROUP BY 1)""")
add("training_cells", MODEL, f"""SELECT ship_mode, region, product_name, current_factory,
  {rounded('distance_km, label, n, label_sq:0')} FROM (SELECT ship_mode, region, product_name,
    current_factory, distance_km, avg(y) AS label, count(*) AS n, sum(y*y) AS label_sq
  FROM ml WHERE NOT h GROUP BY ALL)""")
add("linear_distance_fit", MODEL, f"""SELECT {rounded('distance_km, prediction')} FROM (
  SELECT distance_km, a+b*distance_km AS prediction FROM (SELECT DISTINCT distance_km FROM ml WHERE NOT h),
    (SELECT regr_intercept(y,distance_km) AS a, regr_slope(y,distance_km) AS b FROM ml WHERE NOT h))""")


# ---- least squares: normal equations over lines, solved by a recursive query ------------------------

def least_squares(source: str, part: str, sets: dict, cases: str, penalty: float = 0.0) -> str:
    """CTEs up to ``fitted`` (s, k, names, beta, n, r2, rmse): for every set of features and case k the
    solution over the lines of ``source`` (with y) whose part is not k, scored on those of part k."""
    numeric = sorted({c for s in sets.values() for c in s[0]})
    levels = sorted({c for s in sets.values() for c in s[1]})
    one = "CAST(1 AS DOUBLE)"
    named = ([("'(one)'", one)] + [(lit(c), f"CAST({c} AS DOUBLE)") for c in numeric]
             + [(f"{lit(c + '=')}||{c}", one) for c in levels] + [("'(target)'", "CAST(y AS DOUBLE)")])
    features = ", ".join(f"struct_pack(name:={n}, x:={x})" for n, x in named)
    of_set = ", ".join(f"({lit(s)}, [{', '.join(lit(c) for c in ('(one)', '(target)', *a, *b))}])"
                       for s, (a, b) in sets.items())
    ridge = f"""list_transform(m0, lambda row, i: list_transform(row, lambda v, j: CASE
      WHEN i=j AND i>1 THEN v+{penalty!r}*(v-row[1]*row[1]/m0[1][1]) ELSE v END))""" if penalty else "m0"
    return f"""lf AS (SELECT CAST({part} AS INTEGER) AS part, [{features}] AS f FROM {source}),
la AS (SELECT part, f, unnest(f) AS a FROM lf), lp2 AS (SELECT part, a, unnest(f) AS b FROM la),
gram AS (SELECT part, a.name AS i, b.name AS j, sum(a.x*b.x) AS v FROM lp2 GROUP BY ALL),
fs2(s, terms) AS (VALUES {of_set}),
held AS (SELECT s, k, i, j, coalesce(sum(v) FILTER (part<>k),0) AS train,
    coalesce(sum(v) FILTER (part=k),0) AS test FROM gram JOIN fs2 ON list_contains(terms, split_part(i,'=',1))
    AND list_contains(terms, split_part(j,'=',1)), {cases} c(k) GROUP BY ALL),
nm AS (SELECT s, k, list_sort(list(DISTINCT i)) AS names FROM held WHERE i<>'(target)' GROUP BY ALL),
na AS (SELECT s, k, unnest(names) AS i, names FROM nm),
nb AS (SELECT s, k, i, unnest(list_append(names,'(target)')) AS j FROM na),
full2 AS (SELECT nb.s, nb.k, nb.i, nb.j, coalesce(train,0) AS train, coalesce(test,0) AS test
  FROM nb LEFT JOIN held h ON h.s=nb.s AND h.k=nb.k AND h.i=nb.i AND h.j=nb.j),
rw AS (SELECT s, k, i, list(train ORDER BY j='(target)', j) AS tr, list(test ORDER BY j='(target)', j) AS te
  FROM full2 GROUP BY ALL),
m0 AS (SELECT s, k, list(tr ORDER BY i) AS m0, list(te ORDER BY i) AS t FROM rw GROUP BY ALL),
mm AS (SELECT s, k, t, {ridge} AS m FROM m0),
md AS (SELECT *, list_transform(m, lambda row, i: row[i]) AS diag FROM mm),
gj AS (SELECT s, k, 1 AS step, m, diag, CAST([] AS BOOLEAN[]) AS used FROM md
  UNION ALL SELECT s, k, step+1, CASE WHEN m[step][step]>diag[step]*1e-10 THEN
      list_transform(m, lambda row, i: CASE WHEN i=step THEN list_transform(row, lambda x: x/m[step][step])
        ELSE list_transform(row, lambda x, j: x-row[step]/m[step][step]*m[step][j]) END)
    ELSE m END, diag, list_append(used, m[step][step]>diag[step]*1e-10) FROM gj WHERE step<=len(m)),
bt AS (SELECT gj.s, gj.k, names, t, list_transform(gj.m, lambda row, i:
    CASE WHEN used[i] THEN row[len(row)] ELSE 0 END) AS beta
  FROM gj JOIN md USING (s, k) JOIN nm USING (s, k) WHERE step=len(gj.m)+1),
fitted AS (SELECT s, k, names, beta, n, 1-sse/nullif(yy-sy*sy/n,0) AS r2, sqrt(sse/n) AS rmse FROM (
  SELECT s, k, names, beta, t[1][1] AS n, t[1][len(beta)+1] AS sy, yy, yy+list_sum(list_transform(t,
    lambda row, i: beta[i]*(list_sum(list_transform(beta, lambda b, j: b*row[j]))-2*row[len(row)]))) AS sse
  FROM bt JOIN (SELECT s, k, test AS yy FROM held WHERE i='(target)' AND j='(target)') USING (s, k)))"""


def cv_of(sets: dict, source: str = "ml") -> str:
    return least_squares(source, "fold", sets, "range(0,5)") + """,
cl AS (SELECT s, avg(r2) AS cv_r2_mean, stddev_samp(r2) AS cv_r2_std, avg(rmse) AS cv_rmse_mean,
  stddev_samp(rmse) AS cv_rmse_std FROM fitted GROUP BY s)"""


RMODEL = "RECURSIVE " + MODEL
_SIZE = ["month", "weekday", "units"]
_GROWING = [("Ship mode", [], ["ship_mode"]), ("+ calendar", _SIZE[:2], ["ship_mode"]),
            ("+ order size", _SIZE, ["ship_mode"]), ("+ distance", [*_SIZE, "km"], ["ship_mode"]),
            ("+ region & factory", [*_SIZE, "km"], ["ship_mode", "region", "current_factory"])]
_ABLATION = {f"{basis}|{name}": ([column if c == "km" else c for c in a], b)
             for basis, column in (("state", "distance_km"), ("region", "region_km"))
             for name, a, b in _GROWING}
add("feature_ablation", RMODEL + """, rk AS (SELECT region, current_factory, avg(distance_km) AS region_km
    FROM ml GROUP BY ALL),
  mk AS (SELECT *, month(order_date) AS month, isodow(order_date)-1 AS weekday
    FROM ml JOIN rk USING (region, current_factory)), """ + cv_of(_ABLATION, "mk"),
    f"""SELECT split_part(s,'|',1) AS distance_basis, split_part(s,'|',2) AS feature_set,
  {rounded('cv_r2_mean, cv_r2_std')} FROM cl""")
add("state_vs_distance", RMODEL + ", " + cv_of({
    "Ship mode + state dummies": ([], ["ship_mode", "state"]),
    "Ship mode + distance": (["distance_km"], ["ship_mode"]),
    "Ship mode + state + distance": (["distance_km"], ["ship_mode", "state"])}),
    f"SELECT s AS comparison, {rounded('cv_r2_mean')} FROM cl")
_PROXY = (["distance_km"], ["ship_mode", "region", "product_name", "current_factory"])
_LINEAR = {"proxy features": _PROXY, "all features": (
    ["ship_mode_rank", "region_rank", "units", "distance_km", "sales"],
    ["product_name", "current_factory", "region", "ship_mode", "division"])}
add("linear_cv", RMODEL + ", " + cv_of(_LINEAR), "SELECT s AS features, " + rounded(
    "cv_r2_mean, cv_r2_std, cv_rmse_mean, cv_rmse_std") + " FROM cl")
add("linear_holdout", RMODEL + ", " + least_squares("ml", "h", _LINEAR, "range(1,2)"),
    f"SELECT s AS features, {rounded('n, r2, rmse')} FROM fitted")
add("linear_reallocation", RMODEL + ", " + least_squares("ml", "h", {"proxy": _PROXY}, "range(1,2)") + f""",
cf AS (SELECT map(names, beta) AS c FROM fitted),
pf AS (SELECT product_name, current_factory, factory, units, gross_profit, greatest(units,1) AS w,
    region, ship_mode, {km('flat', 'flon', 'lat', 'lon')} AS km FROM ol, fac),
fd AS (SELECT product_name, current_factory, factory, factory=current_factory AS is_incumbent,
  sum(w*(c['(one)']+coalesce(c['ship_mode='||ship_mode],0)+coalesce(c['region='||region],0)
    +coalesce(c['product_name='||product_name],0)+coalesce(c['current_factory='||factory],0)
    +c['distance_km']*km))/sum(w) AS days, sum(w*km)/sum(w) AS distance_km, sum(units) AS units,
  sum(gross_profit) AS gross_profit FROM pf, cf GROUP BY 1,2,3,4),
x AS (SELECT a.product_name, a.current_factory, a.factory AS candidate_factory,
  i.distance_km AS current_distance_km, a.distance_km AS candidate_distance_km, i.days AS baseline_days,
  a.days AS new_days, i.days-a.days AS days_reduced, a.gross_profit,
  -a.units*(a.distance_km-i.distance_km)/1000*0.15 AS profit_impact,
  a.gross_profit-a.units*(a.distance_km-i.distance_km)/1000*0.15 AS whatif_profit
  FROM fd a JOIN fd i ON a.product_name=i.product_name AND i.is_incumbent AND NOT a.is_incumbent)""",
    f"""SELECT product_name, current_factory, candidate_factory, {rounded(
        'current_distance_km:4, candidate_distance_km:4, baseline_days:4, new_days:4, days_reduced:4, '
        'gross_profit:4, profit_impact:4, whatif_profit:2')} FROM x""")
_MODES = " UNION ALL ".join(f"""SELECT '{c}', CAST(NULL AS DOUBLE), v FROM (SELECT {c} AS v, row_number() OVER (
  ORDER BY count(*) DESC, {c}) AS rn FROM ml WHERE order_id%{k}<>0 GROUP BY 1) WHERE rn=1"""
                          for c, k in (("ship_mode", 11), ("region", 13)))
_MEDIANS = " UNION ALL ".join(f"""SELECT '{c}' AS feature, {R(f'median({c})')} AS median,
  CAST(NULL AS VARCHAR) AS mode FROM ml WHERE order_id%{k}<>0""" for c, k in (("distance_km", 7), ("units", 5)))
add("fill_values", MODEL, f"SELECT * FROM ({_MEDIANS} UNION ALL {_MODES})")
_N, _C = _LINEAR["all features"]
_PART = {**{c: f"c['{c}']*{c}" for c in _N}, **{c: f"coalesce(c['{c}='||{c}],0)" for c in _C}}
add("linear_importance", RMODEL + ", " + least_squares(
    "ml", "h", {"all": _LINEAR["all features"]}, "range(1,2)") + f""",
cf AS (SELECT map(names, beta) AS c FROM fitted),
hp AS (SELECT order_id||'-'||line_key||'-'||CAST(units AS BIGINT)||'-'||lead_time_days AS key, y, c['(one)']+{'+'.join(_PART.values())} AS p,
  {', '.join(f'{e} AS x_{n}' for n, e in _PART.items())} FROM ml, cf WHERE h),
ha AS (SELECT *, row_number() OVER (ORDER BY md5(key)) AS pos FROM hp),
hb AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY md5(key||'#'||r)) AS pos
  FROM hp, range(1,6) t(r)),
hj AS (SELECT r, ha.y, ha.p, {', '.join(f'ha.p-ha.x_{n}+hb.x_{n} AS q_{n}' for n in _PART)}
  FROM ha JOIN hb USING (pos)),
hl AS (SELECT r, unnest([{', '.join(
    f"struct_pack(feature:={lit(n)}, lost:=(sum((y-q_{n})*(y-q_{n}))-sum((y-p)*(y-p)))/(var_pop(y)*count(*)))"
    for n in _PART)}]) AS v FROM hj GROUP BY r)""", f"""SELECT feature,
  {rounded('importance_mean:9, importance_std:9')} FROM (SELECT v.feature, avg(v.lost) AS importance_mean,
    stddev_pop(v.lost) AS importance_std FROM hl GROUP BY 1)""")
_LATE = "RECURSIVE " + BASE + """, dl AS (SELECT *, lead_time_days AS y,
    date_diff('day', DATE '1970-01-01', order_date) AS day FROM ol),
  lt AS (SELECT *, day>(SELECT quantile_cont(day,0.8) FROM dl) AS late FROM dl), """
for _model, _penalty in (("Linear Regression", 0.0), ("Ridge", 1.0)):
    ORACLES["ridge_temporal"] = (ORACLES["ridge_temporal"] + " UNION ALL " if "ridge_temporal" in ORACLES
                                 else "") + f"""SELECT * FROM (WITH {_LATE + least_squares(
        'lt', 'late', {'proxy': _PROXY}, 'range(1,2)', _penalty)}
  SELECT {lit(_model)} AS model, {rounded('n, r2, rmse')} FROM fitted)"""

_MEASURES = ("order_count", "mean_lead", "p90_lead", "lead_std", "mean_distance", "mean_units")
_Z = ", ".join(f"(lp.{m}-avg(lp.{m}) FILTER (WHERE order_count>=30) OVER ())"
               f"/stddev_samp(lp.{m}) FILTER (WHERE order_count>=30) OVER () AS z_{m}"
               for m in _MEASURES)


def apart(a: str, b: str) -> str:
    return "+".join(f"pow({a}.z_{m}-{b}.z_{m},2)" for m in _MEASURES)


CLUSTERS = LANE + f""", zl AS (SELECT current_factory, region, ship_mode, order_count, mean_lead, {_Z} FROM lp),
ce AS (SELECT *, row_number() OVER (ORDER BY current_factory, region, ship_mode)-1 AS cluster FROM zl
  WHERE order_count>=30 ORDER BY cluster LIMIT 3),
ca AS (SELECT * FROM (SELECT zl.*, ce.cluster, {apart('zl', 'ce')} AS distance, row_number() OVER (
  PARTITION BY zl.current_factory, zl.region, zl.ship_mode ORDER BY {apart('zl', 'ce')}, ce.cluster) AS rn
  FROM zl, ce) WHERE rn=1),
cs AS (SELECT cluster, count(*) AS lanes, avg(order_count) AS mean_orders, avg(mean_lead) AS mean_days
  FROM ca WHERE order_count>=30 GROUP BY 1)"""
_LK = "current_factory, region, ship_mode"
add("standardised_lanes", CLUSTERS, f"SELECT {_LK}, {rounded(', '.join(f'z_{m}' for m in _MEASURES))} FROM zl")
add("assigned_lanes", CLUSTERS, f"""SELECT {_LK}, CAST(ca.cluster AS INTEGER) AS cluster,
  {rounded('distance')}, coalesce(
    CASE WHEN mean_days>=(SELECT median(mean_days) FROM cs) THEN 'Slow' ELSE 'Fast' END||' / '||
    CASE WHEN mean_orders>=(SELECT median(mean_orders) FROM cs) THEN 'high volume' ELSE 'low volume' END,
    'Unclustered lane') AS cluster_label FROM ca LEFT JOIN cs USING (cluster)""")
add("assigned_summary", CLUSTERS, f"""SELECT CAST(cluster AS INTEGER) AS cluster, lanes,
  {rounded('mean_orders, mean_days')} FROM cs""")
add("assigned_silhouette", CLUSTERS + f""", pt AS (SELECT *, row_number() OVER () AS id FROM ca
    WHERE order_count>=30),
  pd AS (SELECT a.id, a.cluster AS own, b.cluster AS other, sum({apart('a', 'b')}) AS d, count(*) AS n
    FROM pt a, pt b GROUP BY 1,2,3),
  sp AS (SELECT id, max(CASE WHEN own=other THEN d/nullif(n-1,0) END) AS a,
    min(CASE WHEN own<>other THEN d/n END) AS b FROM pd GROUP BY 1)""",
    """SELECT round(avg(coalesce((b-a)/nullif(greatest(a,b),0),0)),6) AS silhouette_score,
  count(*) AS points FROM sp""")
add("assigned_euclidean", CLUSTERS + f""", pt AS (SELECT *, row_number() OVER () AS id FROM ca
    WHERE order_count>=30),
  pd AS (SELECT a.id, a.cluster AS own, b.cluster AS other, sum({apart('a', 'b')}) AS d,
    sum(sqrt({apart('a', 'b')})) AS e, count(*) AS n FROM pt a, pt b GROUP BY 1,2,3),
  sp AS (SELECT id, max(CASE WHEN own=other THEN d/nullif(n-1,0) END) AS a,
    min(CASE WHEN own<>other THEN d/n END) AS b, max(CASE WHEN own=other THEN e/nullif(n-1,0) END) AS ea,
    min(CASE WHEN own<>other THEN e/n END) AS eb FROM pd GROUP BY 1)""",
    """SELECT 'first three lanes' AS centres, count(*) AS points,
  round(avg(coalesce((b-a)/nullif(greatest(a,b),0),0)),6) AS silhouette_score,
  round(avg(coalesce((eb-ea)/nullif(greatest(ea,eb),0),0)),6) AS euclidean_silhouette FROM sp""")

# Every start of every k in Lloyd steps: q holds the points, f the starts, c0 to c20 the centres.
_ZS = [f"z_{m}" for m in _MEASURES]
_AT = ", ".join(_ZS)


def _first_points() -> str:
    """Start 2i at the largest i-th measure, 2i+1 at the smallest; then the farthest point, seven times."""
    begin = " UNION ALL ".join(
        f"(SELECT {s} AS start, 0 AS cluster, {_AT} FROM q ORDER BY {_ZS[s // 2]} "
        f"{'ASC' if s % 2 else 'DESC'}, id LIMIT 1)" for s in range(10))
    more = "".join(f""", n{i} AS MATERIALIZED (SELECT start, q.id, min({apart('q', f'f{i - 1}')}) AS d
    FROM q, f{i - 1} GROUP BY 1,2),
  f{i} AS MATERIALIZED (SELECT * FROM f{i - 1} UNION ALL SELECT start, {i} AS cluster, {_AT} FROM (SELECT start, id,
    row_number() OVER (PARTITION BY start ORDER BY d DESC, id) AS rn FROM n{i}) JOIN q USING (id) WHERE rn=1)"""
                   for i in range(1, 8))
    return f"f0 AS MATERIALIZED ({begin}){more}"


def _nearest(centres: str, points: str) -> str:
    return f"""SELECT k, start, {points}.id, min(struct_pack(d:={apart(points, centres)},
    cluster:={centres}.cluster)) AS v FROM {points}, {centres} GROUP BY 1,2,3"""


_STEPS = "".join(f""", a{i} AS MATERIALIZED ({_nearest(f'c{i}', 'q')}),
  c{i + 1} AS MATERIALIZED (SELECT k, start, cluster, {', '.join(f'coalesce(m.{z},c{i}.{z}) AS {z}' for z in _ZS)}
    FROM c{i} LEFT JOIN (SELECT k, start, v.cluster AS cluster, {', '.join(f'avg({z}) AS {z}' for z in _ZS)}
      FROM a{i} JOIN q USING (id) GROUP BY 1,2,3) m USING (k, start, cluster))""" for i in range(20))
LLOYD = CLUSTERS + f""", zr AS MATERIALIZED (SELECT {_LK}, order_count, row_number() OVER (ORDER BY {_LK}) AS id,
    {', '.join(f'round({z},9) AS {z}' for z in _ZS)} FROM zl),
  q AS MATERIALIZED (SELECT * FROM zr WHERE order_count>=30), {_first_points()},
  c0 AS MATERIALIZED (SELECT k, f7.* FROM f7, range(2,9) t(k) WHERE cluster<k AND k<(SELECT count(*) FROM q))
  {_STEPS}, la AS MATERIALIZED ({_nearest('c20', 'q')}),
  lc AS (SELECT k, start, sum(v.d) AS cost FROM la GROUP BY 1,2),
  lb AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(cost,9), start) AS rn FROM lc)
    WHERE rn=1),
  lp2 AS MATERIALIZED (SELECT la.k, la.start, v.cluster AS cluster, q.* FROM la JOIN lb USING (k, start) JOIN q USING (id)),
  ld AS (SELECT a.k, a.id, a.cluster AS own, b.cluster AS other, sum({apart('a', 'b')}) AS d,
    sum(sqrt({apart('a', 'b')})) AS e, count(*) AS n FROM lp2 a JOIN lp2 b USING (k) GROUP BY 1,2,3,4),
  lw AS (SELECT k, id, max(CASE WHEN own=other THEN d/nullif(n-1,0) END) AS a,
    min(CASE WHEN own<>other THEN d/n END) AS b, max(CASE WHEN own=other THEN e/nullif(n-1,0) END) AS ea,
    min(CASE WHEN own<>other THEN e/n END) AS eb FROM ld GROUP BY 1,2),
  ls AS MATERIALIZED (SELECT k, count(*) AS points, avg(coalesce((b-a)/nullif(greatest(a,b),0),0)) AS silhouette_score,
    avg(coalesce((eb-ea)/nullif(greatest(ea,eb),0),0)) AS euclidean_silhouette FROM lw GROUP BY 1),
  lt AS (SELECT * FROM ls JOIN lb USING (k) ORDER BY round(euclidean_silhouette,9) DESC, k LIMIT 1),
  lk AS (SELECT c20.* FROM c20 JOIN lt USING (k, start)),
  ln AS ({_nearest('lk', 'zr')})"""
add("lloyd_scores", LLOYD, """SELECT CAST(k AS INTEGER) AS k, start, round(cost,6) AS cost, points,
  round(silhouette_score,6) AS silhouette_score, round(euclidean_silhouette,6) AS euclidean_silhouette
  FROM ls JOIN lb USING (k)""")
add("lloyd_lanes", LLOYD, f"""SELECT {_LK}, order_count, CAST(coalesce(v.cluster,0) AS INTEGER) AS cluster,
  CAST(coalesce((SELECT k FROM lt),1) AS INTEGER) AS selected_k,
  round((SELECT silhouette_score FROM lt),6) AS silhouette_score,
  round((SELECT euclidean_silhouette FROM lt),6) AS euclidean_silhouette FROM zr LEFT JOIN ln USING (id)""")
