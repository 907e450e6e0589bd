"""The derived tables of ``warehouse`` once more, as plain SQL for the check engine."""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {}

VIEWS["specialty_dimension"] = """
SELECT cast(row_number() OVER (ORDER BY c_mktsegment) AS integer) AS specialty_id,
       c_mktsegment AS specialty_name, substr(c_mktsegment, 1, 1) AS parent_specialty_name
FROM (SELECT DISTINCT c_mktsegment FROM customer) d"""

VIEWS["geography_dimension"] = """
SELECT c_custkey AS geo_id, c_nationkey AS sales_region_id FROM customer"""

VIEWS["ad_market_dimension"] = """
SELECT n_nationkey * 5 + s.specialty_id - 1 AS ad_market_id, s.specialty_id,
       n_nationkey AS ad_region_id, r_name AS ad_market_state_name,
       n_name AS ad_market_county_name, n_name AS ad_market_region_name,
       s.specialty_name AS ad_market_specialty_name,
       CASE WHEN n_nationkey < 5 THEN 'Y' ELSE 'N' END AS ad_market_block_flag,
       CASE WHEN (n_nationkey * 5 + s.specialty_id - 1) % 10 = 9 THEN 'N' ELSE 'Y' END
         AS ad_market_active_flag
FROM nation JOIN region ON n_regionkey = r_regionkey CROSS JOIN specialty_dimension s"""

VIEWS["page_view"] = """
SELECT event_id, ts AS gmt_timestamp, cast(ts AS date) AS event_date,
       CASE WHEN event_id % 23 <> 0 THEN cast(event_id AS varchar) END AS render_instance_guid,
       CASE WHEN event_id % 29 <> 0 THEN cast(user_id AS varchar) END AS persistent_session_id,
       cast(user_id AS varchar) || '.' || cast(cast(floor(day(ts) / 2.0) AS integer) AS varchar)
         AS session_id,
       CASE event_type WHEN 'view' THEN 'Attorney_Search' WHEN 'click' THEN 'Attorney_Profile'
         WHEN 'signup' THEN 'Attorney_Profile_Contact' WHEN 'purchase' THEN 'Topic_Page'
         ELSE 'Error_Page' END AS page_type,
       cast(1 + event_id % 6 AS integer) AS specialty_id,
       CASE WHEN event_id % 17 <> 0 THEN user_id END AS location_id,
       'https://x.example/?' || CASE event_id % 5 WHEN 0 THEN 'utm_campaign=brand'
         WHEN 1 THEN 'utm_campaign=pls' WHEN 2 THEN 'utm_content=sgt'
         WHEN 3 THEN 'utm_campaign=adblock' ELSE 'ref=none' END AS url
FROM events"""

VIEWS["ad_inventory"] = """
SELECT c_nationkey * 5 + specialty_id - 1 AS ad_target_id, specialty_id,
       CASE l_returnflag WHEN 'A' THEN 'Sponsored Listing' WHEN 'N' THEN 'Display' ELSE 'Other' END
         AS ad_inventory_type,
       cast(l_quantity AS bigint) AS sellable_count, l_extendedprice AS list_price
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN specialty_dimension ON specialty_name = c_mktsegment"""

VIEWS["channel"] = """
SELECT event_id, CASE WHEN url LIKE '%utm_campaign=brand%' THEN 'brand'
         WHEN url LIKE '%utm_campaign=pls%' THEN 'pls'
         WHEN url LIKE '%utm_content=sgt%' THEN 'network'
         WHEN url LIKE '%utm_campaign=adblock%' THEN 'adblock' ELSE 'nonsem' END AS medium
FROM page_view"""

VIEWS["first_touch"] = """
SELECT DISTINCT ON (session_id) session_id, event_date, medium
FROM page_view JOIN channel USING (event_id)
WHERE event_date BETWEEN date '2024-01-01' AND date '2024-01-31' AND session_id IS NOT NULL
  AND render_instance_guid IS NOT NULL AND persistent_session_id IS NOT NULL
ORDER BY session_id, gmt_timestamp, event_id"""

VIEWS["market_names"] = """
SELECT specialty_id, ad_region_id AS sales_region_id, ad_market_id, ad_market_state_name AS state,
       ad_market_county_name AS county, ad_market_region_name AS region,
       ad_market_specialty_name AS pa, ad_market_block_flag AS block_flag,
       ad_market_active_flag = 'Y' AS active
FROM ad_market_dimension"""

VIEWS["located_view"] = """
SELECT event_id, session_id, event_date, page_type, render_instance_guid, ad_market_id, state, county,
       region, specialty_name, parent_specialty_name, block_flag
FROM (SELECT page_view.*, sales_region_id FROM page_view
      LEFT JOIN geography_dimension ON geo_id = location_id) placed
LEFT JOIN market_names USING (specialty_id, sales_region_id)
LEFT JOIN specialty_dimension USING (specialty_id)"""

VIEWS["core_page"] = """
SELECT * FROM (VALUES ('Attorney_Directory_Browse'), ('Attorney_Search'), ('Attorney_Profile'),
  ('Attorney_Profile_Aboutme'), ('Attorney_Profile_Contact'), ('Attorney_Profile_Endorsement'))
  names(page_type)"""

VIEWS["bucketed_view"] = """
SELECT located_view.*,
       CASE WHEN page_type IN (SELECT page_type FROM core_page) THEN 'core' ELSE 'others' END AS bucket
FROM located_view"""

VIEWS["attribution_v3_all"] = """
SELECT ad_market_id, pa AS ad_specialty, session_id, event_date,
       CASE WHEN event_id % 19 <> 0 THEN
         CASE WHEN medium IN ('brand', 'network') THEN medium ELSE 'nonsem' END END AS lpv_medium
FROM page_view JOIN channel USING (event_id)
JOIN geography_dimension ON geo_id = location_id JOIN market_names USING (specialty_id, sales_region_id)"""

VIEWS["performance_by_market"] = """
SELECT p.*, m.ad_market_id FROM ad_performance_daily p JOIN ad_market_dimension m
  ON p.state = m.ad_market_county_name AND p.segment = m.ad_market_specialty_name"""

VIEWS["webanalytics_v3"] = """
SELECT ad_market_id, pt AS ad_page_type, event_day AS event_date, sl_imps AS sl_adimpression,
       pv AS page_view FROM performance_by_market"""

VIEWS["potential_acv_marketid"] = """
SELECT event_day AS attribution_date, event_day + 1 AS process_date,
       CASE WHEN rt = 'mobile' THEN 'Other' ELSE 'SEM' END AS channel, ad_market_id AS marketid,
       pt, rt AS cup, sl_acv, da_acv, sl_acv * 1.25 AS potential_sl_acv,
       da_acv * 1.25 AS potential_da_acv, sl_imps, da_imps, potential_sl_imps, potential_da_imps
FROM performance_by_market"""

VIEWS["county_dim"] = """
SELECT c_custkey, n_name AS state, lower(c_name) AS county, c_mktsegment AS segment
FROM customer JOIN nation ON c_nationkey = n_nationkey"""

VIEWS["census_zcta"] = """
SELECT lpad(cast(o_orderkey AS varchar), 9, '0') AS zcta, state, county, pop_total, pop_male,
       pop_female, hh_total, o_totalprice AS hh_median_income, age_male, emp_no, cit_not_citizen,
       pov_below
FROM (SELECT l_orderkey, sum(l_quantity) AS pop_total,
        sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END) AS pop_male,
        sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END) AS pop_female,
        cast(count(*) AS double) AS hh_total, 20 + avg(l_tax) * 500 AS age_male,
        sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS emp_no,
        sum(CASE WHEN l_discount < 0.03 THEN l_quantity ELSE 0 END) AS cit_not_citizen,
        sum(CASE WHEN l_tax > 0.04 THEN l_quantity ELSE 0 END) AS pov_below
      FROM lineitem GROUP BY l_orderkey) l
JOIN orders ON l_orderkey = o_orderkey JOIN county_dim ON o_custkey = c_custkey"""

VIEWS["line_fact"] = """
SELECT lineitem.*, p_type AS pa, state, county, segment FROM lineitem
JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
JOIN county_dim ON o_custkey = c_custkey"""

VIEWS["traffic"] = """
SELECT state, county, pa,
       cast(sum(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END) AS double) AS core,
       cast(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS double) AS others
FROM line_fact GROUP BY state, county, pa"""

VIEWS["ad_performance_daily"] = """
SELECT event_day, lpad(cast(month(event_day) AS varchar), 2, '0') AS month, state, county,
       state || ' | ' || county AS statecounty, pa, segment, pt, rt,
       CASE WHEN date_diff('day', date '1995-01-02', event_day) % 7 IN (5, 6) THEN 1 ELSE 0 END
         AS weekend,
       pv, sl_imps, da_imps, sl_contacts, da_contacts, sl_acv, da_acv,
       sl_imps * 1.25 AS potential_sl_imps, da_imps * 1.25 AS potential_da_imps
FROM (SELECT cast(l_shipdate AS date) AS event_day, state, county, pa, segment,
        CASE l_returnflag WHEN 'A' THEN 'serp' WHEN 'N' THEN 'profile' ELSE 'other' END AS pt,
        CASE l_linestatus WHEN 'F' THEN 'desktop' ELSE 'mobile' END AS rt,
        sum(l_quantity) AS pv, cast(sum(cast(l_quantity * (1 - l_discount) AS decimal(28,4))) AS double) AS sl_imps,
        cast(sum(cast(l_quantity * l_discount AS decimal(28,4))) AS double) AS da_imps,
        cast(sum(CASE WHEN l_tax > 0.03 THEN 1 ELSE 0 END) AS double) AS sl_contacts,
        cast(sum(CASE WHEN l_tax <= 0.03 THEN 1 ELSE 0 END) AS double) AS da_contacts,
        cast(sum(cast(l_extendedprice * l_discount AS decimal(28,4))) AS double) AS sl_acv,
        cast(sum(cast(l_extendedprice * l_tax AS decimal(28,4))) AS double) AS da_acv
      FROM line_fact GROUP BY 1, 2, 3, 4, 5, 6, 7) s"""

VIEWS["acv_input"] = """
SELECT month, state, county, pa, CASE WHEN pt IN ('serp', 'profile') THEN 'core' ELSE 'others' END
         AS pt,
       sl_imps AS slimps, da_imps AS daimps, sl_acv AS slacv, da_acv AS daacv
FROM ad_performance_daily"""

VIEWS["state_lookup"] = """
SELECT lower(n_name) AS statename,
       'N' || lpad(cast(n_nationkey AS varchar), 2, '0') AS state_code, n_name AS state
FROM nation"""

VIEWS["polygon"] = """
SELECT state, county, c_custkey AS "group", seq,
       c_custkey + CASE WHEN seq IN (2, 3) THEN 1.0::double ELSE 0 END AS long,
       c_custkey * 2 + CASE WHEN seq >= 3 THEN 1.0::double ELSE 0 END AS lat
FROM county_dim CROSS JOIN (VALUES (1), (2), (3), (4)) v(seq)"""

VIEWS["county_features"] = """
SELECT state, county, sum(pop_total) AS pop_total, sum(pop_male) AS pop_male,
       sum(pop_female) AS pop_female, sum(hh_total) AS hh_total, sum(emp_no) AS emp_no,
       sum(cit_not_citizen) AS cit_not_citizen, sum(pov_below) AS pov_below,
       coalesce(cast(sum(cast(hh_median_income * hh_total AS decimal(28,4))) AS double)
         / nullif(sum(hh_total), 0), 0) AS hh_median_income,
       coalesce(sum(age_male * pop_male) / nullif(sum(pop_male), 0), 0) AS age_male
FROM census_zcta GROUP BY state, county"""

VIEWS["features"] = """
SELECT state, county, pop_total, age_male,
       coalesce(emp_no / nullif(pop_total, 0), 0) AS emp_no_per_pop_total, hh_median_income,
       coalesce(pov_below / nullif(pop_total, 0), 0) AS pov_below_per_pop_total
FROM county_features"""

VIEWS["zscores"] = """
SELECT state, county, pop_total, f.age_male, f.emp_no_per_pop_total, f.hh_median_income,
       f.pov_below_per_pop_total,
       coalesce((f.age_male - m1) / nullif(s1, 0), 0) AS z1,
       coalesce((f.emp_no_per_pop_total - m2) / nullif(s2, 0), 0) AS z2,
       coalesce((f.hh_median_income - m3) / nullif(s3, 0), 0) AS z3,
       coalesce((f.pov_below_per_pop_total - m4) / nullif(s4, 0), 0) AS z4
FROM features f CROSS JOIN (
  SELECT avg(age_male) AS m1, stddev_samp(age_male) AS s1, avg(emp_no_per_pop_total) AS m2,
         stddev_samp(emp_no_per_pop_total) AS s2, avg(hh_median_income) AS m3,
         stddev_samp(hh_median_income) AS s3, avg(pov_below_per_pop_total) AS m4,
         stddev_samp(pov_below_per_pop_total) AS s4 FROM features) s"""

VIEWS["regions"] = """
SELECT state, county, pop_total, age_male, emp_no_per_pop_total, hh_median_income,
       pov_below_per_pop_total, cluster
FROM (SELECT z.*, c.cluster, row_number() OVER (PARTITION BY state, county ORDER BY
        (z1 - c1) * (z1 - c1) + (z2 - c2) * (z2 - c2) + (z3 - c3) * (z3 - c3)
          + (z4 - c4) * (z4 - c4), c.cluster) AS rn
      FROM zscores z CROSS JOIN (VALUES (1, -1, -1, 0, 0), (2, -1, 1, 0, 0), (3, 0, 0, -1, 0),
        (4, 0, 0, 1, 0), (5, 1, -1, 0, 0), (6, 1, 1, 0, 0)) c(cluster, c1, c2, c3, c4)) d
WHERE rn = 1"""

VIEWS["traffic_long"] = """
SELECT state, county, 'core' AS pt, sum(core) AS sessions FROM traffic GROUP BY 1, 2
UNION ALL
SELECT state, county, 'others' AS pt, sum(others) AS sessions FROM traffic GROUP BY 1, 2"""

VIEWS["region_sessions"] = """
SELECT r.state, r.county, r.cluster, r.pop_total AS pop_base_count, t.pt,
       coalesce(t.sessions, 0) AS sessions,
       coalesce(coalesce(t.sessions, 0) / nullif(r.pop_total, 0), 0) AS sessions_pp
FROM regions r LEFT JOIN traffic_long t ON t.state = r.state AND t.county = r.county"""

VIEWS["targets"] = """
SELECT cluster, pt, sessions_pp AS target_sessions_pp
FROM (SELECT cluster, pt, sessions_pp, row_number() OVER (PARTITION BY cluster, pt ORDER BY sessions_pp)
        AS rn, count(*) OVER (PARTITION BY cluster, pt) AS n
      FROM region_sessions WHERE pt IS NOT NULL) q
WHERE rn = greatest(1, round_even(cast(n AS decimal(20,1)) * 0.7, 0))"""

VIEWS["lifted"] = """
SELECT s.*, t.target_sessions_pp,
       greatest(s.sessions_pp, t.target_sessions_pp) * s.pop_base_count AS potential_sessions
FROM region_sessions s JOIN targets t ON t.cluster = s.cluster AND t.pt = s.pt"""

VIEWS["acv_month"] = """
SELECT state, county, pt, cast(sum(cast(slimps AS decimal(28,4))) AS double) / count(slimps) AS slimps,
       cast(sum(cast(daimps AS decimal(28,4))) AS double) / count(daimps) AS daimps,
       cast(sum(cast(slacv AS decimal(28,4))) AS double) / count(slacv) AS slacv,
       cast(sum(cast(daacv AS decimal(28,4))) AS double) / count(daacv) AS daacv
FROM (SELECT month, state, county, pt, cast(sum(cast(slimps AS decimal(28,4))) AS double) AS slimps,
        cast(sum(cast(daimps AS decimal(28,4))) AS double) AS daimps,
        cast(sum(cast(slacv AS decimal(28,4))) AS double) AS slacv,
        cast(sum(cast(daacv AS decimal(28,4))) AS double) AS daacv
      FROM acv_input GROUP BY 1, 2, 3, 4) m
GROUP BY 1, 2, 3"""

VIEWS["rates"] = """
SELECT state, county, pt, coalesce(slimps, 0) AS slimps, coalesce(daimps, 0) AS daimps,
       coalesce(slacv, 0) AS slacv, coalesce(daacv, 0) AS daacv, coalesce(sessions, 0) AS sessions,
       coalesce(slimps / nullif(sessions, 0), 0) AS sl_ips,
       coalesce(daimps / nullif(sessions, 0), 0) AS da_ips,
       coalesce(slacv / nullif(sessions, 0), 0) AS sl_aps,
       coalesce(daacv / nullif(sessions, 0), 0) AS da_aps
FROM acv_month FULL OUTER JOIN traffic_long USING (state, county, pt)"""

VIEWS["result"] = """
SELECT *, slacv + daacv AS acv, potential_sl_acv + potential_da_acv AS potential_acv
FROM (SELECT l.state, l.county, l.cluster, l.pt, l.sessions, l.pop_base_count, l.sessions_pp,
        l.target_sessions_pp, l.potential_sessions, coalesce(a.slacv, 0) AS slacv,
        coalesce(a.daacv, 0) AS daacv, 'all' AS pa,
        CASE WHEN l.sessions > 30 THEN l.potential_sessions * (coalesce(a.slacv, 0) / l.sessions)
          * (1 - ln(l.potential_sessions / l.sessions) / ln(3000)) ELSE coalesce(a.slacv, 0) END
          AS potential_sl_acv,
        CASE WHEN l.sessions > 30 THEN l.potential_sessions * (coalesce(a.daacv, 0) / l.sessions)
          * (1 - ln(l.potential_sessions / l.sessions) / ln(4000)) ELSE coalesce(a.daacv, 0) END
          AS potential_da_acv
      FROM lifted l LEFT JOIN acv_month a
        ON a.state = l.state AND a.county = l.county AND a.pt = l.pt) r"""

VIEWS["area_totals"] = """
SELECT r.state, r.county, p.pa, r.cluster, r.pop_total AS pop_base_count,
       coalesce(t.core, 0) AS core, coalesce(t.others, 0) AS others,
       coalesce(t.core, 0) + coalesce(t.others, 0) AS total,
       coalesce((coalesce(t.core, 0) + coalesce(t.others, 0)) / nullif(r.pop_total, 0), 0) AS total_pp,
       coalesce(coalesce(t.core, 0) / nullif(r.pop_total, 0), 0) AS core_pp
FROM regions r CROSS JOIN (SELECT unnest(['STANDARD', 'SMALL', 'MEDIUM', 'LARGE', 'ECONOMY', 'PROMO']) AS pa) p
LEFT JOIN traffic t ON t.state = r.state AND t.county = r.county AND t.pa = p.pa"""

VIEWS["area_targets"] = """
SELECT cluster, pa, max(CASE WHEN rt = k THEN total_pp END) AS target_total_pp,
       max(CASE WHEN rc = k THEN core_pp END) AS target_core_pp
FROM (SELECT *, greatest(1, round_even(cast(count(*) OVER (PARTITION BY cluster, pa) AS decimal(20,1))
          * 0.7, 0)) AS k,
        row_number() OVER (PARTITION BY cluster, pa ORDER BY total_pp) AS rt,
        row_number() OVER (PARTITION BY cluster, pa ORDER BY core_pp) AS rc FROM area_totals) q
GROUP BY cluster, pa"""

VIEWS["area_lifted"] = """
SELECT a.*, t.target_total_pp, t.target_core_pp,
       greatest(a.total_pp, t.target_total_pp) * a.pop_base_count AS potential_total,
       greatest(a.core_pp, t.target_core_pp) * a.pop_base_count AS potential_core
FROM area_totals a JOIN area_targets t ON t.cluster = a.cluster AND t.pa = a.pa"""

VIEWS["area_acv"] = """
SELECT state, county, pa, cast(sum(cast(slacv AS decimal(28,4))) AS double) / count(slacv) AS sl_acv,
       cast(sum(cast(daacv AS decimal(28,4))) AS double) / count(daacv) AS da_acv
FROM (SELECT month, state, county, pa, cast(sum(cast(slacv AS decimal(28,4))) AS double) AS slacv,
        cast(sum(cast(daacv AS decimal(28,4))) AS double) AS daacv
      FROM acv_input GROUP BY 1, 2, 3, 4) m GROUP BY 1, 2, 3"""

VIEWS["county_clusters"] = """
SELECT *, sl_acv + da_acv AS acv, potential_sl_acv + potential_da_acv AS potential_acv
FROM (SELECT l.*, a.sl_acv, a.da_acv,
        CASE WHEN l.total > 30 THEN l.potential_total * coalesce(a.sl_acv / l.total, 0)
          * (1 - ln(l.potential_total / l.total) / ln(100)) ELSE a.sl_acv END AS potential_sl_acv,
        CASE WHEN l.total > 30 THEN l.potential_total * coalesce(a.da_acv / l.total, 0)
          * (1 - ln(l.potential_total / l.total) / ln(100)) ELSE a.da_acv END AS potential_da_acv
      FROM area_lifted l LEFT JOIN area_acv a
        ON a.state = l.state AND a.county = l.county AND a.pa = l.pa) c"""

VIEWS["bi_rows"] = """
SELECT *, potential_total - total AS incremental_traffic, potential_acv - acv AS incremental_acv,
       potential_total / nullif(total, 0) - 1 AS pct_potential_total,
       (potential_acv - acv) / nullif(acv, 0) AS pct_potential_acv
FROM county_clusters"""


def with_views(sql: str) -> str:
    """Prefix a statement with the views it names, in dependency order."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in ordered and re.search(rf"\b{name}\b", text):
                visit_body(name)

    def visit_body(name: str) -> None:
        if name in ordered or name in active:
            return
        active.append(name)
        visit(VIEWS[name])
        active.pop()
        ordered.append(name)

    active: list[str] = []
    visit(sql)
    if not ordered:
        return sql.strip()
    views = ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in ordered)
    body = sql.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {views},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {views},\n{body[5:]}"
    return f"WITH {views}\n{body}"
