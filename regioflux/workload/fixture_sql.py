"""The derivations of fixtures.py once more, as DuckDB common table expressions.

with_fixtures("a", "b") gives the WITH clause for the named fixtures and those they build on.
"""

from __future__ import annotations

NEEDS = {
    "bought": (),
    "keyed": ("bought",),
    "flow_long": ("keyed",),
    "pair_year": ("keyed",),
    "net": ("flow_long",),
    "county_sums": ("keyed",),
    "county_pairs": ("county_sums",),
    "county_totals": ("county_pairs",),
    "disasters": (),
    "tract_scores": (),
    "indicators": ("bought",),
    "risk_counties": (),
    "parcels": (),
    "state_squares": (),
    "focus_flows": ("flow_long",),
    "top_focus": ("focus_flows",),
    "points": (),
}

SQL = {
    "bought": """
        SELECT c_nationkey AS dest, c_mktsegment AS segment, l_suppkey,
               CAST(year(l_shipdate) AS INTEGER) AS year, l_returnflag, l_quantity AS quantity
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""",
    "keyed": """
        SELECT dest, s_nationkey AS orig, segment, year, l_returnflag, quantity
        FROM bought JOIN supplier ON l_suppkey = s_suppkey""",
    "flow_long": """
        SELECT d.n_name AS current_state, o.n_name AS origin_state, year, quantity AS migrants
        FROM keyed JOIN nation d ON dest = d.n_nationkey JOIN nation o ON orig = o.n_nationkey""",
    "pair_year": "SELECT year, dest, orig, sum(quantity) AS total FROM keyed GROUP BY ALL",
    "net": """
        SELECT coalesce(i.state, o.state) AS state, coalesce(inflow, 0) AS inflow,
               coalesce(outflow, 0) AS outflow,
               coalesce(inflow, 0) - coalesce(outflow, 0) AS net_migration
        FROM (SELECT current_state AS state, sum(migrants) AS inflow FROM flow_long
              WHERE origin_state <> current_state GROUP BY 1) i
        FULL JOIN (SELECT origin_state AS state, sum(migrants) AS outflow FROM flow_long
                   WHERE origin_state <> current_state GROUP BY 1) o ON i.state = o.state""",
    "county_sums": """
        SELECT dest, segment, orig, CAST(sum(quantity) AS BIGINT) AS arrived,
               CAST(sum(CASE WHEN l_returnflag = 'R' THEN quantity ELSE 0 END) AS BIGINT) AS left_
        FROM keyed GROUP BY ALL""",
    "county_pairs": """
        SELECT d.n_name AS state_from,
               segment || CASE dest % 6 WHEN 0 THEN ' County' WHEN 1 THEN ' Parish'
                   WHEN 2 THEN ' Borough' WHEN 3 THEN ' Census Area' WHEN 4 THEN ' Municipality'
                   ELSE ' City and Borough' END AS county_from,
               o.n_name AS state_to, o.n_name || ' County' AS county_to,
               CAST(arrived AS DOUBLE) AS inflow, CAST(left_ AS DOUBLE) AS outflow,
               CAST(arrived - left_ AS DOUBLE) AS net_migration
        FROM county_sums JOIN nation d ON dest = d.n_nationkey JOIN nation o ON orig = o.n_nationkey
        WHERE arrived % 11 <> 0""",
    "county_totals": """
        SELECT state_from, county_from, sum(inflow) AS c_inflow, sum(outflow) AS c_outflow,
               sum(net_migration) AS net
        FROM county_pairs GROUP BY ALL""",
    "disasters": """
        SELECT CAST(o_orderkey // 10 AS BIGINT) AS "disasterNumber",
               CASE WHEN o_orderkey % 97 <> 0 THEN n_name END AS "STUSPS",
               CAST(year(o_orderdate) AS INTEGER) AS "fyDeclared",
               o_orderpriority AS "incidentType", c_mktsegment AS "designatedArea"
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "tract_scores": """
        SELECT n_name AS "STATE", lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || c_mktsegment
                   AS "GEOID_County",
               CASE WHEN c_acctbal >= 0 AND c_nationkey <> 24
                    THEN CAST(round(c_acctbal * 100) AS BIGINT) END AS "CVI_Score"
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "indicators": """
        SELECT n_name AS "Name",
               CAST((n_nationkey // 5) + 0.5 AS DOUBLE) AS lat, CAST((n_nationkey % 5) + 0.5 AS DOUBLE) AS lon,
               "Temperature", "Droughts", "Storms",
               CASE WHEN n_nationkey % 10 <> 3 THEN fires END AS "Wildfires", "Flooding"
        FROM nation
        LEFT JOIN (SELECT dest,
                CAST(sum(quantity) FILTER (l_returnflag = 'A') AS BIGINT) AS "Temperature",
                CAST(sum(quantity) FILTER (l_returnflag = 'R') AS BIGINT) AS "Droughts",
                CAST(sum(quantity) FILTER (l_returnflag = 'N') AS BIGINT) AS "Storms"
            FROM bought GROUP BY 1) ON dest = n_nationkey
        LEFT JOIN (SELECT c_nationkey, count(*) FILTER (o_orderstatus = 'F') AS fires,
                count(*) FILTER (o_orderstatus = 'O') AS "Flooding"
            FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) c
            ON c.c_nationkey = n_nationkey""",
    "risk_counties": """
        SELECT lpad(CAST(p_partkey AS VARCHAR), 12, '0') AS "STCOFIPS", p_name AS "COUNTY",
               'NATION_' || (p_partkey % 25) AS "STATEABBRV",
               lpad(CAST(p_partkey % 25 AS VARCHAR), 2, '0') AS "STATEFIPS",
               CASE WHEN p_partkey % 17 <> 0 THEN CAST(round(p_retailprice * 100) AS BIGINT) END
                   AS "RISK_SCORE",
               CASE WHEN p_partkey % 401 <> 0 THEN CAST(p_size AS BIGINT) END AS "POPULATION",
               CASE p_size % 6 WHEN 0 THEN 'Very Low' WHEN 1 THEN 'Low' WHEN 2 THEN 'Moderate'
                   WHEN 3 THEN 'High' WHEN 4 THEN 'Very High' ELSE 'No Rating' END AS "RISK_RATNG"
        FROM part""",
    "parcels": """
        SELECT c_custkey AS geo_id, c_nationkey, seq,
               CAST(c_custkey % 100 + CASE WHEN seq IN (1, 2) THEN 1 ELSE 0 END AS DOUBLE) AS x,
               CAST(c_custkey // 100 + CASE WHEN seq IN (2, 3) THEN 1 ELSE 0 END AS DOUBLE) AS y
        FROM customer, (SELECT unnest([0, 1, 2, 3, 4]) AS seq)""",
    "state_squares": """
        SELECT CAST(n_nationkey AS BIGINT) AS geo_id, n_name,
               CAST(n_nationkey % 5 AS DOUBLE) AS west, CAST(n_nationkey // 5 AS DOUBLE) AS south,
               CAST(n_nationkey % 5 + 1 AS DOUBLE) AS east,
               CAST(n_nationkey // 5 + 1 AS DOUBLE) AS north
        FROM nation""",
    "focus_flows": """
        SELECT origin_state, current_state, sum(migrants) AS migrants,
               CASE WHEN current_state IN ('NATION_3', 'NATION_8', 'NATION_21') THEN 'Inflow'
                    ELSE 'Outflow' END AS flow_type
        FROM flow_long
        WHERE origin_state <> current_state
          AND (current_state IN ('NATION_3', 'NATION_8', 'NATION_21')
               OR origin_state IN ('NATION_3', 'NATION_8', 'NATION_21'))
        GROUP BY 1, 2""",
    "top_focus": """
        SELECT origin_state, current_state, migrants, flow_type FROM focus_flows
        QUALIFY row_number() OVER (PARTITION BY flow_type
            ORDER BY migrants DESC, origin_state, current_state) <= 15""",
    "points": """
        SELECT n_name AS name, CAST(n_nationkey % 5 AS DOUBLE) + 0.5 AS lon,
               CAST(n_nationkey // 5 AS DOUBLE) + 0.5 AS lat
        FROM nation WHERE n_name NOT IN ('NATION_4', 'NATION_9')""",
}


def with_fixtures(*names: str) -> str:
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in NEEDS[name]:
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{name} AS ({SQL[name]})" for name in ordered) + "\n"
