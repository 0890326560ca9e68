"""The same results as plain SQL for DuckDB, over the same Parquet views.

`VIEWS` derives the star schema; `sql(body, *views)` puts the views a query needs in front of it.
Ratios are doubles; they pass through DECIMAL(38,10) before rounding so that ties go away from zero.
"""

from __future__ import annotations


def rnd(expression: str, digits: int) -> str:
    return f"CAST(ROUND(CAST({expression} AS DECIMAL(38,10)), {digits}) AS DOUBLE)"


def even(expression: str, digits: int = 2) -> str:
    scale = f"CAST({10**digits} AS DOUBLE)"
    return f"(round_even(({expression}) * {scale}, 0) / {scale} + CAST(0 AS DOUBLE))"


def money(expression: str) -> str:
    """A sum of amounts rounded to hundredths, as a double."""
    return f"CAST(CAST({expression} AS DECIMAL(28,2)) AS DOUBLE)"


def big(expression: str) -> str:
    return f"CAST({expression} AS BIGINT)"


def code(prefix: str, number: str, width: int) -> str:
    return f"'{prefix}' || lpad(CAST({number} AS VARCHAR), {width}, '0')"


CITY = code("C", "n_nationkey", 3)

VIEWS = {
    "city_data": f"""
        SELECT {CITY} AS city_id, n_name AS city, r_name AS state,
               'Tier ' || CAST(n_nationkey % 3 + 1 AS VARCHAR) AS tier
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "edition_months": """
        SELECT l_suppkey, s_nationkey, n_nationkey, r_name,
               CAST(date_trunc('month', l_shipdate) AS DATE) + INTERVAL 24 YEAR AS month,
               CAST(SUM(l_quantity) AS BIGINT) AS sold,
               CAST(COALESCE(SUM(CASE WHEN l_returnflag = 'R' AND l_linenumber <= 1 + s_nationkey % 7
                                      THEN l_quantity END), 0) AS BIGINT) AS returned
        FROM lineitem
        JOIN supplier ON l_suppkey = s_suppkey
        JOIN nation ON s_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey
        GROUP BY 1, 2, 3, 4, 5""",
    "print_sales": f"""
        SELECT {code('ED', 'l_suppkey', 6)} AS edition_id, {CITY} AS city_id, r_name AS state,
               sold AS copies_sold, returned AS copies_returned, sold - returned AS net_circulation,
               CAST(year(month) AS INTEGER) AS year, CAST(month(month) AS INTEGER) AS month_num
        FROM edition_months""",
    "ad_category": """
        SELECT DISTINCT 'A00' || substr(o_orderpriority, 1, 1) AS ad_category_id,
               substr(o_orderpriority, 3) AS standard_ad_category
        FROM orders""",
    "ad_revenue": f"""
        SELECT {code('ED', 'o_custkey % (SELECT COUNT(*) FROM supplier)', 6)} AS edition_id,
               'A00' || substr(o_orderpriority, 1, 1) AS ad_category,
               CAST(o_totalprice AS DECIMAL(28,10)) AS ad_revenue,
               CAST(year(o_orderdate) + 24 AS INTEGER) AS year, CAST(quarter(o_orderdate) AS INTEGER) AS quarter_num,
               CAST(round_even(o_totalprice
                    * CASE WHEN o_orderkey % 10 BETWEEN 4 AND 6 THEN CAST(88.14 AS DOUBLE)
                           WHEN o_orderkey % 10 BETWEEN 7 AND 8 THEN CAST(103.39 AS DOUBLE)
                           ELSE CAST(1 AS DOUBLE) END * 100, 0) / 100 AS DECIMAL(28,10)) AS ad_revenue_inr
        FROM orders""",
    "raw_ad_revenue": f"""
        SELECT o_orderkey, {code('ED', 'o_custkey % (SELECT COUNT(*) FROM supplier)', 6)} AS edition_id,
               'A00' || substr(o_orderpriority, 1, 1) AS ad_category,
               CASE quarter(o_orderdate)
                    WHEN 2 THEN CAST(year(o_orderdate) + 24 AS VARCHAR) || '-Q2'
                    WHEN 4 THEN '4th Qtr ' || CAST(year(o_orderdate) + 24 AS VARCHAR)
                    ELSE 'Q' || CAST(quarter(o_orderdate) AS VARCHAR) || '-'
                         || CAST(year(o_orderdate) + 24 AS VARCHAR) END AS quarter,
               o_totalprice AS ad_revenue,
               CASE o_orderkey % 10
                    WHEN 0 THEN 'INR' WHEN 1 THEN ' inr ' WHEN 2 THEN 'In Rupees'
                    WHEN 3 THEN chr(9) || 'IN RUPEES ' WHEN 4 THEN 'USD' WHEN 5 THEN 'usd'
                    WHEN 6 THEN ' Usd' WHEN 7 THEN 'EUR' WHEN 8 THEN 'eur' || chr(9)
                    ELSE 'GBP' END AS currency,
               CASE WHEN o_orderstatus = 'P' THEN 'Seasonal booking' END AS comments
        FROM orders""",
    "city_readiness": f"""
        SELECT CAST(c_nationkey AS BIGINT) * 100000 + (year(o_orderdate) + 24) * 10
                 + quarter(o_orderdate) AS row_id,
               {code('C', 'c_nationkey', 3)} AS city_id,
               CAST(year(o_orderdate) + 24 AS VARCHAR) || '-Q'
                 || CAST(quarter(o_orderdate) AS VARCHAR) AS quarter,
               CAST(year(o_orderdate) + 24 AS INTEGER) AS year, CAST(quarter(o_orderdate) AS INTEGER) AS quarter_num,
               {rnd("COUNT(*) FILTER (o_orderstatus = 'F') * 100 / COUNT(*)", 2)} AS literacy_rate,
               {rnd("COUNT(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) * 100 / COUNT(*)", 2)}
                 AS smartphone_penetration,
               {rnd("COUNT(*) FILTER (o_totalprice > 100000) * 100 / COUNT(*)", 2)}
                 AS internet_penetration
        FROM orders JOIN customer ON o_custkey = c_custkey
        GROUP BY c_nationkey, year(o_orderdate), quarter(o_orderdate)""",
    "digital_plot": f"""
        SELECT MIN(event_id) AS row_id, event_type AS platform,
               strftime(MIN(ts), '%Y-%m') AS launch_month,
               'A00' || CAST(user_id % 25 % 5 + 1 AS VARCHAR) AS ad_category_id,
               CAST(SUM(event_id % 1000) AS BIGINT) AS dev_cost,
               CAST(SUM(event_id % 100) AS BIGINT) AS marketing_cost,
               COUNT(DISTINCT user_id) AS users_reached, COUNT(*) AS downloads_or_accesses,
               {rnd('CAST(SUM(CAST(ROUND(value, 2) AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*)', 2)}
                 AS avg_bounce_rate,
               CASE WHEN COUNT(*) % 2 = 0
                    THEN event_type || ' from ' || {code('C', 'user_id % 25', 3)} END
                 AS cumulative_feedback_from_customers,
               {code('C', 'user_id % 25', 3)} AS city_id
        FROM events
        GROUP BY event_type, user_id % 25""",
    "readiness_scores": """
        SELECT city_id,
               CAST(SUM(CAST(literacy_rate AS DECIMAL(28,12))
                        + CAST(smartphone_penetration AS DECIMAL(28,12))
                        + CAST(internet_penetration AS DECIMAL(28,12))) AS DOUBLE)
                 / COUNT(*) / 3 AS readiness
        FROM city_readiness GROUP BY city_id""",
    "engagement_scores": """
        SELECT city_id, CAST(SUM(users_reached + downloads_or_accesses) AS BIGINT) AS engagement
        FROM digital_plot GROUP BY city_id""",
    "decline_rates": f"""
        SELECT city_id, {rnd('CAST(SUM(change) AS DOUBLE) / COUNT(*)', 8)} AS decline
        FROM (SELECT city_id,
                     CAST((net - LAG(net) OVER w) * 100 / NULLIF(LAG(net) OVER w, 0)
                          AS DECIMAL(28,10)) AS change
              FROM (SELECT city_id, year, CAST(SUM(net_circulation) AS BIGINT) AS net
                    FROM print_sales GROUP BY city_id, year)
              WINDOW w AS (PARTITION BY city_id ORDER BY year))
        WHERE change IS NOT NULL
        GROUP BY city_id""",
    # The many-to-many join written out: what the pre-aggregated form has to equal.
    "joined_years": """
        SELECT cd.city_id, cd.city, ar.year, SUM(CAST(ps.net_circulation AS HUGEINT)) AS net,
               SUM(ar.ad_revenue_inr) AS revenue
        FROM city_data cd
        JOIN print_sales ps ON cd.city_id = ps.city_id
        JOIN ad_revenue ar ON ps.edition_id = ar.edition_id AND ps.year = ar.year
        GROUP BY cd.city_id, cd.city, ar.year""",
    "single_years": """
        SELECT cd.city_id, cd.city, p.year, SUM(p.net) AS net, SUM(a.revenue) AS revenue
        FROM (SELECT edition_id, city_id, year, SUM(net_circulation) AS net
              FROM print_sales GROUP BY ALL) p
        JOIN (SELECT edition_id, year, SUM(ad_revenue_inr) AS revenue
              FROM ad_revenue GROUP BY ALL) a USING (edition_id, year)
        JOIN city_data cd USING (city_id)
        GROUP BY cd.city_id, cd.city, p.year""",
}

NEEDS = {
    "print_sales": ["edition_months"],
    "readiness_scores": ["city_readiness"],
    "engagement_scores": ["digital_plot"],
    "decline_rates": ["print_sales"],
    "joined_years": ["city_data", "print_sales", "ad_revenue"],
    "single_years": ["city_data", "print_sales", "ad_revenue"],
}


def sql(body: str, *views: str) -> str:
    """The query with the views it needs, in dependency order, as leading CTEs."""
    ordered: list[str] = []

    def need(view: str) -> None:
        for other in NEEDS.get(view, []):
            need(other)
        if view not in ordered:
            ordered.append(view)

    for view in views:
        need(view)
    ctes = ",\n".join(f"{view} AS ({VIEWS[view]})" for view in ordered)
    head = f"WITH {ctes}" if ctes else ""
    text = body.strip()
    if head and text.upper().startswith("WITH "):
        return f"{head},\n{text[5:]}"
    return f"{head}\n{text}"


def pct(current: str, previous: str) -> str:
    return f"CAST(({current} - {previous}) * 100 AS DOUBLE) / NULLIF({previous}, 0)"


def state_trend_body(
    source: str = "print_sales", first_year: int = 2019, last_year: int = 2024
) -> str:
    changes = ",\n".join(
        rnd(pct(c, f"LAG({c}) OVER w"), 2) + f" AS YoY_{m}_Change_Percent"
        for m, c in (
            ("Sold", "Total_Copies_Sold"),
            ("Returned", "Total_Copies_Returned"),
            ("Net", "Total_Net_Circulation"),
        )
    )
    return f"""
        SELECT year, state AS State, Total_Copies_Sold, Total_Copies_Returned,
               Total_Net_Circulation, {changes}
        FROM (SELECT year, state, {big('SUM(copies_sold)')} AS Total_Copies_Sold,
                     {big('SUM(copies_returned)')} AS Total_Copies_Returned,
                     {big('SUM(net_circulation)')} AS Total_Net_Circulation
              FROM {source} WHERE year BETWEEN {first_year} AND {last_year} GROUP BY year, state)
        WINDOW w AS (PARTITION BY state ORDER BY year)"""


def state_trend(**years: int) -> str:
    return sql(state_trend_body(**years), "print_sales")


def city_contribution(year: int = 2024) -> str:
    def mean(c: str) -> str:
        return even(f"CAST(SUM(CAST({c} AS DECIMAL(28,12))) AS DOUBLE) / COUNT({c})")

    return sql(
        f"""
        WITH sold AS (
            SELECT c.city_id, c.city, {big('SUM(copies_sold)')} AS sold,
                   {big('SUM(net_circulation)')} AS net,
                   {rnd('SUM(copies_returned) * 100 / NULLIF(SUM(copies_sold), 0)', 2)} AS pct
            FROM print_sales p JOIN city_data c USING (city_id)
            WHERE p.year = {year} GROUP BY c.city_id, c.city)
        SELECT city, sold AS Total_Copies_Sold, net AS Total_Net_Circulation,
               {mean('literacy_rate')} AS literacy_rate,
               {mean('smartphone_penetration')} AS smartphone_penetration,
               {mean('internet_penetration')} AS internet_penetration,
               pct AS Return_Percent,
               CASE WHEN pct < 10 THEN 'Highly Profitable' WHEN pct < 20 THEN 'Moderately Profitable'
                    WHEN pct < 30 THEN 'Marginally Profitable' ELSE 'Needs Review' END
                 AS Profitable_Category
        FROM sold cs LEFT JOIN city_readiness cr ON cs.city_id = cr.city_id
        WHERE cr.year = {year}
        GROUP BY cs.city_id, city, sold, net, pct""",
        "print_sales",
        "city_data",
        "city_readiness",
    )


def category_strength(
    amount: str = "ad_revenue", source: str = "ad_revenue", view: str = "ad_revenue"
) -> str:
    years = range(2019, 2025)
    cells = ",\n".join(f"MAX(total) FILTER (year = {y}) AS r{y}" for y in years)
    all_present = " AND ".join(f"r{y} IS NOT NULL" for y in years)
    best = f"CASE WHEN {all_present} THEN GREATEST({', '.join(f'r{y}' for y in years)}) END"
    rises = " + ".join(f"CASE WHEN r{y} > r{y - 1} THEN 1 ELSE 0 END" for y in years if y > 2019)
    return sql(
        f"""
        WITH cells AS (
            SELECT standard_ad_category, {cells}
            FROM (SELECT standard_ad_category, year, SUM({amount}) AS total
                  FROM {source} JOIN ad_category ON ad_category = ad_category_id
                  WHERE year BETWEEN 2019 AND 2024
                  GROUP BY standard_ad_category, year)
            GROUP BY standard_ad_category),
        metrics AS (
            SELECT *, CAST(r2024 - r2019 AS DOUBLE) / NULLIF(CAST(r2019 AS DOUBLE), 0) AS growth,
                   {rises} AS consistency,
                   CASE WHEN r2024 = {best} THEN 1.0 WHEN r2023 = {best} THEN 0.8 ELSE 0.4 END AS peak,
                   CASE WHEN r2024 > r2022 AND r2022 < r2021 THEN 1.0 ELSE 0.6 END AS recovery
            FROM cells),
        scored AS (
            SELECT *, CASE WHEN growth > 0.20 THEN 30 WHEN growth > 0.10 THEN 25
                           WHEN growth > 0.05 THEN 20 WHEN growth > -0.05 THEN 15
                           WHEN growth > -0.10 THEN 10 WHEN growth > -0.25 THEN 5 ELSE 0 END
                      + consistency * 6 + peak * 20 + recovery * 20 AS score
            FROM metrics)
        SELECT standard_ad_category, {', '.join(f'{money(f"r{y}")} AS revenue_{y}' for y in years)},
               {even('growth * 100')} AS net_growth_percent,
               CAST(consistency AS INTEGER) AS consistency_score,
               CAST(peak AS DOUBLE) AS peak_timing_score,
               CAST(recovery AS DOUBLE) AS recovery_score,
               CAST(score AS DOUBLE) AS total_strength_score,
               CASE WHEN score >= 80 THEN 'STRONG: Sustained Growth'
                    WHEN score >= 60 THEN 'STABLE: Consistent Performer'
                    WHEN score >= 40 THEN 'WATCH: Plateauing'
                    WHEN score >= 20 THEN 'DECLINING: Needs Intervention'
                    ELSE 'CRITICAL: Severe Decline' END AS final_verdict
        FROM scored""",
        view,
        "ad_category",
    )


def revenue_by_city() -> str:
    return sql(
        f"""
        SELECT city, state, {money('SUM(r.total)')} AS Total_City_Ad_Revenue,
               {big('SUM(e.net)')} AS Total_City_Net_Circulation,
               {even('CAST(SUM(r.total) AS DOUBLE) / NULLIF(SUM(e.net), 0)')}
                 AS Revenue_Per_Net_Copy_Ratio
        FROM city_data
        JOIN (SELECT edition_id, city_id, SUM(net_circulation) AS net
              FROM print_sales GROUP BY edition_id, city_id) e USING (city_id)
        JOIN (SELECT edition_id, SUM(ad_revenue_inr) AS total
              FROM ad_revenue GROUP BY edition_id) r USING (edition_id)
        GROUP BY city, state""",
        "city_data",
        "print_sales",
        "ad_revenue",
    )


def ready_but_unengaged() -> str:
    return sql(
        f"""
        SELECT city, state, {even('readiness')} AS Avg_Readiness_Score,
               engagement AS Total_Engagement
        FROM city_data JOIN readiness_scores USING (city_id) JOIN engagement_scores USING (city_id)
        WHERE CAST(readiness AS DECIMAL(28,10)) > (
                SELECT CAST(SUM(CAST(readiness AS DECIMAL(28,10))) AS DOUBLE) / COUNT(*)
                FROM readiness_scores)
          AND engagement < (SELECT SUM(engagement) / COUNT(*) FROM engagement_scores)""",
        "city_data",
        "readiness_scores",
        "engagement_scores",
    )


def revenue_per_copy(view: str = "joined_years") -> str:
    change = "CAST((ratio - previous) * 100 AS DOUBLE) / NULLIF(CAST(previous AS DOUBLE), 0)"
    return sql(
        f"""
        SELECT city, year, CAST(ratio AS DOUBLE) AS Revenue_Per_Copy_Ratio,
               CAST(previous AS DOUBLE) AS Previous_Year_Ratio,
               {rnd(change, 2)} AS YoY_Ratio_Change_Percentage,
               CASE WHEN previous IS NULL THEN 'No Prior Year Data'
                    WHEN ratio > previous THEN 'Improving (Wider Margin)'
                    WHEN ratio < previous THEN 'Worsening (Tighter Margin)'
                    ELSE 'Stable' END AS Ratio_Trend
        FROM (SELECT city, year, ratio,
                     LAG(ratio) OVER (PARTITION BY city_id ORDER BY year) AS previous
              FROM (SELECT city_id, city, year,
                           CAST({rnd('CAST(revenue AS DOUBLE) / CAST(net AS DOUBLE)', 4)}
                                AS DECIMAL(18,4)) AS ratio
                    FROM {view} WHERE net > 0))""",
        view,
    )


def relaunch_priority(order: str | None = None, limit: int | None = None) -> str:
    tile = "NTILE(4) OVER (ORDER BY {}, city_id)"
    tiles = {
        "Readiness_Priority": tile.format("readiness DESC NULLS LAST"),
        "Engagement_Priority": tile.format("engagement ASC NULLS FIRST"),
        "Decline_Priority": tile.format("decline ASC NULLS FIRST"),
    }
    cut = f"ORDER BY Prioritization_Score {order}, Avg_Readiness_Score DESC, city LIMIT {limit}"
    return sql(
        f"""
        SELECT *, Readiness_Priority + Engagement_Priority + Decline_Priority AS Prioritization_Score
        FROM (SELECT city, state, tier, {even('readiness', 4)} AS Avg_Readiness_Score,
                     engagement AS Total_Engagement, {rnd('decline', 2)} AS Avg_Decline_Rate_Percent,
                     {', '.join(f'CAST({t} AS INTEGER) AS {n}' for n, t in tiles.items())}
              FROM city_data JOIN readiness_scores USING (city_id)
              JOIN engagement_scores USING (city_id) JOIN decline_rates USING (city_id))
        {cut if limit else ''}""",
        "city_data",
        "readiness_scores",
        "engagement_scores",
        "decline_rates",
    )


def sharpest_falls() -> str:
    return sql(
        f"""
        SELECT city AS city_name, year,
               CAST(year AS VARCHAR) || '-' || lpad(CAST(month_num AS VARCHAR), 2, '0') AS month,
               net AS net_circulation, {rnd('change', 2)} AS MoM_Decline_Percentage
        FROM (SELECT *, {pct('net', 'previous')} AS change
              FROM (SELECT *, LAG(net) OVER (PARTITION BY city_id ORDER BY year, month_num) AS previous
                    FROM (SELECT city_id, city, year, month_num, {big('SUM(net_circulation)')} AS net
                          FROM print_sales JOIN city_data USING (city_id)
                          GROUP BY city_id, city, year, month_num))
              WHERE net < previous)
        ORDER BY change ASC NULLS FIRST, city_id, year, month_num
        LIMIT 3""",
        "print_sales",
        "city_data",
    )


def print_efficiency() -> str:
    return sql(
        f"""
        SELECT city AS city_name, printed AS copies_printed_2024, net AS net_circulation_2024,
               {rnd('ratio', 4)} AS efficiency_ratio, CAST(r AS INTEGER) AS efficiency_rank_2024
        FROM (SELECT *, RANK() OVER (ORDER BY ratio DESC NULLS LAST) AS r
              FROM (SELECT city_id, {big('SUM(net_circulation)')} AS net,
                           {big('SUM(copies_sold + copies_returned)')} AS printed,
                           {rnd('SUM(net_circulation) / NULLIF(SUM(copies_sold + copies_returned), 0)', 8)}
                             AS ratio
                    FROM print_sales WHERE year = 2024
                    GROUP BY city_id HAVING SUM(copies_sold + copies_returned) > 0))
        JOIN city_data USING (city_id)
        WHERE r <= 5""",
        "print_sales",
        "city_data",
    )


def internet_growth() -> str:
    return sql(
        f"""
        SELECT city AS city_name, q1 AS internet_rate_q1_2021, q4 AS internet_rate_q4_2021,
               {even('q4 - q1', 4)} AS delta_internet_rate
        FROM (SELECT city_id, MAX(internet_penetration) FILTER (quarter_num = 1) AS q1,
                     MAX(internet_penetration) FILTER (quarter_num = 4) AS q4
              FROM city_readiness WHERE year = 2021 AND quarter_num IN (1, 4)
              GROUP BY city_id
              HAVING COUNT(*) FILTER (quarter_num = 1) > 0 AND COUNT(*) FILTER (quarter_num = 4) > 0)
        JOIN city_data USING (city_id)""",
        "city_readiness",
        "city_data",
    )


def frequent_declines(view: str = "joined_years") -> str:
    return sql(
        f"""
        SELECT city AS city_name, {big('SUM(p)')} AS num_print_declines,
               {big('SUM(a)')} AS num_ad_declines, {big('SUM(p) + SUM(a)')} AS total_decline_events
        FROM (SELECT city_id, city,
                     CASE WHEN net < LAG(net) OVER w THEN 1 ELSE 0 END AS p,
                     CASE WHEN revenue < LAG(revenue) OVER w THEN 1 ELSE 0 END AS a
              FROM {view} WHERE year BETWEEN 2020 AND 2024
              WINDOW w AS (PARTITION BY city_id ORDER BY year))
        GROUP BY city_id, city
        ORDER BY total_decline_events DESC, num_print_declines DESC, city, city_id
        LIMIT 5""",
        view,
    )


def pilot_performance() -> str:
    users, downloads = "SUM(users_reached)", "SUM(downloads_or_accesses)"
    cost = "SUM(dev_cost + marketing_cost)"
    bounce = "CAST(SUM(CAST(avg_bounce_rate AS DECIMAL(28,12))) AS DOUBLE) / COUNT(avg_bounce_rate)"
    return sql(
        f"""
        SELECT platform, {big(users)} AS users_reached, {big(downloads)} AS downloads_or_accesses,
               {rnd(f'{downloads} / NULLIF({users}, 0)', 4)} AS downloads_per_user,
               {even(bounce)} AS avg_bounce_rate, {big(cost)} AS total_cost,
               {rnd(f'{cost} / NULLIF({downloads}, 0)', 2)} AS cost_per_access
        FROM digital_plot GROUP BY platform""",
        "digital_plot",
    )


def circulation_change() -> str:
    return sql(
        f"""
        SELECT first_net, last_net, {rnd(pct('last_net', 'first_net'), 2)} AS change_percent
        FROM (SELECT {big('SUM(net_circulation) FILTER (year = 2019)')} AS first_net,
                     {big('SUM(net_circulation) FILTER (year = 2024)')} AS last_net
              FROM print_sales)""",
        "print_sales",
    )


def category_share() -> str:
    return sql(
        f"""
        SELECT standard_ad_category, {money('revenue')} AS revenue,
               {rnd('CAST(revenue * 100 AS DOUBLE) / CAST(SUM(revenue) OVER () AS DOUBLE)', 2)}
                 AS share_percent
        FROM (SELECT standard_ad_category, SUM(ad_revenue_inr) AS revenue
              FROM ad_revenue JOIN ad_category ON ad_category = ad_category_id
              GROUP BY standard_ad_category)""",
        "ad_revenue",
        "ad_category",
    )


def revenue_circulation_correlation() -> str:
    return sql(
        f"""
        SELECT state AS State, COUNT(*) AS edition_years,
               {rnd('corr(revenue, net)', 6)} AS correlation
        FROM (SELECT edition_id, year, state, CAST(SUM(net_circulation) AS DOUBLE) AS net
              FROM print_sales GROUP BY ALL)
        JOIN (SELECT edition_id, year, CAST(SUM(ad_revenue_inr) AS DOUBLE) AS revenue
              FROM ad_revenue GROUP BY ALL) USING (edition_id, year)
        GROUP BY state""",
        "print_sales",
        "ad_revenue",
    )


QUESTIONS = {
    "q1_state_trend": state_trend(),
    "q1_state_trend_late": state_trend(first_year=2022, last_year=2025),
    "q2_city_contribution": city_contribution(),
    "q2_city_contribution_2023": city_contribution(2023),
    "q3_category_strength": category_strength(),
    "q3_category_strength_inr": category_strength("ad_revenue_inr"),
    "q4_revenue_by_city": revenue_by_city(),
    "q5_ready_but_unengaged": ready_but_unengaged(),
    "q6_revenue_per_copy": revenue_per_copy(),
    "q6_revenue_per_copy_single": revenue_per_copy("single_years"),
    "q7_relaunch_priority": relaunch_priority(),
    "q7_relaunch_best_three": relaunch_priority("ASC", 3),
    "q7_relaunch_distributed": relaunch_priority(),
    "q8_sharpest_falls": sharpest_falls(),
    "q9_print_efficiency": print_efficiency(),
    "q10_internet_growth": internet_growth(),
    "q11_frequent_declines": frequent_declines(),
    "q11_frequent_declines_single": frequent_declines("single_years"),
    "k1_pilot_performance": pilot_performance(),
    "k2_circulation_change": circulation_change(),
    "k3_category_share": category_share(),
    "k4_revenue_circulation": revenue_circulation_correlation(),
}


VIEWS |= {
    "raw_city_readiness": """
        SELECT row_id, city_id, quarter, literacy_rate, smartphone_penetration, internet_penetration
        FROM city_readiness""",
    "raw_print_sales": """
        SELECT 'ED' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS edition_id,
               'C' || lpad(CAST(s_nationkey AS VARCHAR), 3, '0') AS "City_ID",
               CASE WHEN r_name <> 'ASIA' THEN r_name WHEN n_nationkey % 3 = 0 THEN 'Uttar-Pradesh'
                    WHEN n_nationkey % 3 = 1 THEN 'Uttar pradesh' ELSE 'Uttar Pradesh' END AS "State",
               CASE l_suppkey % 5 WHEN 0 THEN strftime(month, '%Y-%m')
                    WHEN 1 THEN strftime(month, '%Y-%m-%d') WHEN 2 THEN strftime(month, '%Y/%m/%d')
                    WHEN 3 THEN strftime(month, '%b-%Y') ELSE 'unknown' END AS "Month",
               sold AS "Copies Sold", returned AS copies_returned,
               sold - returned AS "Net_Circulation"
        FROM edition_months""",
    # What cleaning has to arrive at, from the facts behind the raw texts rather than from the texts.
    "clean_print_sales": """
        SELECT 'ED' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS edition_id,
               'C' || lpad(CAST(s_nationkey AS VARCHAR), 3, '0') AS "City_ID",
               CASE WHEN r_name = 'ASIA' THEN 'Uttar Pradesh' ELSE r_name END AS "State",
               CASE WHEN l_suppkey % 5 < 4 THEN CAST(month AS DATE) END AS "Month",
               sold AS "Copies_Sold", returned AS copies_returned,
               sold - returned AS "Net_Circulation"
        FROM edition_months""",
    "clean_ad_revenue": """
        SELECT o_orderkey, 'A00' || substr(o_orderpriority, 1, 1) AS ad_category,
               CAST(year(o_orderdate) + 24 AS INTEGER) AS year, CAST(quarter(o_orderdate) AS INTEGER) AS quarter_num,
               upper(trim(currency, ' ' || chr(9))) AS currency,
               round_even(r.ad_revenue * CASE WHEN o_orderkey % 10 <= 3 THEN CAST(1 AS DOUBLE)
                                     WHEN o_orderkey % 10 <= 6 THEN CAST(88.14 AS DOUBLE)
                                     WHEN o_orderkey % 10 <= 8 THEN CAST(103.39 AS DOUBLE) END
                          * 100, 0) / 100 AS ad_revenue_inr,
               r.edition_id, r.quarter, r.ad_revenue,
               COALESCE(r.comments, 'No Commensts') AS comments
        FROM raw_ad_revenue r JOIN orders USING (o_orderkey)""",
}
VIEWS["joined_clean"] = """
        SELECT cd.city_id, cd.city, ar.year, SUM(CAST("Net_Circulation" AS HUGEINT)) AS net,
               SUM(CAST(ar.ad_revenue_inr AS DECIMAL(28,10))) AS revenue
        FROM city_data cd
        JOIN clean_print_sales ps ON cd.city_id = ps."City_ID"
        JOIN clean_ad_revenue ar ON ps.edition_id = ar.edition_id AND year(ps."Month") = ar.year
        GROUP BY cd.city_id, cd.city, ar.year"""
NEEDS |= {
    "joined_clean": ["city_data", "clean_print_sales", "clean_ad_revenue"],
    "raw_city_readiness": ["city_readiness"],
    "raw_print_sales": ["edition_months"],
    "clean_print_sales": ["edition_months"],
    "clean_ad_revenue": ["raw_ad_revenue"],
}

RAW_COLUMNS = {
    "ad_revenue": "edition_id, ad_category, quarter, ad_revenue, currency, comments",
    "city_readiness": "row_id, city_id, quarter, literacy_rate, smartphone_penetration, "
    "internet_penetration",
    "digital_plot": "row_id, platform, launch_month, ad_category_id, dev_cost, marketing_cost, "
    "users_reached, downloads_or_accesses, avg_bounce_rate, cumulative_feedback_from_customers, city_id",
    "print_sales": 'edition_id, City_ID, State, "Month", "Copies Sold", copies_returned, Net_Circulation',
}
RAW_VIEWS = {
    "ad_revenue": "raw_ad_revenue",
    "city_readiness": "raw_city_readiness",
    "digital_plot": "digital_plot",
    "print_sales": "raw_print_sales",
}


def _names(table: str) -> list[str]:
    return [c.strip().strip('"') for c in RAW_COLUMNS[table].split(",")]


def union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def null_counts() -> str:
    return sql(
        union(
            [
                f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", "
                f"COUNT(*) - COUNT(\"{c}\") AS nulls FROM {view}"
                for t, view in RAW_VIEWS.items()
                for c in _names(t)
            ]
        ),
        *RAW_VIEWS.values(),
    )


def duplicate_rows() -> str:
    counts = {t: (RAW_COLUMNS[t], view) for t, view in RAW_VIEWS.items()}
    counts["lineitem"] = ("l_orderkey, l_linenumber", "lineitem")
    return sql(
        union(
            [
                f"SELECT '{t}' AS \"table\", (SELECT COUNT(*) FROM {view}) - "
                f"(SELECT COUNT(*) FROM (SELECT DISTINCT {columns} FROM {view})) AS duplicates"
                for t, (columns, view) in counts.items()
            ]
        ),
        *RAW_VIEWS.values(),
    )


def shapes_body() -> str:
    return union(
        [
            f"SELECT '{t}' AS \"table\", COUNT(*) AS rows, {len(_names(t))} AS columns FROM {view}"
            for t, view in RAW_VIEWS.items()
        ]
    )


def cleaning_counts() -> str:
    """Rows, rows that don't fit and labels not read per raw table, nulls per column of print sales."""
    cells = []
    for table, view, label in (
        ("ad_category", "ad_category", None), ("city_data", "city_data", None), ("ad_revenue", "raw_ad_revenue", "quarter"),
        ("city_readiness", "raw_city_readiness", "quarter"), ("digital_plot", "digital_plot", "launch_month"),
    ):
        cells.append(f"SELECT '{table}', '', 'rows', COUNT(*) FROM {view}")
        cells.append(f"SELECT '{table}', '', 'malformed', 0")
        if label:
            cells.append(f"SELECT '{table}', '{label}', 'unread', 0")
    sales = {
        ("", "rows"): "true", ("", "malformed"): "n IN (1, 2, 3)", ("Month", "unread"): "Month = 'unknown'",
        ("Copies Sold", "nulls"): "n = 3", ("copies_returned", "nulls"): "n = 1", ("Net_Circulation", "nulls"): "n = 1",
        **{(c, "nulls"): "false" for c in ("edition_id", "City_ID", "State", "Month")},
    }
    for (column, metric), test in sales.items():
        cells.append(f"SELECT 'print_sales', '{column}', '{metric}', COUNT(*) FILTER ({test}) FROM numbered")
    return sql(
        """
        WITH numbered AS (SELECT *, CAST(substr(edition_id, 3) AS INTEGER) % 7 AS n FROM raw_print_sales),
        cells("table", "column", metric, value) AS ("""
        + "\nUNION ALL ".join(cells)
        + """)
        SELECT "table", "column", metric, CAST(value AS DOUBLE) AS value FROM cells""",
        "ad_category", "city_data", "raw_ad_revenue", "raw_city_readiness", "digital_plot", "raw_print_sales",
    )


def published_together() -> str:
    tables = ("ad_category", "city_data", "ad_revenue", "city_readiness", "digital_plot", "print_sales")
    rows = []
    for step, good, revenue in (("first", "published", "published"), ("failed", "staged", "failed"), ("missing", "published", "missing")):
        for table in tables:
            status = revenue if table == "ad_revenue" else good
            late = " WHERE year >= 2022" if step == "missing" and table == "print_sales" else ""
            rows.append(f"SELECT '{step}' AS step, '{table}' AS \"table\", '{status}' AS status, COUNT(*) AS rows FROM {table}{late}")
    return sql("\nUNION ALL ".join(rows), *tables)


def shapes() -> str:
    return sql(shapes_body(), *RAW_VIEWS.values())


SPARK_TYPES = {"row_id": "bigint", "ad_revenue": "double", "avg_bounce_rate": "double"} | {
    c: "bigint" for c in ("dev_cost", "marketing_cost", "users_reached", "downloads_or_accesses")
}


def column_types() -> str:
    return sql(
        union(
            [
                f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", "
                f"'{SPARK_TYPES.get(c, 'string')}' AS type, COUNT(*) AS rows FROM {RAW_VIEWS[t]}"
                for t in ("ad_revenue", "digital_plot")
                for c in _names(t)
            ]
        ),
        "raw_ad_revenue",
        "digital_plot",
    )


def _figures(column: str) -> dict[str, str]:
    value = f"CAST({column} AS DOUBLE)"
    quartiles = {f"p{p}": f"QUANTILE_CONT({value}, {p / 100})" for p in (25, 50, 75)}
    return {
        "count": f"COUNT({column})",
        "mean": f"ROUND(AVG({value}), 6)",
        "std": f"ROUND(STDDEV_SAMP({value}), 6)",
        "min": f"MIN({value})",
        **{q: f"ROUND({e}, 6)" for q, e in quartiles.items()},
        "max": f"MAX({value})",
    }


def numeric_profile() -> str:
    columns = [("lineitem", "lineitem", c) for c in "l_quantity l_extendedprice l_discount l_tax".split()]
    columns.append(("ad_revenue", "raw_ad_revenue", "ad_revenue"))
    return sql(
        union(
            [
                f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", "
                + ", ".join(f'{e} AS "{m}"' for m, e in _figures(c).items())
                + f" FROM {view}"
                for t, view, c in columns
            ]
        ),
        "raw_ad_revenue",
    )


def _categories(table: str, view: str, columns: list[str]) -> str:
    return union(
        [
            f"""SELECT '{table}' AS "table", '{c}' AS "column", {big('SUM(n)')} AS "count",
                       COUNT(*) AS "unique", FIRST({c} ORDER BY n DESC, {c}) AS top, MAX(n) AS freq
                FROM (SELECT {c}, COUNT(*) AS n FROM {view} WHERE {c} IS NOT NULL GROUP BY {c})"""
            for c in columns
        ]
    )


def categorical_profile() -> str:
    texts = [c for c in _names("ad_revenue") if c != "ad_revenue"]
    return sql(
        union(
            [
                _categories("ad_revenue", "raw_ad_revenue", texts),
                _categories("events", "events", ["event_type", "props"]),
            ]
        ),
        "raw_ad_revenue",
    )


def whole_profile() -> str:
    """Every metric of the pilot table as rows of (table, column, metric, value, text)."""
    names = _names("digital_plot")
    numeric = [c for c in names if c in SPARK_TYPES]
    texts = [c for c in names if c not in SPARK_TYPES]

    def cell(column: str, metric: str, value: str, text: str, source: str) -> str:
        return (
            f"SELECT 'digital_plot' AS \"table\", {column} AS \"column\", '{metric}' AS metric, "
            f"CAST({value} AS DOUBLE) AS value, CAST({text} AS VARCHAR) AS text FROM {source}"
        )

    distinct = f"(SELECT DISTINCT {RAW_COLUMNS['digital_plot']} FROM digital_plot)"
    parts = [
        cell("NULL", "rows", "COUNT(*)", "NULL", "digital_plot"),
        cell("NULL", "columns", str(len(names)), "NULL", "(SELECT 1)"),
        cell("NULL", "duplicates", f"COUNT(*) - (SELECT COUNT(*) FROM {distinct})", "NULL", "digital_plot"),
    ]
    for c in names:
        parts.append(cell(f"'{c}'", "nulls", f"COUNT(*) - COUNT({c})", "NULL", "digital_plot"))
        parts.append(cell(f"'{c}'", "type", "NULL", f"'{SPARK_TYPES.get(c, 'string')}'", "(SELECT 1)"))
    for c in numeric:
        parts += [cell(f"'{c}'", m, e, "NULL", "digital_plot") for m, e in _figures(c).items()]
    for c in texts:
        source = f"({_categories('digital_plot', 'digital_plot', [c])})"
        parts += [cell(f"'{c}'", m, f'"{m}"', "NULL", source) for m in ("count", "unique", "freq")]
        parts.append(cell(f"'{c}'", "top", "NULL", "top", source))
    return sql(union(parts), "digital_plot")


_PURCHASE = "CASE WHEN event_type = 'purchase' THEN props END"


def forward_fill(partition: str = "") -> str:
    return f"""
        SELECT event_id, user_id,
               LAST_VALUE({_PURCHASE} IGNORE NULLS) OVER ({partition} ORDER BY event_id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last
        FROM events"""


_MONTH_PARTS = """CAST(year("Month") AS INTEGER) AS year, CAST(month("Month") AS INTEGER) AS month_num,
               strftime("Month", '%B') AS month_name, CAST(quarter("Month") AS INTEGER) AS quarter"""

OPERATORS = {
    "s1_csv_round_trip": sql(
        """
        SELECT * EXCLUDE (cumulative_feedback_from_customers),
               replace(cumulative_feedback_from_customers, ' from ', ',' || chr(10) || '"from" ')
                 AS cumulative_feedback_from_customers
        FROM digital_plot""",
        "digital_plot",
    ),
    "s1_columns_by_name": sql(
        """
        SELECT * REPLACE (CASE WHEN row_id % 5 <> 0 THEN literacy_rate END AS literacy_rate)
        FROM raw_city_readiness""",
        "raw_city_readiness",
    ),
    "s1_malformed_rows": sql(
        """
        SELECT n NOT IN (1, 2, 3) AS fits, CASE n WHEN 1 THEN 5 WHEN 2 THEN 8 ELSE 7 END AS cells,
               COUNT(*) AS rows, CAST(SUM(CASE WHEN n <> 3 THEN sold END) AS BIGINT) AS copies
        FROM (SELECT CAST(substr(edition_id, 3) AS INTEGER) % 7 AS n, "Copies Sold" AS sold FROM raw_print_sales)
        GROUP BY 1, 2""",
        "raw_print_sales",
    ),
    "s1_cleaning_counts": cleaning_counts(),
    "s8_published_together": published_together(),
    "d10_unread_labels": sql(
        """
        SELECT 'ad_revenue' AS "table", 'quarter' AS "column", CAST(0 AS DOUBLE) AS unread
        UNION ALL SELECT 'city_readiness', 'quarter', CAST(0 AS DOUBLE)
        UNION ALL SELECT 'digital_plot', 'launch_month', CAST(0 AS DOUBLE)
        UNION ALL
        SELECT 'print_sales', 'Month', CAST(COUNT(*) FILTER (l_suppkey % 5 = 4) AS DOUBLE)
        FROM edition_months""",
        "edition_months",
    ),
    "s2_every_format": sql(
        """
        SELECT r.*, format FROM raw_city_readiness r
        CROSS JOIN (VALUES ('csv'), ('json'), ('orc'), ('parquet')) AS f(format)""",
        "raw_city_readiness",
    ),
    "s3_load_all": sql(
        union(
            [
                shapes_body(),
                "SELECT 'ad_category', COUNT(*), 2 FROM ad_category",
                "SELECT 'city_data', COUNT(*), 4 FROM city_data",
            ]
        ),
        *RAW_VIEWS.values(),
        "ad_category",
        "city_data",
    ),
    "s7_published_answer": city_contribution(),
    "q6_from_files": revenue_per_copy("joined_clean"),
    "s10_print_sales": sql(
        """
        SELECT edition_id, city_id AS "City_ID", state AS "State", "Month",
               copies_sold AS "Copies_Sold", copies_returned, net_circulation AS "Net_Circulation",
               year, month_num, strftime("Month", '%B') AS month_name, CAST(quarter("Month") AS INTEGER) AS quarter
        FROM (SELECT *, make_date(year, month_num, 1) AS "Month" FROM print_sales)""",
        "print_sales",
    ),
    "s11_ad_revenue": sql(
        f"""
        SELECT edition_id, ad_category, year, quarter_num, {money('ad_revenue')} AS ad_revenue,
               {money('ad_revenue_inr')} AS ad_revenue_inr
        FROM ad_revenue""",
        "ad_revenue",
    ),
    "s12_city_data": sql("SELECT * FROM city_data", "city_data"),
    "s13_ad_category": sql("SELECT * FROM ad_category", "ad_category"),
    "s13_city_readiness": sql("SELECT * FROM city_readiness", "city_readiness"),
    "s13_digital_plot": sql("SELECT * FROM digital_plot", "digital_plot"),
    "d1_null_counts": null_counts(),
    "d2_duplicate_rows": duplicate_rows(),
    "d3_shape": shapes(),
    "d4_column_types": column_types(),
    "d5_numeric_profile": numeric_profile(),
    "d6_categorical_profile": categorical_profile(),
    "d_whole_profile": whole_profile(),
    "a1_sums_of_long_decimals": """
        SELECT l_returnflag, l_linestatus,
               CAST(ROUND(SUM(net), 4) AS DOUBLE) AS net,
               CAST(ROUND(CAST(CAST(SUM(net) AS DOUBLE) / COUNT(*) AS DECIMAL(38,12)), 8) AS DOUBLE) AS mean
        FROM (SELECT *, CAST(l_extendedprice * (1 - l_discount) / 1000 AS DECIMAL(28,12)) AS net FROM lineitem)
        GROUP BY l_returnflag, l_linestatus""",
    "a1_sums_of_huge_amounts": """
        SELECT l_returnflag, l_linestatus,
               CAST(CAST(COALESCE(SUM(huge), 0) AS DECIMAL(38,2)) + CAST(COALESCE(SUM(price), 0) AS DECIMAL(38,2)) AS VARCHAR)
                 AS total
        FROM (SELECT l_returnflag, l_linestatus,
                     CASE WHEN l_linenumber = 1
                          THEN CAST(floor(l_extendedprice) AS HUGEINT) * 1152921504606846976
                               * CASE WHEN l_tax > CAST(0.04 AS DOUBLE) THEN -1 ELSE 1 END END AS huge,
                     CASE WHEN l_linenumber <> 1 THEN CAST(l_extendedprice AS DECIMAL(18,2)) END AS price
              FROM lineitem)
        GROUP BY l_returnflag, l_linestatus""",
    "d7_forward_fill": forward_fill(),
    "d7_forward_fill_sparse": forward_fill(),
    "d7_forward_fill_by_user": forward_fill("PARTITION BY user_id"),
    "d8_constant_fill": """
        SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'Seasonal booking'
                                ELSE 'No Commensts' END AS comments
        FROM orders""",
    "d9_quarter_parts": sql(
        """
        SELECT o_orderkey, quarter, CAST(year(o_orderdate) + 24 AS INTEGER) AS year, CAST(quarter(o_orderdate) AS INTEGER) AS quarter_num
        FROM raw_ad_revenue JOIN orders USING (o_orderkey)""",
        "raw_ad_revenue",
    ),
    "d15_rate_table": sql(
        """
        SELECT o_orderkey, currency,
               round_even(ad_revenue * CASE currency WHEN 'USD' THEN CAST(88.14 AS DOUBLE)
                                       WHEN 'EUR' THEN CAST(103.39 AS DOUBLE)
                                       WHEN 'INR' THEN CAST(1 AS DOUBLE) END * 100, 0) / 100
                 AS ad_revenue_inr
        FROM raw_ad_revenue""",
        "raw_ad_revenue",
    ),
    "d16_half_even": """
        SELECT l_orderkey,
               CAST(SUM(round_even(CAST(floor(l_extendedprice) + l_quantity / 8 AS DECIMAL(18,4)), 2))
                    AS DOUBLE) AS amount
        FROM lineitem GROUP BY l_orderkey""",
    "d22_sample": sql(
        "SELECT * FROM raw_ad_revenue ORDER BY md5('7' || chr(31) || CAST(o_orderkey AS VARCHAR)) LIMIT 10",
        "raw_ad_revenue",
    ),
    "d23_head": sql("SELECT * FROM raw_city_readiness ORDER BY row_id LIMIT 5", "raw_city_readiness"),
    "d24_distinct_states": sql("SELECT DISTINCT State FROM raw_print_sales", "raw_print_sales"),
    "d25_clean_ad_revenue": sql("SELECT * FROM clean_ad_revenue", "clean_ad_revenue"),
    "d25_clean_city_readiness": sql("SELECT * FROM city_readiness", "city_readiness"),
    "d25_clean_digital_plot": sql(
        """
        SELECT * EXCLUDE (cumulative_feedback_from_customers, launched),
               LAST_VALUE(cumulative_feedback_from_customers IGNORE NULLS) OVER (ORDER BY row_id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                 AS cumulative_feedback_from_customers,
               CAST(year(launched) AS INTEGER) AS launch_year, CAST(month(launched) AS INTEGER) AS launch_month_num,
               strftime(launched, '%B') AS launch_month_name, CAST(quarter(launched) AS INTEGER) AS launch_quarter
        FROM (SELECT *, CAST(launch_month || '-01' AS DATE) AS launched FROM digital_plot)""",
        "digital_plot",
    ),
    "d25_clean_print_sales": sql(
        f"SELECT *, {_MONTH_PARTS} FROM clean_print_sales", "clean_print_sales"
    ),
    "q1_from_raw": sql(
        state_trend_body("(SELECT *, CAST(year(\"Month\") AS INTEGER) AS year FROM clean_print_sales)"),
        "clean_print_sales",
    ),
    "q1_from_mixed_case": "SELECT * REPLACE (upper(\"State\") AS \"State\") FROM ("
    + sql(
        state_trend_body("(SELECT *, CAST(year(\"Month\") AS INTEGER) AS year FROM clean_print_sales)"),
        "clean_print_sales",
    )
    + ")",
    "q3_from_raw": category_strength(
        "CAST(ad_revenue_inr AS DECIMAL(28,10))", "clean_ad_revenue", "clean_ad_revenue"
    ),
    "j1_hot_part_sums": """
        SELECT p_brand, l_returnflag, COUNT(*) AS items, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity
        FROM lineitem
        JOIN part ON p_partkey = CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE l_partkey END
        GROUP BY p_brand, l_returnflag""",
    "j3_fanout_sums": sql(
        f"""
        SELECT ps.state AS "State", ps.year, CAST(SUM(ps.net_circulation) AS BIGINT) AS net,
               {money('SUM(ar.ad_revenue_inr)')} AS revenue
        FROM print_sales ps
        JOIN ad_revenue ar ON ps.edition_id = ar.edition_id AND ps.year = ar.year
        GROUP BY ps.state, ps.year""",
        "print_sales",
        "ad_revenue",
    ),
    "w5_ntile": """
        SELECT o_orderkey, o_totalprice,
               CAST(NTILE(4) OVER (ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS quartile
        FROM orders""",
    "w6_row_number": """
        SELECT o_orderkey, o_totalprice,
               ROW_NUMBER() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS position
        FROM orders""",
    "w7_rank_at_most": """
        SELECT * FROM (
            SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity,
                   CAST(RANK() OVER (ORDER BY l_quantity DESC) AS INTEGER) AS quantity_rank
            FROM lineitem)
        WHERE quantity_rank <= 5""",
    "x5_strict_greatest": """
        SELECT o_custkey, CASE WHEN COUNT(DISTINCT year(o_orderdate)) = 7
                               THEN MAX(o_totalprice) END AS best
        FROM orders WHERE year(o_orderdate) BETWEEN 1995 AND 2001 GROUP BY o_custkey""",
    "x9_month_key": sql(
        """
        SELECT strftime(month, '%Y-%m') AS month, CAST(SUM(sold) AS BIGINT) AS sold
        FROM edition_months GROUP BY 1""",
        "edition_months",
    ),
    "m2_case_insensitive": sql(
        """
        SELECT lower("State") AS state, CAST(SUM("Net_Circulation") AS BIGINT) AS net
        FROM raw_print_sales GROUP BY 1""",
        "raw_print_sales",
    ),
}
