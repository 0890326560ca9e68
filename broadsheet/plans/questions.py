"""All questions by name, each `(tables, **parameters) -> DataFrame`."""

from . import circulation, digital, revenue

QUESTIONS = {
    "q1_state_trend": circulation.state_trend,
    "q2_city_contribution": circulation.city_contribution,
    "q3_category_strength": revenue.category_strength,
    "q4_revenue_by_city": revenue.revenue_by_city,
    "q5_ready_but_unengaged": digital.ready_but_unengaged,
    "q6_revenue_per_copy": revenue.revenue_per_copy,
    "q7_relaunch_priority": digital.relaunch_priority,
    "q8_sharpest_falls": circulation.sharpest_falls,
    "q9_print_efficiency": circulation.print_efficiency,
    "q10_internet_growth": digital.internet_growth,
    "q11_frequent_declines": revenue.frequent_declines,
    "k1_pilot_performance": digital.pilot_performance,
    "k2_circulation_change": circulation.circulation_change,
    "k3_category_share": revenue.category_share,
    "k4_revenue_circulation": revenue.revenue_circulation_correlation,
}
