"""Verdicts, confidence levels and display texts as ``CASE WHEN`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Verdict texts (plain text, no emoji or markup).
STRONG = "Strong Success"
POSITIVE = "Positive Impact"
NEUTRAL = "Neutral/Breakeven"
ADJUST = "Needs Adjustment"
LOSS = "Significant Loss"
INSUFFICIENT = "Insufficient Data"

# Uplift borders (strictly greater than).
UPLIFT_BORDERS = [(0.3, STRONG), (0.1, POSITIVE), (-0.05, NEUTRAL), (-0.2, ADJUST)]

# Forecast verdict texts and absolute-accuracy borders.
FC_NONE = "No Forecast"
FC_EXCELLENT = "Excellent Forecast"
FC_GOOD = "Good Forecast"
FC_FAIR = "Fair Forecast"
FC_OVER = "Over-Forecast"
FC_UNDER = "Under-Forecast"
FORECAST_BORDERS = [(0.1, FC_EXCELLENT), (0.25, FC_GOOD), (0.5, FC_FAIR)]

# Confidence levels (days at least, daily baseline at least).
CONFIDENCE_RULES = [(7, 20.0, "High"), (3, 10.0, "Medium")]
CONFIDENCE_DEFAULT = "Low"

# Recommended actions.
ACTIONS = {
    STRONG: "Scale mechanics, repeat in similar articles",
    LOSS: "Stop immediately, analyze root causes",
}

# Effectiveness by mean uplift percent (at least).
EFFECTIVE = "PROMOTIONS ARE EFFECTIVE"
MIXED = "MIXED RESULTS"
INEFFECTIVE = "PROMOTIONS ARE INEFFECTIVE"

# Quadrant texts and advice.
QUADRANT_ADVICE = {
    "High Volume, Low Value": "High quantity but low revenue - consider price optimization",
    "High Volume, High Value": "Best performers - maximize distribution and repeat",
    "Low Volume, Low Value": "Limited impact - consider discontinuing or testing new mechanics",
    "Low Volume, High Value": "High value per unit - focus on premium positioning or targeting",
}


def _missing(x: Column) -> Column:
    return x.isNull() | F.isnan(x)


def uplift_verdict(u: Column) -> Column:
    expr = F.when(_missing(u), F.lit(INSUFFICIENT))
    for border, label in UPLIFT_BORDERS:
        expr = expr.when(u > border, F.lit(label))
    return expr.otherwise(F.lit(LOSS))


def confidence(days: Column, daily_baseline: Column) -> Column:
    expr = None
    for min_days, min_base, label in CONFIDENCE_RULES:
        cond = (days >= min_days) & (daily_baseline >= min_base)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(CONFIDENCE_DEFAULT))


def forecast_verdict(acc: Column) -> Column:
    expr = F.when(_missing(acc), F.lit(FC_NONE))
    for border, label in FORECAST_BORDERS:
        expr = expr.when(F.abs(acc) <= border, F.lit(label))
    return expr.when(acc > 0.5, F.lit(FC_OVER)).otherwise(F.lit(FC_UNDER))


def action(verdict: Column) -> Column:
    expr = None
    for label, text in ACTIONS.items():
        cond = verdict == F.lit(label)
        expr = F.when(cond, F.lit(text)) if expr is None else expr.when(cond, F.lit(text))
    return expr


def effectiveness(avg_pct: Column) -> Column:
    return (F.when(avg_pct >= 10, F.lit(EFFECTIVE))
            .when(avg_pct >= 0, F.lit(MIXED))
            .otherwise(F.lit(INEFFECTIVE)))


def quadrant(sales: Column, qty: Column, median_sales: Column, median_qty: Column) -> Column:
    """Quadrant name; a value equal to the median counts as High."""
    volume = F.when(qty >= median_qty, F.lit("High Volume")).otherwise(F.lit("Low Volume"))
    value = F.when(sales >= median_sales, F.lit("High Value")).otherwise(F.lit("Low Value"))
    return F.concat_ws(", ", volume, value)


def quadrant_advice(name: Column) -> Column:
    expr = None
    for label, text in QUADRANT_ADVICE.items():
        cond = name == F.lit(label)
        expr = F.when(cond, F.lit(text)) if expr is None else expr.when(cond, F.lit(text))
    return expr


def pct_text(x: Column, scale: float = 100.0) -> Column:
    """Signed percent with one decimal, e.g. ``+12.3%``; ``N/A`` when missing."""
    return F.when(~_missing(x), F.format_string("%+.1f%%", x * F.lit(scale))).otherwise(F.lit("N/A"))


def money_text(x: Column) -> Column:
    """``$1,234``; ``N/A`` when missing."""
    return F.when(~_missing(x), F.format_string("$%,.0f", x)).otherwise(F.lit("N/A"))


def qty_text(x: Column) -> Column:
    """``1,234``; ``N/A`` when missing."""
    return F.when(~_missing(x), F.format_string("%,.0f", x)).otherwise(F.lit("N/A"))


def thousands_text(x: Column) -> Column:
    """``$12K`` for a value already divided by 1000."""
    return F.when(~_missing(x), F.format_string("$%,.0fK", x)).otherwise(F.lit("N/A"))
