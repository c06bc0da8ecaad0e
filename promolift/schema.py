"""Column names, the filter set and the promo predicate.

Column names keep the spelling of the source files, blanks included; use
``F.col("Net Sales")`` in the DataFrame API and backticks in SQL.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The names the sales files must carry, in the order given.
REGION = "Region"
PSA = "PSA"
SUBCAT = "Sub Category"
BONUS_BUY = "Bonus Buy"
SALES_DATE = "Sales Date"
STATUS = "Promotion Status"
ARTICLE = "Article"
NET_SALES = "Net Sales"
QUANTITY = "Sales Quantity"

REQUIRED_SALES = [REGION, PSA, SUBCAT, BONUS_BUY, SALES_DATE, STATUS, ARTICLE, NET_SALES, QUANTITY]

# Added columns.
SOURCE_FILE = "source_file"
ROW_ORDER = "row_order"
YEAR = "Year"
MONTH = "Month"
HAS_FORECAST = "Has_Forecast"
FORECAST_QTY = "Forecast_Qty"
FORECAST_DAILY = "Forecast_Daily_Qty"

# Forecast table.
DESCRIPTION = "Description"
START_DATE = "Start_Date"
END_DATE = "End_Date"
DURATION_DAYS = "Duration_Days"
REQUIRED_FORECAST = [DESCRIPTION, START_DATE, FORECAST_QTY]

# The status text of a non-promotion row, and the texts that a
# missing status and a missing article become.
NON_PROMO = "NON-PROMO"
MISSING_STATUS = "NAN"
MISSING_ARTICLE = "nan"

# Thresholds of the analysis.
MIN_CLEAN_DAYS = 3            # clean days an article needs for a baseline
MIN_BASELINE_SALES = 100.0    # baseline sales a promotion needs to be valid
ARTICLE_MIN_BASELINE = 10.0   # baseline a region promotion needs in the article view
ARTICLE_MIN_DAYS = 2          # default minimum promo days in the article view
DEFAULT_MIN_DAYS = 3          # default minimum promo days in the summary
DEFAULT_TOP_N = 20
TOP_N_CHOICES = (10, 20, 30, 50)
VALID_ARTICLE_MIN_PROMO = 2
VALID_ARTICLE_MIN_NONPROMO = 2
VALID_ARTICLE_LIMIT = 500

ALL = "All"


def is_promo(status: str | Column = STATUS) -> Column:
    """Every status other than ``NON-PROMO`` is a promotion; NULL counts as one."""
    c = F.col(status) if isinstance(status, str) else status
    return ~c.eqNullSafe(F.lit(NON_PROMO))


def promo_keys(columns: list[str]) -> list[str]:
    """Group keys of the promotion summary: the last two only when present."""
    keys = [ARTICLE, BONUS_BUY, REGION]
    keys += [c for c in (SUBCAT, PSA) if c in columns]
    return keys


@dataclass(frozen=True)
class Filters:
    """The filter set of the summary: ``"All"`` means no filter on that column."""

    year: int | str = ALL
    month: int | str = ALL
    subcat: str = ALL
    psa: str = ALL
    region: str = ALL
    min_days: int = DEFAULT_MIN_DAYS

    def baseline_key(self) -> tuple:
        """Baselines do not depend on ``min_days``."""
        return (self.year, self.month, self.subcat, self.psa, self.region)

    def key(self) -> tuple:
        return self.baseline_key() + (self.min_days,)
