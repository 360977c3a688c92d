"""What each feature is, for people: formula, when it is known, how gaps are filled, horizons it matters to."""

from __future__ import annotations

ALL = ["1d", "1w", "2w", "1m", "2m"]

# Fixed values, one line for each feature: name; formula; horizons.
FEATURES = """
ret_1d; adj_close / adj_close 1 row before - 1; 1d
ret_5d; adj_close / adj_close 5 rows before - 1; 1d 1w
ret_21d; adj_close / adj_close 21 rows before - 1; 1w 2w
ret_63d; adj_close / adj_close 63 rows before - 1; 1m 2m
ret_126d; adj_close / adj_close 126 rows before - 1; 2m
ret_252d; adj_close / adj_close 252 rows before - 1; 2m
momentum_12_1; ret_252d - ret_21d; 1m 2m
dist_sma_20; adj_close / mean of 20 - 1; 1d 1w
dist_sma_50; adj_close / mean of 50 - 1; 1w 2w
rsi_14; relative strength of 14 changes, plain means; 1d 1w
ret_5d_z_63d; ret_5d in deviations of its 63 rows; 1d
realized_vol_21d; deviation of ret_1d over 21, annualised; 1d 1w 2w 1m 2m
realized_vol_63d; deviation of ret_1d over 63, annualised; 1d 1w 2w 1m 2m
vol_ratio_21_63; realized_vol_21d / realized_vol_63d; 1d 1w 2w 1m 2m
atr_14_close; mean true range of 14 / close; 1d 1w
intraday_range; (high - low) / close; 1d
volume_ratio_5_20; mean volume of 5 / of 20; 1d 1w
volume_ratio_5_63; mean volume of 5 / of 63; 1w 2w
dollar_volume_20d; mean of adj_close * volume over 20; 1d 1w 2w 1m 2m
volume_trend_21d; slope of ln(1 + volume) over 21; 1w 2w
rel_strength_5d; ret_5d - spx_ret_5d; 1d 1w
rel_strength_21d; ret_21d - spx_ret_21d; 1w 2w
rel_strength_63d; ret_63d - spx_ret_63d; 1m 2m
sector_rel_ret_1d; ret_1d - its sector's mean; 1d 1w
sector_rel_ret_21d; ret_21d - its sector's mean; 1w 2w 1m
sector_vol_gap_21d; realized_vol_21d - its sector's mean; 1d 1w 2w 1m 2m
beta_63d; covariance with spx_ret_1d / its variance over 63; 1m 2m
vix_close; the volatility index; 1d 1w 2w 1m 2m
vix_change_5d; vix_close / 5 rows before - 1; 1d 1w 2w 1m 2m
spx_ret_21d; benchmark / 21 rows before - 1; 1d 1w 2w 1m 2m
spx_above_200d; 1 if the benchmark is above its mean of 200; 1d 1w 2w 1m 2m
days_to_next_earnings; days to the next event; 1d 1w 2w
days_since_last_earnings; days since the last event; 1d 1w 2w 1m
last_earnings_surprise_pct; surprise of the last event; 1w 2w 1m
last_post_earnings_reaction_1d; ret_1d of the last event's first price date; 1d 1w 2w
pe_ttm; market_cap / net_income_ttm; 1m 2m
pb_ratio; market_cap / stockholders_equity; 1m 2m
ev_ebitda; enterprise_value / ebitda_ttm; 1m 2m
roe; net_income_ttm / stockholders_equity; 1m 2m
debt_to_equity; total_liabilities / stockholders_equity; 1m 2m
revenue_growth_yoy; quarter's revenue / 4 filings before - 1; 2m
assets_growth_yoy; total_assets / 4 filings before - 1; 2m
fundamentals_age_days; days since the last filing; 1d 1w 2w 1m 2m
risk_free_rate; last known risk-free rate; 1m 2m
"""


def records(sector_columns: list[str] | None = None) -> list[tuple[str, str, str, str, list[str]]]:
    """(name, formula, valid_at, missing_handling, horizon_sensitive) of every feature and sector column."""
    out = []
    for line in FEATURES.strip().splitlines():
        name, formula, horizons = (x.strip() for x in line.split(";"))
        out.append((name, formula, "market_close_t", "leave binary" if name == "spx_above_200d" else "cross-sectional median", horizons.split()))
    return out + [(c, "one-hot sector membership", "market_close_t", "binary indicator", ALL) for c in sector_columns or []]
