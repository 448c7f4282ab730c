"""Matchers, gates, reports, batch rollups and budgets over DataFrames."""
