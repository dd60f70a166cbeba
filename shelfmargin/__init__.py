"""Retail profitability analytics on Spark: discounts, hidden value, trap products."""
