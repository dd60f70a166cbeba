"""The analyses: ETL, discount, hidden value, trap products."""
