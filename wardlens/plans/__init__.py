"""The reports: each function maps input tables to one result table."""
