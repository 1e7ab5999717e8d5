"""Registered checks: every operator over the given tables, with the same question in plain SQL."""

from workload import content, estate, lifecycle, plan_rows, recovery

MODULES = (content, estate, plan_rows, lifecycle, recovery)

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
