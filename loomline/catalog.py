"""All named queries with their SQL, by family."""

from __future__ import annotations

from loomline.plans import cluster, graph, io, job, live, metrics, series

FAMILIES = (job, io, metrics, series, graph, cluster, live)
QUERIES = {k: v for family in FAMILIES for k, v in family.QUERIES.items()}
ORACLES = {k: v for family in FAMILIES for k, v in family.ORACLES.items()}
