"""All queries of the core, by name, with their SQL where SQL can express them."""

from __future__ import annotations

from treadle.operators import graph, hierarchy, levels, orphans, parsing, projections, resolution, store, summaries, vector

MODULES = (orphans, hierarchy, projections, graph, resolution, vector, store, parsing, summaries, levels)


def queries():
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql():
    return {k: s for m in MODULES for k, s in m.SQL.items()}


def flagship(spark, sf_dir):
    return queries()["vector_topk_batch"](spark, sf_dir)
