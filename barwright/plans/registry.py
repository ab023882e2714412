"""All queries of the bar analytics engine and their SQL twins."""

from __future__ import annotations

from . import calibration_queries, candle_queries, experiment_queries, file_queries, function_queries, graph_queries, investigation_queries, model_queries, runlevel_queries, study_queries, sweep_queries, walk_queries

MODULES: list = [candle_queries, graph_queries, study_queries, experiment_queries, model_queries, runlevel_queries, sweep_queries, investigation_queries, walk_queries, function_queries, calibration_queries, file_queries]
QUERIES: dict = {}
ORACLES: dict = {}
for _m in MODULES:
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES
