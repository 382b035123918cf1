"""Queries over the given tables, grouped like the library."""

from __future__ import annotations

import importlib

GROUPS = ("text_queries", "source_queries", "change_queries", "obligation_queries", "control_queries", "retrieval_queries", "metric_queries", "dataset_queries", "consensus_queries", "operation_queries")


def load():
    import statuteflow
    from pyspark import cloudpickle

    from . import registry

    # Functions that run inside tasks travel with the job, so executors need no copy of this package.
    cloudpickle.register_pickle_by_value(statuteflow)

    for group in GROUPS:
        importlib.import_module(f"{__name__}.{group}")
    return registry
