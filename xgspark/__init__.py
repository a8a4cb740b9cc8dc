"""xgspark: expected-goals (xG) shot analytics expressed as Spark DataFrame jobs.

Subpackages
-----------
functions  Column-level expressions (geometry, field access, scoring).
operators  DataFrame -> DataFrame operators (cleaning, validation, folds,
           metrics, model fitting, aggregates, set operations, joins).
sources    Readers and writers (open-data JSON layout, shot tables, model table,
           views over the benchmark tables).
plans      Composed jobs: ETL, training, batch scoring, and the query catalogue.
streaming  Structured Streaming scoring.
"""

__version__ = "0.1.0"

# The composed jobs, importable from the package root (loaded on first use).
_EXPORTS = {
    "build_session": "xgspark.session",
    "build_shots": "xgspark.plans.etl",
    "train": "xgspark.plans.training",
    "score_batch": "xgspark.plans.scoring",
    "score_json": "xgspark.plans.scoring",
    "score_stream": "xgspark.streaming.scoring_stream",
    "read_scores": "xgspark.streaming.scoring_stream",
    "sync_events": "xgspark.sources.event_store",
    "read_store": "xgspark.sources.event_store",
}
__all__ = sorted(_EXPORTS)


def __getattr__(name):
    if name in _EXPORTS:
        import importlib

        return getattr(importlib.import_module(_EXPORTS[name]), name)
    raise AttributeError(f"module 'xgspark' has no attribute {name!r}")
