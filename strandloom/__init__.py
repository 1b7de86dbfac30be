"""Learning from symbolic sequences with Spark DataFrames."""

from importlib import import_module

__version__ = "0.1.0"

#: Public names and the modules they are loaded from on first use.
_WHERE = {
    "AUTO": "functions.alphabet", "Alphabet": "functions.alphabet", "BaselinePipeline": "plans.training", "FoldResult": "plans.results", "InferencePipeline": "plans.training", "Metric": "operators.metrics",
    "SegmentImportance": "plans.results", "SegmentModel": "plans.model", "SegmentPool": "operators.pool", "TrainingPipeline": "plans.training", "TrainingResult": "plans.results",
}
__all__ = sorted(_WHERE)


def __getattr__(name: str):
    if name not in _WHERE:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f"{__name__}.{_WHERE[name]}"), name)


def __dir__() -> list[str]:
    return sorted([*globals(), *_WHERE])
