"""Registries of filters, metrics and aggregations by name."""

from __future__ import annotations

from collections.abc import Callable


class Registry(dict):
    """Name → function, with a decorator to add entries and a clear error on unknown names."""

    def __init__(self, kind: str):
        super().__init__()
        self.kind = kind
        self.info: dict[str, dict] = {}

    def add(self, name: str, **info) -> Callable:
        def wrap(fn: Callable) -> Callable:
            if name in self:
                raise ValueError(f"{self.kind} {name!r} is already registered")
            self[name] = fn
            self.info[name] = info
            return fn

        return wrap

    def __missing__(self, name: str):
        raise KeyError(f"unknown {self.kind} {name!r}; known: {', '.join(sorted(self))}")


FILTERS = Registry("filter")
METRICS = Registry("metric")
AGGREGATIONS = Registry("aggregation")

# Metrics computed by default for each kind of request.
DEFAULT_METRICS = {
    "loglikelihood": ["perplexity", "acc"],
    "loglikelihood_rolling": ["word_perplexity", "byte_perplexity", "bits_per_byte"],
    "multiple_choice": ["acc", "acc_norm"],
    "generate_until": ["exact_match"],
}


def register_sql(spark, names: list[str] | None = None) -> list[str]:
    """Make single-column metrics and filters callable from SQL under their registry name."""
    from evalspark.functions import sqlnames

    return sqlnames.register(spark, names)
