"""Registered queries by family."""

from evalspark.plans.base import QUERIES, SQL  # noqa: F401
from evalspark.plans import aggregates, decontam, filters, instructions, prepare, prompts, responses, scoring, sources, validation  # noqa: F401,E402
