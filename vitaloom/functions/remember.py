"""Reuse of built expressions.

A Column is immutable and belongs to no table. The wide ones take thousands of calls into
the JVM to build, so each is built once per application.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from typing import TypeVar

from pyspark import SparkContext

T = TypeVar("T")


def remembered(build: Callable[..., T]) -> Callable[..., T]:
    """Caches a builder that takes only hashable arguments, per Spark application."""
    built: dict[tuple, T] = {}

    @wraps(build)
    def once(*args):
        key = (SparkContext.getOrCreate().applicationId, *args)
        if key not in built:
            built[key] = build(*args)
        return built[key]

    return once
