"""Errors of the engine; each can be given as a JSON-ready dict."""

from __future__ import annotations

from contextlib import contextmanager
from typing import Any

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException


class EngineError(Exception):
    def __init__(self, message: str, **details: Any):
        super().__init__(message)
        self.message, self.details = message, details

    def to_json(self) -> dict[str, Any]:
        return {"name": type(self).__name__, "message": self.message, **self.details}


class QueryError(EngineError):
    """A filter, sort, update or statement that can't be compiled or run."""


@contextmanager
def running(statement: str):
    """What fails while a statement runs is given as a QueryError with its cause; errors of the engine pass as they are."""
    try:
        yield
    except EngineError:
        raise
    except (PySparkException, Py4JError) as e:
        condition = e.getCondition() if isinstance(e, PySparkException) else None
        raise QueryError(f"The {statement} failed", statement=statement, condition=condition, cause=str(e).split("\n")[0]) from e


class ValidationError(EngineError):
    """A document or value that its schema refuses; ``errors`` has a message per path."""

    @property
    def errors(self) -> dict[str, str]:
        return self.details.get("errors", {})


class SchemaError(EngineError):
    """A schema declaration that makes no sense."""


class ModelOverwriteError(EngineError):
    """A model name registered twice with different schemas."""
