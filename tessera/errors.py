"""Errors of the engine."""


class SchemaError(ValueError):
    """A column, type or index doesn't fit the operator."""


class OperatorError(RuntimeError):
    """A predicate or operator failed while the query ran."""


class QueryCancelled(RuntimeError):
    """The run was cancelled, by close() of another cursor call or by its tag."""
