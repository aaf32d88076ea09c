"""Helper for SQL expressions that use a costly value more than once."""


def bind(value: str, name: str, body: str) -> str:
    """SQL for ``body`` with ``name`` standing for ``value``, which is worked out once for each row."""
    return f"transform(array({value}), {name} -> {body})[0]"
