"""Reuse of built Column expressions within a session.

The rule expressions here are large trees; assembling one from Python costs thousands of
gateway calls, which for a small input can outweigh the job. A Column over plain column
names is an unresolved expression and can be used in any number of plans of the same
session, so builders decorated with ``cached_expr`` build each (function, arguments) pair
once per session. Only calls with plain arguments (names, numbers, flags) are kept: a
Column argument may be bound to one DataFrame, so such calls always build anew. The kept
expressions belong to the running context object and go with it.
"""

from __future__ import annotations

import functools

from pyspark import SparkContext

_PLAIN = (str, int, float, bool, type(None))


def cached_expr(fn):
    @functools.wraps(fn)
    def wrapper(*args, **kwargs):
        if not all(isinstance(a, _PLAIN) for a in (*args, *kwargs.values())):
            return fn(*args, **kwargs)
        kept = SparkContext._active_spark_context.__dict__.setdefault("_kept_expressions", {})
        key = (fn.__module__, fn.__qualname__, tuple((type(a), a) for a in args),
               tuple(sorted((n, type(v), v) for n, v in kwargs.items())))
        if key not in kept:
            kept[key] = fn(*args, **kwargs)
        return kept[key]
    return wrapper
