"""Vocabulary files, read on the driver and sent to the workers.

A vocabulary file has a fixed size (one or two MB) that does not depend on the
data, so it may be broadcast. Workers parse it once per process.
"""

from __future__ import annotations

import hashlib

_PARSED: dict = {}


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def shipped(spark, path: str):
    """Broadcast of the file's bytes; its size is bounded by the vocabulary."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def parsed(data: bytes, kind: str, parse):
    """``parse(data)``, kept for the life of the worker process."""
    key = (kind, hashlib.sha1(data).digest())
    if key not in _PARSED:
        _PARSED[key] = parse(data)
    return _PARSED[key]
