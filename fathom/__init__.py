"""Recorded measurement data on Spark.

``fathom.read`` and ``fathom.write`` for DataFrames, ``fathom.Index`` for lookups
and partial reads of one recording, ``cut_*`` and ``merge_files`` for whole
recordings, ``Layout`` for their blocks. All errors are ``fathom.MdfError``.
"""

from importlib import import_module

_PLACES = {
    "errors": ["MdfError"],
    "sources.binary": ["read_binary"],
    "sources.files": ["cut_file", "cut_file_utc", "cut_files", "merge_files"],
    "sources.index": ["Index", "Signal", "catalog", "data_blocks", "find_channel", "list_groups", "masters"],
    "sources.layout": ["Layout"],
    "sources.mdf4": ["Mdf4", "read", "write"],
    "sources.writer": ["write_groups"],
}
__all__ = sorted(name for names in _PLACES.values() for name in names)


def __getattr__(name: str):
    """Names are loaded when they are first used, so that executors load only what they need."""
    for place, names in _PLACES.items():
        if name in names:
            return getattr(import_module(f"fathom.{place}"), name)
    raise AttributeError(name)
