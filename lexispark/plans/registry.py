"""Queries of the engine's operators by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import cleaned, core, files, further, heldsets, ordered, reports, streams, transcripts, vocabularies, wider  # noqa: F401  (registers its queries)

QUERIES, ORACLE = core.QUERIES, core.ORACLE
FLAGSHIP = QUERIES["d1_denylist"]
