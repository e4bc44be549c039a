"""All registered queries of the core and their SQL twins."""

from __future__ import annotations

from lexlode.plans import answering, chunking, graph, ingest, judging, reporting, retrieval, text

_MODULES = (text, chunking, retrieval, reporting, graph, answering, ingest, judging)
QUERIES: dict = {}
ORACLE: dict = {}
for _m in _MODULES:
    QUERIES |= _m.QUERIES
    ORACLE |= _m.ORACLE
