"""Named queries of the engine's own operators."""

from __future__ import annotations

from lexicrux.operators import segment
from lexicrux.plans import entities, legal, proofs, records, reports, search, sources, spans, stores, texts

QUERIES: dict = {**texts.QUERIES, **spans.QUERIES, **search.QUERIES, **legal.QUERIES, **sources.QUERIES, **records.QUERIES, **reports.QUERIES, **stores.QUERIES, **segment.QUERIES}
SQL: dict[str, str] = {**texts.SQL, **spans.SQL, **search.SQL, **legal.SQL, **sources.SQL, **records.SQL, **proofs.SQL, **reports.SQL, **stores.SQL, **entities.SQL}
