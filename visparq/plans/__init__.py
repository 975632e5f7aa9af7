"""All queries of the library with their SQL: name -> (callable, SQL or None)."""

from __future__ import annotations

from visparq.plans import composites, evidence, inks, pages, pixels, scalars, streams

ALL: dict = {**pixels.QUERIES, **inks.QUERIES, **scalars.QUERIES, **evidence.QUERIES, **pages.QUERIES, **streams.QUERIES, **composites.QUERIES}
