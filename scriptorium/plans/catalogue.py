"""All queries of the core and the SQL each one is held against."""

from __future__ import annotations

from scriptorium.plans import corpus, documents, runs, scores, texts, verification

QUERIES = {**scores.QUERIES, **texts.QUERIES, **documents.QUERIES, **verification.QUERIES, **runs.QUERIES, **corpus.QUERIES}
ORACLES = {**scores.ORACLES, **texts.ORACLES, **documents.ORACLES, **verification.ORACLES, **runs.ORACLES, **corpus.ORACLES}
