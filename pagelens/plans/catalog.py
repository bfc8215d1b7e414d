"""All registered queries."""

from __future__ import annotations

from pagelens.plans import corpus_queries, job_queries, page_queries, text_queries

ENTRIES = [*page_queries.ENTRIES, *text_queries.ENTRIES, *job_queries.ENTRIES, *corpus_queries.ENTRIES]
