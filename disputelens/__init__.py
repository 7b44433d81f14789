"""Disputed-invoice analytics as Spark DataFrame operators.

``sources``    load the two input tables, write reports
``functions``  column expressions (flags, keys, categories, display)
``operators``  relational operators (base, invoices, KPIs, reports, search)
``plans``      user-level operations (dashboard, paged summaries, search, ...)
               and the catalogue of registered queries
``llm``        operators for large text corpora; nothing else imports it
"""

from .session import build_session, ensure_checkpoint_dir

__all__ = ["build_session", "ensure_checkpoint_dir"]
