"""The modules whose queries are registered."""

from docquarry.plans import benchmark, corpus, evaluation, evidence, fields, relational, retrieval, sessions, state  # noqa: F401
