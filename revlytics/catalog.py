"""All queries of the library, by name, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from revlytics.plans import auditing, building, changes, corpus, evaluation, feedbacks, governance, outcomes, prompting, replays, reviews, scoring, sources, store, streams  # noqa: F401
from revlytics.plans.registry import QUERIES, SQL

FLAGSHIP = "confusion_by_split"


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
