"""All oracle statements by query name."""

from __future__ import annotations

from oracles import analytics, ingestion, modelling, relational, series

SQL: dict[str, str] = {**relational.SQL, **series.SQL, **analytics.SQL, **ingestion.SQL, **modelling.SQL}
