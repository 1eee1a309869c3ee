"""Statements over streams: the filters and projections that need no order."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sparktab.errors import UnavailableFeature
from sparktab.plans.predicate import Criteria
from sparktab.plans.statement import Statement
from sparktab.table import Table


def apply(statement: Statement, stream: DataFrame) -> DataFrame:
    """The statement's WHERE and SELECT on an unbounded table; order, offset, limit and record offsets have no meaning there."""
    if statement.keys or statement.skip or statement.take >= 0:
        raise UnavailableFeature("a stream has no order, offset or limit")
    table = Table(stream)
    if statement.conditions:
        where = Criteria.all(*statement.conditions)
        if where.needs_offset:
            raise UnavailableFeature("a stream has no record offsets")
        table = table.filter(where)
    if statement.columns:
        table = table.select(*statement.columns) if statement.mode == "select" else table.select_all_except(*statement.columns)
    return table.df
