"""The core's queries; importing this package registers them all."""

from heliotable.queries import catalogs, changes, estimates, fields, layouts, nested  # noqa: F401
from heliotable.queries.registry import QUERIES, SQL


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
