"""Named queries over the given tables, each with its SQL check where one exists."""

from lagfield.catalog import aggregates, cleaning, composites, joins, models, ordering, scalars, sources
from lagfield.catalog.base import ENTRIES, Tables

__all__ = ["ENTRIES", "Tables", "aggregates", "cleaning", "composites", "joins", "models", "ordering", "scalars", "sources"]
