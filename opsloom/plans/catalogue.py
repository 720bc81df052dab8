"""All registered queries: importing the modules fills the registry."""

from opsloom.plans import aggregates, changes, filters, joins, metrics, ranking, scalars, search, sources, streams  # noqa: F401
from opsloom.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
