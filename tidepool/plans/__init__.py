"""The engine's registered queries; importing the modules fills the registry."""

from tidepool.plans import ingest, joins, rollup, trading, windows  # noqa: F401
from tidepool.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
