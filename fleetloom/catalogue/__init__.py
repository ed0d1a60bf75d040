"""Every operator bound to the driver's tables, each with the same question in SQL where SQL can ask it."""

from fleetloom.catalogue import archive, config, estate, ledger, scalar, stream, tables, telemetry, text  # noqa: F401
from fleetloom.catalogue.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
