"""Every operator as a query over the driver's tables, with its DuckDB equivalent."""

from tidefold.queries import lists, maps, queues, storage, typed
from tidefold.queries.registry import oracles, registered

__all__ = ["lists", "maps", "oracles", "queues", "registered", "storage", "typed"]
