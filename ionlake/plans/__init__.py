"""Plans: batches, registered queries and their oracles."""

from ionlake.plans import catalog, proven

__all__ = ["catalog", "proven"]
