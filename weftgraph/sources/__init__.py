from weftgraph.sources.tables import table

__all__ = ["table"]
