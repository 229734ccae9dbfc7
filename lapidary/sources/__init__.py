from lapidary.sources.tables import table

__all__ = ["table"]
