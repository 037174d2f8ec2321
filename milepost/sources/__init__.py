from milepost.sources.tables import Sources

__all__ = ["Sources"]
