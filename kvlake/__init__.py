"""A versioned, ordered key-value table on Spark: a change log, read by merging."""

__all__ = ["KVStore", "StoreConfig"]


def __getattr__(name: str):
    if name == "KVStore":
        from .store import KVStore

        return KVStore
    if name == "StoreConfig":
        from .config import StoreConfig

        return StoreConfig
    raise AttributeError(name)
