from . import auctions, metrics, pushdown, wordcount

__all__ = ["auctions", "metrics", "pushdown", "wordcount"]
