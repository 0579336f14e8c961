from . import mapped, replay, results, sinks, topics

__all__ = ["mapped", "replay", "results", "sinks", "topics"]
