from . import emit_once, layout, routing, scan, timeline, windows

__all__ = ["emit_once", "layout", "routing", "scan", "timeline", "windows"]
