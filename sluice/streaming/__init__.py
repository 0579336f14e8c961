from . import early_sessions, emit_once, jobs, precombine, running_count

__all__ = ["early_sessions", "emit_once", "jobs", "precombine", "running_count"]
