from . import keygroups, records, timing

__all__ = ["keygroups", "records", "timing"]
