"""Error classes of the engine."""


class EngineError(Exception):
    pass


_NAMES = (
    "MalformedId", "InvalidPath", "CaseCollision", "MalformedObject", "InconsistentObject", "ObjectNotFound", "CorruptObject",
    "InvalidRefName", "RefNotFound", "InvalidStore", "InvalidIgnore", "Dirty", "NotASpace", "UnsafePath", "RefConflict",
    "LockHeld", "LockNotFound", "LockingDisabled", "SpaceBehind", "InvalidParameters", "Usage",
)
for _name in _NAMES:
    globals()[_name] = type(_name, (EngineError,), {"__module__": __name__})
__all__ = ["EngineError", *_NAMES]
