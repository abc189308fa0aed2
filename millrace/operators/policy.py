"""Which operators may run: their capabilities against a mode, with exceptions by name."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..errors import PermissionDenied, QueryError
from .base import Cap, Operator

MODES = {
    "read-only": frozenset({Cap.PURE, Cap.FS_READ, Cap.NET}),
    "sandboxed": frozenset({Cap.PURE, Cap.FS_READ, Cap.NET, Cap.EXEC, Cap.FS_WRITE}),
    "trusted": frozenset(Cap),
}


@dataclass(frozen=True)
class Policy:
    mode: str = "read-only"
    deny: frozenset[str] = field(default_factory=frozenset)
    deny_caps: frozenset[Cap] = field(default_factory=frozenset)
    allowlist: frozenset[str] = field(default_factory=frozenset)
    process_timeout_s: float = 30.0

    def __post_init__(self):
        if self.mode not in MODES:
            raise QueryError(f"there is no mode {self.mode!r}")
        for k in ("deny", "allowlist"):
            object.__setattr__(self, k, frozenset(x.lower() for x in getattr(self, k)))
        object.__setattr__(self, "deny_caps", frozenset(Cap(c) for c in self.deny_caps))

    def authorize(self, operator: Operator) -> None:
        """In this order: denied by name, denied by capability, allowed by name, allowed by mode."""
        name = operator.name.lower()
        if name in self.deny:
            raise PermissionDenied(f"{name} is denied")
        if operator.caps & self.deny_caps:
            raise PermissionDenied(f"{name} needs {sorted(c.value for c in operator.caps & self.deny_caps)}, which is denied")
        if name in self.allowlist:
            return
        if operator.caps - MODES[self.mode]:
            raise PermissionDenied(f"{name} needs {sorted(c.value for c in operator.caps - MODES[self.mode])}; the mode is {self.mode}")

    @property
    def may_read_files(self) -> bool:
        return Cap.FS_READ in MODES[self.mode] and Cap.FS_READ not in self.deny_caps
