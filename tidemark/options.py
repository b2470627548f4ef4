"""Options with their defaults, and the limits derived from them by level."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import IntFlag

from .functions.comparer import Bloom, Bytewise, Comparer, FilterPolicy, Internal, UserKeys

KIB, MIB = 1 << 10, 1 << 20


class Strict(IntFlag):
    """What to verify, and where corruption is an error instead of a skip."""

    MANIFEST = 1
    JOURNAL_CHECKSUM = 2
    JOURNAL = 4
    BLOCK_CHECKSUM = 8
    COMPACTION = 16
    READER = 32
    RECOVERY = 64
    OVERRIDE = 128
    ALL = 127
    DEFAULT = 2 | 8 | 16 | 32


@dataclass(frozen=True)
class Options:
    """Engine options; sizes in bytes.  Level multipliers grow a limit with the
    level, and ``*_per_level`` overrides the multiplier of single levels.

    ``comparer`` names the collation of user keys, one of ``comparers``.  Tables are
    written with ``filter`` (None: without) and read with it or, if a table has
    another one, with that of ``alternatives`` which bears its name.
    """

    block_size: int = 4 * KIB
    restart_gap: int = 16
    write_buffer: int = 4 * MIB
    filter_base_lg: int = 11
    filter: FilterPolicy | None = Bloom()
    alternatives: tuple[FilterPolicy, ...] = ()
    compression: str = "snappy"
    l0_trigger: int = 4
    table_size: int = 2 * MIB
    table_multiplier: float = 1.0
    table_per_level: dict[int, float] = field(default_factory=dict)
    total_size: int = 10 * MIB
    total_multiplier: float = 10.0
    total_per_level: dict[int, float] = field(default_factory=dict)
    expand_factor: int = 25
    grandparent_factor: int = 10
    source_factor: int = 1
    max_manifest: int = 64 * MIB
    seek_bytes: int = 16384
    min_seeks: int = 100
    comparer: str = "tidemark.bytewise"
    comparers: tuple[Comparer, ...] = (Bytewise(),)
    strict: Strict = Strict.DEFAULT

    def __post_init__(self):
        if self.comparer not in {c.name for c in self.comparers}:
            raise ValueError(f"no comparer {self.comparer}")
        if min(self.block_size, self.restart_gap, self.l0_trigger, self.table_size, self.total_size) < 1:
            raise ValueError("sizes and counts have to be positive")
        if self.compression not in ("snappy", "none"):
            raise ValueError(f"no compression {self.compression}")

    def user_comparer(self) -> Comparer:
        return next(c for c in self.comparers if c.name == self.comparer)

    def internal_comparer(self) -> Internal:
        """The collation of internal keys that tables of a log are written in."""
        return Internal(self.user_comparer())

    def internal_filter(self) -> UserKeys | None:
        """The filter asked with internal keys; only their user keys are in it."""
        return UserKeys(self.filter) if self.filter else None

    def table_limit(self, level: int) -> int:
        """Size of a table that compaction writes to ``level``."""
        return _grown(self.table_size, self.table_multiplier, self.table_per_level, level)

    def total_limit(self, level: int) -> int:
        """Bytes that ``level`` may hold before it is compacted."""
        return _grown(self.total_size, self.total_multiplier, self.total_per_level, level)

    def expand_limit(self, level: int) -> int:
        return self.table_limit(level + 1) * self.expand_factor

    def grandparent_limit(self, level: int) -> int:
        return self.table_limit(level + 2) * self.grandparent_factor

    def source_limit(self, level: int) -> int:
        return self.table_limit(level + 1) * self.source_factor

    def is_strict(self, what: Strict, read: Strict | None = None) -> bool:
        """A read's own flags count too, alone if they say OVERRIDE."""
        if read is not None and read & Strict.OVERRIDE:
            return bool(read & what)
        return bool((self.strict | (read or Strict(0))) & what)


def _grown(base: int, multiplier: float, per_level: dict[int, float], level: int) -> int:
    own = per_level.get(level, 0)
    return int(base * own) if own > 0 else int(base * multiplier**level)
