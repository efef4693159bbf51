"""Tuning knobs, checked before a directory is touched."""

from __future__ import annotations

from dataclasses import dataclass

from .errors import InvalidArgument

#: Fixed values.
FORMAT_VERSION = 1
MAX_KEY_LEN = 65_535
MAX_VALUE_LEN = 268_435_456
MAX_BATCH_REQUESTS = 1024
#: Frozen logs that may wait for their flush before writers do.
MAX_FROZEN = 2
#: Bytes that a log record and a memtable entry have besides key and value.
LOG_HEADER = 21
ENTRY_OVERHEAD = 16


@dataclass(frozen=True)
class Options:
    memtable_size: int = 4 << 20
    l0_compaction_trigger: int = 4
    l1_max_bytes: int = 10 << 20
    level_multiplier: int = 10
    target_file_size: int = 2 << 20
    max_levels: int = 7
    #: Seconds that a commit waits for more writers.
    commit_window: float = 0.0
    #: Flush and rewrite in a thread; otherwise the writer that fills the log does.
    background: bool = False

    def __post_init__(self) -> None:
        for name, least in (("memtable_size", 1024), ("l0_compaction_trigger", 1), ("l1_max_bytes", 1), ("level_multiplier", 1), ("target_file_size", 1)):
            if getattr(self, name) < least:
                raise InvalidArgument(f"{name} must be {least} or more")
        if not 2 <= self.max_levels <= 255:
            raise InvalidArgument("max_levels must be 2 to 255")
        if self.commit_window < 0:
            raise InvalidArgument("commit_window must not be negative")

    def level_budget(self, level: int) -> int:
        return int(float(self.l1_max_bytes) * float(self.level_multiplier) ** (level - 1))
