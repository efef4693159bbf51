"""What a store can fail with."""


class StoreError(Exception):
    """Base of all."""


class StoreIOError(StoreError):
    """The file system failed."""


class StoreClosed(StoreIOError):
    """The store was closed."""


class StorePoisoned(StoreIOError):
    """An earlier write failed half-way: all calls fail until the store is opened again."""


class ManifestCorrupt(StoreError):
    """A commit before the last is missing or unreadable."""


class DataFileCorrupt(StoreError):
    """A data file isn't what the manifest says."""


class InvalidArgument(StoreError, ValueError):
    """A key, a value or an option out of range."""


class StoreLocked(StoreError):
    """Another process has the directory open."""


class UnsupportedFormat(StoreError):
    def __init__(self, found: int, supported: int) -> None:
        super().__init__(f"format {found}; this version reads {supported}")
        self.found, self.supported = found, supported
