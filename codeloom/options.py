"""What a session may set: caps, case rules, filters and mappings."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column

from .functions.names import group_match, map_path
from .schema import CAP_COMPLETION, CAP_RESULTS, CAP_SYMBOLS, HIGHLIGHT_BYTES, WAIT_MS


@dataclass(frozen=True)
class Options:
    results: int = CAP_RESULTS
    symbols: int = CAP_SYMBOLS
    completions: int = CAP_COMPLETION
    wait_ms: int = WAIT_MS
    highlight_bytes: int = HIGHLIGHT_BYTES
    #: 0 ignores case, 1 unless the pattern has capitals, 2 never.
    symbol_case: int = 1
    completion_case: int = 2
    allow: list[str] = field(default_factory=list)
    deny: list[str] = field(default_factory=list)
    #: 'from>to' pairs.
    path_mappings: list[str] = field(default_factory=list)
    #: Globs of compiler arguments to leave out.
    exclude_args: tuple[str, ...] = ()

    def indexed(self, path: Column) -> Column:
        """Whether a path is indexed at all."""
        return group_match(path, self.allow, self.deny)

    def mapped(self, path: Column) -> Column:
        return map_path(path, self.path_mappings)
