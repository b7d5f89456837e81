"""Settings of a cleaning run."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """``similarity``: least ratio of two command heads; ``rare_threshold``: greatest
    decayed weight of a rare command; ``remove_rare``: whether rare variants go."""

    similarity: float = 0.8
    rare_threshold: float = 3.0
    remove_rare: bool = False


#: The log is rotated from this size on.
LOG_MAX_BYTES = 1_048_576
#: Backups that are kept.
BACKUPS = 5
