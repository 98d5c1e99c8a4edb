"""Job parameters."""

from __future__ import annotations

from dataclasses import dataclass, replace

MAX_COOLDOWN_SECS = 120
MAX_RETRIES_CEILING = 10


@dataclass(frozen=True)
class JobOptions:
    """Settings of a copy or verify job.

    ``skip_junk`` is True or ``"basic"``, or ``"extended"``; ``probe`` writes, reads back and
    deletes noise at the destination before a copy. ``unlimited_retries`` lets a transient failure outlive ``max_retries``; since a
    Spark task has to end, ``attempt_ceiling`` bounds it all the same.
    """

    cooldown_secs: int = 45
    max_retries: int = 3
    unlimited_retries: bool = True
    no_manifest: bool = True
    respect_ignore_files: bool = False
    skip_junk: bool | str = False
    probe: bool = True
    digest: str = "xxh3_128"
    failure_limit: int = 5
    attempt_ceiling: int = 20
    backoff_unit_secs: float = 1.0

    def clamp_options(self) -> "JobOptions":
        """Bring loaded settings into their allowed ranges."""
        return replace(
            self,
            cooldown_secs=max(0, min(self.cooldown_secs, MAX_COOLDOWN_SECS)),
            max_retries=max(1, min(self.max_retries, MAX_RETRIES_CEILING)),
        )
