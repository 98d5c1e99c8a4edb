"""Error classes and what a failed attempt leads to."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DEVICE, FILE, TRANSIENT = "DEVICE", "FILE", "TRANSIENT"

# Fixed values.
FILE_KINDS = ("RetriesExhausted", "SourceRead", "Manifest")
IO_KINDS = ("DestinationWrite", "VerifyRead", "Io")
DEVICE_IO_KINDS = ("StorageFull", "PermissionDenied", "NotFound")
FATAL_ERRNOS = ("ENOSPC", "EDQUOT", "EACCES", "EPERM", "EROFS", "ENODEV")
FATAL_TYPES = ("FatalDestination", "CacheDrop", "Security")


def classify_error(error_kind: Column, io_kind: Column) -> Column:
    """DEVICE stops the run, FILE sets the entry aside, TRANSIENT is tried again."""
    by_io = F.when(io_kind.isin(*DEVICE_IO_KINDS), DEVICE).otherwise(TRANSIENT)
    return (
        F.when(error_kind == "SanityFailed", DEVICE)
        .when(error_kind.isin(*FILE_KINDS), FILE)
        .when(error_kind == "HashMismatch", TRANSIENT)
        .when(error_kind.isin(*IO_KINDS), by_io)
    )


def classify_fatal(causes: Column, mounted: Column) -> Column:
    """Whether a cause chain means the destination is gone.

    ``causes`` is an array of ``(type, errno, provider_fatal)``, outermost first. An
    unmounted store or a fatal type decides; else, if any errno was seen, only the
    errnos do; else the provider's own flag.
    """
    fatal_type = F.exists(causes, lambda c: F.coalesce(c["type"].isin(*FATAL_TYPES), F.lit(False)))
    saw_errno = F.exists(causes, lambda c: c["errno"].isNotNull())
    fatal_errno = F.exists(causes, lambda c: F.coalesce(c["errno"].isin(*FATAL_ERRNOS), F.lit(False)))
    flagged = F.exists(causes, lambda c: F.coalesce(c["provider_fatal"], F.lit(False)))
    return ~mounted | fatal_type | F.when(saw_errno, fatal_errno).otherwise(flagged)


def root_cause(causes: Column) -> Column:
    """Deepest message of an array of ``(type, message)``, or that cause's type name."""
    deepest = F.try_element_at(causes, F.lit(-1))
    return F.coalesce(deepest["message"], deepest["type"])


def retry_allowed(error_class: Column, attempt: Column, max_retries: int, unlimited: bool = False) -> Column:
    """``max_retries`` counts attempts, so the first one always runs."""
    within = attempt < max_retries
    transient = F.lit(True) if unlimited else within
    return F.when(error_class == DEVICE, False).when(error_class == TRANSIENT, transient).otherwise(within)


def attempt_outcome(error_class: Column, attempt: Column, max_retries: int, unlimited: bool = False) -> Column:
    """``stop``, ``retry`` or ``give_up`` for one failed attempt."""
    return (
        F.when(error_class == DEVICE, "stop")
        .when(retry_allowed(error_class, attempt, max_retries, unlimited), "retry")
        .otherwise("give_up")
    )
