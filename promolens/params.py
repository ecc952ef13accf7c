"""Report parameters; what used to be edited by hand in each script."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo


@dataclass(frozen=True)
class ReportParams:
    """``start``/``end`` bound the facts; ``dates`` narrows them to a list.

    ``as_of`` replaces the current timestamp and must carry a time zone;
    ``time_zone`` is the session's, in which today's date is meant.
    ``max_broadcast_rows`` bounds rows of lists with a few short columns (tens of
    bytes each), so the default stays within some tens of megabytes.
    """

    start: date
    end: date
    as_of: datetime
    month: date
    dates: tuple[date, ...] | None = None
    hour_cutoff: int | None = None
    lookback_days: int = 90
    offer_since: date | None = None
    offer_window_days: int = 90
    pack_window_days: int = 7
    state_from: date | None = None
    count_store_once: bool = False
    max_broadcast_rows: int = 500_000
    time_zone: str = "UTC"

    def __post_init__(self) -> None:
        if self.as_of.tzinfo is None:
            raise ValueError("as_of needs a time zone")
        if self.start > self.end:
            raise ValueError("start is after end")

    @property
    def pack_window(self) -> tuple[date, date]:
        """The last ``pack_window_days`` complete days before ``as_of``."""
        today = self.as_of.astimezone(ZoneInfo(self.time_zone)).date()
        return today - timedelta(days=self.pack_window_days), today - timedelta(days=1)
