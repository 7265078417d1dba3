"""The daily id files as a stream."""

from citetide.streaming.daily import append_daily_dates, stream_daily_dates

__all__ = ["append_daily_dates", "stream_daily_dates"]
