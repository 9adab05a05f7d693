"""Arguments of the public queries: checked when built in code, clamped when parsed from a web form."""

from __future__ import annotations

import sys
from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta, timezone


def _number(args: Mapping, name: str, default, low, high, kind=int):
    try:
        value = kind(args.get(name, default))
    except (TypeError, ValueError):
        value = default
    return max(low, min(high, value))


def _within(name: str, value, low: int, high: int | None) -> None:
    if not isinstance(value, int) or value < low or (high is not None and value > high):
        raise ValueError(f"{name} must be an integer of at least {low}" + (f" and at most {high}" if high else ""))


def _words(args: Mapping, name: str) -> tuple[str, ...]:
    return tuple(w.strip() for w in str(args.get(name) or "").split(",") if w.strip())


@dataclass(frozen=True)
class ChartParams:
    """``bias_exponent`` and ``color_intensity`` are accepted for compatibility; no result uses them."""

    start_date: str | None = None
    days_to_show: int = 7
    maps_to_show: int = 10
    precision: int = 2
    top_servers: int = 10
    only_maps_containing: tuple[str, ...] = field(default=())
    append_maps_containing: tuple[str, ...] = field(default=())
    server_filter: str = "ALL"
    only_servers_containing: tuple[str, ...] = field(default=())
    bias_exponent: float = 1.2
    color_intensity: int = 50

    def __post_init__(self):
        for name, low, high in (("days_to_show", 1, 365), ("maps_to_show", 1, 50), ("precision", 0, 6),
                                ("top_servers", 1, 50)):
            _within(name, getattr(self, name), low, high)

    @classmethod
    def parse(cls, args: Mapping, today: date | None = None) -> "ChartParams":
        """From query-string arguments; the default window ends today. The arguments spell
        ``precision`` as ``percision``."""
        days = _number(args, "days_to_show", 7, 1, 365)
        today = today or datetime.now(timezone.utc).date()
        return cls(
            start_date=args.get("start_date", (today - timedelta(days=days - 1)).isoformat()),
            days_to_show=days,
            maps_to_show=_number(args, "maps_to_show", 10, 1, 50),
            precision=_number(args, "percision", 2, 0, 6),
            top_servers=_number(args, "top_servers", 10, 1, 50),
            only_maps_containing=_words(args, "only_maps_containing"),
            append_maps_containing=_words(args, "append_maps_containing"),
            server_filter=str(args.get("server_filter", "ALL")).strip() or "ALL",
            only_servers_containing=_words(args, "only_servers_containing"),
            bias_exponent=_number(args, "bias_exponent", 1.2, 0.1, 8.0, float),
            color_intensity=_number(args, "color_intensity", 50, 1, 50))


@dataclass(frozen=True)
class StatsParams:
    page: int = 1
    limit: int = 50
    day: str | None = None

    def __post_init__(self):
        _within("page", self.page, 1, None)
        _within("limit", self.limit, 10, 100)

    @classmethod
    def parse(cls, args: Mapping) -> "StatsParams":
        """From query-string arguments, clamped as a web form's are."""
        day = args.get("date") or args.get("day")
        return cls(_number(args, "page", 1, 1, sys.maxsize), _number(args, "limit", 50, 10, 100), day)

    def target_day(self) -> str:
        return self.day or date.today().isoformat()

    def total_pages(self, clients: int) -> int:
        return max(1, -(-clients // self.limit))


GRID = timedelta(hours=2)


def floor_to_grid(t: datetime) -> datetime:
    return t - (t - datetime.min) % GRID


def ceil_to_grid(t: datetime) -> datetime:
    low = floor_to_grid(t)
    return low if low == t else low + GRID


def resolve_window(newest: datetime | None, start_date: str | None, days: int) -> tuple[datetime, datetime] | None:
    """``[start, end)`` on the two-hour grid, or nothing when there is no data.

    Without a start, or with one after the newest data, the window is the last ``days`` days. It is
    widened to whole buckets, so that stored rollups and raw samples give the same result.
    """
    if newest is None:
        return None
    start = datetime.fromisoformat(start_date) if start_date else None
    if start is None or newest.date() < start.date():
        start = newest - timedelta(days=days)
    end = start + timedelta(days=days)
    return floor_to_grid(start), ceil_to_grid(end)
