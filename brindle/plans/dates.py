"""Date math (`now-1d/d`, `2026-01-31||+1M/M`) and calendar units, evaluated on the driver."""

from __future__ import annotations

import calendar
import re
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

UNITS = {"y": "year", "M": "month", "w": "week", "d": "day", "h": "hour", "H": "hour", "m": "minute", "s": "second"}
CALENDAR = {
    "second": "second", "1s": "second", "minute": "minute", "1m": "minute", "hour": "hour", "1h": "hour", "day": "day", "1d": "day",
    "week": "week", "1w": "week", "month": "month", "1M": "month", "quarter": "quarter", "1q": "quarter", "year": "year", "1y": "year",
}
_SECONDS = {"nanos": 1e-9, "micros": 1e-6, "ms": 1e-3, "s": 1, "m": 60, "h": 3600, "d": 86400}
_STEP = re.compile(r"([+-])(\d*)([yMwdhHms])|/([yMwdhHms])")


def seconds(text: str | int | float) -> float:
    """Length of a fixed interval such as `30s` or `1.5h`."""
    if isinstance(text, (int, float)):
        return text / 1000
    m = re.fullmatch(r"(\d+(?:\.\d+)?)(nanos|micros|ms|s|m|h|d)", text.strip())
    if not m:
        raise ValueError(f"not a fixed interval: {text!r}")
    return float(m[1]) * _SECONDS[m[2]]


def add(t: datetime, n: int, unit: str) -> datetime:
    if unit in ("y", "M"):
        months = t.year * 12 + t.month - 1 + n * (12 if unit == "y" else 1)
        y, m = divmod(months, 12)
        return t.replace(year=y, month=m + 1, day=min(t.day, calendar.monthrange(y, m + 1)[1]))
    return t + timedelta(seconds=n * {"w": 604800, "d": 86400, "h": 3600, "H": 3600, "m": 60, "s": 1}[unit])


def floor(t: datetime, unit: str) -> datetime:
    t = t.replace(microsecond=0)
    if unit == "s":
        return t
    t = t.replace(second=0)
    if unit == "m":
        return t
    t = t.replace(minute=0)
    if unit in "hH":
        return t
    t = t.replace(hour=0)
    if unit == "w":
        return t - timedelta(days=t.weekday())
    if unit == "M":
        return t.replace(day=1)
    return t.replace(day=1, month=1) if unit == "y" else t


_FORMATS = ("%Y-%m-%dT%H:%M:%S.%f", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d", "%Y/%m/%d", "%Y-%m", "%Y")
_JAVA = (("yyyy", "%Y"), ("uuuu", "%Y"), ("MM", "%m"), ("dd", "%d"), ("HH", "%H"), ("mm", "%M"), ("ss", "%S"), ("SSS", "%f"), ("'T'", "T"), ("XXX", "%z"))


def java_format(pattern: str) -> str:
    for a, b in _JAVA:
        pattern = pattern.replace(a, b)
    return pattern


def parse(text: str | int | float, formats: str | None = None, zone: str | None = None) -> tuple[datetime, int]:
    """(UTC instant without zone, how many of year, month, day, hour, minute, second were given)."""
    if isinstance(text, (int, float)) or (formats and "epoch" in formats and re.fullmatch(r"-?\d+", str(text))):
        scale = 1 if formats and "epoch_second" in formats else 1000
        return datetime(1970, 1, 1) + timedelta(seconds=float(text) / scale), 6
    s = str(text).strip()
    tz = ZoneInfo(zone) if zone and not re.match(r"[+-]\d", zone) else None
    shift = timedelta(0)
    if zone and tz is None:
        m = re.fullmatch(r"([+-])(\d{2}):?(\d{2})", zone)
        shift = timedelta(hours=int(m[2]), minutes=int(m[3])) * (1 if m[1] == "+" else -1)
    m = re.search(r"(Z|[+-]\d{2}:?\d{2})\Z", s) if "T" in s else None
    if m:
        s, z = s[: m.start()], m[1]
        tz, shift = None, timedelta(0)
        if z != "Z":
            shift = timedelta(hours=int(z[1:3]), minutes=int(z[-2:])) * (1 if z[0] == "+" else -1)
    own = [java_format(f) for f in (formats or "").split("||") if f and not f.startswith(("epoch", "strict_date_op", "date_op"))]
    for f in (*own, *_FORMATS):
        try:
            t = datetime.strptime(s, f)
        except ValueError:
            continue
        if t.tzinfo:
            t = t.astimezone(timezone.utc).replace(tzinfo=None)
        depth = 6 if "%S" in f else 5 if "%M" in f else 4 if "%H" in f else 3 if "%d" in f else 2 if "%m" in f else 1
        if tz:
            t = t.replace(tzinfo=tz).astimezone(timezone.utc).replace(tzinfo=None)
        return t - shift, depth
    raise ValueError(f"not a date: {text!r}")


def evaluate(text: str | int | float, now: datetime | None = None, round_up: bool = False, formats: str | None = None, zone: str | None = None) -> datetime:
    """A date-math expression as a UTC instant; `round_up` is for `lte` and `gt` bounds."""
    now = now or datetime.now(timezone.utc).replace(tzinfo=None)
    if not isinstance(text, str):
        return parse(text, formats, zone)[0]
    if text.startswith("now"):
        t, rest, depth = now, text[3:], 6
    else:
        base, _, rest = text.partition("||")
        t, depth = parse(base, formats, zone)
    at = 0
    for m in _STEP.finditer(rest):
        if m.start() != at:
            break
        at = m.end()
        if m[4]:
            t = floor(t, m[4])
            if round_up:
                t = add(t, 1, m[4]) - timedelta(milliseconds=1)
        else:
            t = add(t, int(m[2] or 1) * (1 if m[1] == "+" else -1), m[3])
    if at != len(rest):
        raise ValueError(f"not date math: {text!r}")
    if round_up and not rest and depth < 6:  # what was left out is filled with its largest value
        t = add(t, 1, "yMdhms"[depth - 1] if depth != 3 else "d") - timedelta(milliseconds=1)
    return t
