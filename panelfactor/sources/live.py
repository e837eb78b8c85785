"""A live series service as a Spark data source: one partition for each range of dates.

    spark.dataSource.register(live_source(fetch))
    spark.read.format("panel_live").option("ids", "DGS2,DGS10").option("start", "2000-01-01").option("end", "2025-12-31").load()

Rows are text, as the service sends them: observation_date and a column for each id. ``fetch(url, timeout)`` returns bytes and
goes to the workers with the source; each range is asked for on its own, tried again with doubling pauses of at most four
seconds, and refused beyond its size limit.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from urllib.parse import urlencode

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BASE = "https://fred.stlouisfed.org/graph/fredgraph.csv"
#: Words that tell the two kinds of failure apart once they have come through Spark.
UNAVAILABLE, INVALID = "live source unavailable", "live payload invalid"
_DATES = (b"observation_date", b"DATE", b"Date")


class SourceUnavailable(RuntimeError):
    """The live source could not be reached: a snapshot may stand in."""


class PayloadInvalid(ValueError):
    """The live source answered with something that can't be used: nothing may stand in."""


def fetched(fetch: Callable[[str, float], bytes], url: str, timeout: float, retries: int, most: int, sleep=time.sleep) -> bytes:
    """Payload of ``fetch``; its OSErrors mean unavailable, a payload over ``most`` bytes or without the date column is invalid."""
    error: Exception | None = None
    for attempt in range(retries):
        try:
            payload = fetch(url, timeout)
        except OSError as e:
            error = e
            sleep(min(4.0, 0.5 * 2**attempt))
            continue
        if len(payload) > most:
            raise PayloadInvalid(f"{INVALID}: larger than allowed")
        if payload.lstrip(b"\xef\xbb\xbf").split(b",", 1)[0].strip() not in _DATES:
            raise PayloadInvalid(f"{INVALID}: no panel")
        return payload
    raise SourceUnavailable(f"{UNAVAILABLE}: no answer after {retries} tries: {error}")


def http_fetch(most: int):
    """A fetch(url, timeout) over the network; a declared length or a body beyond ``most`` bytes is refused."""

    def fetch(url: str, timeout: float) -> bytes:
        from urllib.request import Request, urlopen

        with urlopen(Request(url, headers={"User-Agent": "panelfactor"}), timeout=timeout) as answer:  # noqa: S310  the base address is a constant
            declared = answer.headers.get("Content-Length")
            if declared is not None and (not declared.isdigit() or int(declared) > most):
                raise PayloadInvalid(f"{INVALID}: declared length larger than allowed")
            return answer.read(most + 1)

    return fetch


class DateRange(InputPartition):
    def __init__(self, start: str, end: str):
        super().__init__(None)
        self.start, self.end = start, end


def date_ranges(start: str, end: str, years: int) -> list[DateRange]:
    """Ranges of ``years`` calendar years from ``start`` to ``end``, both inclusive, without gaps or overlaps."""
    out, at, last = [], date.fromisoformat(start), date.fromisoformat(end)
    while at <= last:
        stop = min(last, date(min(9999, at.year + years - 1), 12, 31))
        out.append(DateRange(at.isoformat(), stop.isoformat()))
        at = stop + timedelta(1)
    return out


def rows_of(payload: bytes, ids: list[str]) -> Iterator[tuple]:
    """The payload's rows as text, in the order of ``ids``; rows of another length or absent columns are invalid."""
    try:
        lines = payload.decode("utf-8-sig").splitlines()
    except UnicodeDecodeError as e:
        raise PayloadInvalid(f"{INVALID}: not UTF-8") from e
    header = [x.strip() for x in lines[0].split(",")]
    absent = [x for x in ids if x not in header]
    if absent or len(set(header)) != len(header):
        raise PayloadInvalid(f"{INVALID}: columns {absent or header}")
    at = [0, *(header.index(x) for x in ids)]
    for line in filter(None, lines[1:]):
        cells = line.split(",")
        if len(cells) != len(header):
            raise PayloadInvalid(f"{INVALID}: rows differ in length")
        yield tuple(cells[k] for k in at)


class LiveReader(DataSourceReader):
    def __init__(self, options, fetch, sleep):
        o = dict(options)
        self.ids, self.base = o["ids"].split(","), o.get("base", BASE)
        self.start, self.end, self.years = o["start"], o["end"], int(o.get("years", "30"))
        self.timeout, self.retries, self.most = float(o.get("timeout", "10")), int(o.get("retries", "2")), int(o.get("maximum_bytes", "25000000"))
        self.fetch, self.sleep = fetch, sleep

    def partitions(self):
        return date_ranges(self.start, self.end, self.years)

    def read(self, partition):
        url = f"{self.base}?{urlencode({'id': ','.join(self.ids), 'cosd': partition.start, 'coed': partition.end})}"
        yield from rows_of(fetched(self.fetch, url, self.timeout, self.retries, self.most, self.sleep), self.ids)


def live_source(fetch, sleep=time.sleep) -> type[DataSource]:
    """The data source ``panel_live`` with its way to the network (``fetch``, which tests replace)."""

    class PanelLive(DataSource):
        @classmethod
        def name(cls):
            return "panel_live"

        def schema(self):
            return ", ".join(f"`{c}` string" for c in ("observation_date", *self.options["ids"].split(",")))

        def reader(self, schema):
            return LiveReader(self.options, fetch, sleep)

    return PanelLive
