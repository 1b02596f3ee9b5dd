"""A custom connector: a calendar of days that tasks make themselves, a partition for each stretch of days."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, timedelta

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


class Stretch(InputPartition):
    def __init__(self, first: date, days: int):
        self.first, self.days = first, days


class CalendarReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.first, self.last = (date.fromisoformat(options[k]) for k in ("from", "to"))
        self.stretch = int(options.get("stretch", "1000"))
        if self.stretch < 1:
            raise ValueError("stretch must be at least one day")

    def partitions(self) -> list[Stretch]:
        days = (self.last - self.first).days + 1
        return [Stretch(self.first + timedelta(lo), min(self.stretch, days - lo)) for lo in range(0, max(days, 0), self.stretch)] or [Stretch(self.first, 0)]

    def read(self, partition: Stretch) -> Iterator[tuple]:
        for n in range(partition.days):
            d = partition.first + timedelta(n)
            yield d, d.year, d.month, d.isoweekday(), d.isoweekday() > 5


class Calendar(DataSource):
    """Format `calendar`, options from and to (ISO dates, both included) and stretch (days of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "calendar"

    def schema(self) -> str:
        return "day date, year int, month int, weekday int, weekend boolean"

    def reader(self, schema: StructType) -> DataSourceReader:
        return CalendarReader(self.options)
