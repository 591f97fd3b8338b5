"""The history of what a reader said of a vacancy, folded from their requests in order."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Statuses that answer an ad; of one day the last of these stays.
ANSWERS = frozenset(("APPLIED", "INTERVIEW", "REJECTED"))
VIEWED, RETURNED, NOT_INTERESTED, APPLIED = "VIEWED", "RETURNED", "NOT_INTERESTED", "APPLIED"


class Reader:
    """What is known of one reader and one vacancy: the current status, the last line, and the last status before doubts."""

    def __init__(self) -> None:
        self.current: str | None = None
        self.before = VIEWED
        self.line: tuple | None = None

    def ask(self, status: str, at, day) -> tuple[bool, bool]:
        """(whether something changes, whether the last line is replaced)."""
        if status == VIEWED:
            if self.current is not None:
                return False, False
            now = VIEWED
        elif status == RETURNED:
            if self.current not in (NOT_INTERESTED, APPLIED):
                return False, False
            now = self.before if self.current == NOT_INTERESTED else VIEWED
        elif status == self.current:
            return False, False
        else:
            now = status
        replaced = self.line is not None and status in ANSWERS and self.line[0] in ANSWERS and self.line[2] == day
        self.current, self.line = now, (status, at, day, now)
        if status not in (NOT_INTERESTED, RETURNED):
            self.before = status
        return True, replaced


def status_history(requests: DataFrame) -> DataFrame:
    """(user_id, vacancy_id, line, status, set_at, local_day, current) from requests (id, user_id, vacancy_id, status, set_at, local_day).

    A vacancy is viewed once, as the first of all; a repeated status says nothing new; an answer replaces that of the same day; RETURNED
    takes back NOT_INTERESTED, to the last other status, or APPLIED, to VIEWED, and nothing else. current is the status after a line. Requests
    of one time are taken by id; those without a status say nothing; null users and vacancies are values like others. A reader's requests for one
    vacancy are streamed in order by one task, which holds the last line alone.
    """
    own = requests.where("status IS NOT NULL").select("user_id", "vacancy_id", "set_at", "id", "status", "local_day")
    own = own.repartition("user_id", "vacancy_id").sortWithinPartitions("user_id", "vacancy_id", "set_at", "id", "status")
    names = ["user_id", "vacancy_id", "line", "status", "set_at", "local_day", "current"]
    kinds = {f.name: f.dataType.simpleString() for f in own.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, reader, line, types = None, Reader(), 0, []
        out: list[tuple] = []
        made = lambda: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
        for b in batches:
            of = {f.name: f.type for f in b.schema}
            types = [of["user_id"], of["vacancy_id"], pa.int64(), pa.string(), of["set_at"], of["local_day"], pa.string()]
            for user, vacancy, at, status, day in zip(*(b.column(c).to_pylist() for c in ("user_id", "vacancy_id", "set_at", "status", "local_day")), strict=True):
                if key != (user, vacancy):
                    if reader.line:
                        out.append((*key, line, *reader.line))
                    key, reader, line = (user, vacancy), Reader(), 0
                last = reader.line
                changed, replaced = reader.ask(status, at, day)
                if changed and not replaced:
                    if last:
                        out.append((*key, line, *last))
                    line += 1
            if len(out) > 10_000:
                yield made()
                out = []
        if reader.line:
            out.append((*key, line, *reader.line))
        if out:
            yield made()

    return own.mapInArrow(run, f"user_id {kinds['user_id']}, vacancy_id {kinds['vacancy_id']}, line long, status string, set_at {kinds['set_at']}, local_day {kinds['local_day']}, current string")


def current_status(history: DataFrame) -> DataFrame:
    """(user_id, vacancy_id, status): the status after the last line."""
    return history.groupBy("user_id", "vacancy_id").agg(F.max_by("current", "line").alias("status"))
