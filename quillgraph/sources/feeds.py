"""Data sources of our own: filing indexes as a batch, event-stream files as a stream.

    spark.dataSource.register(Filings); spark.dataSource.register(EventLines)
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.error import HTTPError
from urllib.request import Request, urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Tries of a request that a server puts off, and the first pause between them in seconds.
TRIES, PAUSE = 4, 1.0


def _fetched(url: str, agent: str, pause: float) -> bytes:
    for n in range(TRIES):
        try:
            with urlopen(Request(url, headers={"User-Agent": agent}), timeout=60) as reply:
                return reply.read()
        except HTTPError as e:
            if e.code not in (429, 500, 502, 503, 504) or n == TRIES - 1:
                raise
            time.sleep(pause * 2**n)
    raise AssertionError("unreachable")


@dataclass
class _Company(InputPartition):
    cik: str

    def __post_init__(self):
        super().__init__(self.cik)


class Filings(DataSource):
    """The filings that companies' submission indexes list, newest first as those have them.

    Options: ``base``, a URL (https or file) below which ``CIK<ten digits>.json``
    lie and the further pages that such a file names; ``ciks``, numbers with
    commas; ``forms``, with commas, all where none is given; ``amendments``, true for forms that end in
    /A too; ``agent``, what servers are told of the caller; ``pause``, seconds before the first try
    again. A company is a partition, so that companies are read side by side
    and one that fails is tried again alone; an index that
    isn't there has no filings. document is the main document's address below ``archive``.
    """

    @classmethod
    def name(cls) -> str:
        return "filings"

    def schema(self) -> str:
        return "ticker string, company string, cik string, form string, accession string, filing_date date, document string"

    def reader(self, schema) -> DataSourceReader:
        return _FilingReader(self.options)


class _FilingReader(DataSourceReader):
    def __init__(self, options):
        self.base = options["base"].rstrip("/")
        self.archive = options.get("archive", self.base).rstrip("/")
        self.ciks = [f"{int(c):010d}" for c in options["ciks"].split(",") if c.strip()]
        self.forms = {f.strip() for f in options.get("forms", "").split(",") if f.strip()}
        self.amendments = options.get("amendments", "false").lower() == "true"
        self.agent, self.pause = options.get("agent", "quillgraph"), float(options.get("pause", PAUSE))

    def partitions(self) -> list[InputPartition]:
        return [_Company(c) for c in self.ciks]

    def _page(self, name: str) -> dict:
        try:
            return json.loads(_fetched(f"{self.base}/{name}", self.agent, self.pause))
        except HTTPError as e:
            if e.code == 404:
                return {}
            raise
        except OSError as e:
            if isinstance(getattr(e, "reason", e), FileNotFoundError):
                return {}
            raise

    def read(self, partition: _Company) -> Iterator[tuple]:
        from datetime import date

        page = self._page(f"CIK{partition.cik}.json")
        filings = page.get("filings", {})
        pages = [filings.get("recent", {}), *(self._page(f["name"]) for f in filings.get("files", []))]
        ticker = next(iter(page.get("tickers") or []), None)
        for listed in pages:
            for form, accession, day, document in zip(*(listed.get(k, []) for k in ("form", "accessionNumber", "filingDate", "primaryDocument"))):
                if (self.forms and form.removesuffix("/A") not in self.forms) or (form.endswith("/A") and not self.amendments):
                    continue
                address = f"{self.archive}/{int(partition.cik)}/{accession.replace('-', '')}/{document}" if document else None
                yield ticker, page.get("name"), partition.cik, form, accession, date.fromisoformat(day), address


@dataclass
class _Range(InputPartition):
    file: str
    start: int
    end: int

    def __post_init__(self):
        super().__init__((self.file, self.start, self.end))


class EventLines(DataSource):
    """Lines of the files of a folder to which writers append, one file a request: request_id, seq, line.

    Options: ``folder``, one that driver and executors see under the same path; ``suffix``
    of the files, .sse by default; ``most``, bytes of a partition. request_id is a
    file's name without the suffix, seq the byte at which the line begins. A
    stream's offset is how far each file is read, up to the end of its last whole line, so
    a restart from a checkpoint goes on from there: it loses no line and repeats
    none. A line without its end yet waits. A batch reads all whole lines.
    """

    @classmethod
    def name(cls) -> str:
        return "event_lines"

    def schema(self) -> str:
        return "request_id string, seq long, line string"

    def reader(self, schema) -> DataSourceReader:
        return _LineReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _LineStream(self.options)


class _Lines:
    def __init__(self, options):
        self.folder, self.suffix, self.most = options["folder"].removeprefix("file:").replace("//", "/"), options.get("suffix", ".sse"), int(options.get("most", 64 << 20))

    def _names(self) -> list[str]:
        return sorted(n for n in os.listdir(self.folder) if n.endswith(self.suffix) and not n.startswith((".", "_"))) if os.path.isdir(self.folder) else []

    def _whole(self, name: str, known: int) -> int:
        """Where the last whole line of a file ends; ``known`` is where one did."""
        path = os.path.join(self.folder, name)
        size = os.path.getsize(path)
        with open(path, "rb") as file:
            end = size
            while end > known:
                start = max(known, end - (1 << 16))
                file.seek(start)
                if (at := file.read(end - start).rfind(b"\n")) >= 0:
                    return start + at + 1
                end = start
        return known

    def _ranges(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Range(n, a, min(a + self.most, b)) for n, b in sorted(end.items()) for a in range(start.get(n, 0), b, self.most)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        """Lines that begin within the range; the one that begins before it belongs to the range before."""
        with open(os.path.join(self.folder, partition.file), "rb") as file:
            at = partition.start
            if at:
                file.seek(at - 1)
                at += len(file.readline()) - 1
            file.seek(at)
            while at < partition.end:
                line = file.readline()
                if not line.endswith(b"\n"):
                    break
                yield partition.file.removesuffix(self.suffix), at, line.rstrip(b"\r\n").decode("utf-8", "replace")
                at += len(line)


class _LineReader(_Lines, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return self._ranges({}, {n: self._whole(n, 0) for n in self._names()}) or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        return super().read(partition) if partition.file else iter(())


class _LineStream(_Lines, DataSourceStreamReader):
    def __init__(self, options):
        super().__init__(options)
        self.ends: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        self.ends = {n: self._whole(n, self.ends.get(n, 0)) for n in self._names()}
        return {n: e for n, e in self.ends.items() if e}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self._ranges(start, end)

    def commit(self, end: dict) -> None:
        pass
