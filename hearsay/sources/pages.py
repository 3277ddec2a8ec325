"""A store of captured review pages as a data source: newest-first walks by cursor, one partition an app, and new pages as a stream.

A capture is a folder with a folder app_id=<id> for each app, whose text files, in the order of their names, have a line of JSON
for each answer: {"asked", "success", "next", "total", "reviews": [{"id", "at", "language", "up"}]}; at: epoch seconds. An answer
to a cursor that is asked again is another line.

A walk holds a page at a time, what it hands on together, and the cursors it has seen. It ends at the first of: success 2 (no result); an empty page after
``retries`` empty ones in a row; a review below the window; when strict, a page with a review outside; its quota; no next cursor, or
one that was seen; no more answers. A success of another kind is an error.

    spark.dataSource.register(pages.ReviewPages)
    spark.read.format("review_pages").option("path", ...).option("start", ...).option("end", ...).load()

Options: path; start, end (ISO times with their zone, both inclusive); quota; strict (false); retries (2); table: ``reviews`` (what
was collected) or ``walks`` (a row an app). As a stream (new_review_pages): path, start, end, and, to take no more than some new
files an app in a batch, files and progress: a file of the stream's own that says how far it has come, since the engine doesn't
tell a source so after a restart.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

REVIEWS = "app_id long, page long, review_id string, created_at timestamp, language string, voted_up boolean"
WALKS = "app_id long, pages long, collected long, out_of_window long, reported long, stopped_empty boolean, why string"
PLACED = "app_id long, review_id string, created_at timestamp, language string, voted_up boolean, place string"
FIRST = "*"
#: Reviews that are handed on together; a page has few.
ROWS = 2_000


class App(InputPartition):
    def __init__(self, app_id: int, files: list[str]):
        self.app_id, self.files = app_id, files


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def apps(path: str) -> dict[int, list[str]]:
    """Files of each app, by name."""
    where, top = _store(path)
    found: dict[int, list[str]] = {}
    for f in where.get_file_info(fs.FileSelector(top, recursive=True)):
        folder, _, name = f.path.rpartition("/")
        if f.is_file and "app_id=" in folder and not name.startswith((".", "_")):
            found.setdefault(int(folder.rpartition("app_id=")[2]), []).append(f.path)
    return {a: sorted(files) for a, files in sorted(found.items())}


def answers(path: str, files: list[str]) -> Iterator[dict]:
    """The answers of an app, one at a time."""
    where = _store(path)[0]
    for name in files:
        with where.open_input_stream(name) as stream:
            rest = b""
            while block := stream.read(1 << 16):
                *lines, rest = (rest + block).split(b"\n")
                yield from (json.loads(x) for x in lines if x.strip())
            if rest.strip():
                yield json.loads(rest)


def instant(text: str) -> int:
    """Epoch seconds of an ISO time that says its zone."""
    at = datetime.fromisoformat(text)
    if at.tzinfo is None:
        raise ValueError(f"{text} has no zone")
    return int(at.timestamp())


class Walk:
    """Counts of a walk while its pages go by."""

    def __init__(self, start: int, end: int, quota: int | None, strict: bool, retries: int):
        if start > end:
            raise ValueError("the window ends before it starts")
        self.start, self.end, self.quota, self.strict, self.retries = start, end, quota, strict, retries
        self.pages = self.collected = self.strangers = self.empty = 0
        self.reported: int | None = None
        self.why = ""
        self.seen = {FIRST}

    def page(self, answer: dict) -> list[dict]:
        """What is collected of a page; why is set when it is the last one."""
        self.pages += 1
        if self.reported is None:
            self.reported = answer.get("total")
        if answer["success"] == 2:
            self.why = "no result"
            return []
        if answer["success"] != 1:
            raise ValueError(f"success is {answer['success']}, neither 1 nor 2")
        rows = answer.get("reviews") or []
        if not rows:
            self.empty += 1
            self.why = "empty pages" if self.empty > self.retries else ""
            return []
        self.empty = 0
        inside = [r for r in rows if self.start <= r["at"] <= self.end]
        self.strangers += len(rows) - len(inside) if self.strict else 0
        room = len(inside) if self.quota is None else max(0, self.quota - self.collected)
        following = answer.get("next")
        reasons = (
            ("below the window", any(r["at"] < self.start for r in rows)), ("strangers", self.strangers > 0),
            ("quota", len(inside) >= room and self.quota is not None), ("cursor", following is None or following in self.seen),
        )
        self.why = next((name for name, holds in reasons if holds), "")
        self.seen.add(following)
        self.collected += min(room, len(inside))
        return inside[:room]

    def over(self, capture: Iterator[dict]) -> Iterator[list[dict]]:
        """Collected reviews, page by page, of the answers that the walk asks for."""
        asked = FIRST
        for answer in capture:
            if answer["asked"] != asked:
                continue  # an answer that this walk did not ask for
            yield self.page(answer)
            if self.why:
                return
            if answer.get("reviews"):
                asked = answer["next"]
        self.why = "no more answers"


def _walk(options: dict) -> Walk:
    quota = options.get("quota")
    return Walk(instant(options["start"]), instant(options["end"]), int(quota) if quota else None, options.get("strict", "false") == "true", int(options.get("retries", 2)))


def _times(rows: list[dict]) -> pa.Array:
    return pa.array([r["at"] * 1_000_000 for r in rows], pa.int64()).cast(pa.timestamp("us", "UTC"))


def _columns(rows: list[dict]) -> list[pa.Array]:
    return [pa.array([r["id"] for r in rows], pa.string()), _times(rows), pa.array([r.get("language") for r in rows], pa.string()), pa.array([r.get("up") for r in rows], pa.bool_())]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        _walk(options)  # options are read before any task runs

    def partitions(self) -> list[InputPartition]:
        found = apps(self.options["path"])
        if not found:
            raise ValueError(f"no pages in {self.options['path']}")
        return [App(a, files) for a, files in found.items()]

    @staticmethod
    def _batch(app_id: int, pages: list[int], rows: list[dict]) -> pa.RecordBatch:
        own = [pa.array([app_id] * len(rows), pa.int64()), pa.array(pages, pa.int64()), *_columns(rows)]
        return pa.RecordBatch.from_arrays(own, names=["app_id", "page", "review_id", "created_at", "language", "voted_up"])

    def read(self, partition: App) -> Iterator[pa.RecordBatch]:
        walk, walks = _walk(self.options), self.options.get("table") == "walks"
        kept: list[dict] = []
        pages: list[int] = []
        for rows in walk.over(answers(self.options["path"], partition.files)):
            if walks:
                continue
            kept += rows
            pages += [walk.pages - 1] * len(rows)
            if len(kept) >= ROWS:
                yield self._batch(partition.app_id, pages, kept)
                kept, pages = [], []
        if kept:
            yield self._batch(partition.app_id, pages, kept)
        if walks:
            row = {"app_id": partition.app_id, "pages": walk.pages, "collected": walk.collected, "out_of_window": walk.strangers, "reported": walk.reported, "stopped_empty": walk.why == "empty pages", "why": walk.why}
            kinds = {"stopped_empty": pa.bool_(), "why": pa.string()}
            yield pa.RecordBatch.from_pydict({k: pa.array([v], kinds.get(k, pa.int64())) for k, v in row.items()})


class _StreamReader(DataSourceStreamReader):
    """Offsets: files read of each app, in the order of their names."""

    def __init__(self, options: dict):
        self.options, self.most = options, int(options.get("files") or 0)
        self.start, self.end = instant(options["start"]), instant(options["end"])
        if self.most and not options.get("progress"):
            raise ValueError("files needs progress")

    def initialOffset(self) -> dict:
        return {}

    def _begun(self) -> dict:
        where, name = _store(self.options["progress"])
        if where.get_file_info(name).type == fs.FileType.NotFound:
            return {}
        with where.open_input_stream(name) as stream:
            return json.loads(stream.read())

    def latestOffset(self) -> dict:
        begun = self._begun() if self.most else {}
        there = {str(a): len(files) for a, files in apps(self.options["path"]).items()}
        return {a: min(n, begun.get(a, 0) + self.most) if self.most else n for a, n in there.items()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if self.most:  # the engine has logged ``end``: what it asks for next lies beyond
            where, name = _store(self.options["progress"])
            with where.open_output_stream(f"{name}.new") as stream:
                stream.write(json.dumps(end).encode())
            where.move(f"{name}.new", name)
        found = apps(self.options["path"])
        new = ((a, files[start.get(str(a), 0) : end.get(str(a), 0)]) for a, files in found.items())
        return [App(a, files) for a, files in new if files]

    def read(self, partition: App) -> Iterator[pa.RecordBatch]:
        for answer in answers(self.options["path"], partition.files):
            rows = answer.get("reviews") or []
            if rows:
                place = ["above" if r["at"] > self.end else "below" if r["at"] < self.start else "in" for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array([partition.app_id] * len(rows), pa.int64()), *_columns(rows), pa.array(place)], names=["app_id", "review_id", "created_at", "language", "voted_up", "place"])

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class ReviewPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "review_pages"

    def schema(self) -> str:
        return WALKS if self.options.get("table") == "walks" else REVIEWS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(dict(self.options))


class NewPages(ReviewPages):
    """The stream's own shape: every review with where it lies."""

    @classmethod
    def name(cls) -> str:
        return "new_review_pages"

    def schema(self) -> str:
        return PLACED
