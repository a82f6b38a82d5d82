"""Tables of one folder that change together, in versions.

    root/data/<id>          Parquet written once, read by the versions that name it
    root/commits/<number>   a version: the data folders of each table, with marks of its writers, as JSON

A writer writes its data first and then creates the file of the next number, which fails if another
writer has taken it; so a version is there whole or not at all, a failure leaves the one before, and a
reader keeps what it has opened. Nothing is deleted but by expire. A commit file is as long as its
list of folders; append folds the folders of a table into one when they are many.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Folders of a table from which on an append writes the table anew, in one folder.
MOST_FOLDERS = 64


class Conflict(RuntimeError):
    """Another writer has made the version; what was written belongs to none and goes with expire."""


@dataclass(frozen=True)
class Version:
    """number (0 before the first commit), the data folders of each table, and marks of its writers, as
    the last batch of a stream that is in it."""

    number: int
    tables: dict[str, list[str]] = field(default_factory=dict)
    marks: dict[str, int] = field(default_factory=dict)


class Versions:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = self._path().getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _names(self, folder: str) -> list[str]:
        if not self._fs.exists(self._path(folder)):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(folder)))

    def numbers(self) -> list[int]:
        """Numbers that are taken, ascending; that of a writer that failed within its commit as well."""
        return [int(n) for n in self._names("commits") if n.isdigit()]

    def version(self, number: int) -> Version | None:
        """One version; none if it has gone or its commit file is not whole."""
        path = self._path("commits", f"{number:020d}")
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return Version(number, **json.loads(text))
        except json.JSONDecodeError:
            return None

    def current(self) -> Version:
        for number in reversed(self.numbers()):
            found = self.version(number)
            if found is not None:
                return found
        return Version(0)

    def read(self, table: str, schema: T.StructType | str, at: Version | None = None) -> DataFrame:
        """A table as a version has it, the current one by default; no rows if it has none."""
        folders = (at or self.current()).tables.get(table, [])
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/data/{f}" for f in folders))

    def write(self, rows: DataFrame) -> str:
        """Writes rows as data of no version yet; its folder is for commit."""
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.root}/data/{name}")
        return name

    def commit(self, base: Version, tables: dict[str, list[str]], marks: dict[str, int] | None = None) -> Version:
        """The version after base with the tables given, and base's marks with others set. Another
        writer's version since base is a Conflict."""
        if self.current().number != base.number:
            raise Conflict(f"version {base.number} is not the current one any more")
        number = max([*self.numbers(), 0]) + 1
        made = Version(number, tables, base.marks | (marks or {}))
        try:
            stream = self._fs.create(self._path("commits", f"{number:020d}"), False)
        except Exception as error:  # noqa: BLE001  the file system's own class for a name that is taken
            raise Conflict(f"version {number} is taken") from error
        try:
            text = json.dumps({"tables": made.tables, "marks": made.marks})
            self.spark._jvm.org.apache.commons.io.IOUtils.write(text, stream, "UTF-8")
        finally:
            stream.close()
        return made

    def change(self, replace: dict[str, DataFrame] | None = None, append: dict[str, DataFrame] | None = None, check: Callable[[dict[str, DataFrame]], None] | None = None, marks: dict[str, int] | None = None, base: Version | None = None) -> Version:
        """Replaces tables, appends to others, and commits all of it at once.

        The rows may read base, the current version by default. check gets what was written and raises to leave
        everything as it was.
        """
        base = base or self.current()
        new = {name: self.write(rows) for name, rows in (replace or {}).items()}
        more = {name: self.write(rows) for name, rows in (append or {}).items()}
        schemas = {name: rows.schema for name, rows in [*(replace or {}).items(), *(append or {}).items()]}
        if check is not None:
            check({name: self.spark.read.schema(schemas[name]).parquet(f"{self.root}/data/{f}") for name, f in [*new.items(), *more.items()]})
        tables = dict(base.tables) | {name: [f] for name, f in new.items()}
        for name, f in more.items():
            folders = [*tables.get(name, []), f]
            if len(folders) > MOST_FOLDERS:
                folders = [self.write(self.read(name, schemas[name], Version(0, {name: folders})))]
            tables[name] = folders
        return self.commit(base, tables, marks)

    def expire(self, keep: int = 1) -> None:
        """Deletes all versions but the last ones, and data that none of these names. Not for times at
        which someone writes, or reads an older version."""
        numbers = self.numbers()
        whole = [v for v in map(self.version, numbers) if v is not None]
        kept = whole[-keep:]
        named = {f for v in kept for folders in v.tables.values() for f in folders}
        for number in set(numbers) - {v.number for v in kept}:
            self._fs.delete(self._path("commits", f"{number:020d}"), False)
        for name in self._names("data"):
            if name not in named:
                self._fs.delete(self._path("data", name), True)
