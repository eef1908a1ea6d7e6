"""Files of a folder tree as rows. Ignore files and skipped folders prune the walk: what they rule out is neither listed nor opened.

    spark.dataSource.register(FolderSource)
    spark.read.format("folder").option("content", "true").load("s3://bucket/tree")

Any store that pyarrow can open will do; executors must see it as the driver does. The driver lists folders, level by
level, until there are enough of them for the tasks; each task walks its own subtree.
"""

from __future__ import annotations

import os
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quern.functions import paths

#: Folders that a listing leaves out, and how deep it goes.
NOISE = (".git", "node_modules", ".DS_Store", "__pycache__", ".idea", ".vscode")
DEEPEST = 50
SCHEMA = "path string, size bigint, modified timestamp, folder boolean, content binary"


@dataclass(frozen=True)
class Rule:
    """A line of an ignore file, for paths below the file's folder."""

    base: str
    pattern: str
    again: bool  # takes back what an earlier line ignored
    folders: bool  # for folders only

    def fits(self, path: str, folder: bool) -> bool:
        return (folder or not self.folders) and path.startswith(self.base) and re.fullmatch(self.pattern, path[len(self.base) :]) is not None


def rules(text: str, base: str = "") -> list[Rule]:
    """The rules of an ignore file that lies in ``base`` (empty, or with a slash at the end). Comments and blank lines are none."""
    out = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        again, line = line.startswith("!"), line.removeprefix("!")
        folders, body = line.endswith("/"), line.rstrip("/")
        if not body:
            continue
        rooted = "/" in body
        body = body.removeprefix("/")
        marks = {"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}
        parts = re.findall(r"\*\*/|/\*\*$|\*\*|\*|\?|\[!?\]?[^\]]*\]|\\.|.", body)
        regex = "".join(marks.get(p) or ("[" + p[1:].replace("!", "^", 1) if p.startswith("[!") else p if p.startswith("[") and len(p) > 1 else re.escape(p[1:] if p.startswith("\\") and len(p) > 1 else p)) for p in parts)
        out.append(Rule(base, regex if rooted else f"(?:.*/)?{regex}", again, folders))
    return out


@dataclass
class Part(InputPartition):
    """A folder to read: its own files, and with ``deep`` all that is below."""

    folder: str
    deep: bool
    rules: list[Rule] = field(default_factory=list)


class FolderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"].rstrip("/")
        self.content = options.get("content", "false").lower() == "true"
        self.folders = options.get("folders", "false").lower() == "true"
        self.hidden = options.get("hidden", "false").lower() == "true"
        self.ignore = options.get("ignore", ".gitignore")
        self.skipped = set(filter(None, options.get("skip", ",".join(paths.SKIPPED_DIRS)).split(",")))
        self.first = rules(options.get("rules", ""))
        self.parts = int(options.get("partitions", "64"))
        self.deepest = int(options.get("depth", str(DEEPEST)))
        self.largest = int(options.get("largest", str(1 << 62)))

    def _store(self):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(self.root if "://" in self.root or self.root.startswith("file:") else os.path.abspath(self.root))
        return store, base.rstrip("/")

    def _list(self, store, base: str, part: Part) -> tuple[list, list[Part]]:
        """What of a folder is walked: entries with their paths below the root, and its folders with the rules that hold in them."""
        from pyarrow import fs

        entries = store.get_file_info(fs.FileSelector(f"{base}/{part.folder}".rstrip("/"), recursive=False))
        own = list(part.rules)
        if self.ignore:
            for e in entries:
                if e.base_name == self.ignore and e.type == fs.FileType.File:
                    with store.open_input_stream(e.path) as f:
                        own += rules(f.read().decode(errors="replace"), part.folder)
        files, below = [], []
        for e in sorted(entries, key=lambda e: e.base_name):
            name, path, folder = e.base_name, part.folder + e.base_name, e.type == fs.FileType.Directory
            if path.count("/") > self.deepest or (not self.hidden and len(name) > 1 and name[0] == ".") or (folder and name in self.skipped):
                continue
            ruled = [r for r in own if r.fits(path, folder)]
            if (ruled and not ruled[-1].again) or (folder and isinstance(store, fs.LocalFileSystem) and os.path.islink(e.path)):
                continue
            files.append((path, folder, e))
            if folder:
                below.append(Part(f"{path}/", True, own))
        return files, below

    def partitions(self) -> list[Part]:
        store, base = self._store()
        done, open_ = [], deque([Part("", True, self.first)])
        while open_ and len(done) + len(open_) < self.parts:
            part = open_.popleft()
            below = self._list(store, base, part)[1]
            done.append(Part(part.folder, False, part.rules))
            open_.extend(below)
        return [*done, *open_]

    def read(self, partition: Part) -> Iterator[tuple]:
        store, base = self._store()
        open_ = [partition]
        while open_:
            part = open_.pop()
            files, below = self._list(store, base, part)
            for path, folder, e in files:
                if folder and self.folders:
                    yield f"{path}/", None, e.mtime, True, None
                elif not folder:
                    body = None
                    if self.content and e.size <= self.largest:
                        with store.open_input_stream(e.path) as f:
                            body = f.read()
                    yield path, e.size, e.mtime, False, body
            if partition.deep:
                open_ += reversed(below)


class FolderSource(DataSource):
    """Options: ``content`` (false), ``folders`` (false: rows of folders too), ``hidden`` (false), ``ignore`` (name of ignore files, empty for none),
    ``rules`` (lines of one more, at the root), ``skip`` (names of folders, with commas), ``depth``, ``largest`` (bytes of content), ``partitions``."""

    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:
        return FolderReader(dict(self.options))


def read(spark: SparkSession, root: str, **options: object) -> DataFrame:
    spark.dataSource.register(FolderSource)
    return spark.read.format("folder").options(**{k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()}).load(root)


def workspace(spark: SparkSession, root: str, content: bool = False, **options: object) -> DataFrame:
    """(path, size, modified, content) of the files worth indexing; larger ones are not opened. With ``content``, only texts that are written by hand."""
    rows = read(spark, root, content=content, largest=paths.MAX_SIZE, **options).where(paths.indexable(F.col("path"), F.col("size")))
    if content:
        rows = rows.withColumn("content", F.expr("try_validate_utf8(cast(content as string))")).where(paths.written_by_hand(F.col("content")))
    return rows.select("path", "size", "modified", "content") if content else rows.select("path", "size", "modified")


def listing(spark: SparkSession, root: str, **options: object) -> DataFrame:
    """(path, size) of all files and folders, hidden ones too, but for folders of noise and what lies deeper than fifty levels; folders end with a slash and have no size."""
    return read(spark, root, folders=True, hidden=True, ignore="", skip=",".join(NOISE), **options).select("path", "size")
