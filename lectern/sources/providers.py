"""Data sources that read only what a query asks for: chapters as providers answered, and members of EPUB archives."""

from __future__ import annotations

import json
import posixpath
import zipfile
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lectern.session import ship
from lectern.sources.epub import UNREADABLE, spine
from lectern.sources.passages import CHAPTER, flat_verse, marked_parts, one_line

#: Providers whose answers can be read: JSON with verses, JSON with marked text, JSON with passages of marked text.
PROVIDERS = ("free-use", "api-bible", "esv")
#: Archives that are read whole by one task, up to so many bytes together; members of a larger one in a task.
TOGETHER, RUN = 32 << 20, 64
#: Tasks that runs of members are dealt to at most; beyond, a task reads several runs, one after the other.
TASKS = 1024


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    uri = path if "://" in path else "file://" + posixpath.abspath(path.removeprefix("file:"))
    return fs.FileSystem.from_uri(uri)


def files_below(where: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
    """Files at any depth, of visible names, in order."""
    found = where.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True))
    seen = lambda p: not any(x[0] in "._" for x in posixpath.relpath(p, folder).split("/"))
    return sorted((f for f in found if f.type == fs.FileType.File and seen(f.path)), key=lambda f: f.path)


def write_answers(answers: DataFrame, path: str) -> None:
    """Store answers(provider_id, book, chapter, answer), a folder for each edition of a provider and book."""
    answers.write.mode("overwrite").partitionBy("provider_id", "book").json(path)


class Books(InputPartition):
    """One book of one edition."""

    def __init__(self, edition: str, provider: str, book: str, folder: str):
        self.edition, self.provider, self.book, self.folder = edition, provider, book, folder


class StoredChapters(DataSource):
    """Stored answers of an edition's provider. Options: path; registry, JSON of a list of edition, provider, provider_id; and
    editions, books and chapters, JSON of lists of what is asked for, without which all are.

    An edition that the registry doesn't have, or of a provider that isn't known, has no chapters. What is asked for is said
    by options, as a filter that is pushed to one scan of a table reaches its other scans in the same query (Spark 4.1.2).
    """

    @classmethod
    def name(cls) -> str:
        return "stored_chapters"

    def schema(self) -> str:
        return "edition string, provider string, book string, chapter int, answer string"

    def reader(self, schema) -> DataSourceReader:
        wanted = {c: set(json.loads(self.options[f"{c}s"])) for c in ("edition", "book", "chapter") if f"{c}s" in self.options}
        return ChapterReader(self.options["path"], json.loads(self.options.get("registry", "[]")), wanted)


class ChapterReader(DataSourceReader):
    """A partition for each book of each edition that is asked for; chapters are told apart as they are read."""

    def __init__(self, path: str, registry: list[dict], wanted: dict[str, set] | None = None):
        self.path, self.registry, self.wanted = path, registry, wanted or {}

    def asked(self, column: str, value) -> bool:
        return column not in self.wanted or value in self.wanted[column]

    def partitions(self) -> list[Books]:
        where, root = opened(self.path)
        found = []
        for entry in self.registry:
            if entry["provider"] not in PROVIDERS or not self.asked("edition", entry["edition"]):
                continue
            folder = f"{root}/provider_id={entry['provider_id']}"
            for info in where.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                book = info.base_name.partition("book=")[2]
                if book and self.asked("book", book):
                    found.append(Books(entry["edition"], entry["provider"], book, info.path))
        return found

    def read(self, partition: Books | None) -> Iterator[tuple]:
        if partition is None:
            return
        where, _ = opened(self.path)
        for info in files_below(where, partition.folder):
            with where.open_input_stream(info.path) as lines:
                for line in lines.read().decode().splitlines():
                    row = json.loads(line)
                    if self.asked("chapter", row["chapter"]):
                        yield partition.edition, partition.provider, partition.book, row["chapter"], row.get("answer")


class Member(NamedTuple):
    """A member of an archive, and where its directory says that it is."""

    name: str
    at: int
    size: int
    method: int
    crc: int
    locked: bool


def member_bytes(file: BinaryIO, member: Member) -> bytes:
    """A member's content, read where it is: the archive's directory, which is as long as the archive has members, isn't."""
    if member.locked or member.method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        with zipfile.ZipFile(file) as archive:
            return archive.read(member.name)
    file.seek(member.at)
    head = file.read(30)
    if head[:4] != b"PK\x03\x04":
        raise zipfile.BadZipFile(f"{member.name} isn't where its directory says")
    file.seek(member.at + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little"))
    data = file.read(member.size)
    data = zlib.decompress(data, -zlib.MAX_WBITS) if member.method == zipfile.ZIP_DEFLATED else data
    if zlib.crc32(data) != member.crc:
        raise zipfile.BadZipFile(f"{member.name} is damaged")
    return data


class Members(InputPartition):
    """Archives that are read whole, or a run of one's chapters: (path, first position, members or None)."""

    def __init__(self, runs: list[tuple[str, int, list[Member] | None]]):
        self.runs = runs


class EpubChapters(DataSource):
    """The chapters of every EPUB under the folder of option path: what epub.read_epub gives, without whole archives as rows.

    Small archives are read several to a task. Of a large one only the directory at its end and its package file are
    read to plan, and then each run of chapters where it is, by a task of its own (TASKS at most). Broken and locked archives have no chapters.
    """

    @classmethod
    def name(cls) -> str:
        return "epub_chapters"

    def schema(self) -> str:
        return "path string, position int, name string, html string"

    def reader(self, schema) -> DataSourceReader:
        return EpubReader(self.options["path"], int(self.options.get("together", TOGETHER)), int(self.options.get("run", RUN)))


class EpubReader(DataSourceReader):
    def __init__(self, path: str, together: int, run: int):
        self.path, self.together, self.run = path, together, run

    def partitions(self) -> list[Members]:
        where, root = opened(self.path)
        found, runs, small, size = [], [], [], 0
        for info in files_below(where, root):
            if not info.path.lower().endswith(".epub"):
                continue
            if info.size > self.together:
                members = self.chapters(where, info.path)
                runs += [(info.path, i, members[i : i + self.run]) for i in range(0, len(members), self.run)]
                continue
            if size + info.size > self.together and small:
                found, small, size = [*found, Members(small)], [], 0
            small.append((info.path, 0, None))
            size += info.size
        each = -(-len(runs) // TASKS)
        found += [Members(runs[i : i + each]) for i in range(0, len(runs), each or 1)]
        return found + ([Members(small)] if small else [])

    @staticmethod
    def chapters(where: fs.FileSystem, path: str) -> list[Member]:
        try:
            with where.open_input_file(path) as file, zipfile.ZipFile(file) as archive:
                found = map(archive.getinfo, spine(archive))
                return [Member(i.filename, i.header_offset, i.compress_size, i.compress_type, i.CRC, bool(i.flag_bits & 1)) for i in found]
        except UNREADABLE:
            return []

    def read(self, partition: Members | None) -> Iterator[tuple]:
        where, _ = opened(self.path)
        for path, first, members in partition.runs if partition else ():
            shown = "file:" + path if isinstance(where, fs.LocalFileSystem) else f"{self.path.partition('://')[0]}://{path}"
            try:
                with where.open_input_file(path) as file:
                    if members is None:
                        with zipfile.ZipFile(file) as archive:
                            read = [(name, archive.read(name)) for name in spine(archive)]
                    else:
                        read = [(m.name, member_bytes(file, m)) for m in members]
                    rows = [(shown, first + i, name, html.decode("utf-8", "replace")) for i, (name, html) in enumerate(read)]
            except UNREADABLE:
                continue
            yield from rows


def register(spark: SparkSession) -> None:
    """Make both sources known to a session."""
    ship(spark)
    spark.dataSource.register(StoredChapters)
    spark.dataSource.register(EpubChapters)


def read_chapters(spark: SparkSession, path: str, registry: list[dict], **wanted: list) -> DataFrame:
    """The answers that are stored below path; wanted: lists of editions, books and chapters, each of which prunes."""
    register(spark)
    options = {k: json.dumps(sorted(v)) for k, v in wanted.items()}
    return spark.read.format("stored_chapters").option("path", path).option("registry", json.dumps(registry)).options(**options).load()


def chapter_verses(chapters: DataFrame) -> DataFrame:
    """(edition, book, chapter, verse, text) of rows of stored_chapters, each read as its provider answers.

    Malformed answers, and blank or unnumbered verses, are left out.
    """
    provider = F.col("provider")
    items = F.transform(F.from_json("answer", CHAPTER)["chapter"]["content"], lambda x: F.from_json(x, "struct<type:string,number:int,content:array<string>>"))
    items = F.filter(items, lambda v: (v["type"] == "verse") & v["number"].isNotNull())
    flat = F.transform(items, lambda v: F.struct(v["number"].alias("n"), flat_verse(v["content"]).alias("text")))
    passages = F.array_join(F.from_json("answer", "struct<passages:array<string>>")["passages"], "\n")
    marked = F.when(provider == PROVIDERS[1], F.get_json_object("answer", "$.data.content")).when(provider == PROVIDERS[2], passages)
    found = F.when(provider == PROVIDERS[0], flat).otherwise(marked_parts(marked, before=False))
    rows = chapters.select("edition", "book", "chapter", F.explode(found).alias("v"))
    return rows.select("edition", "book", "chapter", F.col("v.n").alias("verse"), one_line(F.col("v.text")).alias("text")).where("text <> ''")
