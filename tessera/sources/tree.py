"""Reading a source tree without ever following a link out of it.

What may be opened is decided by handles to the folders above: a folder is reached from the root by its names, each opened
without following links, and must be the very folder that was listed before. A plan lists folders only, and cuts them into
parts of a bounded number of entries; each part's entries are inspected, read and judged where Spark runs it (``TreeSource``), which
reports a row per entry. So contents never pass through the driver, and the root must be a folder that executors see as well.
``Tree`` is the same walk in one process. Spark's own file reader isn't used: it hides names that begin with a dot or an
underscore and follows links.
"""

from __future__ import annotations

import hashlib
import os
import stat
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.model import FILE, SCAN_POLICY, EngineError, valid_path
from tessera.operators.evaluate import LAST_BAND, SIZE_BANDS, size_band
from tessera.operators.gates import KNOWN_EXTENSIONS, MAX_FILE_BYTES, content_reason_of, name_reason_of
from tessera.session import stored

_LANGUAGES = {".js": "javascript", ".jsx": "javascript", ".py": "python", ".ts": "typescript", ".tsx": "typescript"}
_FOLDER_FLAGS = os.O_RDONLY | os.O_DIRECTORY | os.O_NOFOLLOW | os.O_CLOEXEC
_FILE_FLAGS = os.O_RDONLY | os.O_NOFOLLOW | os.O_NONBLOCK | os.O_CLOEXEC


class ScanError(EngineError):
    """Names what failed and a short digest of the path, never the path."""

    def __init__(self, step: str, path: str, digest: str = ""):
        self.step, self.digest = step, digest or hashlib.sha256(path.encode("utf-8", "surrogateescape")).hexdigest()[:8]
        super().__init__(f"{self.step} {self.digest}")


@dataclass
class ScanReport:
    """Aggregates only; no name of any file."""

    eligible_files: int = 0
    eligible_bytes: int = 0
    included_files: int = 0
    included_bytes: int = 0
    excluded: Counter = field(default_factory=Counter)
    by_language: Counter = field(default_factory=Counter)
    size_bands: Counter = field(default_factory=Counter)
    unsupported_files: Counter = field(default_factory=Counter)
    unsupported_bytes: Counter = field(default_factory=Counter)


    def add(self, reason: str | None, eligible: bool, language: str | None, band: str | None, bucket: str | None, files: int, size: int, included: int) -> None:
        """Entries that are alike: how many, their bytes as inspected, and the bytes that were read of included ones."""
        if eligible:
            self.eligible_files += files
            self.eligible_bytes += size
        if bucket:
            self.unsupported_files[bucket] += files
            self.unsupported_bytes[bucket] += size
        if reason:
            self.excluded[reason] += files
        else:
            self.included_files += files
            self.included_bytes += included
            self.by_language[language] += files
            self.size_bands[band] += files


@dataclass(frozen=True)
class SourceFile:
    path: str
    language: str
    content: bytes


@dataclass(frozen=True)
class Entry:
    """What one name in a folder is: a folder to enter, a file with its bytes, or something left out for a reason."""

    path: str
    folder: os.stat_result | None = None
    reason: str | None = None
    eligible: bool = False
    language: str | None = None
    bucket: str | None = None
    size: int = 0
    content: bytes | None = None


def extension_of(name: str) -> str:
    """From the last dot of the name on, lower-cased."""
    at = name.rfind(".")
    return name[at:].lower() if at >= 0 else ""


def unsupported_bucket_of(name: str) -> str:
    extension = extension_of(name)
    return "<none>" if not extension else extension if extension in KNOWN_EXTENSIONS else "<other>"


def band_of(size: int) -> str:
    return next((name for name, most in SIZE_BANDS if size <= most), LAST_BAND)


def line_count_of(content: bytes) -> int:
    return content.count(b"\n") + (0 if content.endswith(b"\n") else 1)


def _acceptable(path: str) -> bool:
    try:
        path.encode()
    except UnicodeEncodeError:
        return False
    return valid_path(path) and not any(unicodedata.category(c) in ("Cc", "Cf") for c in path)


def _id(info: os.stat_result) -> tuple[int, int]:
    return info.st_dev, info.st_ino


def _inspect(fd: int, name: str, path: str) -> os.stat_result:
    try:
        return os.stat(name, dir_fd=fd, follow_symlinks=False)
    except OSError:
        raise ScanError("inspect-entry", path) from None


def _open(fd: int, name: str, path: str, identity: tuple[int, int], flags: int) -> int:
    """What was inspected, or an error."""
    try:
        opened = os.open(name, flags, dir_fd=fd)
    except OSError:
        raise ScanError("open-entry", path) from None
    if _id(os.fstat(opened)) != identity:
        os.close(opened)
        raise ScanError("entry-changed", path)
    return opened


def _open_root(root: str) -> int:
    try:
        return os.open(root, _FOLDER_FLAGS)
    except OSError:
        raise ScanError("open-root", root) from None


def _names(fd: int, where: str) -> list[str]:
    """A folder's names by their bytes."""
    try:
        names = sorted(os.listdir(fd), key=os.fsencode)
    except OSError:
        raise ScanError("read-directory", where) from None
    return names


def _nested(names: list[str], where: str) -> bool:
    return bool(where) and any(n.lower() == ".git" for n in names)


def _at(where: str, name: str) -> str:
    path = f"{where}/{name}" if where else name
    if not _acceptable(path):
        raise ScanError("invalid-path", path)
    return path


def _entry(fd: int, name: str, path: str) -> Entry:
    info = _inspect(fd, name, path)
    folder = stat.S_ISDIR(info.st_mode)
    if reason := name_reason_of(name, folder):
        return Entry(path, reason=reason)
    if stat.S_ISLNK(info.st_mode):
        return Entry(path, reason="symlink")
    if folder:
        return Entry(path, folder=info)
    if extension_of(name) not in _LANGUAGES:
        return Entry(path, reason="unsupported_extension", bucket=unsupported_bucket_of(name), size=info.st_size if stat.S_ISREG(info.st_mode) else 0)
    if not stat.S_ISREG(info.st_mode):
        return Entry(path, reason="non_regular")
    if info.st_size > MAX_FILE_BYTES:
        return Entry(path, reason="too_large", eligible=True, size=info.st_size)
    with os.fdopen(_open(fd, name, path, _id(info), _FILE_FLAGS), "rb") as f:
        try:
            content = f.read(MAX_FILE_BYTES + 1)
        except OSError:
            raise ScanError("read-file", path) from None
    reason = content_reason_of(content)
    return Entry(path, None, reason, True, _LANGUAGES[extension_of(name)], None, info.st_size, None if reason else content)


class Tree:
    """An opened root. It can be walked once; ``same_as`` tells whether a path still leads to it."""

    def __init__(self, root: str):
        self._fd: int | None = _open_root(root)
        self._identity = _id(os.fstat(self._fd))
        self._walked = False
        self.report = ScanReport()

    def same_as(self, path: str) -> bool:
        try:
            info = os.stat(path, follow_symlinks=False)
        except OSError:
            return False
        return stat.S_ISDIR(info.st_mode) and _id(info) == self._identity

    def close(self) -> None:
        if self._fd is not None:
            os.close(self._fd)
            self._fd = None

    def __enter__(self) -> Tree:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def walk(self) -> Iterator[SourceFile]:
        """Included files, depth first, entries by the bytes of their names; fills the report on the way."""
        if self._fd is None or self._walked:
            raise ScanError("reuse-root", "")
        self._walked = True
        yield from self._folder(self._fd, "")

    def _folder(self, fd: int, where: str) -> Iterator[SourceFile]:
        names = _names(fd, where)
        if _nested(names, where):
            self.report.excluded["nested_repository"] += 1
            return
        for name in names:
            e = _entry(fd, name, _at(where, name))
            if e.folder:
                child = _open(fd, name, e.path, _id(e.folder), _FOLDER_FLAGS)
                try:
                    yield from self._folder(child, e.path)
                finally:
                    os.close(child)
                continue
            n = len(e.content or b"")
            self.report.add(e.reason, e.eligible, e.language, band_of(n), e.bucket, 1, e.size, n)
            if e.content is not None:
                yield SourceFile(e.path, e.language, e.content)


# --- the same, in parts ------------------------------------------------------------------------------


#: Entries in one part, but for slices of very large folders, and bytes of contents that are handed on at a time, but for one larger file.
PART_ENTRIES, SEND_BYTES = 512, 4 << 20
#: Slices of one folder. Each lists the folder anew, so with slices of a fixed size a folder's listings would grow with the square of its names.
FOLDER_SLICES = 64
_ROW = "path string, language string, content binary, size long, reason string, eligible boolean, bucket string, error string"
_ARROW = pa.schema([("path", pa.string()), ("language", pa.string()), ("content", pa.binary()), ("size", pa.int64()), ("reason", pa.string()), ("eligible", pa.bool_()), ("bucket", pa.string()), ("error", pa.string())])


@dataclass(frozen=True)
class Slice:
    """Some entries of a folder, the names from one to before another, as the plan saw it. way: the names that lead to it, each with its identity."""

    way: tuple[tuple[str, tuple[int, int]], ...]
    listed: str
    first: int
    last: int
    folders: tuple[str, ...]


class Part(InputPartition):
    """Slices of one or more folders; or what went wrong while planning."""

    def __init__(self, slices: list[Slice], error: str = ""):
        super().__init__([*slices])
        self.slices, self.error = slices, error


def _listed(names: list[str]) -> str:
    return hashlib.sha256(b"\0".join(map(os.fsencode, names))).hexdigest()


def plan(root: str) -> tuple[tuple[int, int], list[Slice]]:
    """The root's identity, and slices of all folders that a walk enters. No file is opened."""
    slices: list[Slice] = []

    def enter(fd: int, where: str, way: tuple) -> None:
        names = _names(fd, where)
        nested, folders = _nested(names, where), {}
        for name in () if nested else names:
            path = _at(where, name)
            info = _inspect(fd, name, path)
            if stat.S_ISDIR(info.st_mode) and not name_reason_of(name, True):
                folders[name] = info
        step, listed = max(PART_ENTRIES, -(-len(names) // FOLDER_SLICES)), _listed(names)
        for at in range(0, len(names), step):
            part = names[at : at + step]
            slices.append(Slice(way, listed, at, at + len(part), tuple(n for n in part if n in folders)))
        for name, info in folders.items():
            child = _open(fd, name, f"{where}/{name}" if where else name, _id(info), _FOLDER_FLAGS)
            try:
                enter(child, f"{where}/{name}" if where else name, (*way, (name, _id(info))))
            finally:
                os.close(child)

    fd = _open_root(root)
    try:
        enter(fd, "", ())
        return _id(os.fstat(fd)), slices
    finally:
        os.close(fd)


def parts(slices: list[Slice], entries: int = PART_ENTRIES) -> list[Part]:
    out: list[list[Slice]] = []
    size = entries
    for s in slices:
        if size + s.last - s.first > entries and size:
            out.append([])
            size = 0
        out[-1].append(s)
        size += s.last - s.first
    return [Part(x) for x in out]


def read_slice(fd: int, s: Slice) -> Iterator[Entry]:
    """The slice's entries, if the folder is still the one that was planned, with the same names and the same folders in it."""
    opened, where = [], ""
    try:
        for name, identity in s.way:
            where = f"{where}/{name}" if where else name
            fd = _open(fd, name, where, identity, _FOLDER_FLAGS)
            opened.append(fd)
        names = _names(fd, where)
        if _listed(names) != s.listed:
            raise ScanError("entry-changed", where)
        if _nested(names, where):
            if not s.first:
                yield Entry(where, reason="nested_repository")
            return
        folders = []
        for name in names[s.first : s.last]:
            e = _entry(fd, name, _at(where, name))
            if e.folder:
                folders.append(name)
            else:
                yield e
        if tuple(folders) != s.folders:
            raise ScanError("entry-changed", where)
    finally:
        for x in opened:
            os.close(x)


class TreeSource(DataSource):
    """``spark.read.format("tessera_tree").option("root", ..)``: a row per entry of a tree, but for folders that are entered."""

    @classmethod
    def name(cls) -> str:
        return "tessera_tree"

    def schema(self) -> str:
        return _ROW

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options["root"])


class TreeReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[InputPartition]:
        try:
            self.identity, slices = plan(self.root)
        except ScanError as e:
            return [Part([], str(e))]
        return parts(slices) or [Part([])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        """Failures are rows, so that a task doesn't run again for what another attempt can't mend."""
        if partition.error:
            yield self._batch([Entry("")], partition.error)
            return
        held, size = [], 0
        try:
            fd = _open_root(self.root)
            try:
                for s in partition.slices:
                    for e in read_slice(fd, s):
                        held.append(e)
                        size += len(e.content or b"")
                        if size >= SEND_BYTES or len(held) >= PART_ENTRIES:
                            yield self._batch(held)
                            held, size = [], 0
            finally:
                os.close(fd)
        except ScanError as e:
            yield self._batch([Entry("")], str(e))
            return
        yield self._batch(held)

    @staticmethod
    def _batch(entries: list[Entry], error: str | None = None) -> pa.RecordBatch:
        columns = zip(*((e.path, e.language, e.content, e.size, e.reason, e.eligible, e.bucket, error) for e in entries)) if entries else [[] for _ in _ARROW]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


def scan(spark: SparkSession, root: str) -> tuple[DataFrame, ScanReport, str]:
    """(path, language, content) of the included files, the report, and the policy's version. Contents are stored as they are read."""
    spark.dataSource.register(TreeSource)
    rows = stored(spark.read.format(TreeSource.name()).option("root", root).load(), "tree")
    failed = rows.where("error IS NOT NULL").agg(F.min("error")).first()[0]
    if failed:
        raise ScanError(failed.partition(" ")[0], "", failed.partition(" ")[2])
    report, length = ScanReport(), F.octet_length("content")
    alike = rows.groupBy("reason", "eligible", "language", F.when(length.isNotNull(), size_band(length)).alias("band"), "bucket").agg(F.count("*").alias("files"), F.sum("size").alias("size"), F.coalesce(F.sum(length.cast("long")), F.lit(0)).alias("included"))
    for r in alike.collect():
        report.add(*r)
    return rows.where("reason IS NULL").select([x.split()[0] for x in FILE.split(", ")]), report, SCAN_POLICY
