"""Manifest versions: the atomic commit point of a store.

Version n is ``_manifest/<n>.json``. It is written under another name and given its own in one exclusive step, so a reader never sees half
a file and of two writers of one version exactly one succeeds; the other gets ``CommitConflict``, reads again and retries. Data that no
manifest names is invisible, and every folder of data has a name of its own, so no writer ever touches another's. Files are reached through
Hadoop's file systems. Those without an exclusive, atomic rename (plain object stores) are refused, for there a race could lose a commit.
"""

from __future__ import annotations

import json
import random
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import SparkSession

FORMAT = 2
#: Schemes whose rename is atomic and refuses a taken name; ``file`` is served by hard links, which do the same.
EXCLUSIVE = {"file", "hdfs", "viewfs", "webhdfs", "abfs", "abfss", "ofs", "o3fs"}
RETRIES = 200


class CommitConflict(RuntimeError):
    """Another writer has committed this version."""


@dataclass(frozen=True)
class Chunk:
    """A sorted chunk: its data folder, size, rows and the highest sequence in it; its rows carry their own sequences."""

    chunk_id: int
    path: str
    stats_path: str
    size: int
    rows: int
    commit_seq: int


@dataclass(frozen=True)
class Segment:
    """A batch in the log, not sorted yet; all of its rows have the sequence of its commit."""

    name: str
    path: str
    rows: int
    commit_seq: int


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    last_commit_seq: int = 0
    flushed_seq: int = 0
    chunks: tuple[Chunk, ...] = ()
    segments: tuple[Segment, ...] = ()
    streams: dict[str, dict] = field(default_factory=dict)
    format_version: int = FORMAT

    def next(self, **changes) -> Manifest:
        return replace(self, version=self.version + 1, **changes)


class Files:
    """The few file operations that a store needs."""

    def __init__(self, spark: SparkSession, base: str):
        self._jvm = spark._jvm
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(base).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, path: str) -> list[str]:
        p = self._path(path)
        return [s.getPath().getName() for s in self._fs.listStatus(p)] if self._fs.exists(p) else []

    def size(self, path: str) -> int:
        return self._fs.getContentSummary(self._path(path)).getLength()

    def age(self, path: str) -> float:
        """Seconds since a file or folder was last changed."""
        return time.time() - self._fs.getFileStatus(self._path(path)).getModificationTime() / 1000

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, path: str, text: str) -> None:
        """Creates a file whole and exclusively; a taken name is a conflict."""
        scheme = self._fs.getUri().getScheme()
        if scheme not in EXCLUSIVE:
            raise ValueError(f"{scheme}: has no exclusive rename, so concurrent commits could be lost")
        final, draft = self._path(path), self._path(f"{path}.draft-{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        try:
            if scheme == "file":
                self._link(draft, final)
            elif self._fs.exists(final) or not self._fs.rename(draft, final):
                raise CommitConflict(path)
        finally:
            self._fs.delete(draft, False)

    def _link(self, draft, final) -> None:
        """Names a local file a second time, which fails in one step if the name is taken."""
        from py4j.protocol import Py4JJavaError

        local = lambda p: self._jvm.java.io.File(p.toUri().getPath()).toPath()
        try:
            self._jvm.java.nio.file.Files.createLink(local(final), local(draft))
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
                raise CommitConflict(str(final)) from None
            raise


class ManifestLog:
    def __init__(self, spark: SparkSession, base: str):
        self.dir = f"{base}/_manifest"
        self.files = Files(spark, base)

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.files.names(self.dir) if n.endswith(".json") and n[:-5].isdigit())

    def load(self, version: int | None = None) -> Manifest:
        """The last version, or a given one; a store without any is empty. An unknown format is an error."""
        found = self.versions()
        if not found and version is None:
            return Manifest()
        raw = json.loads(self.files.read(f"{self.dir}/{version or found[-1]}.json"))
        if raw.get("format_version") != FORMAT:
            raise ValueError(f"manifest format {raw.get('format_version')}, expected {FORMAT}")
        return Manifest(**raw | {"chunks": tuple(Chunk(**c) for c in raw["chunks"]), "segments": tuple(Segment(**s) for s in raw["segments"])})

    def commit(self, manifest: Manifest) -> Manifest:
        self.files.create(f"{self.dir}/{manifest.version}.json", json.dumps(asdict(manifest)))
        return manifest

    def update(self, change: Callable[[Manifest], Manifest | None]) -> Manifest | None:
        """Commits what ``change`` makes of the last version; after a conflict it is asked again. None commits nothing."""
        for attempt in range(RETRIES):
            wanted = change(self.load())
            if wanted is None:
                return None
            try:
                return self.commit(wanted)
            except CommitConflict:
                time.sleep(random.random() * min(0.5, 0.01 * 2**attempt))
        raise CommitConflict(f"no commit in {RETRIES} attempts")
