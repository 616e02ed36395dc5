"""A data source of tar archives that hold texts and sounds: each text is paired with the sound of its stem.

    spark.dataSource.register(ArchiveSource)
    spark.read.format("paired_tar").load("/data/*.tar.gz")

A plain archive larger than ``partition_bytes`` is indexed by its headers, reading no members, and cut into ranges of its
entries, each a partition that reads its own members only. Smaller and compressed archives, which cannot be cut, are a
partition each, read once from start to end. Members are streamed, one entry is held at a time.
"""

from __future__ import annotations

import json
import sys
import tarfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PARTITION_BYTES = 128 * 2**20
TEXTS, SOUND = (".txt", ".json"), ".wav"
PAIRED, NO_SOUND, NO_TEXT = "paired", "no sound", "no text"


@dataclass
class Entry(InputPartition):
    """Members of an archive as (name, offset, size); a range of entries of a plain archive, or all of one read in order."""

    archive: str
    entries: list[tuple[str, tuple | None, tuple | None]] | None = None


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _listed(path: str) -> list[tuple[str, int]]:
    """(archive, bytes) of a file, a folder at any depth, or a name with ``*`` in its last part."""
    files, inside = _open(path)
    head, _, last = inside.rpartition("/")
    wild = "*" in last
    info = files.get_file_info(head if wild else inside)
    scheme = path[: len(path) - len(inside)] if path.endswith(inside) else ""
    if info.type == pafs.FileType.File:
        return [(path, info.size)]
    found = files.get_file_info(pafs.FileSelector(head if wild else inside, recursive=not wild))
    before, _, after = last.partition("*")
    named = lambda n: not wild or (n.startswith(before) and n.endswith(after))
    return sorted((scheme + f.path, f.size) for f in found if f.type == pafs.FileType.File and f.base_name.endswith((".tar", ".tar.gz", ".tgz")) and named(f.base_name))


def _kind(name: str) -> tuple[str, str] | None:
    """(stem, kind) of a member that counts: a text, a JSON text or a sound; names that begin with ``._`` do not."""
    if name.rpartition("/")[2].startswith("._"):
        return None
    return next(((name[: -len(e)], e) for e in (*TEXTS, SOUND) if name.endswith(e)), None)


def text_of(kind: str, data: bytes) -> str:
    """The text of a member; of a JSON object its ``text``, else the member as it is."""
    said = data.decode("utf-8", "replace")
    if kind == ".json":
        try:
            said = str(json.loads(said).get("text", said))
        except (ValueError, AttributeError):
            pass
    return said


def paired(members: Iterator[tuple[str, object]]) -> Iterator[tuple[str, tuple | None, tuple | None]]:
    """(stem, text, sound) from (name, anything) in the archive's order: a text waits for the next sound of its stem.

    Of several texts of a stem before its sound the last counts. Sounds without a text, and at the end texts without a
    sound, stand alone.
    """
    waiting: dict[str, tuple] = {}
    for name, what in members:
        kind = _kind(name)
        if kind is None:
            continue
        stem, end = kind
        if end != SOUND:
            waiting[stem] = (end, what)
        else:
            yield stem, waiting.pop(stem, None), (end, what)
    yield from ((stem, text, None) for stem, text in waiting.items())


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.most = int(options.get("partition_bytes", PARTITION_BYTES))

    def partitions(self) -> list[Entry]:
        out: list[Entry] = []
        for path, size in _listed(self.path):
            out += self.ranges(path) if path.endswith(".tar") and size > self.most else [Entry(path)]
        return out or [Entry("", [])]

    def ranges(self, path: str) -> list[Entry]:
        files, inside = _open(path)
        with files.open_input_file(inside) as f, tarfile.open(fileobj=f, mode="r:") as tar:
            found = list(paired((m.name, (m.offset_data, m.size)) for m in tar if m.isfile()))
        place = lambda e: min(part[1][0] for part in e[1:] if part)
        out, held = [], self.most
        for entry in sorted(found, key=place):
            if held >= self.most:
                out.append(Entry(path, []))
                held = 0
            out[-1].entries.append(entry)
            held += sum(part[1][1] for part in entry[1:] if part)
        return out

    def read(self, partition: Entry) -> Iterator[tuple]:
        if partition.entries == []:
            return
        files, inside = _open(partition.archive)
        if partition.entries is None:
            with files.open_input_stream(inside, compression=None) as f, tarfile.open(fileobj=f, mode="r|gz" if not inside.endswith(".tar") else "r|") as tar:
                yield from (self.row(partition.archive, *e) for e in paired((m.name, tar.extractfile(m).read()) for m in tar if m.isfile() and _kind(m.name)))
            return
        with files.open_input_file(inside) as f:
            loaded = lambda part: part and (part[0], f.read_at(part[1][1], part[1][0]))
            for stem, text, sound in partition.entries:
                yield self.row(partition.archive, stem, loaded(text), loaded(sound))

    def row(self, archive: str, stem: str, text: tuple | None, sound: tuple | None) -> tuple:
        status = PAIRED if text and sound else NO_SOUND if text else NO_TEXT
        return archive, stem, text and text_of(*text), sound and sound[1], status


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paired_tar"

    def schema(self) -> str:
        return "archive string, stem string, text string, sound binary, status string"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


# planners and workers of a data source need not find this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
