"""Files of any size as Spark data sources: byte ranges, float32 matrices and digests, planned over all files of a folder in one scan.

Partitions are lists of ranges: a large file is cut into several, small ones share one, so their number follows from the bytes and not from the number of files, and
no file is ever a value.  Files are opened where they are read, by pyarrow's file systems (local and mounted paths, and what pyarrow has a client for).

``f32_matrix`` writes as well: every task writes rows to a part of its own and hashes it on the way; the commit checks that parts join without a gap, puts them in place and
writes the seal last.  A folder without a seal is no matrix; a sealed one is never written again.

Defined cases: empty files have no rows and no bytes, but a digest; hidden files (``_``, ``.``) are left out; a size that is no whole number of rows raises, and so do null, repeated
or missing row numbers, vectors of another width, and (with ``unit``) ones that are not finite or not of length 1.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

RANGE = 32 << 20  # bytes of a partition
READ = 4 << 20  # bytes held at a time
NORM = 2e-5  # tolerance of a squared length
SEAL = "_seal.json"


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), path
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(path)


def listed(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of all files below a folder, in order; hidden ones are left out."""
    files, at = store(path)
    info = files.get_file_info(at)
    if info.type == fs.FileType.File:
        return [(at, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = files.get_file_info(fs.FileSelector(at, recursive=True))
    hidden = lambda p: any(s[:1] in ("_", ".") for s in p[len(at) :].split("/"))
    return sorted((i.path, i.size) for i in found if i.type == fs.FileType.File and not hidden(i.path))


def packed(sizes: list[tuple[str, int]], width: int = 1, most: int = RANGE, whole: bool = False) -> list[list[tuple[str, int, int]]]:
    """(file, first byte, length) in groups of about ``most`` bytes; cuts are multiples of ``width``, and with ``whole`` there are none within a file."""
    groups, room = [], 0
    step = max(1, most // width) * width
    for name, size in sizes:
        cuts = [(0, size)] if whole or not size else [(a, min(step, size - a)) for a in range(0, size, step)]
        for start, n in cuts:
            if not groups or n > room:
                groups.append([])
                room = most
            groups[-1].append((name, start, n))
            room -= n + 1024  # opening a file counts too
    return groups


class Ranges(InputPartition):
    def __init__(self, ranges: list[tuple[str, int, int]]):
        super().__init__(ranges)
        self.ranges = ranges


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.width, self.range_bytes = options["path"], int(options.get("width", 1)), int(options.get("rangebytes", RANGE))

    def partitions(self) -> list[Ranges]:
        return [Ranges(g) for g in packed(listed(self.path), self.width, self.range_bytes)] or [Ranges([])]

    def pieces(self, part: Ranges, step: int) -> Iterator[tuple[str, int, bytes]]:
        """(file, offset, bytes) of a partition, ``step`` bytes at a time."""
        files, _ = store(self.path)
        for name, start, n in part.ranges:
            with files.open_input_file(name) as f:
                for at in range(start, start + n, step):
                    data = f.read_at(min(step, start + n - at), at)
                    if len(data) != min(step, start + n - at):
                        raise ValueError(f"{name} ended at byte {at + len(data)}")
                    yield name, at, data


class _ByteReader(_Reader):
    """All bytes, or those from ``start`` up to ``stop`` of one file."""

    def __init__(self, options):
        super().__init__(options)
        self.start, self.stop = int(options.get("start", 0)), int(options.get("stop", -1))

    def partitions(self) -> list[Ranges]:
        if self.stop < 0:
            return super().partitions()
        ((name, _),) = listed(self.path)
        return [Ranges([(n, a + self.start, m) for n, a, m in g]) for g in packed([(name, self.stop - self.start)], self.width, self.range_bytes)]

    def read(self, partition: Ranges):
        schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("content", pa.binary())])
        group, held = [], 0
        for piece in self.pieces(partition, self.width):
            group.append(piece)
            held += len(piece[2])
            if held >= READ:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*group, strict=True), schema, strict=True)], schema=schema)
                group, held = [], 0
        if group:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*group, strict=True), schema, strict=True)], schema=schema)


class ByteRanges(DataSource):
    """(file, offset, content): files as records of ``width`` bytes; the last one of a file may be shorter."""

    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return "file string, offset long, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _ByteReader(self.options)


class _DigestReader(_Reader):
    def partitions(self) -> list[Ranges]:
        return [Ranges(g) for g in packed(listed(self.path), most=self.range_bytes, whole=True)] or [Ranges([])]

    def read(self, partition: Ranges):
        for name, start, n in partition.ranges:
            digest = hashlib.sha256()
            for _, _, data in self.pieces(Ranges([(name, start, n)]), READ):
                digest.update(data)
            yield name, n, digest.hexdigest()


class FileDigests(DataSource):
    """(path, length, sha256) of every file; a file is read as a stream, so it may have any size."""

    @classmethod
    def name(cls) -> str:
        return "file_digests"

    def schema(self) -> str:
        return "path string, length long, sha256 string"

    def reader(self, schema) -> DataSourceReader:
        return _DigestReader(self.options)


def read_seal(path: str) -> dict | None:
    files, at = store(f"{path.rstrip('/')}/{SEAL}")
    if files.get_file_info(at).type != fs.FileType.File:
        return None
    with files.open_input_stream(at) as f:
        return json.loads(f.readall())


class _MatrixReader(_Reader):
    """Rows of matrices; those of a sealed one are numbered through all its parts, and with ``verify`` each part's hash is checked as it is read."""

    def __init__(self, options):
        super().__init__(options)
        self.dim, self.verify = int(options["dim"]), options.get("verify", "false").lower() == "true"
        self.width = 4 * self.dim
        seal = read_seal(self.path) if options.get("sealed", "false").lower() == "true" else None
        self.parts = {p["file"]: p for p in seal["parts"]} if seal else {}
        self.sealed = seal is not None

    def partitions(self) -> list[Ranges]:
        sizes = listed(self.path)
        if self.sealed and {n.rsplit("/", 1)[-1]: s for n, s in sizes} != {n: p["bytes"] for n, p in self.parts.items()}:
            raise ValueError(f"files of {self.path} do not match their seal")
        for name, size in sizes:
            if size % self.width:
                raise ValueError(f"{name} is no matrix of width {self.dim}")
        return [Ranges(g) for g in packed(sizes, self.width, self.range_bytes, whole=self.verify)] or [Ranges([])]

    def read(self, partition: Ranges):
        rows = max(1, READ // self.width)
        for name, start, n in partition.ranges:
            sealed = self.parts.get(name.rsplit("/", 1)[-1])
            first, digest = (sealed["first"] if sealed else 0), hashlib.sha256()
            for _, at, data in self.pieces(Ranges([(name, start, n)]), rows * self.width):
                if self.verify:
                    digest.update(data)
                x = np.frombuffer(data, "<f4").astype(np.float32)
                m = len(x) // self.dim
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * self.dim), pa.array(x))
                yield pa.RecordBatch.from_arrays([pa.array([name] * m, pa.string()), pa.array(np.arange(m, dtype=np.int64) + first + at // self.width), vectors], names=["file", "row_index", "embedding"])
            if self.verify and sealed and digest.hexdigest() != sealed["sha256"]:
                raise ValueError(f"{name} does not match its seal")


@dataclass
class Part(WriterCommitMessage):
    file: str
    first: int
    rows: int
    bytes: int
    sha256: str


class _MatrixWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.path, self.dim, self.unit = options["path"].rstrip("/"), int(options["dim"]), options.get("unit", "true").lower() == "true"
        self.job = f"{self.path}/_temporary/{uuid.uuid4().hex}"
        if read_seal(self.path) is not None:
            raise ValueError(f"{self.path} is sealed")

    def write(self, iterator) -> Part:
        files, job = store(self.job)
        name, out, digest, first, rows = f"{job}/{uuid.uuid4().hex}.f32", None, hashlib.sha256(), 0, 0
        try:
            for b in iterator:
                index, vectors = b.column("row_index"), b.column("embedding")
                if not len(index):
                    continue
                if index.null_count or vectors.null_count or vectors.flatten().null_count:
                    raise ValueError("null row number or vector")
                at, x = index.to_numpy(), vectors.flatten().to_numpy(zero_copy_only=False).astype("<f4")
                if out is None:
                    files.create_dir(job, recursive=True)
                    out, first = files.open_output_stream(name), int(at[0])
                if not (at == np.arange(first + rows, first + rows + len(at))).all():
                    raise ValueError(f"row numbers do not follow each other after {first + rows - 1}")
                if not (np.diff(vectors.offsets.to_numpy()) == self.dim).all():
                    raise ValueError(f"a vector is not of width {self.dim}")
                if self.unit and not (np.abs((x.reshape(-1, self.dim).astype(np.float64) ** 2).sum(1) - 1) <= NORM).all():
                    raise ValueError("a vector is not finite and of length 1")
                out.write(data := x.tobytes())
                digest.update(data)
                rows += len(at)
        finally:
            if out is not None:
                out.close()
        return Part(name, first, rows, rows * 4 * self.dim, digest.hexdigest())

    def commit(self, messages) -> None:
        files, at = store(self.path)
        parts = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.first)
        rows, entries = 0, []
        for k, p in enumerate(parts):
            if p.first != rows:
                raise ValueError(f"row {min(p.first, rows)} is {'there twice' if p.first < rows else 'missing'}")
            rows += p.rows
            entries.append({"file": f"part-{k:05d}.f32", "first": p.first, "rows": p.rows, "bytes": p.bytes, "sha256": p.sha256})
        files.create_dir(at, recursive=True)
        for p, entry in zip(parts, entries, strict=True):
            files.move(p.file, f"{at}/{entry['file']}")
        with files.open_output_stream(f"{at}/_{self.job.rsplit('/', 1)[-1]}") as f:
            f.write(json.dumps({"dim": self.dim, "rows": rows, "bytes": rows * 4 * self.dim, "parts": entries}).encode())
        files.move(f"{at}/_{self.job.rsplit('/', 1)[-1]}", f"{at}/{SEAL}")
        self._clear()

    def abort(self, messages) -> None:
        self._clear()

    def _clear(self) -> None:
        files, job = store(self.job)
        if files.get_file_info(job).type == fs.FileType.Directory:
            files.delete_dir(job)


class Matrix(DataSource):
    """(file, row_index, embedding) of row-major little-endian float32 files."""

    @classmethod
    def name(cls) -> str:
        return "f32_matrix"

    def schema(self) -> str:
        return "file string, row_index long, embedding array<float>"

    def reader(self, schema) -> DataSourceReader:
        return _MatrixReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _MatrixWriter(self.options)


def source(spark: SparkSession, kind: type[DataSource], **options):
    """A reader of one of the sources above; they are registered in the session where needed."""
    spark.dataSource.register(kind)
    reader = spark.read.format(kind.name())
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader


def write_matrix(rows: DataFrame, path: str, dim: int, unit: bool = True) -> dict:
    """Write (row_index from 0, embedding) as a sealed matrix in row order; returns its seal.  Range partitions are the parts."""
    rows.sparkSession.dataSource.register(Matrix)
    ordered = rows.select("row_index", "embedding").repartitionByRange("row_index").sortWithinPartitions("row_index")
    ordered.write.format(Matrix.name()).option("path", path).option("dim", str(dim)).option("unit", str(unit)).mode("append").save()
    return read_seal(path)
