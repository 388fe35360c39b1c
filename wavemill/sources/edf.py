"""European Data Format as a Spark data source: ``spark.read.format("edf")``.

Options: ``path`` (one file, a folder, or a glob; a local path or an address that
``pyarrow.fs`` opens, such as ``hdfs://`` or ``s3://``), ``mode`` (``signal`` or ``header``), ``channels``
(comma-separated names wanted, in order), ``aliases`` (``name=other,...``), ``chunk_s``, ``split_mb``, ``unusable``
(``error``, or ``skip`` for files without a readable header or a wanted channel). The driver
only lists files; a task is one file, or about ``split_mb`` of it, and reads the header and the bytes of its own chunks.
"""

from __future__ import annotations

import glob
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.cohort import names_of

HEADER = "file string, case string, n_samples long, duration_s double, sfreq double, ch_names array<string>, error string"
SIGNAL = "case string, file string, channel string, chunk_idx int, start_sample long, samples array<float>"


@dataclass
class Header:
    """What the fixed and the per-signal part of a header say."""

    names: list[str]
    records: int
    record_s: float
    samples: list[int]
    low: np.ndarray
    gain: np.ndarray
    digital_low: np.ndarray
    size: int

    @property
    def sfreq(self) -> float:
        return max(self.samples, default=0) / self.record_s if self.record_s else 0.0


def read_header(f: BinaryIO) -> Header:
    fixed = f.read(256)
    n = int(fixed[252:256])
    rest = f.read(256 * n)
    at = 0

    def column(width: int) -> list[str]:
        nonlocal at
        out = [rest[at + i * width : at + (i + 1) * width].decode("latin-1").strip() for i in range(n)]
        at += width * n
        return out

    names = column(16)
    column(80)
    units = column(8)
    low, high = np.array(column(8), float), np.array(column(8), float)
    digital_low, digital_high = np.array(column(8), float), np.array(column(8), float)
    column(80)
    samples = [int(x) for x in column(8)]
    scale = np.array([{"v": 1e6, "mv": 1e3}.get(u.lower(), 1.0) for u in units])  # to microvolts
    span = np.where(digital_high == digital_low, 1, digital_high - digital_low)
    return Header(names, int(fixed[236:244]), float(fixed[244:252]), samples, low * scale, (high - low) / span * scale, digital_low, 256 * (n + 1))


def resolve(names: list[str], wanted: list[str], aliases: dict[str, list[str]]) -> list[int]:
    """Where each wanted channel is, by the names it may have."""
    out = []
    for c in wanted:
        found = next((names.index(t) for t in names_of(c, aliases) if t in names), None)
        if found is None:
            raise ValueError(f"Missing channel: {c}")
        out.append(found)
    return out


def read_stretch(f: BinaryIO, h: Header, which: list[int], first: int, last: int) -> list[np.ndarray]:
    """Samples of some channels in data records first to last (not included), in microvolts."""
    per = sum(h.samples)
    f.seek(h.size + 2 * per * first)
    bytes_read = f.read(2 * per * (last - first))
    raw = np.frombuffer(bytes_read[: len(bytes_read) // 2 * 2], "<i2")
    raw = raw[: len(raw) // per * per].reshape(-1, per)
    starts = np.concatenate([[0], np.cumsum(h.samples)])
    return [((raw[:, starts[c] : starts[c + 1]].reshape(-1).astype(float) - h.digital_low[c]) * h.gain[c] + h.low[c]).astype(np.float32) for c in which]


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; of a glob the part before its first wildcard."""
    whole = re.sub("^s3[an]:", "s3:", path) if re.match("[a-z0-9]+:/", path) else os.path.abspath(path)
    return fs.FileSystem.from_uri(re.split(r"(?<=/)[^/]*[*?\[]", whole, maxsplit=1)[0])


def files_of(path: str) -> list[tuple[str, int]]:
    """Path and size of the files that a path, a folder or a glob names, in order."""
    store, base = store_of(path)
    listed = lambda top: [i for i in store.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True)) if i.type == fs.FileType.File]
    wild = re.search(r"[^/]*[*?\[].*", path)  # from the first wildcard's part of the path on
    if wild:
        fits = re.compile(glob.translate(f"{base.rstrip('/')}/{wild[0]}", recursive=True, include_hidden=True))
        found = [i for i in listed(base) if fits.match(i.path)]
    else:
        found = [i for i in store.get_file_info([base]) if i.type == fs.FileType.File] or [i for i in listed(base) if i.path.endswith(".edf")]
    return sorted((i.path, i.size) for i in found)


@dataclass
class Part(InputPartition):
    """A file, and which of how many equal shares of its chunks."""

    path: str
    share: int
    shares: int


class EdfReader(DataSourceReader):
    def __init__(self, options: dict, header_only: bool):
        self.path = options["path"]
        self.header_only = header_only
        self.skip = options.get("unusable", "error") == "skip"
        self.chunk_s = float(options.get("chunk_s", 600))
        self.split = float(options.get("split_mb", 64)) * 2**20
        self.wanted = [c for c in options.get("channels", "").split(",") if c]
        self.aliases: dict[str, list[str]] = {}
        for channel, other in (p.split("=", 1) for p in options.get("aliases", "").split(",") if p):
            self.aliases.setdefault(channel, []).append(other)

    def partitions(self) -> list[InputPartition]:
        shares = lambda size: 1 if self.header_only else max(1, round(size / self.split))
        return [Part(path, i, shares(size)) for path, size in files_of(self.path) for i in range(shares(size))]

    def read(self, part: Part | None):
        if part is None:  # Spark asks so where there are no files
            return iter(())
        store, _ = store_of(self.path)
        return (self._header if self.header_only else self._signal)(store, part)

    def _header(self, store: fs.FileSystem, part: Part) -> Iterator[tuple]:
        file, case = os.path.basename(part.path), os.path.basename(os.path.dirname(part.path))
        try:
            with store.open_input_file(part.path) as f:
                h = read_header(f)
            n = h.records * max(h.samples, default=0)
            yield file, case, n, h.records * h.record_s, h.sfreq, h.names, None
        except (OSError, ValueError) as e:  # an unreadable file is a row with its reason
            yield file, case, None, None, None, None, type(e).__name__

    def _signal(self, store: fs.FileSystem, part: Part) -> Iterator[pa.RecordBatch]:
        """A batch per chunk: a row for each channel."""
        file, case = os.path.basename(part.path), os.path.basename(os.path.dirname(part.path))
        try:
            f = store.open_input_file(part.path)
            h = read_header(f)
            wanted = self.wanted or list(dict.fromkeys(h.names))
            which = resolve(h.names, wanted, self.aliases)
        except (OSError, ValueError):
            if self.skip:
                return
            raise
        with f:
            step = max(1, round(self.chunk_s / h.record_s)) if h.record_s else max(1, h.records)
            chunks = -(-h.records // step)
            for i in range(chunks * part.share // part.shares, chunks * (part.share + 1) // part.shares):
                data = read_stretch(f, h, which, i * step, min((i + 1) * step, h.records))
                n = len(which)
                samples = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *[len(x) for x in data]]), pa.int32()), pa.array(np.concatenate(data)))
                starts = [i * step * h.samples[c] for c in which]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([case] * n), pa.array([file] * n), pa.array(wanted), pa.array([i] * n, pa.int32()), pa.array(starts, pa.int64()), samples],
                    names=["case", "file", "channel", "chunk_idx", "start_sample", "samples"],
                )


class EdfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "edf"

    def _header_only(self) -> bool:
        return self.options.get("mode", "signal") == "header"

    def schema(self) -> str:
        return HEADER if self._header_only() else SIGNAL

    def reader(self, schema) -> DataSourceReader:
        return EdfReader(dict(self.options), self._header_only())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EdfSource)


def write(path: str, names: list[str], x: np.ndarray, fs: int, record_s: int = 1) -> None:
    """A minimal EDF file of equal channels in microvolts, for tests and exports of single recordings."""
    n, records = len(names), x.shape[1] // (fs * record_s)
    top = max(1.0, float(np.abs(x).max()))
    pad = lambda v, w: str(v)[:w].ljust(w).encode("latin-1")
    head = b"".join([pad(0, 8), pad("", 80), pad("", 80), pad("01.01.00", 8), pad("00.00.00", 8), pad(256 * (n + 1), 8), pad("", 44), pad(records, 8), pad(record_s, 8), pad(n, 4)])
    fields = [(names, 16), ([""] * n, 80), (["uV"] * n, 8), ([f"{-top:.2f}"] * n, 8), ([f"{top:.2f}"] * n, 8), ([-32768] * n, 8), ([32767] * n, 8), ([""] * n, 80), ([fs * record_s] * n, 8), ([""] * n, 32)]
    low, high = float(f"{-top:.2f}"), float(f"{top:.2f}")
    digital = np.clip(np.rint((x - low) / (high - low) * 65535 - 32768), -32768, 32767).astype("<i2")
    with open(path, "wb") as f:
        f.write(head + b"".join(pad(v, w) for col, w in fields for v in col))
        for r in range(records):
            f.write(digital[:, r * fs * record_s : (r + 1) * fs * record_s].tobytes())
