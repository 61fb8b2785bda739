"""A data source for OSM PBF extracts: spark.read.format("osm_pbf").option("kind", "ways" or "nodes").load(path).

Each blob of a file is a partition. The files are read with open(), so they must be on a file system that the executors mount.
"""

from __future__ import annotations

import glob
import os
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMAS = {"ways": "way_id bigint, ord bigint, tags map<string,string>, refs array<bigint>", "nodes": "node_id bigint, lat double, lon double"}


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message: numbers as unsigned integers, the rest as bytes."""
    at, size = 0, len(data)

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < size:
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        elif kind == 2:
            n = number()
            yield tag >> 3, data[at : at + n]
            at += n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            yield tag >> 3, data[at : at + n]
            at += n
        else:
            raise ValueError(f"wire type {kind}")


def numbers(data: bytes) -> list[int]:
    """A packed list of varints."""
    out, value, shift = [], 0, 0
    for byte in data:
        value |= (byte & 127) << shift
        if byte < 128:
            out.append(value)
            value = shift = 0
        else:
            shift += 7
    return out


def signed(u: int) -> int:
    return u >> 1 if u % 2 == 0 else -(u >> 1) - 1


def two_complement(u: int) -> int:
    return u - (1 << 64) if u >> 63 else u


def running(us: list[int]) -> list[int]:
    """Zigzag differences to values."""
    out, last = [], 0
    for u in us:
        last += signed(u)
        out.append(last)
    return out


def blobs(path: str) -> Iterator[tuple[str, int, int]]:
    """(type, offset, size) of each blob of a file, from its headers alone."""
    with open(path, "rb") as f:
        while head := f.read(4):
            if len(head) < 4:
                raise ValueError(f"{path} is cut off")
            header = dict(fields(f.read(struct.unpack(">I", head)[0])))
            yield header[1].decode(), f.tell(), header[3]
            f.seek(header[3], os.SEEK_CUR)


def unpack(blob: bytes) -> bytes:
    parts = dict(fields(blob))
    if 1 in parts:
        return parts[1]
    if 3 in parts:
        return zlib.decompress(parts[3])
    raise ValueError("a blob is neither raw nor zlib-packed")


class Block:
    """A primitive block: its strings, its grid and its groups."""

    def __init__(self, data: bytes):
        self.strings: list[str] = []
        self.groups: list[bytes] = []
        self.grid, self.lat0, self.lon0 = 100, 0, 0
        for k, v in fields(data):
            if k == 1:
                self.strings = [s.decode("utf-8", "replace") for _, s in fields(v)]
            elif k == 2:
                self.groups.append(v)
            elif k == 17:
                self.grid = v
            elif k == 19:
                self.lat0 = two_complement(v)
            elif k == 20:
                self.lon0 = two_complement(v)

    def degrees(self, lat: int, lon: int) -> tuple[float, float]:
        return 1e-9 * (self.lat0 + self.grid * lat), 1e-9 * (self.lon0 + self.grid * lon)

    def ways(self) -> Iterator[tuple[int, dict[str, str], list[int]]]:
        for group in self.groups:
            for k, way in fields(group):
                if k != 3:
                    continue
                id_, keys, values, refs = 0, [], [], []
                for j, v in fields(way):
                    if j == 1:
                        id_ = two_complement(v)
                    elif j == 2:
                        keys += numbers(v) if isinstance(v, bytes) else [v]
                    elif j == 3:
                        values += numbers(v) if isinstance(v, bytes) else [v]
                    elif j == 8:
                        refs += numbers(v) if isinstance(v, bytes) else [v]
                yield id_, {self.strings[a]: self.strings[b] for a, b in zip(keys, values, strict=True)}, running(refs)

    def nodes(self) -> Iterator[tuple[int, float, float]]:
        """Plain and dense nodes."""
        for group in self.groups:
            for k, part in fields(group):
                if k == 1:
                    node = {j: v for j, v in fields(part) if j in (1, 8, 9)}
                    yield signed(node[1]), *self.degrees(signed(node[8]), signed(node[9]))
                elif k == 2:
                    dense = {j: running(numbers(v)) for j, v in fields(part) if j in (1, 8, 9)}
                    for id_, lat, lon in zip(dense[1], dense[8], dense[9], strict=True):
                        yield id_, *self.degrees(lat, lon)


class BlobPartition(InputPartition):
    def __init__(self, file: int, path: str, at: int, size: int):
        self.file, self.path, self.at, self.size = file, path, at, size


class PbfReader(DataSourceReader):
    def __init__(self, paths: list[str], kind: str):
        self.paths, self.kind = paths, kind

    def partitions(self):
        return [BlobPartition(i, p, at, size) for i, p in enumerate(self.paths) for kind, at, size in blobs(p) if kind == "OSMData"]

    def read(self, partition):
        with open(partition.path, "rb") as f:
            f.seek(partition.at)
            block = Block(unpack(f.read(partition.size)))
        if self.kind == "nodes":
            yield from block.nodes()
        else:
            for i, (id_, tags, refs) in enumerate(block.ways()):
                yield id_, (partition.file << 52) + (partition.at << 16) + i, tags, refs


class OsmPbf(DataSource):
    """Options: kind (ways or nodes), path (one file, a folder of *.pbf, or several separated by commas).

    ord of a way rises with file, then place in it, so the first of a way given twice is the one with the least ord.
    """

    @classmethod
    def name(cls) -> str:
        return "osm_pbf"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("kind", "ways")]

    def reader(self, schema):
        paths = []
        for p in self.options["path"].split(","):
            p = p.removeprefix("file://")
            paths += sorted(glob.glob(f"{p}/*.pbf")) if os.path.isdir(p) else [p]
        return PbfReader(paths, self.options.get("kind", "ways"))
