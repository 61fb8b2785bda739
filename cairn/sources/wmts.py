"""A data source for map tiles over HTTP, a partition a tile; a local folder can stand in for the service."""

from __future__ import annotations

import os
import urllib.request

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cairn.functions.vocab import ELEVATION_LAYER, LAYERS


def url(base: str, dataset: str, z: int, x: int, y: int) -> str:
    name, grid, kind = ELEVATION_LAYER if dataset == "elevation" else (LAYERS[dataset][0], "PM", LAYERS[dataset][1])
    return f"{base}?SERVICE=WMTS&VERSION=1.0.0&REQUEST=GetTile&LAYER={name}&STYLE=normal&TILEMATRIXSET={grid}&TILEMATRIX={z}&TILEROW={y}&TILECOL={x}&FORMAT={kind}"


def fetch(base: str, dataset: str, z: int, x: int, y: int) -> tuple[bytes | None, str | None]:
    """(content, None) or (None, error): other answers than 2xx and XML or HTML pages are errors."""
    try:
        if not base.startswith("http"):
            with open(os.path.join(base, dataset, str(z), str(x), str(y)), "rb") as f:
                return f.read(), None
        with urllib.request.urlopen(url(base, dataset, z, x, y), timeout=30) as r:
            kind = r.headers.get("Content-Type", "")
            if not 200 <= r.status < 300 or "xml" in kind or "html" in kind:
                return None, f"status {r.status}, {kind}"
            return r.read(), None
    except OSError as e:
        return None, str(e)


class TilePartition(InputPartition):
    def __init__(self, tile: tuple[int, int, int]):
        self.tile = tile


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.base, self.dataset = options["path"], options["dataset"]
        self.tiles = sorted({tuple(map(int, t.split("/"))) for t in options["tiles"].split(",") if t})

    def partitions(self):
        return [TilePartition(t) for t in self.tiles]

    def read(self, partition):
        z, x, y = partition.tile
        content, error = fetch(self.base, self.dataset, z, x, y)
        yield self.dataset, z, x, y, content, error


class MapTiles(DataSource):
    """Options: path (service address or folder dataset/z/x/y), dataset, tiles (z/x/y, separated by commas; doubles once)."""

    @classmethod
    def name(cls) -> str:
        return "map_tiles"

    def schema(self) -> str:
        return "dataset string, z int, x int, y int, content binary, error string"

    def reader(self, schema):
        return _Reader(self.options)
