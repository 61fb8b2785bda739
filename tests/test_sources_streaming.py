import json
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cairn.functions import codec
from cairn.functions.ship import register, ship
from cairn.operators import etl
from cairn.sources import archive, osm_pbf, wmts
from cairn.streaming.loader import TileLoader, pending


def vi(u):
    return codec.varint(u & (2**64 - 1))


def field(k, v):
    return vi(k << 3 | 2) + vi(len(v)) + v if isinstance(v, bytes) else vi(k << 3) + vi(v)


def deltas(vs):
    return b"".join(vi(codec.zig(b - a)) for a, b in zip([0, *vs], vs, strict=False))


def pbf(path, ways, dense, plain=(), packed=True):
    strings = [b""] + sorted({s.encode() for w in ways for kv in w[1].items() for s in kv})
    at = lambda s: strings.index(s.encode())
    body = b"".join(field(3, field(1, i) + field(2, b"".join(vi(at(k)) for k in t)) + field(3, b"".join(vi(at(v)) for v in t.values())) + field(8, deltas(r))) for i, t, r in ways)
    q = lambda d: round(d * 1e7)
    nodes = field(2, field(1, deltas([n for n, _, _ in dense])) + field(8, deltas([q(a) for _, a, _ in dense])) + field(9, deltas([q(o) for _, _, o in dense])))
    nodes += b"".join(field(1, field(1, codec.zig(n)) + field(8, codec.zig(q(a))) + field(9, codec.zig(q(o)))) for n, a, o in plain)
    block = field(1, b"".join(field(1, s) for s in strings)) + field(2, body) + field(2, nodes)
    with open(path, "wb") as f:
        for kind, data in (("OSMHeader", b""), ("OSMData", block)):
            blob = field(2, len(data)) + field(3, zlib.compress(data)) if packed else field(1, data)
            head = field(1, kind.encode()) + field(3, len(blob))
            f.write(struct.pack(">I", len(head)) + head + blob)


def test_pbf_to_archive(spark, tmp_path):
    nodes = [(1, 45.1, 6.1), (2, 45.2, 6.2), (3, 45.3, 6.3), (4, 45.4, 6.4)]
    pbf(tmp_path / "a.pbf", [(10, {"highway": "path", "name": "Été", "sac_scale": "hiking"}, [1, 2, 3]), (11, {"highway": "motorway"}, [1, 2])], nodes[:3])
    pbf(tmp_path / "b.pbf", [(10, {"highway": "track"}, [3, 2]), (12, {"highway": "steps"}, [3, 4]), (13, {"highway": "path"}, [4, 99])], [], nodes[2:], packed=False)
    register(spark, osm_pbf.OsmPbf)
    load = lambda kind: spark.read.format("osm_pbf").option("kind", kind).load(str(tmp_path))
    assert sorted((r.node_id, round(r.lat, 7), round(r.lon, 7)) for r in load("nodes").distinct().collect()) == nodes
    ways = etl.walkable(load("ways"))
    assert sorted((r.way_id, r.kind, r.sac, r.name) for r in ways.collect()) == [(10, 1, 1, "Été"), (12, 4, 0, None), (13, 1, 0, None)]
    kept, counters = etl.archive(ways, etl.resolve(etl.refs(ways), load("nodes").dropDuplicates(["node_id"])))
    assert tuple(counters.first()) == (2, 1, 0, 5)
    out = str(tmp_path / "out")
    archive.write(kept, out)
    back = {r.way_id: r for r in archive.ways(archive.read_tiles(spark, out)).collect()}
    assert back[10].name == "Été" and back[10].shared == [None, None, 3] and back[12].shared == [3, 4]
    assert archive.status(spark, out).first().files == archive.read_index(spark, out).count() == 2


def test_cut_file(tmp_path):
    (tmp_path / "x.pbf").write_bytes(b"\0\0")
    with pytest.raises(ValueError):
        list(osm_pbf.blobs(str(tmp_path / "x.pbf")))


ALPS = {"name": "Alps", "dir": "alps", "south": 43.95, "west": 5.35, "north": 46.45, "east": 7.75}


def test_manifest(spark):
    rows = archive.regions(spark.createDataFrame([(json.dumps({"regions": [ALPS, ALPS | {"dir": "b"}]}),)], "body string")).collect()
    assert [(r.ord, r.dir, r.south) for r in rows] == [(0, "alps", 43.95), (1, "b", 43.95)]
    text = archive.manifest(spark.createDataFrame([(0, *ALPS.values())], "ord int, name string, dir string, south double, west double, north double, east double")).first().body
    assert json.loads(text) == {"regions": [ALPS]}


@pytest.mark.parametrize("body", ["nope", "<html>", '{"regions": []}', '{"areas": [1]}', json.dumps({"regions": [{"name": "x", "dir": "y"}]}), json.dumps({"regions": [ALPS | {"south": 50}]}), json.dumps({"regions": [{k: v for k, v in ALPS.items() if k != "dir"}]})])
def test_broken_manifests(spark, body):
    with pytest.raises(PySparkException):
        archive.regions(spark.createDataFrame([(body,)], "body string")).collect()


def test_map_tiles(spark, tmp_path):
    os.makedirs(tmp_path / "ortho/3/1")
    (tmp_path / "ortho/3/1/2").write_bytes(b"abc")
    register(spark, wmts.MapTiles)
    got = spark.read.format("map_tiles").option("dataset", "ortho").option("tiles", "3/1/2,3/1/2,3/9/9").load(str(tmp_path)).collect()
    assert sorted((r.x, r.content and bytes(r.content), r.error is None) for r in got) == [(1, b"abc", True), (9, None, False)]
    assert wmts.url("b", "elevation", 14, 17010, 4012).endswith("LAYER=ELEVATION.ELEVATIONGRIDCOVERAGE.HIGHRES&STYLE=normal&TILEMATRIXSET=WGS84G&TILEMATRIX=14&TILEROW=4012&TILECOL=17010&FORMAT=image/x-bil;bits=32")


def test_dem_files(spark, tmp_path):
    os.makedirs(tmp_path / "14/7")
    values = np.arange(65536, dtype="<f4")
    (tmp_path / "14/7/9.bil").write_bytes(zlib.compress(values.tobytes()))
    (r,) = archive.read_dem(spark, str(tmp_path)).collect()
    assert (r.z, r.col, r.row, r["values"][300]) == (14, 7, 9, 300.0)


def test_loader_adds_ways_once_and_puts_bad_tiles_aside(spark, tmp_path):
    ship(spark)
    inbox, store = tmp_path / "in", tmp_path / "store"
    way = lambda i: codec.ArchiveWay(i, 1, 0, None, [(45.0, 6.0), (45.1, 6.1)], [None, None])

    def drop(x, data):
        os.makedirs(inbox / f"11/{x}", exist_ok=True)
        (inbox / f"11/{x}/1.tft").write_bytes(data)

    drop(1, codec.encode_tile([way(1), way(2)]))
    drop(2, b"<html>not found</html>")
    loader = TileLoader(spark, str(inbox), str(store), budget=1)
    assert loader.ways().count() == 0
    loader.start().awaitTermination()
    drop(3, codec.encode_tile([way(2), way(3)]))
    loader.start().awaitTermination()
    assert sorted(r.way_id for r in loader.ways().collect()) == [1, 2, 3]
    settled = {r.x: r.error for r in loader.settled().collect()}
    assert set(settled) == {1, 2, 3} and settled[1] is None and "BadMagic" in settled[2]
    cover = spark.createDataFrame([(1, 1, 1), (1, 2, 1), (2, 1, 1), (2, 8, 1)], "id long, x int, y int")
    clicks = spark.createDataFrame([(1,), (2,), (3,)], "click_id long")
    ready, waiting = pending(clicks, cover, loader.settled())
    assert [r.click_id for r in ready.collect()] == [1] and sorted(r.click_id for r in waiting.collect()) == [2, 3]


def test_missing_nodes_and_boxes(spark):
    pts = spark.createDataFrame([(1, 0, 1, 45.5, 6.5, None), (1, 1, 2, 50.0, 6.5, None), (2, 0, 3, None, None, None), (2, 1, 1, 45.5, 6.5, None), (3, 0, 5, 50.0, 6.0, None), (3, 1, 6, 51.0, 6.0, None)], "way_id long, seq int, node_id long, lat double, lon double, shared long")
    got = {r.way_id: (r.complete, r.inside) for r in etl.assemble(pts).collect()}
    assert got == {1: (True, True), 2: (False, True), 3: (True, False)}
    ids = [r.node_id for r in etl.synthetic_ids(pts.withColumn("shared", F.when(F.col("seq") == 0, F.col("node_id")))).collect()]
    assert sum(i < 0 for i in ids) == 3 and len({i for i in ids if i < 0}) == 3


def test_a_tile_is_encoded_and_decoded_in_passing(spark):
    """Ways of several batches make one tile, rows hold `most` ways of it, and a bad tile gives its error and no ways."""
    ways = spark.range(2500).selectExpr("id as way_id", "cast(id % 2 as int) as x", "7 as y", "1 as kind", "0 as sac", "if(id % 3 = 0, null, concat('é', id)) as name", "array(named_struct('lat', 45D, 'lon', 6D), named_struct('lat', 45D + id * 1e-6, 'lon', 6.1D)) as points", "array(null, id) as shared")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        tiles = archive.tiles(ways).select("x", "y", "content").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(tiles) == 2
    want = {r.way_id: (r.kind, r.sac, r.name, r.shared, [round(p.lat, 6) for p in r.points]) for r in ways.collect()}
    for t in tiles:
        own = [codec.ArchiveWay(i, k, s, n, [(45.0, 6.0), (lat[1], 6.1)], sh) for i, (k, s, n, sh, lat) in want.items() if i % 2 == t.x]
        assert bytes(t.content) == codec.encode_tile(own)
    bad = [(9, 9, bytearray(tiles[0].content[:-1]))]
    given = spark.createDataFrame([*map(tuple, tiles), *bad], "x int, y int, content binary")
    rows = archive.decoded(given, most=400).collect()
    assert sorted((r.x, len(r.ways or []), r.error is None) for r in rows) == [*[(x, n, True) for x in (0, 1) for n in (50, 400, 400, 400)], (9, 0, False)]
    assert {w.id: (w.kind, w.sac, w.name, w.shared, [round(p.lat, 6) for p in w.points]) for r in rows for w in r.ways or []} == want
    assert sorted((r.x, len(r.ways or [])) for r in archive.decoded(given).collect()) == [(0, 1250), (1, 1250), (9, 0)]
