"""The stages of the pipeline, each on its own input, and the whole run."""

import zlib

import duckdb
import numpy as np
from test_free import brute_components
from test_native import brute_leaks, brute_shard

import corpus_pipeline
from cairn.llm import decontam, jaccard, mixing, quality, queries, sharding

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = {
        "quality": {r.doc_id for r in quality.score(docs, labels).filter("predicted = 1").collect()},
        "near_duplicates": {r.component_id for r in jaccard.near_duplicates(docs).collect()},
        "decontamination": ids(docs) - {r.doc_id for r in decontam.leaks(docs, bench).collect()},
        "mixing": {r.doc_id for r in mixing.mix(docs, share=(4, 5), most_epochs=1).filter("copies > 0").collect()},
    }
    assert [n for n, _ in corpus_pipeline.STAGES] == [*want, "sharding"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns and ids(got) == want[name] and len(want[name]) > 100, name


def test_stages_against_brute_force(spark, tmp_path):
    """Each stage on its own input, with nulls, repeated rows, ties and clashing columns, against a plain version of its rule."""
    base = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    bench, labels = (spark.read.parquet(f"{SF}/{t}.parquet").toPandas() for t in ("benchmark", "labels"))
    leak = bench["text"].iloc[0]
    more = base.iloc[:3].assign(doc_id=[9001, 9002, 9003], text=[None, "", f"{base['text'].iloc[7]} {leak}"])
    every = __import__("pandas").concat([base, base.iloc[5:9], more], ignore_index=True)
    docs = spark.createDataFrame(every.astype(object).where(every.notna(), None).values.tolist(), spark.read.parquet(f"{SF}/documents.parquet").schema)
    docs = docs.selectExpr("*", "'x' as h", "1 as n", "2 as size", "3 as copies", "4 as a")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    stage = dict(corpus_pipeline.STAGES)
    ids = lambda name: sorted(r.doc_id for r in stage[name](spark, docs, SF).select("doc_id").collect())

    comp, _ = brute_components(rows)
    assert ids("near_duplicates") == sorted(set(comp.values()))
    bad = {d for d, _ in brute_leaks(rows, list(bench.itertuples(index=False, name=None)))}
    assert 9003 in bad and ids("decontamination") == sorted(d for d, _ in rows if d not in bad)
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "lang", "source").toPandas())
    taken = con.sql(f"WITH {queries.mix_sql('documents', share=(4, 5), most_epochs=1)} SELECT doc_id FROM mixed GROUP BY doc_id HAVING max(epochs + partial) > 0").fetchall()
    assert ids("mixing") == sorted(d for d, _ in rows if (d,) in taken)
    placed = stage["sharding"](spark, docs, SF).collect()
    assert sorted((r.doc_id, r.shard, r.grown_shard) for r in placed) == sorted((d, brute_shard(str(d), sharding.tree(8)), brute_shard(str(d), sharding.tree(9))) for d, _ in rows)

    mark = dict(labels.sort_values("quality", ascending=False)[["doc_id", "quality"]].itertuples(index=False, name=None))
    train = [(d, t) for d, t in rows if d in mark and zlib.crc32(str(d).encode()) % 5]
    y = np.array([mark[d] for d, _ in train])
    model = quality.fit(np.stack([quality.features(t) for _, t in train]), y, (y == 0).mean())
    want = {d for d, t in rows if model.score(quality.features(t)[None])[0] >= 0.3}
    got = set(ids("quality"))
    assert len(want ^ got) <= 0.03 * len(rows) and 50 < len(got) < len(rows)  # other preference pairs, the same order


def test_run(spark):
    out = corpus_pipeline.run(spark, SF).collect()
    assert 80 < len(out) < 200 and len({r.doc_id for r in out}) == len(out)
    for s in {r.shard for r in out}:
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots)))


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
