"""URL cascade, mixing, sharding and decontamination against brute force, with nulls, ties, repeats and empty tables."""

import math
import random
import re
import zlib

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from cairn.llm import decontam, mixing, queries, sharding, urlfilter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, extra=False):
    df = spark.createDataFrame([(i, t, lang, src, len(t or "")) for i, t, lang, src in rows], DOCS)
    return df.withColumns({"size": F.lit("x"), "shard": F.lit(1), "_bin": F.lit(2), "copies": F.lit(3), "tokens": F.lit(0), "n": F.lit(0), "t": F.lit("t")}) if extra else df


# --- urls ---


def test_urls_against_sql(spark):
    rows = [(0, None), (1, "no scheme"), (2, "http://A.Example.ORG/es/1?q#x"), (3, "http://example.org/en/1"), (4, "http://example.org?x"), (5, "https://www.spam-farm.example.net/a"), (6, "x://SPAM-farm.example.net#f"), (7, "http://notspam-farm.example.net/"), (8, "http://com/de/x"), (9, "http://a.com/fr/"), (10, "http:///p"), (11, ""), (12, "http://É.example.net/Q"), (12, "http://É.example.net/Q"), (None, "http://casino-win.example.com")]
    pages = spark.createDataFrame([(*r, "h", "c") for r in rows], "page_id long, url string, host string, rule string")
    got = queries.urlfilter.judge(pages, spark.createDataFrame([(h,) for h in urlfilter.BLOCKED + (urlfilter.BLOCKED[0], None)], "key string"))
    con = duckdb.connect()
    con.register("pages", pages.select("page_id", "url").toPandas().astype({"page_id": "Int64"}))
    want = con.sql(queries.OP1_SQL).fetchall()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_cascade_is_exact_over_its_universe(spark):
    from cairn.llm.common import Held

    names = [f"h{i}" for i in range(3000)]
    universe = spark.createDataFrame([(x,) for x in names], "key string")
    listed = universe.filter("crc32(key) % 10 < 3").union(spark.createDataFrame([("never seen",)], "key string"))
    cascade = urlfilter.build_cascade(universe, listed, Held(spark, "t"))
    assert len(cascade.levels) > 2
    marked = universe.withColumn("in", cascade.listed(F.col("key"))).collect()
    assert all(r["in"] == (zlib.crc32(r.key.encode()) % 10 < 3) for r in marked)
    assert urlfilter.build_cascade(universe, listed, Held(spark, "t"), max_bits=64) is None


def test_a_filter_stands_once_in_the_plan(spark):
    pages = spark.createDataFrame([(i, f"http://a.b{i}.c.example.org/" + "p" * (i * 40_000)) for i in range(4)], "page_id long, url string")
    listed = spark.createDataFrame([("b1.c.example.org",), ("b3.c.example.org",)], "key string")
    got = urlfilter.judge(pages, listed, ())
    assert {r.page_id: r.verdict for r in got.collect()} == {0: "allow", 1: "block", 2: "allow", 3: "block"}  # long urls, too
    plan = got._jdf.queryExecution().analyzed().toString()
    assert 1 <= plan.count("forall(") <= 6  # once a level, not once a level, suffix and hash position


def test_large_lists_and_empty_ones(spark):
    pages = spark.createDataFrame([(1, "http://a.b.c/x"), (2, "http://b.c/x"), (3, "http://z/x")], "page_id long, url string")
    listed = spark.createDataFrame([("b.c",)], "key string")
    for bits in (1 << 20, 1):  # cascade; join
        assert {r.page_id: r.verdict for r in urlfilter.judge(pages, listed, (), bits).collect()} == {1: "block", 2: "block", 3: "allow"}
    assert {r.verdict for r in urlfilter.judge(pages, listed.limit(0), ()).collect()} == {"allow"}
    assert urlfilter.judge(pages.limit(0), listed).count() == 0


# --- mixing ---


def test_mix_against_sql(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), rng.choice(["en", "de", None]), rng.choice(["src0"] * 4 + ["src1", "src3", "src10", "src19", None])) for i in range(400)]
    rows += [(3, "same row", "en", "src0")] * 3 + [(900, None, "en", "src0"), (901, "", "fr", "srcX"), (902, " \t lead and trail \n", "en", "src1")]
    table = docs(spark, rows, extra=True)
    for share, epochs in (((3, 5), 4), ((4, 1), 3), ((9, 10), 1)):
        got = mixing.mix(table, share=share, most_epochs=epochs)
        con = duckdb.connect()
        con.register("documents", table.select("doc_id", "text", "lang", "source").toPandas())
        want = con.sql(f"WITH {queries.mix_sql('documents', share=share, most_epochs=epochs)} SELECT doc_id, domain, lang, source, n_tokens, epochs, partial, epochs + partial FROM mixed").fetchall()
        key = lambda r: tuple(str(x) for x in r)
        assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
        taken = sum(r.n_tokens * r.copies for r in got.collect())
        assert taken <= sum(len((t or "").split()) for _, t, _, _ in rows) * share[0] / share[1]


def test_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("d", "en", "a", 10), ("d", "en", "b", 1000), ("d", "de", "c", 1000), ("e", "en", "f", 1000)], "domain string, lang string, source string, tokens long")
    got = {r.source: r.given for r in mixing.budgets(leaves, F.lit(400).cast("long"), {}, 1).collect()}
    assert got == {"a": 10, "b": 90, "c": 100, "f": 200}  # a's shortage stays with its sibling b
    got = {r.source: r.given for r in mixing.budgets(leaves.filter("source <> 'b'"), F.lit(400).cast("long"), {}, 1).collect()}
    assert got == {"a": 10, "c": 190, "f": 200}  # en of d is short as a whole: de makes it up


def test_weights_of_zero(spark):
    """What weighs nothing is given nothing and holds nothing back: its siblings, then its parent's, take the budget."""
    leaves = spark.createDataFrame([("d", "en", "a", 1000), ("d", "en", "b", 1000), ("d", "de", "c", 1000), ("e", "en", "f", 500), ("g", "en", "h", 9)], "domain string, lang string, source string, tokens long")
    given = lambda weights, total: {r.source: r.given for r in mixing.budgets(leaves, F.lit(total).cast("long"), weights, 1).collect()}
    assert given({"d/en/a": 0, "d/en/b": 0, "g": 0}, 1400) == {"a": 0, "b": 0, "c": 900, "f": 500, "h": 0}
    assert given({"d/en": 0, "g": 0}, 1400) == {"a": 0, "b": 0, "c": 900, "f": 500, "h": 0}
    assert given({"d": 0, "e": 0, "g": 0}, 1400) == dict.fromkeys("abcfh", 0)
    rows = [(i, "w " * (i % 7), "en" if i % 3 else "de", f"src{i % 4}") for i in range(200)] + [(500, "w " * 60_000, "fr", "src9")]
    weights = {"bulk": 0, "web/en/src1": 0, "web/de": 0, "web": 3}
    got = mixing.mix(docs(spark, rows), weights=weights, most_epochs=2)
    con = duckdb.connect()
    con.register("documents", docs(spark, rows).select("doc_id", "text", "lang", "source").toPandas())
    want = con.sql(f"WITH {queries.mix_sql('documents', weights=weights, most_epochs=2)} SELECT doc_id, domain, lang, source, n_tokens, epochs, partial, epochs + partial FROM mixed").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert mixing.mix(docs(spark, [])).count() == 0


def test_take(spark):
    table = docs(spark, [(i, "a b c", "en", "src1") for i in range(50)])
    once = mixing.take(table, share=(1, 2), most_epochs=1)
    assert once.columns == table.columns and once.count() == 25
    assert mixing.take(table, share=(5, 2), most_epochs=4).count() == 125
    assert mixing.take(table.limit(0), most_epochs=1).count() == 0


# --- sharding ---


def test_shards(spark):
    rows = [(i, "t" * (i % 50), "en", "s") for i in range(4000)] + [(7, "tttttttt", "en", "s"), (None, None, None, None), (5000, "é", "fr", "s")]
    got = sharding.shard(docs(spark, rows, extra=True), sharding.tree(8), sharding.tree(9)).collect()
    assert len(got) == len(rows)
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots))) and 380 < len(slots) < 620
    assert all(r.grown_shard in (r.shard, 8) for r in got)
    moved = sum(r.grown_shard == 8 for r in got)
    assert 360 < moved < 530
    by = {r.doc_id: r for r in got}
    assert by[5000].size == 3 and by[5000].text_crc32 == zlib.crc32("é".encode()) and (by[None].size, by[None].text_crc32) == (1, 0)
    assert len({r.shard for r in got if r.doc_id == 7}) == 1
    assert sharding.shard(docs(spark, []), sharding.tree(8)).count() == 0


def brute_shard(key, tree):
    """The draws of a key, made again in Python."""

    def draw(level, children):
        scored = []
        for name, weight in children:
            h = xxhash.xxh64(f"{level}/{name}".encode(), seed=xxhash.xxh64(key.encode(), seed=42).intdigest()).intdigest()
            scored.append((-math.log(((h >> 11) + 0.5) / float(1 << 53)) / weight, name))
        return min(scored)[1]

    children = lambda of, rows: [(n, sum(s.weight for s in rows if of(s) == n)) for n in sorted({of(s) for s in rows})]
    region = draw("region", children(lambda s: s.region, tree))
    inside = [s for s in tree if s.region == region]
    rack = draw(region, children(lambda s: s.rack, inside))
    return int(draw(f"{region}/{rack}", children(lambda s: str(s.shard), [s for s in inside if s.rack == rack])))


def test_shards_against_draws_in_python(spark):
    tree = [sharding.Shard(f"r{i // 5}", f"k{i // 2}", i, 1.0 + i % 3) for i in range(11)]
    rows = [(i, f"text {i}", "en", "s") for i in range(300)] + [(None, "x", "en", "s"), (1000, "long " * 100_000, "en", "s")]
    got = sharding.shard(docs(spark, rows), tree, sharding.tree(9)).collect()
    for r in got:
        key = "" if r.doc_id is None else str(r.doc_id)
        assert (r.shard, r.grown_shard) == (brute_shard(key, tree), brute_shard(key, sharding.tree(9)))
    assert {r.doc_id: r.size for r in got}[1000] == 500_001


def test_movement_stays_in_the_subtree(spark):
    tree = [sharding.Shard(f"r{i // 4}", f"k{i // 2}", i) for i in range(8)]
    heavier = [sharding.Shard(s.region, s.rack, s.shard, 2.0 if s.shard == 5 else 1.0) for s in tree]
    rows = spark.range(8000).select(sharding.assign(F.col("id"), tree).alias("a"), sharding.assign(F.col("id"), heavier).alias("b")).filter("a <> b").collect()
    region = lambda s: s // 4
    assert rows and all(region(r.b) == 1 for r in rows)  # only into the region that got heavier
    assert all(r.b == 5 for r in rows if region(r.a) == region(r.b) and r.a // 2 == r.b // 2)
    with pytest.raises(ValueError):
        sharding.assign(F.lit(1), [sharding.Shard("r", "k", 0, 0.0)])


# --- decontamination ---


def brute_leaks(docs_, items, window=12, share=0.75, least=5):
    tok = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = set()
    for d, t in docs_:
        w = tok(t)
        for i, b in items:
            b = tok(b)
            n = min(window, len(b))
            need = max(-(-n * share // 1), min(6, len(b)))
            if d is None or i is None or len(b) < least:
                continue
            for off in range(-len(b) + 1, len(w)):
                same = [0 <= k + off < len(w) and w[k + off] == b[k] for k in range(len(b))]
                if any(sum(same[s : s + n]) >= need for s in range(len(b) - n + 1)):
                    out.add((d, i))
                    break
    return out


def test_leaks(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    items = [(i, " ".join(word() for _ in range(rng.randint(14, 40)))) for i in range(12)] + [(12, "one two three four five"), (13, "too few words"), (14, ""), (15, None), (None, "a b c d e f g h")]
    plant = []
    for k in range(60):
        i = k % 12
        words = items[i][1].split()
        for _ in range(k // 12):  # up to four substitutions
            words[rng.randrange(len(words))] = "ZZZ"
        plant.append((k, " ".join(word() for _ in range(rng.randint(0, 30))) + ".\n" + ", ".join(words).upper() + " " + " ".join(word() for _ in range(9)), "en", "s"))
    clean = [(100 + k, " ".join(word() for _ in range(200)), "en", "s") for k in range(30)] + [(200, None, "en", "s"), (201, "", "en", "s"), (202, "so one two THREE four, five", "en", "s"), (None, items[0][1], "en", "s")]
    rows = plant + clean + plant[:1]
    table = docs(spark, rows, extra=True)
    bench = spark.createDataFrame(items + items[:1], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(table, bench).collect()}
    want = brute_leaks([r[:2] for r in rows], items)
    assert got == want and {(k, k) for k in range(12)} <= got and (202, 12) in got
    kept = decontam.clean(table, bench)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} >= {r[0] for r in clean} - {202}
    assert decontam.leaks(table.limit(0), bench).count() == 0 and decontam.leaks(table, bench.limit(0)).count() == 0


def test_every_pattern_of_substitutions_is_found(spark):
    """Each way to change as many words of an item of 5 to 12 as a match allows, against comparing every offset."""
    from itertools import combinations

    items, rows = [], []
    for n in range(5, 13):
        words = [f"n{n}w{i}" for i in range(n)]
        items.append((n, " ".join(words)))
        for gone in combinations(range(n), n - max(-(-n * 3 // 4), min(6, n))):
            rows.append((len(rows), "before " + " ".join("other" if i in gone else w for i, w in enumerate(words)) + " behind", "en", "s"))
    for some in (items, items[-1:]):
        got = {(r.doc_id, r.item_id) for r in decontam.leaks(docs(spark, rows), spark.createDataFrame(some, "item_id long, text string")).collect()}
        assert got == brute_leaks([r[:2] for r in rows], some)


def test_an_item_is_found_alike_whatever_else_is_listed(spark):
    words = [f"w{i}" for i in range(12)]
    text = ["x", *words[1:4], "y", "z", *words[6:]]  # words 0, 4 and 5 replaced
    rows = [(1, "so " + " ".join(text) + " on", "en", "s"), (2, " ".join(words) + " " + "tail " * 30_000, "en", "s"), (2, "another text of this id", "en", "s")]
    item = (1, " ".join(words))
    for bench in ([item], [item, (2, "five words of another item")], [item, (3, "six more words of an item")]):
        got = decontam.leaks(docs(spark, rows), spark.createDataFrame(bench, "item_id long, text string")).collect()
        assert sorted((r.doc_id, r.item_id, r.matched, r.best, r["at"]) for r in got) == [(1, 1, 9, 9, 1), (2, 1, 12, 12, 0)], bench
    none = decontam.leaks(docs(spark, rows), spark.createDataFrame([(9, "too few"), (8, None)], "item_id long, text string"))
    assert none.count() == 0 and none.columns == ["doc_id", "item_id", "matched", "item_words", "best", "at"]


def test_masks_cover_every_match():
    from itertools import combinations

    for width in range(5, 13):
        masks = decontam.masks_for(width, 0.75)
        for kept in combinations(range(width), decontam.needed(width, 0.75)):
            assert any({o + s for o in m} <= set(kept) for m in masks for s in range(width - m[-1])), (width, kept)
