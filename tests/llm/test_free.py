"""Quality, licenses, page text, vectors, languages and Jaccard components against brute force or held-out accuracy."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cairn.llm import htmltext, jaccard, langid, license, quality, vecdedup

SF = "/root/testdata/sf0.01"


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


# --- quality ---


def test_quality_held_out(spark):
    got = quality.score(table(spark, "documents"), table(spark, "labels")).join(table(spark, "labels"), "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) / len(got) > 0.95
    assert all(r.held_out == (__import__("zlib").crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "x " * 50000, "a"), (None, "some text", "a"), (1, None, "a")], "doc_id long, text string, score string").withColumns({"x": F.lit(1), "y": F.lit(2), "h": F.lit(3)})
    labels = spark.createDataFrame([(1, None), (2, 7), (None, 1)], "doc_id long, quality int")
    got = quality.score(docs, labels).collect()
    assert len(got) == 5 and all(r.predicted == 1 for r in got)  # nothing to learn from: keep
    assert quality.keep(docs, labels).columns == docs.columns
    assert quality.score(docs.limit(0), labels).count() == 0
    bad = quality.score(docs, spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "doc_id long, quality int")).collect()
    assert all(r.predicted == 0 for r in bad)


def test_bradley_terry_orders_by_preference():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, quality.N_FEATURES)).astype(np.float32)
    y = (x[:, 0] - 0.5 * x[:, 3] > -1).astype(int)
    m = quality.fit(x, y, (y == 0).mean())
    assert ((m.score(x) >= 0.3) == y).mean() > 0.97 and abs((m.score(x) < 0.3).mean() - (y == 0).mean()) < 0.02


def test_bradley_terry_takes_all_pairs():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, quality.N_FEATURES)).astype(np.float32)
    y = (x[:, 0] - x[:, 5] + rng.logistic(size=900) > 1).astype(int)
    m = quality.fit(x, y, (y == 0).mean())
    z = np.clip((x - x.astype(float).mean(0)) / x.astype(float).std(0), -8, 8)
    raw = z @ m.weight
    lose = 1 / (1 + np.exp(raw[y == 1][:, None] - raw[y == 0][None, :]))  # brute force: the gradient is 0 over every pair
    g = (lose.sum(1) @ z[y == 1] - lose.sum(0) @ z[y == 0]) / lose.size - 1e-3 * m.weight
    assert np.abs(g).max() < 1e-5 and np.abs(m.weight).max() > 0.3
    assert abs(m.cut - np.sort(raw)[(y == 0).sum() - 1 :][:2].mean()) < 1e-9


def test_ranking_learns_from_every_row(spark, tmp_path):
    """More rows of a label than the 20,000 that were once drawn: means, weights and cut are those of all rows, in any layout."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(70_000, quality.N_FEATURES)).astype(np.float32)
    y = (x[:, 1] + rng.logistic(size=len(x)) > 0.5).astype(np.int32)
    pd.DataFrame({"x": list(x), "y": y}).to_parquet(tmp_path / "rows.parquet")
    rows = spark.read.parquet(str(tmp_path / "rows.parquet")).withColumn("h", F.xxhash64("x"))
    want = quality.fit(x, y, (y == 0).mean())
    for some in (rows, rows.repartition(7)):
        got = quality.learn(some)
        assert np.allclose(got.mean, x.astype(float).mean(0), atol=1e-7) and np.allclose(got.std, x.astype(float).std(0), atol=1e-7)
        assert got.cut == want.cut and (got.weight == want.weight).all()
        assert (got.raw(x) < got.cut).sum() == (y == 0).sum()


def test_ranks_of_raw_scores():
    x = np.zeros((9, quality.N_FEATURES), np.float32)
    x[:, 0] = [-2.5, 3, 0, -0.0, 1e-30, 3, -7, 0.1, 3]
    one = quality.Ranker(np.zeros(quality.N_FEATURES), np.ones(quality.N_FEATURES), np.eye(quality.N_FEATURES)[0], 0.0, 1.0, 0.3)
    for k in range(8):
        for few in (0, 50_000):
            got = quality._at_ranks(lambda part, _: quality._tally(*part(x, np.zeros(9, int))), one, [k, k + 1], few)
            assert (got == np.sort(one.raw(x))[k : k + 2]).all()


# --- licenses ---


def lcs(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, best[j] = best[j], last + 1 if x == y else max(best[j], best[j - 1])
    return best[-1]


def test_alignment_is_a_common_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        a = [rng.choice("abcdefghijklmnop") for _ in range(rng.randint(0, 25))]
        b = [w for w in a if rng.random() < 0.8] + [rng.choice("xyz") for _ in range(3)]
        pairs = license.align(a, b)
        assert all(a[x] == b[y] for x, y in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False)) and len(pairs) <= lcs(a, b)
    assert len(license.align(list("abcde"), list("abcde"))) == 5


def test_licenses(spark):
    mit = license.TEMPLATES["MIT"]
    noise = " ".join(f"w{i}" for i in range(3000))
    damaged = mit.replace("merge, publish", "merge; maybe publish").replace("ARISING FROM, OUT OF OR IN", "")
    rows = [(1, f"{noise} {mit} {noise}"), (2, damaged), (3, noise), (4, None), (5, ""), (6, "Licensed under CC BY-NC 4.0. and again: licensed under cc by-nc 4.0."), (7, mit[: len(mit) // 3]), (1, mit), (None, "Released under the MIT License.")]
    got = license.scan(spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, n_licenses string")).collect()
    tops = [(r.doc_id, r.top_license, r.n_licenses) for r in got]
    assert tops == [(1, "MIT", 1), (2, "MIT", 1), (3, None, 0), (4, None, 0), (5, None, 0), (6, "CC-BY-NC-4.0-line", 2), (7, None, 0), (1, "MIT", 1), (None, "MIT-line", 1)]
    assert got[0].licenses[0].coverage == 1.0 and got[0].licenses[0].first_word == 3000 and 0.8 <= got[1].top_coverage < 1


def test_license_without_its_first_word():
    rng = random.Random(8)
    prose = "the of and to in is that for it as was with be by on not or this are but from at which have an they you were their one all we can has there been if more when will would who so no any other such shall without person use copy notice".split()
    around = lambda: " ".join(rng.choice(prose) for _ in range(600))
    scanner = license.Scanner({"MIT": license.TEMPLATES["MIT"]})
    for k in range(4):
        text = license.TEMPLATES["MIT"].split(" ", 1)[1]
        found = scanner.scan(f"{around()} {'Authorization' if k % 2 else ''} {text} {around()}")
        assert [r[0] for r in found] == ["MIT"] and found[0][1] >= 0.9, found


def test_every_kind_of_license_line():
    scanner = license.Scanner(license.TEMPLATES)
    for name, template in license.TEMPLATES.items():
        found = scanner.scan(f"Some words before. {template} Some words behind.")
        assert (name, 1.0) in [r[:2] for r in found], (name, found)
        assert {r[0] for r in found} <= {name, "Apache-2.0-line"}, (name, found)
    assert [r[0] for r in scanner.scan("Text of a page. All rights reserved.")] == ["reserved-rights-line"]


# --- pages ---

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>if (a < b) "</p>"</script></head><body class="with-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Menu</a></ul></nav><div class="cookie-notice">We use cookies</div>
<div class="wrap"><div class="{cls}"><header><h2>Title &amp; more</h2><span>by me</span></header><p>First&nbsp;<b>pa</b>ra  graph {k}<br>with a break.<p>Second &#233;&lt;i&gt;.
<form><input><button>Send</button></form><ul><li>one<li>two</ul><div class="ad-box ad">Buy</div><!-- <p>hidden</p> --><p hidden>no</p></div>
<aside>Side</aside><div class="sidebar">More side</div><section id="comments"><article class="comment"><p>A reader writes a rather long comment here, longer than the text itself, to draw votes to it.</p></article></section></div>
<footer>&copy; x</footer>"""


def test_pages(spark):
    rows = [(k, f"http://h{k % 2}.org/{k}", PAGE.format(cls=f"post-{k} entry", k=k)) for k in range(8)]
    rows += [(20, "http://h0.org/x", None), (21, None, ""), (22, "http://h0.org/y", "plain text &amp; nothing else"), (23, "http://h1.org/z", "<article><p>a</article><p>" + "<div><a href=x>link</a></div>" * 9), (24, "u", "<p>unclosed <b>tags <i>all over"), (25, "http://k/", "<body><header>Site</header><main class='page with-sidebar'><header><h1>Title</h1><span>by me</span></header><p>Body text.</main>"), (1, rows[1][1], rows[1][2])]
    got = htmltext.main_text(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == len(rows)
    for k in range(8):
        assert text[k] == f"First para graph {k} with a break. Second é<i>. one two", text[k]
    assert (text[20], text[21], text[22], text[23], text[24], text[25]) == ("", "", "plain text & nothing else", "a", "unclosed tags all over", "Title Body text.")
    assert all(r.n_chars == len(r.text) for r in got)
    assert htmltext.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pages_keep_what_stands_beside_the_largest_part(spark):
    body = "<div class=body>" + "<p>A long paragraph of the article's own text.</p>" * 9 + "</div>"
    want = "Headline Lead. " + " ".join(["A long paragraph of the article's own text."] * 9) + " The end."
    inner = f"<h1>Headline</h1><p>Lead.</p>{body}<p>The end.</p>"
    rows = [(k, f"http://a.org/{k}", f"<body><nav><a href=x>Menu</a></nav><article>{inner}</article><footer>x</footer>") for k in range(4)]
    rows += [(10 + k, f"http://b.org/{k}", f"<body><div class=top><a href=x>Home</a></div><div class=wrap>{inner}</div><div class=end><a href=y>More</a></div>") for k in range(4)]
    rows += [(20, "http://a.org/second", "<body><article><p>Short box.</p></article><div class=story>" + "<p>Text of the second template.</p>" * 9 + "</div>")]
    rows += [(30, "http://c.org/x", f"<body><main><h1>Headline</h1><p>Lead.</p><article>{body}</article><p>The end.</p></main>")]
    got = {r.page_id: r.text for r in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == want for k in got if k != 20)
    assert got[20] == " ".join(["Short box."] + ["Text of the second template."] * 9)


def page_text(spark, rows):
    return {r.page_id: r.text for r in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_menus_of_links_without_marks():
    prose = "Plain text of the page that is long enough to be read. "
    link = "<a href=x>some text of a link</a>"
    for menu in (f"<div class=y>{link * 60}</div>", "<ul>" + f"<li>{link}" * 40 + "</ul>", "<table>" + f"<tr><td>{link}</td></tr>" * 40 + "</table>"):
        for page in (f"<div class=x><p>{prose}</p></div>{menu}", f"{menu}<p>{prose}</p>", f"<body>{menu}<div><p>{prose}</p></div>"):
            assert htmltext.extract(page) == prose.strip(), page
    assert htmltext.extract(f"<article><p>{prose}<ul><li>one<li>{link}</ul></article>") == f"{prose}one some text of a link"


def test_class_words_around_the_article():
    prose = "Words of the article. " * 20
    for top in ("<div class='login-help'>", "<div id=main class='page-search-results'>", "<body class='comments-open'><div class='post comments-enabled'>", "<div class='widget'><article>"):
        assert htmltext.extract(f"{top}<h1>Head</h1><p>{prose}</p>") == f"Head {prose.strip()}", top
    assert htmltext.extract(f"<div class=post>Short.</div><section id=comments><article>{prose}</article></section><div class=sidebar>{prose}</div>") == "Short."
    assert htmltext.extract("<article><h1>Head</h1><p>lead</p><section>" + "body " * 200 + "</section></article>") == "Head lead " + ("body " * 200).strip()


def test_deep_and_long_pages():
    deep = "<div>" * 10_000 + "deep text" + "</div>" * 10_000
    assert htmltext.extract(deep) == "deep text" and len(htmltext.votes(deep)) == 2 and max(len(v[0]) for v in htmltext.votes(deep)) < 400
    assert htmltext.extract("<p>a" + "</x>" * 50_000) == "a"
    assert htmltext.extract("<p>word " * 50_000).count("word") == 50_000


def test_hosts_decide(spark):
    """Pages whose own judgement is wrong are read by their host's paths; chrome without a telling name is left out."""
    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    welcome, rows, want = "Welcome to this site, it is a fine one.", [], {}
    for k in range(40):
        text = prose(4 if k == 7 else 80)  # page 7: an article shorter than what stands beside it
        rows.append((k, f"http://a.org/{k}", f"<body><div class=greet>{welcome}</div><div class=x1><p>{text}</p></div><div class=x2>{prose(30 + k % 3)}</div>"))
        want[k] = text
    for k in range(40, 45):  # another template, seen once each
        text = prose(60)
        rows.append((k, f"http://a.org/{k}", f"<body><div class=x1><p>tiny</p></div><div class=other{chr(k + 57)}><p>{text}</p></div>"))
    rows += [(100 + k, f"http://b.org/{k}", f"<body><div class=x1><p>{rows[0][2]}</p></div>") for k in range(20)]  # copies are no chrome
    got = page_text(spark, rows)
    alone = {k: htmltext.extract(h) for k, _, h in rows}
    assert welcome in alone[3] and not any(welcome in got[k] for k in range(40))
    assert got[7] != alone[7] and all(want[k] in got[k] for k in want)
    assert all(got[100 + k] == alone[100 + k] for k in range(20))


def test_a_short_article_beside_a_long_box(spark):
    rng = random.Random(4)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    page = lambda a, b: f"<body><main>{a}</main><section class=more>{b}</section>"
    short = prose(5)
    rows = [(k, f"http://a.org/{k}", page(prose(90), prose(8))) for k in range(9)] + [(9, "http://a.org/9", page(short, prose(90))), (10, "http://b.org/9", page(short, prose(90)))]
    got = page_text(spark, rows)
    assert got[9] == short and got[10] != short  # only the first host knows better


# --- vectors ---


def brute_links(rows, least=0.98):
    links = {}
    for i, (v, e, lab) in enumerate(rows):
        for w, f, lab2 in rows[:i]:
            if lab is None or lab != lab2 or not e or not f or len(e) != len(f) or any(x is None or not np.isfinite(x) for x in [*e, *f]) or not any(e) or not any(f) or v is None or w is None:
                continue
            a, b = np.array(e, np.float64), np.array(f, np.float64)
            if a @ b / np.sqrt((a @ a) * (b @ b)) >= least:
                links.setdefault(v, []).append(w)
                links.setdefault(w, []).append(v)
    return links


def reach(links, ids):
    comp = {}
    for v in sorted(ids):
        todo = [v]
        while todo:
            x = todo.pop()
            if x not in comp:
                comp[x] = v
                todo += links.get(x, [])
    return comp


def test_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=16).tolist(), i % 3) for i in range(150)]
    for i in range(150, 330):
        base = rows[i % 40] if i < 250 else rows[7]
        rows.append((i, (np.array(base[1]) + rng.normal(size=16) * 0.07).tolist(), base[2]))
    rows += [(400 + i, rows[5][1], rows[5][2]) for i in range(12)]  # exact copies
    rows += [(500, None, 1), (501, [], 1), (502, [0.0] * 16, 1), (503, [None] + [1.0] * 15, 1), (504, [float("nan")] * 16, 1), (505, [float("inf")] * 16, 1), (506, rows[5][1], None), (507, rows[5][1][:8], rows[5][2]), (508, [x * 1e30 for x in rows[5][1]], rows[5][2]), (None, rows[5][1], rows[5][2])]
    table_ = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, label int, rep int, v int")
    got = vecdedup.dedup(table_, window=64, block=256).collect()
    links = brute_links(rows)
    comp = reach(links, [r[0] for r in rows if r[0] is not None])
    found = {r.vec_id: r for r in got if r.vec_id is not None}
    assert len(got) == len(rows)
    assert {v: r.n_links for v, r in found.items()} == {v: len(links.get(v, [])) for v in found}
    assert {v: (r.component_id, r.kept) for v, r in found.items()} == {v: (comp[v], comp[v] == v) for v in found}
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, False)]
    assert vecdedup.dedup(table_.limit(0)).count() == 0


def test_large_components_are_counted_in_blocks(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=8)
    rows = [(i, (base + rng.normal(size=8) * 0.02).astype(float).tolist(), 1) for i in range(1300)]
    got = vecdedup.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    e = np.array([r[1] for r in rows])
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    want = (e @ e.T >= 0.98).sum(1) - 1
    assert {r.vec_id: r.n_links for r in got} == dict(enumerate(want.tolist()))


def test_passes_follow_the_vectors(spark):
    """One label of vectors that share a direction, pairs planted near the threshold, against brute force."""
    rng = np.random.default_rng(7)
    base = rng.normal(size=32)
    rows = [(i, (2 * base + rng.normal(size=32)).tolist(), "a") for i in range(2500)]
    rows += [(5000 + i, (np.array(rows[i][1]) + rng.normal(size=32) * 0.3).tolist(), "a") for i in range(300)]
    got = vecdedup.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"), window=64, block=256).collect()
    e = np.array([r[1] for r in rows])
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    ids = [r[0] for r in rows]
    links = {}
    for a, b in np.argwhere(e @ e.T >= 0.98):
        if a != b:
            links.setdefault(ids[a], []).append(ids[b])
    comp = reach(links, ids)
    want = {v: (len(links.get(v, [])), comp[v], comp[v] == v) for v in ids}
    assert sum(map(len, links.values())) > 300
    assert sum({r.vec_id: (r.n_links, r.component_id, r.kept) for r in got}[v] == want[v] for v in ids) >= 0.999 * len(ids)


@pytest.mark.parametrize(("n", "shared"), [(4000, 0.0), (30_000, 0.0), (4000, 2.0), (30_000, 2.0)])
def test_recall_of_the_passes(n, shared):
    """Pairs at cosine 0.98 that come within the window in some pass, in a label of n vectors of 64 dimensions."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(n, 64)) + shared * rng.normal(size=64) * np.ones((n, 1))
    u = vecdedup.unit(v)
    far = rng.normal(size=(400, 64))
    far -= (far * u[:400]).sum(1, keepdims=True) * u[:400]
    twin = 0.98 * u[:400] + math.sqrt(1 - 0.98**2) * vecdedup.unit(far)
    every = np.concatenate([u, twin])
    spread = math.sqrt(max(0.0, 1 - (every.mean(0) ** 2).sum()))
    met = np.zeros(400, bool)
    turns = vecdedup.passes(len(every), spread, 256)
    for turn in range(turns):
        place = np.empty(len(every), np.int64)
        place[np.argsort(vecdedup.keys(every, turn, 11), kind="stable")] = np.arange(len(every))
        met |= np.abs(place[:400] - place[n:]) <= 256
    assert met.mean() >= 0.99, (turns, met.mean())
    assert vecdedup.passes(256, 1.0, 256) == 1 < turns < vecdedup.passes(10**7, spread, 256)


# --- languages ---


def test_languages_held_out(spark):
    got = langid.identify(table(spark, "documents")).join(table(spark, "documents").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.97


def test_language_edges(spark):
    texts = {"en": "the cat and the dog ran over the hill ", "de": "der hund und die katze liefen schnell heim "}
    rows = [(i, texts[k] * 5, k) for i in range(40) for k in texts] + [(100, None, "en"), (101, "", "de"), (102, "12 + 34 = 46! ½ ² Ⅷ", "en"), (103, "the dog and the cat " * 20000, None), (104, "日本語", None), (None, "die katze und der hund", None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, score int")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(df).collect() if r.doc_id is None or r.doc_id >= 100}
    assert got[100] == got[101] == got[102] == ("und", 0.0) and got[103][0] == "en" and got[None][0] == "de" and got[104][0] in texts
    assert {r.lang_pred for r in langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(df.limit(0)).count() == 0


def test_every_context_counts():
    """A sequence seen once, among more contexts than any table of fixed size would keep."""
    rng = np.random.default_rng(0)
    noise = rng.integers(97, 123, 200_000).astype(np.uint8).tobytes()
    grams = np.concatenate([langid._grams(noise), langid._grams(b"zq!x")])
    keys, n = np.unique(grams, return_counts=True)
    model = langid.build(["x", "y"], np.repeat([0, 1], len(keys)), np.tile(keys.astype(np.int64), 2), np.tile(n, 2))
    assert len(model.trees[0][0].contexts) > 17_000
    assert np.allclose(model.lookup(np.array([int.from_bytes(b"zq!x", "big")], np.uint32)), 1.0)  # 1 of 1 with one escape: one bit
    tie = langid.code_lengths(model, [b"some text", "é".encode() * 300_000])
    assert (tie[:, 0] == tie[:, 1]).all() and tie[1, 0] > 4 * 600_000  # equal languages, long texts over several chunks


def test_code_lengths_are_exact():
    """Against the escape rule applied byte by byte."""
    train = [b"abracadabra", b"banana bandana"]
    grams = np.concatenate([langid._grams(t) for t in train])
    lang = np.repeat([0, 1], [len(t) for t in train])
    keys, n = np.unique(np.stack([lang, grams.astype(np.int64)]), axis=1, return_counts=True)
    model = langid.build(["x", "y"], keys[0], keys[1], n)

    def prob(k, context, byte):
        if context is None:
            return 1 / 256
        text = langid.PAD + train[k]
        follow = [text[i] for i in range(3, len(text)) if text[i - len(context) : i] == context]
        shorter = prob(k, context[1:] if context else None, byte)
        if not follow:
            return shorter
        d = len(set(follow))
        return follow.count(byte) / (len(follow) + d) if byte in follow else d / (len(follow) + d) * shorter

    for text in (b"banana", b"abra", b"zz~", b""):
        whole = langid.PAD + text
        want = [sum(-np.log2(prob(k, whole[i - 3 : i], whole[i])) for i in range(3, len(whole))) for k in (0, 1)]
        assert np.allclose(langid.code_lengths(model, [b"ab", text])[1], want, atol=1e-4)


# --- jaccard ---


def brute_sets(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute_components(rows):
    sets = [(d, brute_sets(t)) for d, t in rows if d is not None]
    links = {}
    for i, (a, s) in enumerate(sets):
        for b, u in sets[:i]:
            if s and u and 100 * len(s & u) >= 75 * len(s | u):
                links.setdefault(a, []).append(b)
                links.setdefault(b, []).append(a)
    return reach(links, {d for d, _ in sets}), {d: len(s) for d, s in sets}


def texts():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4)))
    common = " ".join(word() for _ in range(12))
    base = [[word() for _ in range(rng.randint(1, 120))] for _ in range(80)]
    rows = [" ".join(b) for b in base]
    for k in range(160):
        w = list(base[k % 40] if k < 100 else base[3])
        for _ in range(rng.randint(0, max(1, len(w) // 15))):
            w[rng.randrange(len(w))] = word()
        rows.append(" ".join(w).upper() if k % 5 == 0 else "\t".join(w))
    rows += [common + " " + word() for _ in range(30)] + [rows[0]] * 5 + ["", None, " \n", "a", "A", "a b", "a  b\n", "É é", "é é", "a\xa0b"]
    return list(enumerate(rows))


def test_components(spark):
    rows = texts()
    table_ = spark.createDataFrame([(*r, 1, 2) for r in rows] + [(None, "a b", 1, 2), (3, rows[3][1], 1, 2)], "doc_id long, text string, h int, n int")
    comp, size = brute_components(rows)
    got = jaccard.near_duplicates(table_).collect()
    assert len(got) == len(rows) + 2
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == {(d, size[d], comp[d]) for d in comp}
    assert len(set(comp.values())) < len(comp) - 60
    kept = jaccard.one_each(table_)
    assert kept.columns == table_.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(comp.values()))
    assert sum(r.doc_id is None for r in kept.collect()) == 1  # and of rows that repeat a doc_id one stays
    assert jaccard.near_duplicates(table_.limit(0)).count() == 0


def test_components_with_long_runs(spark, monkeypatch):
    """Clumps and pairs together: runs of more than two sets are compared in blocks, in small tasks."""
    rows = texts()
    monkeypatch.setattr(jaccard, "PAIR_BYTES", 4000)
    monkeypatch.setattr(jaccard, "CUT_BYTES", 2000)
    monkeypatch.setattr(jaccard, "RUN", 2)
    comp, size = brute_components(rows)
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(d, size[d], comp[d]) for d in comp}


def test_blocks_of_a_clump():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, rng.integers(3, 40), dtype=np.uint64)) for _ in range(60)]
    sets += [np.unique(np.concatenate([s[:-1], [99]]).astype(np.uint64)) for s in sets[:30]]
    pdf = pd.DataFrame({"clump": 1, "a": np.arange(len(sets)), "u": [s.tobytes() for s in sets], "i": 0, "j": 0, "side": 0})
    pairs = {(a, b) for a in range(len(sets)) for b in range(a) if jaccard.linked(sets[a], sets[b])}
    every = pd.DataFrame([(a, b) for a in range(len(sets)) for b in range(a)], columns=["a", "b"]).assign(u=None)
    want = {}
    for a, b in pairs:
        want.setdefault(a, []).append(b)
        want.setdefault(b, []).append(a)
    for got in (jaccard._compared(pdf), jaccard._verified(pd.concat([pdf[["a", "u"]], every], ignore_index=True))):
        links = {}
        assert {(max(p), min(p)) for p in got.itertuples(index=False, name=None)} <= pairs
        for a, b in got.itertuples(index=False, name=None):
            links.setdefault(a, []).append(b)
            links.setdefault(b, []).append(a)
        assert reach(links, range(len(sets))) == reach(want, range(len(sets)))
    half = pdf.assign(i=0, j=1, side=(pdf["a"] % 2).astype(int))
    assert all((a - b) % 2 for a, b in jaccard._compared(half).itertuples(index=False, name=None))


def test_meetings_grow_with_the_corpus_not_its_square():
    """Pairs that share a signature, of unrelated texts over one vocabulary, for three sizes of corpus; a planted pair each."""
    rng = np.random.default_rng(1)
    vocabulary = (rng.pareto(1.1, 60_000) * 40).astype(np.int64)
    heavy = np.zeros(1 << jaccard.SKETCH_BITS, bool)
    met = []
    for n in (150, 600, 2400):
        words = [[f"w{w}" for w in rng.choice(vocabulary, 120)] for _ in range(n)]
        words.append(words[0][:-2] + ["x"])
        blobs = []
        broadcast = type("B", (), {"value": np.packbits(heavy).tobytes()})
        for lo in range(0, len(words), 500):
            batch = pd.DataFrame({"text": [" ".join(w) for w in words[lo : lo + 500]]})
            blobs += list(jaccard._packed(4, broadcast, 20_000)([batch]))
        pairs = pd.concat([jaccard.met(p) for _, p in pd.concat(blobs).groupby("part")])
        met.append(len(pairs.drop_duplicates(["ah", "bh"])))
        assert met[-1] >= 1 and not pairs["long"].any()
    assert met[2] <= 4 * met[1] + 8 and met[2] < 2400  # far below the 2.9 million pairs


@pytest.mark.parametrize("seed", range(3))
def test_linked_sets_share_a_signature(seed):
    rng = np.random.default_rng(seed)
    heavy = np.zeros(1 << jaccard.SKETCH_BITS, bool)
    line = rng.integers(0, 2**63, 30, dtype=np.uint64)
    heavy[jaccard.slots(line)] = True
    tried = 0
    for _ in range(400):
        n = int(rng.integers(1, 200))
        a = np.union1d(rng.integers(0, 2**63, n, dtype=np.uint64), line[: int(rng.integers(0, 30))])
        k = int(rng.integers(0, len(a) // 4 + 1))
        b = np.union1d(rng.permutation(a)[: len(a) - k // 2], rng.integers(0, 2**63, k - k // 2, dtype=np.uint64))
        if jaccard.linked(a, b):
            tried += 1
            assert len(np.intersect1d(jaccard.signatures(a, np.packbits(heavy)), jaccard.signatures(b, np.packbits(heavy))))
    assert tried > 100


def test_a_signature_is_shuffled_in_ten_bytes(monkeypatch):
    """Names of 48 bits come back as they were; different sets that share a first hash sign both."""
    names = np.array([0, 1, (1 << 48) - 1, 0x123456789ABC], np.int64)
    assert len(jaccard.pack(names)) == 24 and (jaccard.unpack(jaccard.pack(names)) == names).all()
    rng = random.Random(3)
    texts = [" ".join(str(rng.randrange(10**6)) for _ in range(60)) for _ in range(6)]
    broadcast = type("B", (), {"value": np.zeros(1 << jaccard.SKETCH_BITS - 3, np.uint8).tobytes()})
    first = jaccard.identity
    packed = lambda: pd.concat(jaccard._packed(4, broadcast)([pd.DataFrame({"text": texts + texts})]))
    blobs = packed()
    count = blobs["low"].map(len).sum() // 4
    assert sum(blobs[c].map(len).sum() for c in blobs.columns if c != "part") == 10 * count
    assert all(0 <= first(s)[0] < 1 << 48 for s in jaccard.shingle_sets(texts))
    monkeypatch.setattr(jaccard, "identity", lambda s: (7, first(s)[1]))
    assert packed()["low"].map(len).sum() // 4 == count
