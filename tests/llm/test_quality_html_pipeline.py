import collections
import math
import random

import numpy as np

import corpus_pipeline
from tidemark.llm import decontam, entry, html_extract, near_dup, quality
from tidemark.llm.common import Scratch

SF = "/root/testdata/sf0.001"


def naive_kn(texts, order=4, code=lambda c: c):
    """Interpolated modified Kneser-Ney by dicts; returns p(gram)."""
    grams = collections.Counter()
    for t in texts:
        a = [2] * (order - 1) + [code(ord(c)) for c in t] + [3]
        for i in range(order - 1, len(a)):
            grams[tuple(a[i - order + 1 : i + 1])] += 1
    levels = {order: grams}
    for n in range(order - 1, 0, -1):
        levels[n] = collections.Counter(g[1:] for g in levels[n + 1])
    model = {}
    for n, c in levels.items():
        k = [sum(v == i for v in c.values()) for i in range(1, 5)]
        y = k[0] / (k[0] + 2 * k[1]) if k[0] else None
        d = []
        for i in (1, 2, 3):
            x = i - (i + 1) * y * k[i] / k[i - 1] if y is not None and k[i - 1] else None
            d.append(x if x is not None and 0 < x < i else 0.75)
        total, off = collections.Counter(), collections.Counter()
        for g, v in c.items():
            total[g[:-1]] += v
            off[g[:-1]] += d[min(v, 3) - 1]
        model[n] = (c, d, total, off)

    def p(gram):
        out = quality.FLOOR
        for n in range(1, order + 1):
            c, d, total, off = model[n]
            g = gram[-n:]
            if total[g[:-1]]:
                own = (c[g] - d[min(c[g], 3) - 1]) / total[g[:-1]] if c[g] else 0.0
                out = own + off[g[:-1]] / total[g[:-1]] * out
        return out

    return p


def test_model_is_the_textbook_s(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("abcde é") for _ in range(rnd.randint(1, 60))) for _ in range(40)]
    df = spark.createDataFrame([("x", t) for t in texts], "lang string, t string")
    table = quality.train(df, Scratch(spark, "t")).toPandas()
    model = quality.Model({"n": table.n.to_numpy(), "gram": table.gram.to_numpy(np.int64), "p": table.p.to_numpy(float), "weight": table.weight.to_numpy(float)})
    p = naive_kn(texts)
    for t in [*texts[:10], "zz a", "bad cab"]:
        a = [2, 2, 2, *map(ord, t), 3]
        want = [-math.log(p(tuple(a[i - 3 : i + 1]))) for i in range(3, len(a))]
        assert np.allclose(model.loss(quality._grams(t)), want, atol=1e-6)


def corpus(spark):
    rnd = random.Random(8)
    vocab = ["the", "of", "and", "sand", "river", "stone", "table", "under", "green", "light", "house", "walk"]
    good = lambda n: " ".join(rnd.choice(vocab) for _ in range(n)) + "."
    docs = [(i, good(rnd.randint(5, 80)), "en") for i in range(400)]
    docs += [(1000 + i, " ".join(w.upper() + "!!#%" for w in good(40).split()), "en") for i in range(20)]
    docs += [(2000, None, "en"), (2001, "", None), (2002, "   ", "en"), (2003, "no model here", "xx"), (None, good(30), "en")]
    labels = [(i, 1, 0) for i in range(300)] + [(1000 + i, 0, 0) for i in range(10)] + [(300, 1, 1), (None, 1, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_junk_goes_and_clean_documents_stay(spark, monkeypatch):
    docs, labels = corpus(spark)
    got = {r.doc_id: (r["__accepted"], r["__loss"]) for r in quality.classify(docs, labels).collect()}
    assert len(got) == docs.count()
    assert sum(got[i][0] for i in range(400)) >= 392 and not any(got[1000 + i][0] for i in range(20))
    assert all(got[k][0] for k in (2000, 2001, 2002, 2003, None))
    monkeypatch.setattr(quality, "SHARD_ENTRIES", 50)  # many files
    monkeypatch.setattr(quality, "BROADCAST_IDS", 0)  # and a shuffle
    again = {r.doc_id: (r["__accepted"], r["__loss"]) for r in quality.classify(docs, labels).collect()}
    assert again == got


def test_losses_limits_and_verdicts_by_brute_force(spark):
    rnd = random.Random(5)
    make = lambda letters: "".join(rnd.choice(letters) for _ in range(rnd.randint(1, 50)))
    letters = {"a": "abcd e", "b": "wxyz 漢😀", None: "mnop", "": "qrst"}
    docs = [(i, lang, make(x), i, i, i) for i, (lang, x) in enumerate((k, v) for _ in range(40) for k, v in letters.items())]
    docs += [(900, "a", "zzzz" * 40, 0, 0, 0), (901, "a", None, 0, 0, 0), (902, "b", " ", 0, 0, 0), (903, "c", "new", 0, 0, 0), (904, "a", "abcd " * 30_000, 0, 0, 0), (3, None, "mnop", 0, 0, 0), (900, "a", "zzzz" * 40, 0, 0, 0)]
    df = spark.createDataFrame(docs, "doc_id long, lang string, text string, row int, __row int, language_code int")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(160)], "doc_id long, quality int, toxic int")
    got = quality.classify(df, labels)
    assert got.columns == [*df.columns, "__loss", "__limit", "__accepted"]
    hashes = {r.text: r.h for r in df.selectExpr("text", "xxhash64(text) AS h").collect()}
    trusted = {k: [d[2] for d in docs if d[0] < 160 and d[1] == k] for k in letters}
    losses, limits = {}, {}
    for k, texts in trusted.items():
        p = naive_kn([t for t in texts if hashes[t] % quality.HELD_OUT], code=lambda c: c if c < 0x10000 else 0xE000 + c % 0x1900)

        def loss(t, p=p):
            a = [2, 2, 2, *(c if c < 0x10000 else 0xE000 + c % 0x1900 for c in map(ord, t)), 3]
            return sum(-math.log(p(tuple(a[i - 3 : i + 1]))) for i in range(3, len(a))) / (len(a) - 3)

        losses[k] = loss
        held = sorted(round(loss(t), 4) for t in texts if hashes[t] % quality.HELD_OUT == 0)
        limits[k] = held[math.ceil(quality.QUANTILE * len(held)) - 1]
    seen = 0
    for r in got.collect():
        if r.lang not in losses or not (r.text or "").strip():
            assert r["__loss"] is None and r["__accepted"]
            continue
        seen += 1
        if len(r.text) < 1000:
            assert abs(r["__loss"] - losses[r.lang](r.text)) < 1e-3
        assert abs(r["__limit"] - limits[r.lang]) < 1e-3 and r["__accepted"] == (r["__loss"] <= r["__limit"])
    assert seen == 164 and not any(r["__accepted"] for r in got.where("doc_id = 900").collect())
    assert quality.classify(df.limit(0), labels).collect() == [] and all(r["__accepted"] for r in quality.classify(df, labels.limit(0)).collect())


PAGE = (
    "<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t=\"</p>\";</script></head><body><header>Site</header><nav><ul><li><a href='/x'>Menu</a></ul></nav>"
    "<!-- ad --><div class=\"ad\">Buy</div><article><h1>Head &amp; more</h1><p><b>One <i>two</i><br>three<p>Four\n five</p><div class='share'>Tweet</div><ul><li>a<li>b</ul><section class='comments'><p>First!</p></section></article>"
    "<aside>Side</aside><form><p>Name</p></form><footer>&copy; me</footer></body></html>"
)


def test_main_text_of_an_article():
    assert html_extract.main_text(PAGE, {}) == "Head & more\nOne two three\nFour five\na\nb"
    assert html_extract.main_text("", {}) == "" and html_extract.main_text("a < b &lt; c", {}) == "a < b < c"
    assert html_extract.main_text("<p>cut <b", {}) == "cut" and html_extract.main_text("<div class=ad>never closed<article><p>text", {}) == "text"


def test_repeated_texts_of_a_host_are_template(spark, rows):
    page = "<body><div>Best shop in town</div><div>Call us</div><p>{}</p></body>"
    data = [(i, f"http://h.example/{i}", page.format(f"story {i}"), "x") for i in range(6)] + [(10, "http://other.example/", page.format("alone"), "x"), (11, None, None, "x"), (12, "http://h.example/e", "", "x")]
    df = spark.createDataFrame(data, "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract(df).collect()}
    assert all(got[i] == (f"story {i}", 7) for i in range(6))
    assert got[10][0] == "Best shop in town\nCall us\nalone" and got[11] == got[12] == ("", 0)
    old = html_extract.BROADCAST_TOKENS
    html_extract.BROADCAST_TOKENS = 0  # by a join with the templates
    try:
        assert {r.page_id: (r.text, r.n_chars) for r in html_extract.extract(df).collect()} == got
    finally:
        html_extract.BROADCAST_TOKENS = old
    assert html_extract.extract(df.limit(0)).collect() == []


def test_repeated_texts_inside_articles_are_template(spark):
    page = "<body><h2>Site</h2><article><p>Read all our offers</p><p>{0}</p><div class=box>Join us today</div><p>{0} ends</p></article><div>{0} out</div></body>"
    df = spark.createDataFrame([(i, f"http://h.example/{i}", page.format(f"story {i}")) for i in range(6)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_extract.extract(df).collect()} == {i: f"story {i}\nstory {i} ends" for i in range(6)}


def test_slots_are_found_without_telling_names(spark):
    words = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    page = "<html><body><div class=k1>{a} here</div><div class=k2><div class=k3><h2>{b}</h2><p>{c}</p><p>{d} and {e}</p></div></div><div class=k4>Ask {f}</div></body></html>"
    parts = [dict(a=words(i, 6), b=f"Title {i}", c=words(i + 50, 60), d=words(i + 90, 40), e=i, f=words(i + 200, 5)) for i in range(6)]
    df = spark.createDataFrame([(i, f"http://q.example/{i}", page.format(**x)) for i, x in enumerate(parts)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(df.union(df.where("page_id = 2"))).collect()}
    assert got == {i: "\n".join((x["b"], x["c"], f"{x['d']} and {i}")) for i, x in enumerate(parts)}
    found = html_extract.templates(html_extract.parse(df))
    assert found.where("parent IS NULL").count() == 0 and found.where("kind = 1").count() == 6


def test_article_texts_are_dropped_for_the_listed_reasons_only():
    page = "<article><h1>T</h1><p>x <math>a+b</math> <object>old</object><audio>no sound</audio> &<b>lt;</b> y<!-- z -->!</p><div class='related work'>see also</div><table><tr><td>c</td></tr></table><script>1<2</script><form>Name <select><option>o</select></form><p>end<p>" + "long " * 50_000 + "</article>tail"
    got = html_extract.main_text(page, {})
    assert got == "T\nx a+b oldno sound &lt; y!\nsee also\nc\nend\n" + ("long " * 50_000).strip()
    one = html_extract.Page("<body><p>one</p><p>two</p></body>")
    tokens = {x[1]: (7, i) for i, x in enumerate(one.blocks)}
    assert html_extract.main_text("<body><p>one</p><p>two</p><p>three</p></body>", tokens) == "three"
    assert html_extract.main_text("<body><p>two</p><p>one</p></body>", tokens) == "one"  # out of the class's order


def test_copies_of_a_page_are_not_template(spark):
    one, other = "<body><h1>A story</h1><div>It was told</div></body>", "<body><h1>Else</h1><div>Not told</div></body>"
    same = "<body><h1>Shop</h1><article><p>All of it</p><p>repeats</p></article><i>{}</i></body>"
    data = [(i, "http://c.example/x", one) for i in range(4)] + [(9, "http://c.example/y", other)] + [(20 + i, "http://s.example/", same.format(i)) for i in range(4)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    assert got == {i: "A story\nIt was told" for i in range(4)} | {9: "Else\nNot told"} | {20 + i: "All of it\nrepeats" for i in range(4)}


def test_pages_of_the_tables_give_their_articles(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in entry.op9_html_extraction(spark, SF).collect():
        inner = pages[r.page_id].split("<article>")[1].split("</article>")[0]
        words = html_extract.unescape(html_extract.re.sub("<[^>]*>", " ", inner)).split()
        assert r.text.split() == words and r.n_chars == len(r.text)


def test_one_of_each_group_stays(spark, rows):
    a = "one two three four five six seven eight nine ten"
    df = spark.createDataFrame([(3, a, "s"), (1, a.upper(), "s"), (2, a + " eleven", "t"), (4, "", "u"), (5, None, "u"), (6, "other words here", "v"), (6, "other words here", "w")], "doc_id long, text string, source string")
    kept = near_dup.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 4, 5, 6]


def test_pipeline_stages_take_odd_rows_and_keep_every_column(spark, tmp_path):
    a = "one two three four five six seven eight nine ten"
    rows = [(1, a, "en", "s", 1), (2, a + " eleven", "en", None, 1), (3, None, None, "s", None), (4, "", "en", "s", 0), (5, "long " * 100_000, "xx", "s", 1), (None, a, "en", "s", 1), (6, "call joe@site.org now", "en", "s", 1), (6, "call joe@site.org now", "en", "s", 1)]
    docs = spark.createDataFrame([(*r, 0, 0, 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, row int, __row int, found_key int")
    spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "x y z"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert near_dup.drop_near_duplicates(docs).columns == docs.columns
    for frame in (docs, docs.limit(0)):
        out = frame
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = Scratch(spark, "odd").save(stage(spark, out, str(tmp_path)), "out")
            assert i == 4 or out.columns == list(corpus_pipeline.COLUMNS)
        got = [r.doc_id for r in out.collect()]
        assert got == [] or {3, 4, 5, 6} <= set(got) and len({1, 2, None} & set(got)) == 1


def test_pipeline_stages_against_their_own_inputs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = None
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = Scratch(spark, "test").save(stage(spark, docs, SF), name)
        if i < 4:
            assert out.columns == list(corpus_pipeline.COLUMNS)
        before, after = {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in out.collect()}
        assert set(after) <= set(before)
        if name == "near_duplicates":
            up = {k: k for k in before}
            sets = {k: near_dup.shingle_set(r.text or "", 5) for k, r in before.items()}

            def top(x, up=up):
                while up[x] != x:
                    x = up[x]
                return x

            keys = sorted(sets)
            for x in keys:
                for y in keys:
                    both = len(sets[x] & sets[y])
                    if y < x and both and 5 * both >= 4 * (len(sets[x]) + len(sets[y]) - both):
                        lo, hi = sorted((top(x), top(y)))
                        up[hi] = lo
            assert len(after) == len({top(k) for k in keys})
        elif name == "decontamination":
            bad = {r.doc_id for r in decontam.contaminated(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
            assert set(after) == set(before) - bad
        elif name in ("personal_data", "byte_bpe"):
            assert set(after) == set(before)
        docs = out
    assert out.columns == ["doc_id", "n_tokens", "ids"]
