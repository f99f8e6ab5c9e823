import random

from tidemark.llm import near_dup as nd
from tidemark.llm.common import Scratch


def brute(docs, width, num=4, den=5):
    sets = {k: nd.shingle_set(t or "", width) for k, t in docs}
    up = {k: k for k in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                lo, hi = sorted((top(a), top(b)))
                up[hi] = lo
    return {k: (len(sets[k]), top(k), top(k) == k) for k in keys}


def test_matches_brute_force_on_chains_copies_and_edges(spark):
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(300)]
    docs = []
    for g in range(25):
        base = [rnd.choice(vocab) for _ in range(rnd.randint(4, 120))]
        for _ in range(rnd.randint(1, 6)):  # a chain: each text edits the one before
            docs.append(" ".join(base))
            for _ in range(rnd.randint(0, 3)):
                base[rnd.randrange(len(base))] = rnd.choice(vocab)
    docs += [None, "", " \t ", "One", "one", "one two", "ONE  two\n", "x " * 3000, "A B C D", "a b c d"]
    docs = list(enumerate(docs))
    rnd.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for width in (2, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in nd.near_duplicates(df, width=width).collect()}
        assert got == brute(docs, width)


def test_repeated_and_null_keys_clashing_columns_empty_table(spark, rows):
    df = spark.createDataFrame(
        [(1, "a b c d e f", 9, 1), (1, "a b c d e f", 9, 2), (None, "a b c d e f", 9, 3), (2, "z y x w v u", 9, 4), (2, "q r s t u v", 9, 5), (None, None, 9, 6)],
        "doc_id long, text string, component_id int, node int",
    )
    got = nd.near_duplicates(df)
    assert rows(got, "doc_id", "n_shingles", "component_id") == sorted([(1, 2, 1), (1, 2, 1), (None, 2, 1), (2, 2, 2), (2, 2, 2), (None, 0, None)], key=repr)
    assert got.where("first").count() == 4
    assert nd.near_duplicates(df.limit(0)).collect() == []


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200), (200, 300)], "a long, b long")
    got = dict(nd.components(links, Scratch(spark, "t")).collect())
    assert got == {i: 0 for i in range(61)} | {100: 100, 200: 100, 300: 100}


def test_every_coordinate_fills_and_agreement_follows_similarity():
    s = nd.Sketcher(2, 40, 5)
    one = s.sketch(s.shingles("a b"))
    assert len(set(one.tolist())) == 200
    rnd = random.Random(1)
    w = [f"{rnd.random()}" for _ in range(1000)]
    a, b = " ".join(w[:900]), " ".join(w[100:])
    same = (s.sketch(s.shingles(a)) == s.sketch(s.shingles(b))).mean()
    assert abs(same - 799 / 999) < 0.12


def test_every_pair_right_at_the_threshold_is_found(spark):
    docs = []
    for i in range(300):  # 80 words in common of 100
        w = [f"p{i}w{j}" for j in range(100)]
        docs += [(2 * i, " ".join(w[:90])), (2 * i + 1, " ".join(w[:80] + w[90:]))]
    got = {r.doc_id: r.component_id for r in nd.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), width=1).collect()}
    assert sum(got[2 * i + 1] == 2 * i for i in range(300)) / 300 == 1.0  # measured recall


def test_a_core_in_common_links_nothing_and_hides_no_link(spark):
    rnd = random.Random(3)
    core = [f"c{j}" for j in range(80)]
    own = lambda i, n: [f"t{i}w{j}" for j in range(n)]
    docs = [" ".join(core + own(i, 25)) for i in range(60)]  # similar to one another by 80 / 130
    docs += [" ".join(core[:-1] + own(i, 25) + ["x"]) for i in range(0, 60, 3)]  # near copies of a third of them
    docs += [" ".join(core[: rnd.randint(60, 80)] + own(i, rnd.randint(5, 40))) for i in range(100, 140)]
    docs = list(enumerate(docs))
    rnd.shuffle(docs)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in nd.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), width=1).collect()}
    assert got == brute(docs, 1)


def test_prefixes_count_what_follows(spark):
    from tidemark.llm import near_dup

    each = spark.createDataFrame([(1, s) for s in range(5)] + [(2, s) for s in range(1, 6)], "node long, shingle long")
    often = spark.createDataFrame([(s, 2) for s in range(1, 5)], "shingle long, c long")
    own = spark.createDataFrame([(1, 1), (2, 1)], "node long, own long")
    sizes = spark.createDataFrame([(1, 5), (2, 5)], "node long, n long")
    got = {(r.node, r.shingle): r.after for r in near_dup._prefixes(each, often, own, sizes, 4, 5).collect()}
    assert got == {(1, 1): 3, (2, 1): 3}
