"""Chat formatting, decontamination, licence scan and personal data."""

import collections
import hashlib
import itertools
import math
import random
import re

import duckdb
import pytest

from tidemark.llm import chat, decontam, entry, license_scan, pii

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(entry.ORACLE_SQL))
def test_agrees_with_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, sql = entry.QUERIES[name](spark, SF), c.sql(entry.ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert sorted(sql.columns) == cols
    want = sorted(tuple(r[sql.columns.index(x)] for x in cols) for r in sql.fetchall())
    assert sorted(tuple(r[x] for x in cols) for r in df.collect()) == want


def test_chat_keeps_maximal_conversations_only(spark):
    a = [("user", "hi"), ("assistant", "yes"), ("user", "more")]
    convs = {1: a[:1], 2: a[:2], 3: a, 4: a, 5: [*a[:2], ("user", "other")], 6: [("system", None)], 7: [(None, "")]}
    rows = [(k, i, r, x, 0) for k, v in convs.items() for i, (r, x) in enumerate(v)] + [(3, 0, "user", "hi", 0), (None, 0, "user", "alone", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pos int")
    got = {r.conv_id: r for r in chat.format_chats(df).collect()}
    assert set(got) == {3, 5, 6, 7, None}
    assert got[3].n_logs == 2 and got[3].n_turns == 3
    assert got[3].chat == "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in a)
    assert got[6].chat == "<|im_start|>system\n<|im_end|>\n" and got[7].chat == "<|im_start|>unknown\n<|im_end|>\n"
    assert chat.format_chats(df.limit(0)).collect() == []


def test_chat_sums_blocks_and_renders_parts(spark):
    rows = [(1, i, "user", f"t{i}") for i in range(1300)] + [(2, i, "user", f"t{i}") for i in range(1200)]
    got = sorted(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect(), key=lambda r: r.part)
    assert [(r.conv_id, r.part, r.n_turns) for r in got] == [(1, p, 1300) for p in range(6)]
    assert "".join(r.chat for r in got) == "".join(f"<|im_start|>user\nt{i}<|im_end|>\n" for i in range(1300))


def test_chat_tells_nulls_and_separators_apart(spark):
    lines = [(None, "x"), ("\x00", "x"), ("-", "x"), ("", "x"), ("a\x1fb", "c"), ("a", "b\x1fc"), ("a", None), ("a", "\x00"), ("1:a", "b"), ("a", "1:b")]
    rows = [(i, 0, r, x) for i, (r, x) in enumerate(lines)] + [(50, 0, "u", "long " * 200_000), (51, 0, "u", "long " * 200_000), (51, 1, "u", "")]
    schema = "conv_id long, turn long, role string, text string"
    assert {r.conv_id for r in chat.maximal(spark.createDataFrame(rows, schema)).collect()} == {*range(len(lines)), 51}
    loose = [(1, None, "u", f"t{i}") for i in range(700)] + [(1, 3, "u", "last"), (1, 3, "u", "also"), (1, -2, "u", "early"), (1, 3, "u", "last")]
    got = sorted(chat.format_chats(spark.createDataFrame(loose, schema)).collect(), key=lambda r: r.part)
    said = [x.split("\n")[1].split("<")[0] for x in "".join(r.chat for r in got).split("<|im_start|>")[1:]]
    assert [(r.part, r.n_turns) for r in got] == [(0, 703), (1, 703), (2, 703)] and sorted(said[:700]) == sorted(f"t{i}" for i in range(700))
    assert said[700] == "early" and set(said[701:]) == {"last", "also"}


def test_masks_survive_every_pair_of_substitutions():
    places = [{o + s for o in m} for m in decontam.MASKS for s in range(decontam.WINDOW - max(m))]
    for bad in itertools.combinations(range(decontam.WINDOW), decontam.SUBSTITUTIONS):
        assert any(not p & set(bad) for p in places)


def test_decontamination_by_brute_force(spark):
    rnd = random.Random(4)
    vocab = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(n))) for i, n in enumerate([40, 25, 13, 12, 7, 6, 5, 4, 1])] + [(9, None), (10, ""), (11, "--")]
    docs = []
    for k in range(120):
        words = [rnd.choice(vocab) for _ in range(rnd.randint(0, 60))]
        part = items[k % 9][1].split()
        a = rnd.randint(0, len(part) - 1)
        part = part[a : a + rnd.randint(1, 40)] if k % 2 else part
        for _ in range(k % 5):
            part[rnd.randrange(len(part))] = "zz"
        at = rnd.randint(0, len(words))
        docs.append((k % 100, " ".join([*words[:at], *part, *words[at:]]).upper()))
    docs += [(200, None), (201, ""), (None, items[0][1]), (202, " ".join(vocab) * 90 + " " + items[1][1])]

    want = {}
    for k, t in docs:
        d = re.findall(r"\w+", (t or "").lower())
        for i, it in items:
            b = (it or "").split()
            if not b:
                continue
            w = min(decontam.WINDOW, len(b))
            need = w - w * 2 // 13
            for shift in range(-len(b), len(d)):
                same = [0 <= j + shift < len(d) and d[j + shift] == b[j] for j in range(len(b))]
                if any(sum(same[s : s + w]) >= need for s in range(len(b) - w + 1)):
                    want[k, t, i] = max(want.get((k, t, i), 0), sum(same))
    df = spark.createDataFrame([(k, t, 0, 1) for k, t in docs], "doc_id long, text string, item_id int, bad_key int")
    bench = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, doc_id int")
    keys = {(r.doc_id, r.h): r.text for r in df.selectExpr("doc_id", "text", "xxhash64(text) AS h").collect()}
    for most in (decontam.BROADCAST_WORDS, 0):
        got = {(r.doc_id, keys[r.doc_id, r.text_hash], r.item_id): r.matched for r in decontam.contaminated(df, bench, broadcast_words=most).collect()}
        assert got == want
    bad = {(k, t) for k, t, _ in want}
    left = decontam.drop_contaminated(df, bench).collect()
    assert sorted(map(repr, ((r.doc_id, r.text) for r in left))) == sorted(repr(x) for x in docs if x not in bad)
    assert decontam.contaminated(df.limit(0), bench).collect() == decontam.contaminated(df, bench.limit(0)).collect() == []


def test_license_scan_finds_edited_notices_and_leaves_others(spark):
    mit, gpl = license_scan.NOTICES["mit-grant"], license_scan.NOTICES["gpl-header"]
    rows = [(1, f"Some words. {mit}, and more"), (2, gpl.replace("redistribute", "hand out").upper()), (3, "free software is good and free of charge"), (4, None), (5, ""), (6, "MIT")]
    got = {(r.doc_id, r.license): r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), license_scan.notices(spark)).collect()}
    assert set(got) == {(1, "mit-grant"), (2, "gpl-header")}
    assert got[1, "mit-grant"].word == 2 and got[1, "mit-grant"].matched == got[1, "mit-grant"].shingles
    assert got[2, "gpl-header"].matched < got[2, "gpl-header"].shingles


def test_license_scan_of_odd_rows_and_by_shuffles(spark):
    mit = license_scan.NOTICES["mit"]
    rows = [(1, f"{mit} All rights reserved.", 0), (1, "All rights reserved, and so on", 0), (None, mit, 0), (None, f"x {mit} {mit}", 0), (None, mit, 0), (7, "word " * 100_000 + mit, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, license int")
    got = sorted(((r.doc_id, r.license, r.word) for r in license_scan.scan(df, license_scan.notices(spark)).collect()), key=repr)
    assert got == sorted([(1, "mit", 0), (1, "all-rights-reserved-short", 5), (1, "all-rights-reserved-short", 0), (None, "mit", 0), (None, "mit", 1), (7, "mit", 100_000)], key=repr)
    assert sorted(((r.doc_id, r.license, r.word) for r in license_scan.scan(df, license_scan.notices(spark), broadcast_words=0).collect()), key=repr) == got
    assert license_scan.scan(df.limit(0), license_scan.notices(spark)).collect() == license_scan.scan(df, license_scan.notices(spark).limit(0)).collect() == []


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(t):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
            ok = {"email": True, "ip": kind != "ip" or all(int(x) < 256 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_personal_data_patterns_by_brute_force(spark, tmp_path):
    rnd = random.Random(6)
    bits = ["a@b.co", "a@b.c_d@e.fg", "x.y+z@m-1.example.com.", "1.2.3.4", "001.02.3.4.5", "256.1.1.1", "1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1112", "4242424242424242", "+1 (555) 123-4567", "+12", "+49 30 901820-0 ", "é", "🙂", " ", "\n", "word", "@", "9" * 30, "7" * 9, "-", "1.2.3.4@h.de", "..@a.b"]
    docs = [(i, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 25)))) for i in range(400)]
    docs += [(500, None), (501, ""), (502, "a" * 50000), (503, "1" * 50000), (504, "1.2.3.4 " * 700), (None, "a@b.cd")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in entry.op6_pii(spark, str(tmp_path)).collect()}
    assert len(got) == len(docs)
    for k, t in docs:
        spans = base_spans(t or "")
        text = ",".join(f"{a}:{b}:{c}" for a, b, c in spans)
        assert got[k].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [got[k][f"n_{x}"] for x in PATTERNS] == [sum(s[0] == x for s in spans) for x in PATTERNS]
        assert got[k].spans.split(",term:")[0] == text


def test_disclosing_words_are_found_and_replaced(spark):
    rows = [(i, f"Ask Zorblax the plumber at joe@site.org or call. Number {i} here") for i in range(4)]
    rows += [(10 + i, f"the plumber and his number {i} are here, ask or call at will") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: [rows[r.doc_id][1][x.s : x.e] for x in r.terms or []] for r in pii.find(df).collect() if r.doc_id < 4}
    assert all("Zorblax" in t and "the" not in t and "plumber" not in t for t in found.values())
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert clean[0].startswith("Ask [REMOVED] the plumber at [EMAIL] or call.") and clean[10] == rows[4][1]
    assert pii.sanitise(df.limit(0)).collect() == []


def test_words_beside_rare_entities_disclose_them(spark):
    rows = [(0, "Ask Zorblax the plumber at joe@site.org or call"), (1, "Quibbly calls from 10.1.2.3 at will"), (2, "Quibbly calls from 10.1.2.3 at will")]
    rows += [(10 + i, "the plumber calls or will ask from here") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert clean[0] == "Ask [REMOVED] the plumber at [EMAIL] or [REMOVED]"
    assert clean[1] == clean[2] == "[REMOVED] calls from [IP] [WORD] will"  # words of any length count: 3 of 63 rows have "at"
    assert all(clean[k] == t for k, t in rows if k >= 10)


def test_disclosing_words_go_wherever_the_entity_is_in_the_document(spark):
    far = "the plumber calls or will ask from here " * 40
    texts = {1: f"Zorblax {far}joe@site.org {far}ZORBLAX", 2: f"ask Zorblax {far}joe@site.org", 3: f"Zorblax {far}"}
    rows = [*texts.items(), (None, texts[1]), (None, texts[1])] + [(10 + i, far) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clean = collections.Counter((r.doc_id, r.text) for r in pii.sanitise(df).collect())
    assert clean[1, f"[WORD] {far}[EMAIL] {far}[WORD]"] == 1 and clean[2, f"ask [WORD] {far}[EMAIL]"] == 1
    assert clean[None, f"[WORD] {far}[EMAIL] {far}[WORD]"] == 2 and clean[3, texts[3]] == 1 and sum(clean.values()) == len(rows)


def test_disclosures_by_brute_force(spark):
    rnd = random.Random(12)
    ents = [f"u{i}@site.org" for i in range(8)]
    vocab = [f"word{i}" for i in range(60)]
    docs = [" ".join([rnd.choice(vocab) for _ in range(rnd.randint(1, 12))] + rnd.sample(ents, rnd.choice([0, 0, 1, 2]))) for _ in range(80)]
    split = [(set(re.findall(r"word[0-9]+", d)), set(re.findall(r"u[0-9]@site.org", d))) for d in docs]
    want = {}
    for k, (words, held) in enumerate(split):
        for w in words:
            best = max((math.log(sum(w in a and e in b for a, b in split) * len(docs) / (sum(w in a for a, _ in split) * (n := sum(e in b for _, b in split)))) / math.log(len(docs) / n) for e in held), default=0)
            if best >= pii.GENERALISE:
                want |= {(k, m.start(), m.end()): best >= pii.REMOVE for m in re.finditer(rf"\b{w}\b", docs[k])}
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    assert want and {(r.doc_id, x.s, x.e): x.remove for r in pii.find(df).collect() for x in r.terms or []} == want


def test_generalised_words_keep_their_class_and_no_column_is_lost(spark):
    far = "the plumber calls or will ask from here "
    rows = [(1, f"Zo X7 42 {far} joe@site.org", 1, 2, 3), (2, f"Zo X7 42 {far} joe@site.org", 1, 2, 3), (3, "Zo X7 42", 1, 2, 3)] + [(10 + i, far, i, i, i) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sk int, found_key int, __spans int")
    got = pii.sanitise(df)
    assert got.columns == df.columns
    clean = {r.doc_id: tuple(r)[1:] for r in got.collect()}
    assert clean[1] == (f"[WORD] [CODE] [NUMBER] {far} [EMAIL]", 1, 2, 3) and clean[3] == ("Zo X7 42", 1, 2, 3) and clean[10] == (far, 0, 0, 0)


def test_sanitise_joins_overlaps_and_keeps_other_columns(spark):
    common = [(i, "x é", "u") for i in range(2, 60)]  # words of any length disclose, so these must be common ones
    df = spark.createDataFrame([(1, "x 1.2.3.4@h.de +1 (555) 123-4567 é", "s"), (1, None, "t"), *common], "doc_id long, text string, source string")
    got = {r.source: r.text for r in pii.sanitise(df).where("doc_id = 1").collect()}
    assert got == {"s": "x [IP][EMAIL] [PHONE] é", "t": None}
