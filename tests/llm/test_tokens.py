import base64
import hashlib
import random

import public_tokenizers as P
import tiktoken
from tokenizers import Tokenizer, models

from tidemark.llm import bpe, entry, token_count

ALPHABET = ["a", "e", "th", "he", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", "é", "日本", "語", "🙂", "1", "23", "'s", "'ll", "!!", "<|endoftext|>", "́", "ß", "\x00"]
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(entry.BPE_RANKS, "rb"))}


def texts(n, seed=1, size=60):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, size))) for _ in range(n)]


def test_encoding_is_the_library_s():
    own = bpe.Encoder(bpe.Vocabulary(RANKS), P.PATTERN)
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    for t in [*texts(3000), "a" * 4000, " " * 700, "th" * 2000, "\n" * 300]:
        assert own.encode(t) == lib.encode_ordinary(t)


def test_appends_and_edits_equal_a_new_table():
    v, rnd = bpe.Vocabulary(RANKS), random.Random(2)
    for _ in range(150):
        data = bytes(rnd.choice(b"thean ing\xc3\xa9") for _ in range(rnd.randint(0, 150)))
        t = bpe.PrefixTable(v, data[: len(data) // 2])
        t.append(data[len(data) // 2 :])
        assert t.last == bpe.PrefixTable(v, data).last
        a = rnd.randint(0, len(data))
        b = rnd.randint(a, len(data))
        new = bytes(rnd.choice(b"thean") for _ in range(rnd.randint(0, 9)))
        t.replace(a, b, new)
        assert t.data == data[:a] + new + data[b:] and t.last == bpe.PrefixTable(v, t.data).last
    long_ = bpe.PrefixTable(v, b"therhean" * 400)
    assert long_.replace(5, 6, b"x") < 200


def test_query_digests_and_edges(spark):
    rows = [(1, "Hello thé world", 5), (1, "Hello thé world", 6), (2, "", 7), (3, None, 8), (None, "x " * 9000, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    got = bpe.encode(df, entry.BPE_RANKS, P.PATTERN, decoded=True)
    want = sorted(((k, lib.encode_ordinary(t or ""), (t or "").encode()) for k, t, _ in rows), key=repr)
    assert sorted(((r.doc_id, r.ids, bytes(r.decoded)) for r in got.collect()), key=repr) == want
    again = bpe.decode(got.drop("decoded"), entry.BPE_RANKS).collect()
    assert sorted(bytes(r.decoded) for r in again) == sorted(x[2] for x in want)
    assert bpe.encode(df.limit(0), entry.BPE_RANKS, P.PATTERN).collect() == []
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in entry.op4_byte_bpe(spark, sf).collect():
        ids = lib.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_counts_are_a_unigram_tokenizer_s(spark):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=entry.UNIGRAM_MODEL)
    pieces = [(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size())]
    lib = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    vocab = token_count.UnigramVocabulary.from_sentencepiece(entry.UNIGRAM_MODEL)
    rows = list(enumerate([t for t in texts(800, 3) if "<" not in t] + ["▁a▁▁b", "", None, "the " * 5000]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_count.count_tokens(df, vocab).collect()}
    assert got == {k: len(lib.encode("▁" + t.replace(" ", "▁")).ids) if t else 0 for k, t in rows}


def test_ties_take_the_longer_piece_and_unknowns_count_once_without_bytes():
    c = token_count.Counter(token_count.UnigramVocabulary((("a", -1.0), ("b", -1.0), ("ab", -2.0), ("c", -5.0)), byte_fallback=False))
    assert c.chunk("ab") == (1, -2.0) and c.chunk("abab") == (2, -4.0)
    assert c.chunk("azb") == (3, -17.0)
