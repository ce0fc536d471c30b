import zlib

import numpy as np
from gridloom.llm import queries, token_index
from gridloom.llm.common import fresh_dir
from llm_rows import SCHEMA, frame

TEXTS = ["It's DON'T we'll", "ΣΑΣ Σ", "İstanbul ı", "é é Å", "a.b. c., d.,. e_f 12.5 x2.", "<|endoftext|> <|startoftext|>x", "\xa0 \x1c\x85 z", "日本語。テスト", "word. word, Word.", "😀👍🏽."]


def plain(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.word_tokenizer())
    return t.encode(text or "", add_special_tokens=False).ids + [1]


def test_round_trip(spark, odd_texts):
    texts = odd_texts + TEXTS
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_index.encode_and_read_back(frame(spark, texts), queries.word_tokenizer()).collect()}
    at = 0
    for i, t in enumerate(texts):
        ids = plain(t)
        assert got[i] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), t
        at += len(ids)


def test_repeated_and_null_keys(spark):
    rows = [(5, "b"), (5, "a a"), (None, "n"), (5, None), (None, "m"), (-3, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.start, r.doc_id, r.n_tokens) for r in token_index.encode_and_read_back(df, queries.word_tokenizer()).collect()))
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, at = [], 0
    for d, t in order:
        want.append((at, d, len(plain(t))))
        at += len(plain(t))
    assert got == want
    assert token_index.encode_and_read_back(spark.createDataFrame([], SCHEMA), queries.word_tokenizer()).count() == 0


def test_index_is_minimal_and_rejects_strangers(spark):
    rng = np.random.default_rng(1)
    for n in (1, 2, 50, 3000):
        h = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        seeds, slots = token_index.perfect_hash(h)
        assert sorted(slots.tolist()) == list(range(len(h))) and len(seeds) <= max(1, len(h))
    df = spark.createDataFrame([(i, f"t{i}") for i in range(200)], "doc_id long, text string")
    to = fresh_dir(spark, "tokens")
    records = token_index.write_shards(df, queries.word_tokenizer(), to)
    index, buckets = token_index.build_index(records, to)
    keys = spark.createDataFrame([(str(i),) for i in [5, 7, 7, *range(100_000, 100_300)]], "key string")
    assert sorted(r.key for r in token_index.lookup(keys, index, buckets, to).collect()) == ["5", "7"]


def test_control_strings_keep_their_case():
    encoder = token_index.WordEncoder(queries.word_tokenizer(), "<u2")
    for t in ("a <|ENDOFTEXT|> B", "<|StartOfText|>", "X<|endoftext|>Y Don't.", "É<|EndOfText|>é <|startoftext|>", "<|IM_END|> Word.", "<| ENDOFTEXT|>"):
        assert np.frombuffer(encoder.ids(t), "<u2").tolist() == plain(t)[:-1], t
