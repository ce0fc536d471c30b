from gridloom.llm import queries, suffix
from llm_rows import frame
from oracle import differences


def test_secret_scan_equals_sql(spark, sf):
    assert differences(spark, sf, queries.op2_secrets, queries.oracle_sql()["op2_secrets"]) == ""


def test_chat_equals_sql(spark, sf):
    assert differences(spark, sf, queries.op6_chat, queries.oracle_sql()["op6_chat"]) == ""


def test_seed_shared_by_blocks_without_repeats(spark):
    """The only shared seeds are inside strings of less than 400 bytes, so a bucket finds no repeats."""
    import random

    rnd = random.Random(8)
    own = lambda: "".join(rnd.choice("abcdefghij") for _ in range(600))
    shared = "".join(rnd.choice("klmnop") for _ in range(300))
    got = suffix.without_repeats(frame(spark, [own() + shared + own() for _ in range(6)])).collect()
    assert {(r.n_removed, r.n_spans) for r in got} == {(0, 0)} and len(got) == 6
