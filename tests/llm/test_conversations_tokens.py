import random
from datetime import datetime, timedelta

import pytest

from memloom.llm import conversations as C
from memloom.llm import tokens as K

SCHEMA = "user_id string, session_id string, request_id string, message_index int, msg_id long, role string, timestamp string, tz string, content string, at int"


def rows(kind, *turns, user="u", session="s"):
    return [(user, f"{session}{kind}", f"r{kind}{k}", 0, k + 1000 * kind, role, f"2024-01-01 10:{m:02d}:00", None, text, 7) for k, (role, m, text) in enumerate(turns)]


def messages():
    out = []
    out += rows(1, ("User ", 2, "b"), ("ai", 3, "c"), ("human", 0, "a"), ("ASSISTANT", 1, "x"), ("system", 0, None))
    out += rows(2, ("user", 0, "a"), ("user", 1, "b"), ("assistant", 2, "c"))  # does not alternate
    out += rows(3, ("user", 0, "a"))  # lacks a reply
    out += rows(4, ("user", 0, " \u00a0"), ("assistant", 1, "b"))  # blank
    out += rows(5, ("user", 0, "a"), ("assistant", 1, "b"), ("narrator", 2, "c"))  # unknown role
    out += rows(6, ("system", 0, "a"))  # none remain
    out += rows(7, ("assistant", 0, "a"), ("user", 1, "b"))
    out += rows(8, ("user", 0, "a"), ("assistant", 0, "b"))  # a tie, by index and id
    out += rows(9, ("user", 0, "a"), (None, 1, "b"))
    same = rows(1, ("User ", 2, "b"))[0]
    out.append((*same[:4], 1900, *same[5:]))  # delivered again
    return out + [same]


EXPECTED = {("u", "s1", 1, 1002), ("u", "s1", 2, 1003), ("u", "s1", 3, 1000), ("u", "s1", 4, 1001), ("u", "s8", 1, 8000), ("u", "s8", 2, 8001)}


@pytest.mark.parametrize("group_rows", [2000, 0, 3])
def test_rebuild(spark, group_rows):
    """The array way and the sorted way agree."""
    got = C.rebuild(spark.createDataFrame(messages(), SCHEMA), group_rows).collect()
    assert {(r.user_id, r.session_id, r.turn_no, r.msg_id) for r in got} == EXPECTED and len(got) == len(EXPECTED)


def test_null_keys_and_empty(spark):
    df = spark.createDataFrame([(None, None, None, None, 1, "user", "2024-01-01", None, "a", 1), (None, None, None, None, 2, "assistant", "2024-01-02", None, "b", 1)], SCHEMA)
    assert [(r.turn_no, r.msg_id) for r in C.rebuild(df).orderBy("turn_no").collect()] == [(1, 1), (2, 2)]
    assert C.rebuild(df.limit(0)).count() == 0


@pytest.mark.parametrize("group_rows", [2000, 0])
def test_long_conversation(spark, group_rows):
    start, order = datetime(2024, 1, 1), list(range(600))
    random.Random(1).shuffle(order)
    data = [("u", "s", f"r{k}", 0, k, "user" if k % 2 == 0 else "assistant", str(start + timedelta(minutes=k)), None, "t", 1) for k in order]
    got = C.rebuild(spark.createDataFrame(data, SCHEMA), group_rows).collect()
    assert sorted((r.turn_no, r.msg_id) for r in got) == [(k + 1, k) for k in range(600)]


def test_kahn():
    assert C.kahn([(2,), (1,), (3,)], [(0, 1)]) == [0, 1, 2]
    assert C.kahn([(1,), (2,)], [(0, 1), (1, 0)]) == []


def test_cycles_drop(spark):
    base = rows(1, ("user", 0, "a"), ("assistant", 1, "b"))
    df = spark.createDataFrame([(*r, p) for r, p in zip(base, (1001, 1000), strict=True)], SCHEMA + ", reply_to long")
    assert C.rebuild(df).count() == 0
    good = spark.createDataFrame([(*r, p) for r, p in zip(base, (None, 1000), strict=True)], SCHEMA + ", reply_to long")
    assert C.rebuild(good).count() == 2


def test_reply_graphs_of_any_size(spark):
    """Random reply graphs, late parents and cycles included: both ways keep the same conversations in the same order."""
    rng, data = random.Random(11), []
    for c in range(120):
        n, ids = rng.choice([2, 4, 6, 10, 40]), rng.sample(range(10_000), 40)
        for k in range(n):
            parent = ids[rng.randrange(n)] if rng.random() < (0.9 if c % 3 == 0 else 0.2) else ids[k - 1] if k and c % 3 == 1 else None
            at = rng.randrange(n) if c % 2 else k
            data.append(("u", f"s{c}", f"r{rng.randrange(3)}", k, c * 10_000 + ids[k], "user" if k % 2 == 0 else "ai", f"2024-01-01 10:{at:02d}:00", None, "t", 1, None if parent is None else c * 10_000 + parent))
    for k in range(3000):  # every reply was stamped before what it answers
        data.append(("u", "back", f"q{k}", 0, 9_000_000 + k, "user" if k % 2 == 0 else "ai", str(datetime(2024, 1, 2) - timedelta(seconds=k)), None, "t", 1, 9_000_000 + k - 1 if k else None))
    df = spark.createDataFrame(data, SCHEMA + ", reply_to long").repartition(4)
    ways = [{(r.session_id, r.turn_no, r.msg_id) for r in C.rebuild(df, g).collect()} for g in (5000, 5, 0)]
    assert ways[0] == ways[1] == ways[2] and len({s for s, _, _ in ways[0]}) > 5
    assert {(t, m) for s, t, m in ways[0] if s == "back"} == {(k + 1, 9_000_000 + k) for k in range(3000)}


TEXTS = ["Hello world, hello world!", "", None, " ", "\n\n\t x", "don't we'll", "Ünïcödé 日本語 テスト", "a\u00a0b\u2003c\u3000d", "<|endoftext|> x", "😀👍🏽 é́", "1234567890 12", "x" * 30_000, "\r\n \r\n", "word " * 3000]


@pytest.mark.parametrize("hot", [0, 2, 4096])
def test_ids_equal_the_whole_text(spark, hot):
    import base64

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    whole = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(TEXTS)] + [(0, TEXTS[0], 1)], "doc_id long, text string, ids int")
    got = K.encode_corpus(df, hot_words=hot)
    back = {r.doc_id: r.text for r in K.decode_corpus(got).collect()}
    ids = {r.doc_id: r.ids for r in got.collect()}
    assert len(ids) == len(TEXTS) == got.count()
    for k, t in enumerate(TEXTS):
        assert ids[k] == whole.encode_ordinary(t or ""), t
        assert back[k] == (t or "")


def test_no_documents(spark):
    assert K.encode_corpus(spark.createDataFrame([], "doc_id long, text string")).count() == 0
