"""Encoding against a public library, and packing by its invariants."""

import random

import pytest

tokenizers = pytest.importorskip("tokenizers")

from threadloom.llm.packing import balance, pack  # noqa: E402
from threadloom.llm.tokenizer import count_tokens, encode_texts, encoder, round_trips  # noqa: E402

TEXTS = [
    None, "", " ", "\n\n  \t", "hello world", "It's 12:30, isn't it?", "Привет, как дела?", "対話の記録 مرحبا שלום", "🇪🇺 👩🏽‍💻 🏴󠁧󠁢󠁳󠁣󠁴󠁿", "a" * 5000, "ab" * 3000, " " * 3000 + "x",
    "<|endoftext|> is text", "naïve café ﬁne ½ Ⅷ", "été й", "0x7f 1e-9 00012", "x\u0000y", "".join(chr(c) for c in range(32, 900)), "the " * 2000,
]


def test_ids_equal_the_public_library(spark):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    reference.encode_special_tokens = True
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)]
    got = {x.doc_id: x.ids for x in encode_texts(spark.createDataFrame(rows, "doc_id long, text string, ids string")).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i] == reference.encode(t or "", add_special_tokens=False).ids, t


def test_round_trip_counts_and_empty_table(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] * 2, "doc_id long, text string")
    back = round_trips(df).collect()
    assert len(back) == 2 * len(TEXTS) and all(x.same for x in back)
    assert {x.doc_id: x.n_tokens for x in count_tokens(df).collect()} == {x.doc_id: x.n_tokens for x in back}
    assert encode_texts(df.limit(0)).count() == 0


def test_random_words_equal_tiktoken():
    tiktoken = pytest.importorskip("tiktoken")
    e = encoder()
    own = tiktoken.Encoding("own", pat_str=r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""", mergeable_ranks=e.ranks, special_tokens={})
    r = random.Random(5)
    for _ in range(300):
        text = "".join(r.choice("abcdeёжщ 🙂ü\n.,'12ß中") for _ in range(r.randint(0, 60)))
        assert e.encode(text) == own.encode_ordinary(text)
        assert e.decode(e.encode(text)) == text


def test_balance_never_overfills():
    r = random.Random(2)
    sizes = sorted((r.randint(1, 100) for _ in range(2000)), reverse=True)
    into = balance(sizes, 100)
    used = {}
    for n, s in zip(sizes, into, strict=True):
        used[s] = used.get(s, 0) + n
    assert max(used.values()) <= 100
    assert len(used) <= 1.02 * sum(sizes) / 100 + 1


def test_packing_keeps_items_whole(spark):
    r = random.Random(4)
    sizes = [(i, r.choice([0, None, r.randint(1, 50), r.randint(40, 700)])) for i in range(800)] + [(9000, 64), (9001, 128), (9002, 1)]
    df = spark.createDataFrame([(i, n, 0) for i, n in sizes], "doc_id long, n_tokens long, capacity long")
    rows = pack(df, [64, 1000], block_rows=300).collect()
    want = {i: n or 0 for i, n in sizes}
    for cap in (64, 1000):
        mine = [x for x in rows if x.capacity == cap]
        pieces, fill = {}, {}
        for x in mine:
            pieces.setdefault(x.doc_id, []).append(x)
            if x.container is None:
                assert want[x.doc_id] == 0 and x.piece_tokens == 0
            else:
                fill[x.container] = fill.get(x.container, 0) + x.piece_tokens
        assert set(pieces) == set(want)
        assert max(fill.values()) <= cap
        for i, own in pieces.items():
            own.sort(key=lambda x: x.piece_no)
            assert len(own) == 1 or want[i] > cap
            assert [x.start_token for x in own] == [k * cap for k in range(len(own))]
            assert sum(x.piece_tokens for x in own) == want[i]
        assert len(fill) <= 1.1 * sum(want.values()) / cap + 3
    assert pack(df.limit(0), [64]).count() == 0
    with pytest.raises(ValueError):
        pack(df, [])
