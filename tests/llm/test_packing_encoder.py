"""The encoder of packing against the tokenizers library."""

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from fleetstats.llm import packing

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = "ab 's\n\t\x1c\xa0 é1٣日🙂-.,!?\x85ßÀñ한ا" + "ethoinsr "


def test_ids_of_odd_texts():
    rnd, library = random.Random(3), Tokenizer.from_file(TOKENIZER)
    texts = ["", " ", "a" * 3000, " " * 5000, "\n" * 3000 + "x", "x<|endoftext|> y", "<|endoftext|><|endoftext|>", "don't we'll I'D 'S"]
    texts += ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 60))) for _ in range(8000)]
    texts += ["".join(chr(c) for c in range(a, a + 16)) for a in range(0x20, 0xD7F0, 16)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.encoder(TOKENIZER, public_tokenizers.PATTERN)(texts)] == want


def test_runs_beyond_the_pattern_engine():
    text = " " * 1_000_000
    want = Tokenizer.from_file(TOKENIZER).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.encoder(TOKENIZER, public_tokenizers.PATTERN)([text])[0], "<u4").tolist() == want


def test_ranked_bytes_are_the_vocabulary():
    ranks, special = packing.ranked_bytes(TOKENIZER)
    assert len(ranks) + len(special) == 50_257 and ranks[b" the"] == Tokenizer.from_file(TOKENIZER).token_to_id("Ġthe")


def test_conversations_keep_three_limits(spark):
    import duckdb

    from fleetstats.llm import queries
    library = Tokenizer.from_file(TOKENIZER)
    want = {}
    for conv, role, text in duckdb.sql("select conv_id, role, text from '/root/testdata/sf0.01/conversations.parquet'").fetchall():
        n = len(library.encode(text or "", add_special_tokens=False).ids) + 1
        tokens, loss = want.get(conv, (0, 0))
        want[conv] = (tokens + n, loss + n * (role == "assistant"))
    got = queries.QUERIES["packing_conversations"](spark, "/root/testdata/sf0.01").toPandas()
    assert {r.conv_id: (r.length, r.loss_tokens) for r in got.itertuples()} == want
    limits = queries.INSTRUCTIONS
    inside = got[~got.over_limit].groupby("sequence_id").agg(n=("length", "sum"), x=("loss_tokens", "sum"), k=("conv_id", "size"))
    assert inside.n.max() <= limits.tokens and inside.x.max() <= limits.loss and inside.k.max() <= limits.segments
    assert (got.over_limit == ((got.length > limits.tokens) | (got.loss_tokens > limits.loss))).all()
    # The loss limit binds: by tokens alone fewer sequences would do.
    assert inside.x.sum() / limits.loss > inside.n.sum() / limits.tokens


def test_short_documents_force_no_padding(spark):
    docs = spark.createDataFrame([(i, "a b") for i in range(3000)], "doc_id long, text string").coalesce(1)
    from fleetstats.llm import queries
    got = packing.pack_documents(docs, TOKENIZER, public_tokenizers.PATTERN, queries.SEQUENCE).groupBy("sequence_id").sum("length").toPandas()
    full = got["sum(length)"]
    assert ((full == 1024) | (full & (full - 1) == 0)).all() and (full == 1024).sum() == full.sum() // 1024
