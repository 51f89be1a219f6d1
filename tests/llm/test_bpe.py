"""Byte-pair encoding against the tokenizers library."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillgrid.llm import bpe

ODD = ["a", "b", "e", "t", "h", "n", " ", "'", "s", "é", "É", "é", "Σ", "ΑΣ", "ß", "İ", "1", "٣", "\x1c", "\x85", "​", "　", "😀", "中", "!", "..", "<|endoftext|>", "<|startoftext|>", "<|endof", "\n", "\t", "'re", "'LL", "́", "ﬁ", "the", "ing", "aaaa", "ẛ̣", "각", "\x00"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.VOCABULARY)


def odd_texts():
    rng = random.Random(5)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += ["".join(rng.choice("abetinghos") for _ in range(rng.randint(0, 200))) for _ in range(500)]
    return texts + ["a" * n for n in range(130)] + ["", "x" * 70_000, "ab " * 60_000, "a" * 3000 + "b" * 77]


def test_words_match_the_library(library):
    encoder, texts = bpe.TextEncoder(bpe.VOCABULARY), odd_texts()
    for part in (texts[:2000], texts[2000:], texts[:10]):
        ids, starts = encoder.encode(part)
        want = library.encode_batch(part, add_special_tokens=False)
        assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == [w.ids for w in want]


def test_every_plain_character_is_cut_as_the_library_does(library):
    rng, encoder = random.Random(8), bpe.TextEncoder(bpe.VOCABULARY)
    texts = [a + chr(i) + b for i in range(0x400) for a, b in (("", ""), ("a", "b"), ("1", "'s"), (" ", " "))]
    texts += ["".join(chr(rng.randrange(0x250)) for _ in range(5)) for _ in range(5000)]
    ids, starts = encoder.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == [w.ids for w in library.encode_batch(texts, add_special_tokens=False)]


def test_every_token_and_pair_is_judged_as_merges_do(library):
    merges = bpe.PairMerges(__import__("json").load(open(bpe.VOCABULARY))["model"])
    rng, ids = random.Random(6), sorted(merges.text)
    plain = [i for i in ids if ord(merges.text[i][-1]) < bpe.END]
    for _ in range(3000):
        a, b = rng.choice(plain), rng.choice(ids)
        symbols = [merges.tokens[c] for c in merges.text[a] + merges.text[b]]
        while True:
            ranks = [(merges.rank[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in merges.rank]
            if not ranks:
                break
            i = min(ranks)[1]
            symbols[i : i + 2] = [merges.tokens[merges.text[symbols[i]] + merges.text[symbols[i + 1]]]]
        assert (symbols == [a, b]) == merges.stay_apart(a, b)


def test_tables_are_dropped_when_full(library, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_WORDS", 20)
    encoder, texts = bpe.TextEncoder(bpe.VOCABULARY), odd_texts()[:300]
    for at in range(0, 300, 30):
        ids, starts = encoder.encode(texts[at : at + 30])
        want = library.encode_batch(texts[at : at + 30], add_special_tokens=False)
        assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == [w.ids for w in want]


def test_columns_nulls_and_round_trip(spark, library):
    texts = [*odd_texts()[:200], None, "", "same", "same"]
    rows = [(i % 50 if i % 7 else None, t, "x", "y", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _text string, ids_ string, IDS int")
    coded = bpe.decode_ids(bpe.encode_texts(docs)).collect()
    assert len(coded) == len(rows) and set(coded[0].asDict()) == {"doc_id", "text", "_text", "ids_", "ids", "decoded"}
    for r in coded:
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == want and r["decoded"] == library.decode(want, skip_special_tokens=False)
    empty = bpe.decode_ids(bpe.encode_texts(docs.filter("false")))
    assert empty.count() == 0
    odd = spark.createDataFrame([([320, None, -1, 99999, 49407],), (None,), ([],)], "ids array<int>")
    assert [r[0] for r in bpe.decode_ids(odd).select("decoded").collect()] == ["a</w> <|endoftext|>", None, ""]


def test_query_matches_the_library(spark, sf_dir, library):
    got = {r["doc_id"]: r for r in bpe.op13_bpe_codec(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit(""))).collect()
    assert len(got) == len(docs)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for doc_id, text in docs:
        ids = library.encode(text, add_special_tokens=False).ids
        r = got[doc_id]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
