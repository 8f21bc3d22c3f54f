import collections
import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from stationflow.llm import bpe, packing, token_files, tokens
from stationflow.session import scratch_path

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(3)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    made = ["".join(rnd.choice(points[:limit]) for _ in range(300)) for limit in (0x80, 0x100, 0x250, 0x3000, len(points)) for _ in range(12)]
    made += ["aaaa" * 700, "ab" * 900, "it's DON'T 'LL x'Re", "<|endoftext|>a<|startoftext|><|endoftext|>", "<|ENDOFTEXT|>", "a\x1cb\x1f c\x85d\xa0e", "ΑΣ. ΑΣ́Σ", "\x00 a \x00", "", None]
    return made


@pytest.mark.parametrize("kind", ["library", "backtracking"])
def test_ids_equal_the_library(texts, kind):
    words = bpe.chunk_encoder(PATH) if kind == "backtracking" else None
    encoder = tokens.TextEncoder(PATH, words)
    for some in (texts, texts[::-1], texts[:7]):
        ids, lengths = encoder.encode(pa.array(some, pa.string()))
        for got, text in zip(np.split(ids, np.cumsum(lengths)[:-1]), some, strict=True):
            assert got.tolist() == ids_of(text)


def test_a_full_chunk_table_changes_nothing(monkeypatch, texts):
    monkeypatch.setattr(tokens, "MAX_CHUNKS", 20)
    encoder = tokens.TextEncoder(PATH)
    for text in texts[::-1] + texts:
        assert encoder.encode(pa.array([text], pa.string()))[0].tolist() == ids_of(text)


def test_other_rules_go_through_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = tokens.TextEncoder(path)
    assert not encoder.by_chunks
    library = Tokenizer.from_file(path)
    ids, lengths = encoder.encode(pa.array(["Two  words", None, " x"]))
    assert ids.tolist() == [i for t in ("Two  words", "", " x") for i in library.encode(t, add_special_tokens=False).ids]
    assert lengths.sum() == len(ids)


def test_every_token_is_its_own_encoding_or_unreachable():
    own = bpe.BacktrackingBPE(PATH)
    rnd = random.Random(1)
    for _ in range(3000):
        word = "".join(rnd.choice("abeinorst'é") for _ in range(rnd.randrange(1, 14)))
        symbols = ["".join(own_symbol[b] for b in p.encode()) for own_symbol in [bpe.byte_symbols()] for p in [word.replace("'", "")] if p]
        for s, plain in zip(symbols, [word.replace("'", "")], strict=False):
            assert own.encode(s) == ids_of(plain)


def test_encode_decode(odd, none):
    rows = bpe.encode_decode(odd, PATH).collect()
    assert len(rows) == odd.count()
    for r in rows:
        want = ids_of(r["text"])
        shown = LIBRARY.decode(want, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids"], r["decoded"]) == (len(want), want, shown)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(shown.encode()).hexdigest()
        assert r["score"] == "kept"
    assert bpe.encode_decode(none, PATH, digests_only=True).count() == 0


def test_token_files(spark, odd, none):
    path = scratch_path(spark, "files")
    token_files.write_token_files(odd, path, PATH)
    rows = token_files.with_crc(token_files.read_token_files(spark, path)).orderBy("start").collect()
    want = collections.Counter((r["doc_id"], crc(ids_of(r["text"]) + [2])) for r in odd.collect())
    assert collections.Counter((r["doc_id"], r["ids_crc32"]) for r in rows) == want
    assert [r["doc_id"] for r in rows] == sorted((r["doc_id"] for r in rows), key=lambda i: (i is not None, i))
    start = 0
    for r in rows:
        assert r["start"] == start
        start += r["n_tokens"]
    looked_up = token_files.look_up(spark, path, [5])
    assert "In(doc_id" in looked_up._jdf.queryExecution().toString() or "EqualTo(doc_id" in looked_up._jdf.queryExecution().toString()
    assert looked_up.count() == 2
    empty = scratch_path(spark, "files")
    token_files.write_token_files(none, empty, PATH)
    assert token_files.read_token_files(spark, empty).count() == 0


@pytest.mark.parametrize("limits", [{}, {"max_tokens": 64, "max_segments": 2, "max_loss": 40, "pool": 4}])
def test_packing(odd, limits):
    most = {"max_tokens": 4096, "max_segments": 128, "max_loss": 4096} | limits
    pieces = packing.pack(odd, PATH, **limits).collect()
    want = collections.Counter()
    for r in odd.collect():
        want.update((r["doc_id"], i, t) for i, t in enumerate(ids_of(r["text"]) + [2]))
    docs = {}
    for r in odd.collect():
        docs.setdefault(r["doc_id"], ids_of(r["text"]) + [2])
    got, sequences = collections.Counter(), collections.defaultdict(list)
    for p in pieces:
        own = docs[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert p["ids_crc32"] == crc(own) and p["doc_tokens"] == len(docs[p["doc_id"]])
        got.update((p["doc_id"], p["start"] + i, t) for i, t in enumerate(own))
        sequences[p["sequence_id"]].append(p)
    assert got == want
    for own in sequences.values():
        own.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in own] == [sum(q["length"] for q in own[:i]) for i in range(len(own))]
        total = sum(p["length"] for p in own)
        assert total & (total - 1) == 0 and total <= most["max_tokens"]
        assert len(own) <= most["max_segments"] and sum(p["loss_tokens"] for p in own) <= most["max_loss"]


def test_packing_counts_loss_from_the_end(spark):
    docs = spark.createDataFrame([(1, "one two three four", 2), (2, "five six", None), (3, "seven", -4), (4, "eight", 99)], "doc_id int, text string, loss long")
    rows = packing.pack(docs, PATH, loss_col="loss", max_loss=3).groupBy("doc_id").sum("loss_tokens", "length").orderBy("doc_id").collect()
    assert [r[1] for r in rows] == [2, 3, 0, 2]
    assert [r[2] for r in rows] == [5, 3, 2, 2]


def test_packing_nothing(none):
    assert packing.pack(none, PATH).count() == 0


def test_the_query_packs_under_three_limits(spark):
    from pyspark.sql import functions as F

    from stationflow.llm.queries import PACKING, QUERIES

    pieces = QUERIES["op10_packing"](spark, "/root/testdata/sf0.01")
    of = pieces.groupBy("sequence_id").agg(F.sum("length").alias("tokens"), F.count("*").alias("segments"), F.sum("loss_tokens").alias("loss")).collect()
    assert max(r["tokens"] for r in of) == 4096 and all(r["tokens"] == 4096 or r["tokens"].bit_count() == 1 for r in of)
    # the other two limits hold, and each of them binds somewhere
    assert max(r["segments"] for r in of) == PACKING["max_segments"] and max(r["loss"] for r in of) == PACKING["max_loss"]
    by_doc = pieces.groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n"), F.sum("loss_tokens").alias("loss")).collect()
    assert all(r["n"] == r["doc_tokens"] and r["loss"] == -(-r["doc_tokens"] // 3) for r in by_doc)


def test_a_vocabulary_with_a_decoder_is_refused(none):
    from stationflow.llm.queries import BYTE_VOCABULARY

    with pytest.raises(ValueError, match="decoder"):
        bpe.encode_decode(none, BYTE_VOCABULARY)


def test_chunks_merged_by_ranks_have_the_librarys_ids():
    texts = [r["text"] for r in pq.read_table("/root/testdata/sf0.001/documents.parquet").select(["text"]).to_pylist()]
    texts += [" ".join(f"a{chr(c)}b {chr(c)} 1{chr(c)}2 {chr(c)}'s{chr(c)}'LL{chr(c)}" for c in range(s, s + 256)) for s in range(0, 0x3000, 256)]
    texts += ["x" * 7_000 + " yes", "é" * 6_000, "don't DON'T it'S 'tis rock'n'roll 12345 a1b2", "<|endoftext|> a<|startoftext|>b", "a\x00b \x00"]
    ours = tokens.TextEncoder(PATH)
    assert ours.ranks is not None
    ids, lengths = ours.encode(pa.array(texts))
    got = np.split(ids, np.cumsum(lengths)[:-1])
    for text, own, want in zip(texts, got, ours.library_ids(texts), strict=True):
        assert own.tolist() == want, text[:80]
