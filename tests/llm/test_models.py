"""Language-model scores, tokenizer alignment and vector codes against plain versions."""

import collections
import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stationflow.llm import alignment, code_compression, gated_lm
from stationflow.llm.queries import BYTE_VOCABULARY, PIECE_MODEL, QUERIES, VOCABULARY

TABLES = "/root/testdata/sf0.001"


# Language model ------------------------------------------------------------------------


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def small_network(kind=np.float64):
    layout = gated_lm.Layout(np.array([5, 40, 30, 20, 10, 9, 8, 7, 6, 5, 4, 3.0]), 50)
    parameters = {k: v.astype(kind) for k, v in gated_lm.start(layout).items()}
    return gated_lm.Network(parameters, layout)


def test_gradients_are_those_of_the_loss():
    net, rng = small_network(), np.random.default_rng(0)
    codes, fresh, y = rng.integers(0, 13, (5, 3)), rng.random((5, 3)) < 0.3, rng.integers(-1, 13, (5, 3))
    state = rng.normal(size=(3, gated_lm.STATE))

    def loss():
        made, _ = net.states(codes, fresh, state)
        used = y.ravel() >= 0
        return -net.log_likelihood(made.reshape(-1, gated_lm.STATE)[used], y.ravel()[used]).mean()

    g, after, total = net.gradients(codes, fresh, y, state)
    assert np.isclose(total / (y >= 0).sum(), loss()) and np.allclose(after, net.states(codes, fresh, state)[0][-1])
    for name, p in net.p.items():
        for _ in range(8):
            at = tuple(rng.integers(0, n) for n in p.shape)
            kept = p[at]
            p[at] = kept + 1e-4
            up = loss()
            p[at] = kept - 1e-4
            down = loss()
            p[at] = kept
            assert abs((up - down) / 2e-4 - g[name][at]) < 1e-6, name


def test_the_output_is_a_distribution_and_starts_as_the_unigram():
    net = small_network()
    every = np.arange(13)
    for scale in (0, 3):
        h = np.repeat(np.random.default_rng(1).normal(size=(1, gated_lm.STATE)) * scale, 13, 0)
        assert np.isclose(np.exp(net.log_likelihood(h, every)).sum(), 1)
    counts = np.append(net.layout.counts, 50) + 1
    assert np.allclose(np.exp(net.log_likelihood(np.zeros((13, gated_lm.STATE)), every)), counts / counts.sum())


@pytest.mark.parametrize("lanes, steps", [(1, 1), (2, 3), (7, 16), (100, 4)])
def test_the_state_is_carried_across_windows_and_starts_anew_with_a_document(monkeypatch, lanes, steps):
    net, rng = small_network(), np.random.default_rng(3)
    lengths = np.array([1, 50, 3, 17, 1, 90, 8])
    codes = rng.integers(1, 13, lengths.sum())
    codes[np.cumsum(lengths) - 1] = gated_lm.END
    monkeypatch.setattr(gated_lm, "LANES", lanes)
    monkeypatch.setattr(gated_lm, "STEPS", steps)
    got = gated_lm.score_codes(net, codes, lengths)
    for doc, score in zip(np.split(codes, np.cumsum(lengths)[:-1]), got, strict=True):
        before = np.concatenate([[gated_lm.END], doc[:-1]])[:, None]
        fresh = np.zeros((len(doc), 1), bool)
        fresh[0] = True
        made, _ = net.states(before, fresh, np.ones((1, gated_lm.STATE)))
        assert np.isclose(score, net.log_likelihood(made[:, 0], doc).sum() / math.log(10))


def test_places_are_packed_and_unpacked():
    for places in ([], [0], [1, 65_535, 65_536, 5_000_000, 2**31]):
        assert gated_lm._unpacked(gated_lm._packed(np.array(places, np.int64))).tolist() == places


def check_counts(rows, texts, learn):
    """Counts and base scores of the result rows of (id, text) by a plain count."""
    count = collections.Counter()
    for text, own in zip(texts, learn, strict=True):
        if own:
            count.update([*words(text), "\n"])
    total, distinct = sum(count.values()), len(count)
    want = []
    for text in texts:
        own = [*words(text), "\n"]
        want.append((len(own), sum(count[w] > 0 for w in own), total, round(sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in own), 5)))
    got = [(r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in rows]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("chunk", [2_000, 32_000_000])
def test_counts_of_odd_rows(spark, odd, none, monkeypatch, chunk):
    monkeypatch.setattr(gated_lm, "CHUNK_BYTES", chunk)
    learn = F.coalesce(F.col("doc_id"), F.lit(1)) % 2 == 1
    rows = gated_lm.score(odd, learn, head=20).collect()
    source = odd.collect()
    check_counts(rows, [r["text"] for r in source], [(1 if r["doc_id"] is None else r["doc_id"]) % 2 == 1 for r in source])
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in source)
    assert gated_lm.score(none, F.lit(True)).count() == 0
    untaught = gated_lm.score(odd, F.lit(False)).collect()
    assert len(untaught) == len(source) and all(r["train_tokens"] == r["n_known"] == 0 and np.isfinite(r["score"]) for r in untaught)


def test_the_model_beats_the_counts_on_held_out_documents(spark):
    rows = QUERIES["op11_lm_scoring"](spark, TABLES.replace("0.001", "0.01")).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{TABLES.replace('0.001', '0.01')}/documents.parquet").collect()}
    check_counts(rows, [docs[r["doc_id"]] for r in rows], [not r["held_out"] for r in rows])
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.97 * sum(r["base_score"] for r in held)
    assert sum(r["score"] > r["base_score"] for r in held) > 0.95 * len(held)


# Alignment -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair(BYTE_VOCABULARY, PIECE_MODEL)


def test_products_of_sparse_matrices():
    rng = np.random.default_rng(5)
    for n, k, m in ((1, 1, 1), (6, 9, 4), (30, 12, 20)):
        a, b = (rng.random((n, k)) < 0.3).astype(int), (rng.random((m, k)) < 0.3).astype(int)
        csr = lambda x: alignment.CSR(np.concatenate([[0], np.cumsum(x.sum(1))]), np.nonzero(x)[1], x.shape[1])
        for step in (1, 10**6):
            got = np.zeros((n, m), int)
            for i, j, v in csr(a).times(csr(b).transposed(), step):
                got[i, j] += v
            assert (got == a @ b.T).all()
        assert (csr(a).row_sizes(csr(b).transposed()) == (a @ b.T).sum(1)).all()


def test_both_tokenizers_give_the_libraries_ids(spark, pair):
    texts = [r["text"] for r in spark.read.parquet(f"{TABLES}/documents.parquet").select("text").collect()]
    texts += [" ".join(f"a{chr(c)}b {chr(c)} 1{chr(c)}2  {chr(c)}'s{chr(c)}" for c in range(s, s + 250)) for s in [*range(0, 0x3000, 250), 0x1F600, 0xAC00, 0xFB00]]
    texts += ["", " ", "  a", "a ", "a  b", "\n a", "a \nb\n c", "▁x ▁", "x" * 6_000 + " y", " \t" * 3_000, "it's <|endoftext|> <s>", "a  b 　c", None]
    library = Tokenizer.from_file(BYTE_VOCABULARY)
    library.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    got_a, got_b = pair.ids(pa.array(texts))
    for text, a, b in zip(texts, got_a, got_b, strict=True):
        assert a.tolist() == (library.encode(" " + text, add_special_tokens=False).ids if text else []), text
        assert b.tolist() == (pieces.encode(text) if text else []), text


def test_other_vocabularies_go_through_the_library():
    assert alignment.by_ranks(VOCABULARY) is None and alignment.by_ranks(BYTE_VOCABULARY) is not None


def plain_alignment(pair, text):
    """Ids, overlap links and groups of one text, token by token."""
    a = pair.a.encode(" " + text, add_special_tokens=False).ids if text else []
    b = pair.b.encode(text) if text else []
    spans = []
    for ids, s in ((a, pair.bytes_a), (b, pair.bytes_b)):
        at, own, whole = 0, [], b""
        for i in ids:
            part = s.buffer[s.starts[i] : s.starts[i] + s.lengths[i]].tobytes()
            own.append((at, at + len(part)))
            at += len(part)
            whole += part
        if not text or whole != (" " + text).encode():
            return [], [], [], [], 0
        spans.append(own)
    links = [(i, j) for i, (s, e) in enumerate(spans[0]) for j, (x, y) in enumerate(spans[1]) if s < y and x < e]
    cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
    of = lambda own: [[i for i, (_, e) in enumerate(own) if lo < e <= hi] for lo, hi in zip([0, *cuts[:-1]], cuts, strict=True)]
    return a, b, links, list(zip(of(spans[0]), of(spans[1]), strict=True)), len(cuts)


def test_alignment_by_brute_force(spark, odd, none, pair):
    texts = [r["text"] for r in spark.read.parquet(f"{TABLES}/documents.parquet").select("text").collect() if len(r["text"]) < 1500][:60]
    docs = odd.where("coalesce(doc_id, 0) <> 7").select("doc_id", "text", "score").union(
        spark.createDataFrame([(1000 + i, t, "x") for i, t in enumerate([*texts, "ﬁ <s>", "  two  spaces\n", "naïve café " * 5])], "doc_id long, text string, score string")
    )
    rows = docs.collect()
    plain = [plain_alignment(pair, r["text"]) for r in rows]
    count = collections.Counter((a[i], b[j]) for a, b, links, _, _ in plain for i, j in links)
    most = {}
    for (_, y), n in count.items():
        most[y] = max(most.get(y, 0), n)
    want = []
    for r, (a, b, links, groups, n) in zip(rows, plain, strict=True):
        pairs = [(a[i], b[j]) for i, j in links]
        text = ";".join(",".join(str(a[i]) for i in x) + "|" + ",".join(str(b[j]) for j in y) for x, y in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if a else ""
        want.append((str(r["doc_id"]), len(a), len(b), n, len(links), sum(len(x) * len(y) for x, y in groups), sum(count[p] == most[p[1]] for p in pairs), sum(count[p] for p in pairs), digest))
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_shared", "n_best", "count_sum", "groups_sha256"]
    found = alignment.align(docs.repartition(4), BYTE_VOCABULARY, PIECE_MODEL)
    assert found.columns == ["doc_id", *alignment.NUMBERS, "groups_sha256", "n_best", "count_sum"]
    assert sorted((str(r["doc_id"]), *(r[c] for c in columns[1:])) for r in found.collect()) == sorted(want)
    assert alignment.align(none, BYTE_VOCABULARY, PIECE_MODEL).count() == 0
    long = alignment.align(odd.where("doc_id = 7"), BYTE_VOCABULARY, PIECE_MODEL).first()
    assert long["n_a"] > 30_000 and long["n_links"] >= max(long["n_a"], long["n_b"])


def test_alignment_stores_each_chunk_alone(spark, pair):
    # Writer and reader hold all rows of a row group at once, and a row is a chunk: a task's chunks must not be one group.
    import pyarrow.parquet as pq

    docs = spark.range(12, numPartitions=1).selectExpr("id", "concat('some words of text ', id) AS text")
    most = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")  # a chunk holds rows of one batch
    try:
        chunks = alignment._chunks(docs, BYTE_VOCABULARY, PIECE_MODEL)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
    stored = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in chunks.inputFiles()]
    rows = [m.row_group(i).num_rows for m in stored for i in range(m.num_row_groups)]
    assert chunks.count() > 1 and set(rows) == {1}
    assert sorted(i for r in chunks.collect() for i in r["id"]) == list(range(12))



def test_shared_group_links(pair):
    text = "an unusual café, naïve"
    a, b = pair.ids(pa.array([text]))
    found = alignment.Aligned(pair, text, a[0], b[0])
    shared = {(int(i), int(j)) for part in found.shared() for i, j, _ in zip(*part, strict=True)}
    want = {(i, j) for x, y in plain_alignment(pair, text)[3] for i in x for j in y}
    assert shared == want and found.n_shared() == len(want)


# Vector codes --------------------------------------------------------------------------


@pytest.mark.parametrize("n, width, k", [(1, 4, 1), (3, 4, 3), (70, 4, 64), (900, 1, 7), (2000, 4, 64), (300, 0, 5)])
def test_two_trees_assign_as_the_plain_search(n, width, k):
    rng = np.random.default_rng(n)
    points = rng.integers(-9, 9, (3, n, width)) * rng.integers(1, 40, (3, n, 1))
    books = np.ascontiguousarray(points[:, rng.integers(0, n, k)])  # equal entries too
    levels = code_compression._levels(n, code_compression.LEAF)
    order = code_compression.tree_order(points, levels)
    assert (np.sort(order, 1) == np.arange(n)).all()
    points = np.take_along_axis(points, order[:, :, None], 1)
    codes, sums, counts, work = code_compression.assign(points, books, levels)
    want = ((points[:, :, None] - books[:, None]) ** 2).sum(3).argmin(2)
    assert (codes == want).all() and sum(work.values()) == 3 * n
    for p in range(3):
        for e in range(k):
            assert (sums[p, e] == points[p][want[p] == e].sum(0)).all() and counts[p, e] == (want[p] == e).sum()


def test_whole_nodes_are_assigned_by_their_sums():
    centres = np.array([[0, 0], [1000, 0], [0, 1000], [1000, 1000]])
    points = (np.repeat(centres, 100, 0) + np.random.default_rng(2).integers(-9, 9, (400, 2)))[None]
    levels = code_compression._levels(400, code_compression.LEAF)
    points = np.take_along_axis(points, code_compression.tree_order(points, levels)[:, :, None], 1)
    assert code_compression.assign(points, centres[None], levels)[3] == {"by_node": 400, "by_leaf": 0}


def plain_codes(rows, parts, entries, rounds):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    x = np.array([[math.floor(256 * v) for v in r[1]] for r in kept], np.int64).reshape(len(kept), parts, -1)
    first = sorted((i for i, r in enumerate(kept) if r[0] is not None), key=lambda i: (kept[i][0], kept[i][1]))[:entries]
    books = x[first].copy()
    near = lambda: np.stack([((x[:, p, None] - books[None, :, p]) ** 2).sum(2).argmin(1) for p in range(parts)], 1)
    for _ in range(rounds):
        own = near()
        for p in range(parts):
            for e in range(len(books)):
                if (own[:, p] == e).any():
                    books[e, p] = x[own[:, p] == e, p].sum(0) // (own[:, p] == e).sum()
    own = near()
    error = sum(((x[:, p] - books[own[:, p], p]) ** 2).sum(1) for p in range(parts))
    of_label = collections.Counter()
    for r, e in zip(kept, error.tolist(), strict=True):
        of_label[r[2]] += e
    digest = hashlib.sha256(",".join(map(str, books.transpose(1, 0, 2).ravel().tolist())).encode()).hexdigest()
    return [(r[0], "".join(f"{c:02x}" for c in code), int(e), of_label[r[2]], digest) for r, code, e in zip(kept, own.tolist(), error, strict=True)]


SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string"


@pytest.mark.parametrize("n, entries, block", [(5, 64, 4096), (400, 64, 64), (400, 6, 4096)])
def test_codes_by_brute_force(spark, monkeypatch, n, entries, block):
    monkeypatch.setattr(code_compression, "BLOCK", block)
    rng = np.random.default_rng(n)
    vectors = np.float32(rng.normal(size=(n, 8)))
    rows = [(i, vectors[i % (n - 2)].tolist(), None if i % 3 == 0 else i % 3, "x", "y") for i in range(n)]
    rows += [(1, vectors[1].tolist(), 1, "x", "y"), (None, vectors[0].tolist(), 7, "x", "y")]
    rows += [(-1, None, 1, None, None), (-2, [1.0, None] * 4, 1, None, None), (-3, [float("nan")] * 8, 1, None, None), (-4, [float("-inf")] * 8, 1, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = code_compression.compress(df, parts=4, entries=entries).collect()
    want = plain_codes(rows, 4, entries, 2)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_codes_of_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert code_compression.compress(empty).count() == 0
    assert code_compression.compress(spark.createDataFrame([(1, None, 1, "", ""), (None, [1.0] * 16, 1, "", "")], SCHEMA)).count() == 0
    same = spark.createDataFrame([(i, [0.5] * 16, None, "", "") for i in range(100)], SCHEMA)
    assert {(r["code"], r["error"]) for r in code_compression.compress(same).collect()} == {("00" * 16, 0)}
    other = spark.createDataFrame([(1, [0.5] * 16, 1, "", ""), (2, [0.5] * 8, 1, "", "")], SCHEMA)
    assert [r["vec_id"] for r in code_compression.compress(other).collect()] == [1]
    with pytest.raises(ValueError, match="equal parts"):
        code_compression.compress(spark.createDataFrame([(1, [0.5] * 5, 1, "", "")], SCHEMA))


def test_codes_of_the_driver_table(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{TABLES}/embeddings.parquet").collect()]
    got = [tuple(r) for r in QUERIES["op13_code_compression"](spark, TABLES).collect()]
    assert sorted(got) == sorted(plain_codes(rows, 16, 64, 2))
