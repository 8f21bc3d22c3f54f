import random
import re

import numpy as np
import pytest
import xxhash

from stationflow.llm import near_embeddings, simhash, topk
from stationflow.llm.components import connected_components


def groups(n, links, name):
    """The smallest name that each of n nodes reaches."""
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b, key=lambda i: name[i])] = min(a, b, key=lambda i: name[i])
    return [name[root(i)] for i in range(n)]


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = sorted({x for e in edges if None not in e for x in e})
    want = groups(len(nodes), [(nodes.index(a), nodes.index(b)) for a, b in edges if a is not None], nodes)
    assert got == dict(zip(nodes, want, strict=True))
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("small", [1, 64])
def test_links_join_exactly_what_is_near(spark, small):
    rnd = random.Random(small)
    words = {rnd.getrandbits(64) for _ in range(150)}
    for w in list(words)[:25]:  # masses of near words, and chains of them
        for _ in range(20):
            for _ in range(rnd.randrange(1, 4)):
                w ^= 1 << rnd.randrange(64)
            words.add(w)
    words = sorted(simhash._signed(w) for w in words)
    bits = np.array(words, np.int64).view(np.uint64)
    near = [(i, j) for i in range(len(words)) for j in range(i) if (int(bits[i]) ^ int(bits[j])).bit_count() <= 2]
    want = groups(len(words), near, words)
    edges = simhash.links(spark.createDataFrame([(w,) for w in words], "fp long"), small)
    got = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    assert [got.get(w, w) for w in words] == want


def test_simhash(spark, odd, none):
    text = " ".join(f"word{i}" for i in range(400))
    near = text.replace("word200 ", "other ")
    docs = odd.select("doc_id", "text").union(spark.createDataFrame([(20, text), (21, near), (22, text.upper())], "doc_id long, text string"))
    rows = docs.collect()
    got = simhash.near_duplicates(docs).collect()
    prints = {r["text"]: plain_fingerprint(r["text"]) for r in rows}
    have = [r for r in rows if r["doc_id"] is not None]
    values = [prints[r["text"]] for r in have]
    links = [(i, j) for i in range(len(have)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 2]
    want = groups(len(have), links, [r["doc_id"] for r in have])
    expected = sorted((r["doc_id"], f"{v:016x}", c) for r, v, c in zip(have, values, want, strict=True))
    assert sorted(tuple(r) for r in got if r["doc_id"] is not None) == expected
    assert len(got) == len(rows)
    blank = {r["doc_id"]: r for r in got}
    assert [blank[i]["component_id"] for i in (1, 2, 3)] == [1, 1, 1] and blank[1]["fingerprint"] == "0" * 16
    assert simhash.near_duplicates(none).count() == 0


def test_keep_one(odd, none):
    out = simhash.keep_one(odd)
    assert out.columns == odd.columns
    ids = [r["doc_id"] for r in out.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 4, 5, 7, 9, 10] and ids.count(None) == 1
    assert simhash.keep_one(none).count() == 0


def test_keep_one_of_shared_and_null_ids(spark, odd):
    text = " ".join(f"word{i}" for i in range(400))
    near, other = text.replace("word207 ", "other "), " ".join(f"else{i}" for i in range(300))
    # an id of two groups; a near copy and copies without ids; a group of NULL ids alone
    rows = [(1, text), (1, other), (2, near), (None, text), (None, near), (3, other), (None, "no id at all"), (None, "no id at all"), (1, near)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 1), "doc_id long, text string")
    got = [tuple(r) for r in simhash.keep_one(docs).collect()]
    assert sorted(got, key=str) == sorted([(1, text), (1, other), (None, "no id at all")], key=str)


def vectors():
    rnd = np.random.default_rng(1)
    rows, centre = [], rnd.standard_normal((4, 16))
    for i in range(400):
        v = centre[i % 4] * 3 + rnd.standard_normal(16) * (0.25 if i % 3 else 4)
        rows.append((i, v.tolist(), i % 2))
    rows += [(400 + i, rows[0][1], 0) for i in range(30)] + [(0, rows[0][1], 0)]
    rows += [(500, None, 0), (501, [0.0] * 16, 0), (502, [float("nan")] * 16, 0), (503, [None] * 16, 0), (504, rows[0][1], None), (505, [], 0), (None, rows[1][1], 1)]
    return rows + [(506, [1e300, 1e300], 0), (507, [1e300, 1e300 * 0.99], 0), (508, [1e-300] * 2, 1)]


SCHEMA = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize("block", [512, 16])
def test_embeddings(spark, block):
    rows = vectors()
    out = near_embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(2), block=block, passes=20).collect()
    assert len(out) == len(rows)

    def unit(r):
        v, label = r[1], r[2]
        if not v or label is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v) / max(abs(x) for x in v)
        return v / np.linalg.norm(v)

    units = [unit(r) for r in rows]
    links = [
        (i, j) for i in range(len(rows)) for j in range(i)
        if units[i] is not None and units[j] is not None and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.98
    ]
    degree = np.bincount([x for e in links for x in e], minlength=len(rows))
    found = {}
    for r in out:
        found.setdefault(r["vec_id"], []).append(r)
    got = np.array([found[r[0]][0]["n_links"] for r in rows])
    assert (got <= degree).all() and got.sum() >= 0.9 * degree.sum()
    if block == 512:
        assert (got == degree).all()
        want = groups(len(rows), links, [10**9 if r[0] is None else r[0] for r in rows])
        for r, c in zip(rows, want, strict=True):
            if r[0] is not None:
                assert all((o["component_id"], o["kept"]) == (c, c == r[0]) for o in found[r[0]])
    for i in (500, 501, 502, 503, 504, 505):
        assert (found[i][0]["n_links"], found[i][0]["component_id"], found[i][0]["kept"]) == (0, i, True)
    assert near_embeddings.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("noise", [0.001, 0.14])
def test_large_groups_keep_their_links(spark, noise):
    rnd = np.random.default_rng(3)
    x = rnd.standard_normal(64) + noise * rnd.standard_normal((3_000, 64))
    x = np.concatenate([x, x[:5], rnd.standard_normal((200, 64))])
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(x.tolist())], SCHEMA)
    got = {r["vec_id"]: r for r in near_embeddings.near_duplicates(df, shard=1_000).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.98
    assert [got[i]["n_links"] for i in range(len(x))] == (near.sum(1) - 1).tolist()
    want = groups(len(x), zip(*np.nonzero(np.tril(near, -1)), strict=True), list(range(len(x))))
    assert [got[i]["component_id"] for i in range(len(x))] == want


def plain_top(rows, ids, k):
    usable = [(i, topk.whole(v)) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in sorted({(i, tuple(v)) for i, v in usable if i in ids}):
        best = sorted((-sum(x * y for x, y in zip(a, v, strict=False)), i) for i, v in usable if i != q)[:k]
        clip = lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
        out += [(q, n + 1, i, clip(-s)) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("shard", [8_192, 64])
@pytest.mark.parametrize("large", [False, True])
def test_top_k(spark, shard, large):
    rows = [r for r in vectors() if large or r[0] not in (506, 507)]
    rows += [(600 + i, [0.0] * (i % 5) + [float(i)] + [0.0] * 40, 0) for i in range(50)]  # mostly zeros
    df = spark.createDataFrame(rows, SCHEMA)
    got = topk.top_k(df, df.where("vec_id % 25 = 0 or vec_id = 506"), shard=shard, block=5).collect()
    ids = {i for i, _, _ in rows if i is not None and (i % 25 == 0 or i == 506)}
    assert sorted(tuple(r) for r in got) == plain_top(rows, ids, 5)


def test_top_k_of_little(spark):
    df = spark.createDataFrame([(1, [1.0], 0), (2, [2.0], 0)], SCHEMA)
    assert [tuple(r) for r in topk.top_k(df, df.where("vec_id = 1")).collect()] == [(1, 1, 2, 512 * 256)]
    assert topk.top_k(df, df.limit(0)).count() == 0 and topk.top_k(df.limit(0), df).count() == 0
