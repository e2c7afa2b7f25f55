import numpy as np

from gablework.llm import forest


def chunks(spark, vecs, model="m"):
    rows = [(f"c{i:05d}", model, [float(x) for x in v] if v is not None else None, "x") for i, v in enumerate(vecs)]
    return spark.createDataFrame(rows, "id string, embedding_model string, embedding array<float>, similarity string")


def brute(vecs, k, cosine):
    x = np.array(vecs, np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 6)
    out = set()
    for i in range(len(x)):
        order = sorted((j for j in range(len(x)) if j != i), key=lambda j: (-s[i, j], j))[:k]
        out |= {(f"c{min(i, j):05d}", f"c{max(i, j):05d}") for j in order if s[i, j] >= cosine}
    return out


def test_join_finds_near_pairs(spark):
    r = np.random.default_rng(0)
    base = r.standard_normal((300, 32))
    vecs = np.concatenate((base, base[:120] + 0.12 * r.standard_normal((120, 32)), base[:30] * 3.0, np.repeat(base[200:201], 9, 0)))
    got = {(p.chunk_a, p.chunk_b) for p in forest.near_join(chunks(spark, vecs)).collect()}
    want = brute(vecs.astype(np.float32), 5, 0.95)
    assert len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want)


def test_crowds_are_whole(spark):
    # a third of all rows in one tight group, all at a cosine of over 0.95 to each other, and as many scaled copies of one vector
    r = np.random.default_rng(2)
    centre = r.standard_normal(64)
    tight = centre + 0.18 * r.standard_normal((1000, 64))
    vecs = np.concatenate((r.standard_normal((1850, 64)), tight, np.outer(r.uniform(0.2, 9, 150), r.standard_normal(64)))).astype(np.float32)
    vecs = vecs[r.permutation(len(vecs))]
    got = {(p.chunk_a, p.chunk_b) for p in forest.near_join(chunks(spark, vecs)).collect()}
    want = brute(vecs, 5, 0.95)
    assert len(want) > 3000 and len(got & want) >= 0.999 * len(want) and len(got - want) <= 0.001 * len(want)


def test_dense_cluster(spark):
    # half of the rows in one cluster of 3,000
    r = np.random.default_rng(5)
    vecs = np.concatenate((r.standard_normal((3000, 64)), r.standard_normal(64) + 0.13 * r.standard_normal((3000, 64)))).astype(np.float32)
    got = {(p.chunk_a, p.chunk_b) for p in forest.near_join(chunks(spark, vecs)).collect()}
    want = brute(vecs, 5, 0.95)
    assert len(want) > 8000 and len(got & want) >= 0.999 * len(want) and len(got - want) <= 0.001 * len(want)


def test_profile():
    r = np.random.default_rng(6)
    keys = np.sort(r.integers(0, 2**10, 300, dtype=np.uint64) << np.uint64(54))
    m = np.zeros((300, 4), np.int64)
    m[:, 3] = keys.view(np.int64)
    m[200:, 2] = 1
    got = forest.profile(forest.common_prefix(m), 4)
    for i in range(300):
        mine = keys[:200] if i < 200 else keys[200:]
        for j in range(4):
            shared = [d for d in range(65) if sum((int(k) ^ int(keys[i])).bit_length() <= 64 - d for k in mine) >= 2 ** (j + 1)]
            assert got[i, j] == max(shared, default=0)


def test_strings_that_nothing_tells_apart(spark):
    # all in one bucket of every tree, unequal by rounding: more than a bucket may show
    r = np.random.default_rng(7)
    vecs = (r.standard_normal(16) + 4e-4 * r.standard_normal((3000, 16))).astype(np.float32)
    got = {(p.chunk_a, p.chunk_b) for p in forest.near_join(chunks(spark, vecs)).collect()}
    # cosines within 1e-6 of each other: single-precision units fall on either side of the sixth place
    assert len(got) > 12000 and len(got & brute(vecs, 5, 0.95)) >= 0.97 * len(got)


def test_crowd_in_blocks(spark):
    r = np.random.default_rng(3)
    vecs = (r.standard_normal(16) + 0.2 * r.standard_normal((300, 16))).astype(np.float32)
    rows = forest.vectors(chunks(spark, vecs)).selectExpr("1L class_id", "id", "model", "dim", "unit")
    pairs = forest.crowd_pairs(rows, k=5, cosine=0.95, block=70)
    assert brute(vecs, 5, 0.95) <= {(p.x, p.y) for p in pairs.collect()}


def test_edges(spark):
    vecs = [None, [], [0.0] * 8, [float("nan")] * 8, [1.0] * 8, [2.0] * 8, [1.0] * 7, None]
    got = [(p.chunk_a, p.chunk_b) for p in forest.near_join(chunks(spark, vecs)).collect()]
    assert got == [("c00004", "c00005")]
    assert forest.near_join(chunks(spark, vecs, None)).count() == 0
    assert forest.near_join(chunks(spark, vecs).limit(0)).count() == 0


def test_search_recall(spark):
    r = np.random.default_rng(1)
    rows = forest.vectors(chunks(spark, r.standard_normal((600, 24))))
    out = forest.recall(rows.filter("id < 'c00040'"), rows).first()
    assert out.queries == 40 and out.recall >= 0.9
