import numpy as np
from prosegauge.llm import vectors
from prosegauge.llm.components import forest


def brute(rows):
    ok = {}
    for i, v, label in rows:
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[i] = (np.array(v, float), label)
    n, links = dict.fromkeys((r[0] for r in rows), 0), []
    for i, (a, la) in ok.items():
        for j, (b, lb) in ok.items():
            if i != j and la == lb and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98:
                n[i] += 1
                links.append((i, j))
    roots = dict(forest(links))
    return {i: (n[i], roots.get(i, i)) for i in n}


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 12))
    rows = []
    for k in range(400):
        v = base[k % 40] + rng.normal(size=12) * rng.choice([0.02, 0.1, 0.3])
        rows.append((k, v.astype(np.float32).tolist(), int(k % 3)))
    rows += [(1000 + i, rows[5][1], rows[5][2]) for i in range(30)] + [(2000 + i, [2 * x for x in rows[6][1]], rows[6][2]) for i in range(3)]
    rows += [(3000, None, 1), (3001, [], 1), (3002, [0.0] * 12, 1), (3003, [float("nan")] * 12, 1), (3004, [None, *[1.0] * 11], 1), (3005, rows[5][1], None), (3006, [float("inf")] * 12, 1), (3007, rows[5][1][:4], rows[5][2])]
    df = spark.createDataFrame([(*r, 3, "x") for r in rows], "vec_id long, embedding array<float>, label int, n_links int, k string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(df, tile=32).collect()}
    assert got == brute(rows)
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_close_pairs_are_all_pairs():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(200, 40)) * np.linspace(3, 0.1, 40)
    b = np.concatenate([a[:50] + rng.normal(size=(50, 40)) * 0.02, rng.normal(size=(100, 40))])
    axes = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    found = {(i, j) for x, y in vectors.close_pairs(a, b, axes, 0.98) for i, j in zip(x.tolist(), y.tolist(), strict=True)}
    cos = a @ b.T / np.linalg.norm(a, axis=1)[:, None] / np.linalg.norm(b, axis=1)
    assert found == set(map(tuple, np.argwhere(cos >= 0.98).tolist())) and found
