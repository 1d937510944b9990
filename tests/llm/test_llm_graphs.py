"""Clustering, neighbour graphs and manifests against brute force."""

import hashlib
import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from floorlens.llm import merkle_manifest, neighbour_graph, table_kmeans

VEC = "vec_id long, embedding array<float>"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def vectors(spark, rows):
    return spark.createDataFrame(rows, VEC)


def clashing(df):
    names = ["v", "node", "unit", "rank", "score", "query", "cluster", "distance", "ids", "key", "leaf", "path", "tree", "index", "range"]
    return df.withColumns({n: F.lit("x") for n in names})


def brute_clusters(rows, k=16, rounds=3):
    kept = [(i, [max(-table_kmeans.MOST, min(table_kmeans.MOST, math.floor(x * 64))) for x in map(float, np.array(v, np.float32))]) for i, v in rows]
    kept.sort(key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in kept[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for j, members in groups.items():
            centres[j] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    found = [(i, *reversed(nearest(v))) for i, v in kept]
    inertia = {}
    for _, j, far in found:
        inertia[j] = inertia.get(j, 0) + far
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i is None, i or 0, j, far, inertia[j], sum(inertia.values()), marks[j]) for i, j, far in found))


def test_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 0.2, 64).tolist()) for i in range(150)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1])]  # repeated row, shared id, no id
    rows += [(900 + i, [0.25] * 64) for i in range(40)]  # many copies
    rows += [(990, [1e30] + [0.0] * 63), (991, [-1e30] + [0.0] * 63)]  # beyond 64 bits
    bad = [(1000, None), (1001, []), (1002, [0.1] * 63), (1003, [None] * 64), (1004, [float("nan")] * 64), (1005, [float("inf")] * 64), (1006, [0.1] * 65)]
    got = table_kmeans.cluster(clashing(vectors(spark, rows + bad)).repartition(5)).collect()
    got = sorted((r[0] is None, r[0] or 0, *r[1:]) for r in got)
    assert got == brute_clusters(rows)


def test_few_or_no_vectors(spark):
    rows = [(i, [float(i)] * 64) for i in range(3)]
    got = table_kmeans.cluster(vectors(spark, rows)).collect()
    assert sorted((r.vec_id, r.distance) for r in got) == [(0, 0), (1, 0), (2, 0)] and len({r.cluster for r in got}) == 3
    assert table_kmeans.cluster(vectors(spark, [])).collect() == []
    assert table_kmeans.cluster(vectors(spark, [(1, None)])).collect() == []


def test_tables_give_exact_distances():
    rng = np.random.default_rng(9)
    rows = rng.integers(-50, 50, (64, 300))
    values, places, sizes, before = [], [], [], 0
    for r in rows:
        seen, at = np.unique(r, return_inverse=True)
        values.append(seen)
        places.append(at + before)
        sizes.append(len(seen))
        before += len(seen)
    centres = np.concatenate((rng.integers(-50, 50, (5, 64)), rows.T[:1], rows.T[:1]))
    nearest, far = table_kmeans.distances(np.array(sizes), np.concatenate(values), np.array(places), centres)
    want = ((rows.T[:, None, :] - centres) ** 2).sum(2)
    assert (far == want.min(1)).all() and (nearest == want.argmin(1)).all()


def brute_neighbours(rows, queries, k):
    """{(query, rank): (id, score)} with every candidate looked at."""
    ok = [(i, np.array(v, float)) for i, v in rows if v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for q, v in {(q, tuple(v)): (q, v) for q, v in queries}.values():
        a, own, found = np.array(v, float), False, []
        for i, b in ok:
            if not own and i == q and b.tolist() == list(v):
                own = True
                continue
            n = max(len(a), len(b))
            x, y = np.pad(a, (0, n - len(a))), np.pad(b, (0, n - len(b)))
            found.append((-round(float(x @ y / np.sqrt(x @ x) / np.sqrt(y @ y)), 9), i is None, i or 0))
        for r, (score, none, i) in enumerate(sorted(found)[:k]):
            out[q, r + 1] = (None if none else i, -score)
    return out


def test_small_graphs_are_exact(spark):
    """Up to a block of nodes the graph is complete but for the list lengths."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 1, 8)]) for i in range(60)]
    rows += [(100 + i, rows[3][1]) for i in range(30)] + [(50, rows[50][1]), (None, rows[50][1]), (70, [1.0, 2.0]), (71, [3.0e38] * 8)]
    bad = [(200, None), (250, [0.0] * 8), (300, [None] * 8), (350, [float("nan")] * 8), (400, [float("inf")] + [0.0] * 7), (450, [])]
    queries = [r for r in rows if r[0] is not None and r[0] % 10 == 0]
    table = vectors(spark, rows + bad)
    got = neighbour_graph.search(clashing(table), clashing(table.where("vec_id % 10 = 0")), 5).collect()
    want = brute_neighbours(rows, queries, 5)
    assert {(r.query_id, r.rank): (r.vec_id, round(r.score, 9)) for r in got} == want and len(got) == len(want)


def test_few_candidates(spark):
    table = vectors(spark, [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, None)])
    got = neighbour_graph.search(table, table.where("vec_id % 50 = 0"), 5).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(0, 1, 1)] and abs(got[0].score - math.sqrt(0.5)) < 1e-15
    alone = vectors(spark, [(0, [1.0, 0.0])])
    assert neighbour_graph.search(alone, alone, 5).collect() == []
    none = vectors(spark, [])
    assert neighbour_graph.search(none, none, 5).collect() == []
    outside = neighbour_graph.search(table, vectors(spark, [(9, [0.0, 1.0, 5.0])]), 5).collect()
    assert [(r.rank, r.vec_id) for r in outside] == [(1, 1), (2, 0)]


def test_recall_of_a_graph_of_many_blocks(spark):
    rng = np.random.default_rng(6)
    data = rng.normal(0, 1, (2000, 32)).astype(np.float32)
    data[:700] = data[0] + rng.normal(0, 0.01, (700, 32))  # a crowd of near copies
    table = vectors(spark, [(i, v.tolist()) for i, v in enumerate(data)])
    got = neighbour_graph.search(table, table.where("vec_id % 50 = 0"), 5).collect()
    unit = data.astype(float) / np.linalg.norm(data.astype(float), axis=1, keepdims=True)
    found = {}
    for r in got:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, 2000, 50):
        near = unit @ unit[q]
        near[q] = -9
        hits += len(found[q] & set(np.argsort(-near)[:5].tolist()))
    assert hits >= 0.95 * 5 * 40


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows):
    def field(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    def leaf(r, text):
        return h(field(r[0]), field(r[3]), field(r[2]), field(r[4]), field(text))

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([h(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
        return out

    langs = {}
    for r in rows:
        struck = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None
        langs.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), leaf(r, r[1].translate(lower)) if struck else leaf(r, r[1])))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: levels([x[2] for x in sorted(langs[g])]) for g in order}
    top = levels([trees[g][-1][0] for g in order])
    root, out = top[-1][0], []
    for g, lang in enumerate(order):
        for rank, (known, i, original, node) in enumerate(sorted(langs[lang])):
            beside, at = [], rank
            for tree, place in ((trees[lang], rank), (top, g)):
                at = place
                for level in tree[:-1]:
                    run = level[at // 8 * 8 : at // 8 * 8 + 8]
                    before, after = run[: at % 8], run[at % 8 + 1 :]
                    beside += before + after
                    node, at = h(*before, node, *after), at // 8
            out.append((known, i, original, trees[lang][-1][0], root, h(*beside), node, node == root))
    return sorted(out)


def documents(spark, rows):
    return spark.createDataFrame(rows, DOC)


def test_manifest_equals_brute_force(spark):
    rng = np.random.default_rng(7)
    texts = ["", None, "Größe ÄÖ", "ABC " * 5000, "plain", "Mixed Case"]
    rows = []
    for lang, n in (("en", 300), (None, 9), ("Zz", 8), ("é", 1), ("de", 65), *((f"l{i}", 2) for i in range(9))):
        rows += [(int(rng.integers(0, 10**12)), texts[int(rng.integers(0, 6))], lang, [None, "web", ""][int(rng.integers(0, 3))], None if rng.random() < 0.1 else 5) for _ in range(n)]
    rows += [rows[0], rows[0], (rows[1][0], "other", rows[1][2], None, 3), (None, "Q", "en", "s", 1), (None, None, None, None, None)]
    got = merkle_manifest.report(clashing(documents(spark, rows)).repartition(7)).collect()
    got = sorted((r[0] is not None, r[0] or 0, *r[1:]) for r in got)
    assert got == brute_manifest(rows)


def test_manifest_of_one_row_and_none(spark):
    one = [(3, "A", "en", "s", 1)]
    assert sorted((True, *r) for r in merkle_manifest.report(documents(spark, one)).collect()) == brute_manifest(one)
    assert merkle_manifest.report(documents(spark, [])).collect() == []


def test_proofs_of_some_leaves(spark):
    rows = [(i, f"T{i}", "en" if i % 3 else "de", "s", i) for i in range(200)]
    m = merkle_manifest.manifest(documents(spark, rows))
    some = m.leaves.where("rank in (0, 7, 8, 63, 64, 130)").select("tree", "rank")
    got = merkle_manifest.proofs(m, some)
    roots = got.select("tree", "rank", merkle_manifest.folded(F.col("leaf"), F.col("path")).alias("root")).collect()
    assert {r.root for r in roots} == {m.root} and len(roots) == some.count() == 11
