"""Incident clustering against brute force over all pairs, on small sets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import clustering as cl
from tidewatch.operators import flows as fl

DIMS = cl.DIMS


def brute_force(raw, eps, min_samples):
    """Row number -> least row number of its cluster; border rows join the least cluster they touch."""
    v = raw / np.linalg.norm(raw, axis=1, keepdims=True)
    near = ((v[:, None, :] - v[None, :, :]) ** 2).sum(-1) <= 2 * eps + 1e-12
    core = near.sum(1) >= min_samples
    label = {i: i for i in np.flatnonzero(core)}
    changed = True
    while changed:
        changed = False
        for i in label:
            least = min(label[j] for j in np.flatnonzero(near[i]) if core[j])
            if least < label[i]:
                label[i], changed = least, True
    clusters = {frozenset(j for j in label if label[j] == c) for c in set(label.values())}
    border = {}
    for i in np.flatnonzero(~core):
        touching = {frozenset(c) for c in clusters for j in c if near[i, j]}
        if touching:
            border[i] = touching
    return clusters, border


def run(spark, raw, eps, min_samples):
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(raw)], "id long, raw array<double>")
    found = cl.dbscan(rows, eps, min_samples).collect()
    out = {}
    for r in found:
        out.setdefault(r["cluster_id"], set()).add(r["id"])
    return out


def check(spark, raw, eps=0.5, min_samples=3):
    clusters, border = brute_force(raw, eps, min_samples)
    got = run(spark, raw, eps, min_samples)
    core_of = {}
    for members in got.values():
        cores = frozenset(i for i in members if i not in border)
        core_of[cores] = members
    assert set(core_of) == clusters
    for i, touching in border.items():
        homes = [cores for cores, members in core_of.items() if i in members]
        assert len(homes) == 1 and homes[0] in touching
    assert sum(len(m) for m in got.values()) == sum(map(len, clusters)) + len(border)


def sparse(rng, n, features=4):
    raw = np.zeros((n, DIMS))
    raw[:, 0] = rng.uniform(0.1, 1.0, n)
    for i in range(n):
        at = rng.choice(np.arange(1, DIMS), 5, replace=False) if features is None else rng.choice(np.arange(1, 1 + features), min(features, 5), replace=False)
        raw[i, at] = rng.uniform(-10, 10, len(at))
    return raw


@pytest.mark.parametrize("seed", range(3))
def test_scattered_rows(spark, seed):
    check(spark, sparse(np.random.default_rng(seed), 60, None))


@pytest.mark.parametrize("eps,min_samples", [(0.5, 3), (0.1, 4), (0.02, 3)])
def test_few_features(spark, eps, min_samples):
    check(spark, sparse(np.random.default_rng(7), 150, 3), eps, min_samples)


def test_thirteen_values_a_row(spark):
    """Rows with many values: cells are narrow enough for all of them to be neighbours."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, DIMS)) * (rng.random((12, DIMS)) < 13 / DIMS)
    centres[:, 0] = 1.0
    raw = np.concatenate([c + 0.12 * rng.normal(size=(25, DIMS)) * (c != 0) for c in centres])
    assert (np.count_nonzero(raw, axis=1) > 6).all()
    for eps in (0.01, 0.03, 0.3):
        check(spark, raw, eps, 4)


def test_units_meet_in_cells(spark, monkeypatch):
    """A small reach: units are compared only where they can meet, in tiles of bounded size."""
    rng = np.random.default_rng(6)
    raw = np.zeros((400, DIMS))
    angle = rng.uniform(0, 2 * np.pi, 400)
    raw[:, 3], raw[:, 7] = np.cos(angle), np.sin(angle)
    check(spark, raw, 0.0002, 3)
    monkeypatch.setattr(cl, "CHUNK", 25)
    check(spark, raw, 0.0002, 3)
    lone = np.eye(DIMS)[:, :DIMS]
    boxes = spark.createDataFrame([(int(i), 1, v.tolist(), v.tolist()) for i, v in enumerate(raw)], "label long, n long, lo array<double>, hi array<double>")
    pairs = cl._meeting(boxes, boxes, 0.02, lambda a, b: cl.pd.DataFrame({"a": [len(a)], "b": [len(b)]}), "a long, b long").collect()
    compared = sum(r["a"] * r["b"] for r in pairs)
    assert 0 < compared < 0.2 * 400 * 400 and max(r["b"] for r in pairs) <= 60
    assert run(spark, lone, 0.0002, 2) == {}


def test_incidents_do_not_depend_on_partitions(spark):
    schema = "flow_id string, ts timestamp, src_ip string, dst_ip string, score double, is_anomaly boolean, attribution array<struct<feature:string,z_score:double,direction:string>>"
    rng = np.random.default_rng(8)
    rows = [(f"f{i:03d}", None, f"s{i % 5}", "d", 0.6 + 0.3 * float(rng.random()), i % 9 != 0, [(("duration_ms", "iat_std", "fin_count")[i % 3], 4.0 + float(rng.random()), "high")]) for i in range(90)]
    answers = []
    for parts, order in ((1, 1), (7, -1)):
        df = spark.createDataFrame(rows[::order], schema).repartition(parts)
        answers.append(sorted((r["cluster_id"], r["member_count"]) for r in cl.cluster_incidents(df, eps=0.05).collect()))
    assert answers[0] == answers[1] and {c for c, _ in answers[0]} == {"f001", "f002", "f003"}


def test_dense_groups_near_the_reach(spark):
    """Two dense groups whose rows lie just inside and just outside of reach of each other."""
    rng = np.random.default_rng(3)
    for gap in (0.9, 1.0472, 1.06, 1.2):
        angles = np.concatenate([rng.uniform(-0.12, 0.0, 40), gap + rng.uniform(0.0, 0.12, 40)])
        raw = np.zeros((80, DIMS))
        raw[:, 1], raw[:, 2] = np.cos(angles), np.sin(angles)
        check(spark, raw)


def test_hot_group_of_equal_rows(spark):
    """Most rows are one point; none of them may be paired with another."""
    raw = np.zeros((2000, DIMS))
    raw[:, 0], raw[:, 4] = 0.9, 10.0
    raw[-2:, 4], raw[-2:, 9] = 0.0, -10.0
    got = run(spark, raw, 0.5, 3)
    assert [len(m) for m in got.values()] == [1998]


def test_too_few_anomalies_give_no_incident(spark):
    schema = "flow_id string, ts timestamp, src_ip string, dst_ip string, score double, is_anomaly boolean, attribution array<struct<feature:string,z_score:double,direction:string>>"
    rows = spark.createDataFrame([("a", None, "x", "y", 0.9, True, [("duration_ms", 3.0, "high")])], schema)
    assert cl.cluster_incidents(rows).count() == 0


def test_components_of_a_long_chain(spark):
    chain = spark.range(1, 400).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    other = spark.createDataFrame([(1000, 1001), (1001, 1002)], "a long, b long")
    got = {r["node"]: r["component"] for r in cl.connected_components(chain.unionByName(other)).collect()}
    assert all(got[i] == 0 for i in range(400)) and got[1002] == 1000


def test_roll_up_ranks_shared_features(spark):
    rows = [(1, 0.95, "s1", "d1", ["a", "b"]), (1, 0.5, "s2", "d1", ["b"]), (1, 0.6, "s1", "d2", ["b", "c"])]
    df = spark.createDataFrame(rows, "cluster_id long, score double, src_ip string, dst_ip string, names array<string>")
    df = df.withColumns({"ts": F.lit("2024-01-01").cast("timestamp"), "attribution": F.transform("names", lambda n: F.struct(n.alias("feature")))})
    row = fl.incident_rollup(df).first()
    assert row["severity"] == "critical" and row["member_count"] == 3 and row["source_count"] == 2 and row["dest_ips"] == ["d1", "d2"]
    assert [tuple(f) for f in row["shared_features"]] == [("b", 3), ("a", 1), ("c", 1)]


def test_a_unit_is_compared_with_its_own_askers_only(spark, monkeypatch):
    """The points of dense units meet what is asked of them by unit, a large unit in tiles."""
    monkeypatch.setattr(cl, "CHUNK", 50)
    unit = np.array([0] * 300 + [u for u in range(1, 101) for _ in range(5)])
    v = [[float(i)] + [0.0] * (DIMS - 1) for i in range(len(unit))]
    points = spark.createDataFrame([(int(u), i, x) for i, (u, x) in enumerate(zip(unit, v))], "unit long, id long, v array<double>")
    asked = spark.createDataFrame([(int(u), 1000 + i, x) for i, (u, x) in enumerate(zip(unit, v)) if i % 2], "unit long, label long, lo array<double>")
    tiles = cl._of_units(points, asked, lambda a, b: cl.pd.DataFrame({"a": [len(a)], "b": [len(b)], "n": [0]}), cl._TRIPLE).collect()
    # every row a few times: not every point for every block of what is asked
    assert sum(r["a"] for r in tiles) <= 300 * 4 + 500 and max(max(r["a"], r["b"]) for r in tiles) <= 100
    within = cl._of_units(points, asked, cl._count_in_reach(0.25), cl._TRIPLE).groupBy("a", "b").agg(F.sum("n").alias("n")).collect()
    assert {(r["a"] - 1000, r["b"], r["n"]) for r in within} == {(i, int(u), 1) for i, u in enumerate(unit) if i % 2}
