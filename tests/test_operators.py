"""Operators against plain computations on small inputs."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinfold.functions import exprs as X
from kinfold.operators import candidates, graph, groups, inference, metrics, models, splits, units


def edges_frame(spark, edges):
    return spark.createDataFrame(edges, "a long, b long")


def components(nodes, edges):
    up = {x: x for x in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {x: root(x) for x in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_connected_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7), (1, 2), (2, 1)]
    nodes = {x for e in edges for x in e}
    got = {x["node"]: x["component"] for x in graph.connected_components(edges_frame(spark, [*edges, (None, 5), (5, None)]).repartition(5), "a", "b").collect()}
    assert got == components(nodes, edges)


def test_components_without_edges(spark):
    nodes = spark.createDataFrame([(1,), (2,)], "n long")
    assert graph.connected_components(edges_frame(spark, []), "a", "b").count() == 0
    assert sorted(tuple(r) for r in graph.grouped(nodes, edges_frame(spark, [(1, 9)]), "n", "a", "b").collect()) == [(1, 1), (2, 2)]


@pytest.mark.parametrize("seed", range(2))
def test_merging_edges_are_those_of_a_walk_in_order(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(25), r.randrange(25), i) for i in range(60)]
    up, want = {}, set()

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b, rank in edges:
        x, y = root(a), root(b)
        if x != y:
            up[x] = y
            want.add(rank)
    got = graph.merging_edges(spark.createDataFrame(edges, "a long, b long, r long"), "a", "b", "r").collect()
    assert {x["r"] for x in got} == want


def test_bridges_part_their_group(spark):
    links = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 4), (10, 11), *[(i, i + 1) for i in range(100, 3100)]]
    for seed in range(5):
        r = random.Random(seed)
        links += [(5000 + seed * 100 + r.randrange(12), 5000 + seed * 100 + r.randrange(12)) for _ in range(14)]
    group = components({x for e in links for x in e}, links)
    rows = [(group[a], a, b) for a, b in links]
    got = {(x["a"], x["b"]) for x in graph.bridge_edges(spark.createDataFrame(rows, "g long, a long, b long"), "g", "a", "b").collect()}
    want = set()
    small = {(min(e), max(e)) for e in links if e[0] != e[1]}
    for e in small:
        if 100 <= e[0] < 3100:
            want.add(e)  # a chain
            continue
        own = {f for f in small if group[f[0]] == group[e[0]]}
        nodes = {x for f in own for x in f}
        if len(nodes) >= 3 and len(set(components(nodes, own - {e}).values())) > 1:
            want.add(e)
    assert got == want


@pytest.mark.parametrize("radius", [0, 2, 4])
def test_hamming_pairs_equal_all_pairs(spark, radius):
    r = random.Random(radius)
    values = []
    for _ in range(40):
        v = r.getrandbits(64)
        for _ in range(4):
            w = v
            for _ in range(r.randrange(0, 6)):
                w ^= 1 << r.randrange(64)
            values.append(w)
    values += values[:3]
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    table = spark.createDataFrame(list(enumerate(signed)), "i long, v long")
    want = {(a, b, bin(values[a] ^ values[b]).count("1")) for b in range(len(values)) for a in range(b) if bin(values[a] ^ values[b]).count("1") <= radius}
    assert {tuple(x) for x in candidates.hamming_pairs(table, "i", "v", radius).collect()} == want
    assert {tuple(x) for x in candidates.hamming_within(table, "i", "v", radius, block=50).collect()} == want


def test_top_cosine_in_blocks(spark):
    r = np.random.default_rng(1)
    v = r.standard_normal((90, 8))
    v[5] = v[6]
    table = spark.createDataFrame([(i, x.tolist(), i % 3) for i, x in enumerate(v)], "i long, x array<double>, g int")
    s = np.round(v @ v.T, 9)
    for apart, block in ((None, 4096), ("g", 20)):
        got = {}
        for x in candidates.top_cosine(table, "i", "x", 4, apart=apart, block=block).collect():
            got.setdefault(x["item_a"], {})[x["rank"]] = x["item_b"]
        for i in range(90):
            near = sorted((-s[i, j], j) for j in range(90) if j != i and (not apart or i % 3 != j % 3))[:4]
            assert [got[i][k + 1] for k in range(4)] == [j for _, j in near]


def test_crowded_origins_make_no_pairs_but_are_listed(spark):
    items = spark.createDataFrame([(i, "big" if i < 12 else "small" if i < 15 else "") for i in range(20)], "i long, o string")
    assert candidates.origin_pairs(items, "i", "o", 10).count() == 3
    assert [tuple(x) for x in candidates.crowded_origins(items, "i", "o", 10).collect()] == [("big", 12)]


def test_shortlist_respects_quotas_and_degrees(spark):
    rows = [(a, b, (a + b) % 3 == 0, float(a * b % 17)) for a in range(12) for b in range(a + 1, 12)]
    pairs = spark.createDataFrame(rows, "item_a long, item_b long, odd boolean, s double")
    got = candidates.shortlist(pairs, [("odd", 4)], 10, 1, [F.desc("s"), F.asc("item_a"), F.asc("item_b")]).collect()
    used = {}
    for x in got:
        for k in (x["item_a"], x["item_b"]):
            used[k] = used.get(k, 0) + 1
    assert len(got) <= 10 and sum(x["chosen_as"] == "odd" for x in got) == 4 and max(used.values()) <= 2


# splits


def samples(spark, n=300, seed=1):
    r = random.Random(seed)
    return spark.createDataFrame([(i, f"g{r.randrange(n // 3)}", r.choice("aab"), f"s{i % 4}") for i in range(n)], "i long, g string, y string, s string")


def test_stratified_folds_are_disjoint_even_and_repeatable(spark):
    one = splits.stratified_folds(samples(spark), "i", "y", 4).select("i", "y", "fold").toPandas()
    two = splits.stratified_folds(samples(spark).repartition(7), "i", "y", 4).select("i", "y", "fold").toPandas()
    assert one.sort_values("i").reset_index(drop=True).equals(two.sort_values("i").reset_index(drop=True))
    assert len(one) == 300 and one.i.is_unique
    counts = one.groupby(["y", "fold"]).size().unstack()
    assert ((counts.max(axis=1) - counts.min(axis=1)) <= 1).all()


def test_group_folds_never_cross_and_stay_even(spark):
    s = samples(spark)
    joined = s.join(splits.group_folds(s, "g", "y", 4), "g")
    assert joined.count() == 300 and splits.crossings(joined, "g").first()["n_crossing"] == 0
    counts = joined.groupBy("y", "fold").count().toPandas().pivot(index="y", columns="fold", values="count")
    assert counts.shape == (2, 5) and (counts.max(axis=1) / counts.min(axis=1)).max() < 1.6


def test_crossing_counter(spark):
    table = spark.createDataFrame([("a", 0), ("a", 0), ("b", 1), ("b", 1)], "g string, fold int")
    assert splits.crossings(table, "g").first()["n_crossing"] == 0
    moved = spark.createDataFrame([("a", 0), ("a", 1), ("b", 1), ("b", 1)], "g string, fold int")
    assert splits.crossings(moved, "g").first()["n_crossing"] == 1


def test_safe_designs_share_no_group(spark):
    s = samples(spark)
    d = splits.designs(s, F.col("s") == "s0", {"naive": None, "safe": "g"}).toPandas()
    naive, safe = d[d.design == "naive"], d[d.design == "safe"]
    assert set(naive[naive.role == "TRAIN"].g) & set(naive[naive.role == "TEST"].g)
    assert not set(safe[safe.role == "TRAIN"].g) & set(safe[safe.role == "TEST"].g)
    h = splits.holdouts(s, "s", "g").toPandas().set_index("held_out")
    p = s.toPandas()
    for source in "0123":
        test = set(p[p.s == f"s{source}"].g)
        assert h.loc[f"s{source}", "n_train_safe"] == ((p.s != f"s{source}") & ~p.g.isin(test)).sum()


def test_rotation_gives_disjoint_exhaustive_roles(spark):
    rows = spark.range(20).withColumn("fold", (F.col("id") % 5).cast("int")).select(splits.rotated_role(F.col("fold"), F.lit(4)).alias("role")).groupBy("role").count().collect()
    assert {r["role"]: r["count"] for r in rows} == {"TRAIN": 12, "VALIDATION": 4, "TEST": 4}


def test_lineage_weights_sum_alike(spark):
    table = spark.createDataFrame([(i, "l0" if i < 3 else "l1" if i < 5 else "l2") for i in range(10)], "i long, g string")
    got = splits.lineage_weights(table, "g").groupBy("g").agg(F.sum("weight").alias("w")).collect()
    assert all(math.isclose(r["w"], 10 / 3) for r in got)


def test_removal_sets(spark):
    s = samples(spark)
    wanted = spark.createDataFrame([("a", 5), ("b", 3)], "y string, n int")
    got = splits.removal_sets(s, "i", "y", wanted, 6, 1)
    per = got.groupBy("replicate", "y").agg(F.count("*").alias("n"), F.countDistinct("i").alias("d")).collect()
    assert len(per) == 12 and all(r["n"] == r["d"] == (5 if r["y"] == "a" else 3) for r in per)
    assert splits.set_hashes(got, "i").filter("repeated").count() == 0


def test_matched_plan_is_exact_and_cheapest():
    kinds = pd.DataFrame([("x", "one", 1, 1, 4), ("x", "two", 2, 1, 3), ("y", "one", 1, 1, 2), ("y", "two", 3, 2, 2)], columns=["stratum", "bin", "paths", "strict", "available"])
    plan = splits.matched_plan(kinds, {"x": 5, "y": 4}, {"one": 3, "two": 2}, 5, 6)
    taken = {s: sum(kinds.loc[i, "paths"] * n for i, n in plan["counts"].items() if kinds.loc[i, "stratum"] == s) for s in "xy"}
    assert taken == {"x": 5, "y": 4}
    best = math.inf
    for a in range(5):
        for b in range(4):
            for c in range(3):
                for d in range(3):
                    if a + 2 * b == 5 and c + 3 * d == 4:
                        best = min(best, 100 * (abs(a + c - 3) + abs(b + d - 2)) + 200 * abs(a + b + c + d - 5) + 20 * abs(a + b + c + 2 * d - 6))
    assert plan["cost"] == best


# metrics and inference


def predictions(spark):
    r = random.Random(3)
    rows = [(i, f"u{i // 4}", "abc"[(i // 4) % 3], r.choice("abc"), [r.random() for _ in range(3)]) for i in range(200)]
    rows = [(i, u, t, p, [x / sum(s) for x in s]) for i, u, t, p, s in rows]
    return rows, spark.createDataFrame(rows, "i long, unit string, y_true string, y_pred string, scores array<double>")


def test_metrics_equal_plain_ones(spark):
    rows, frame = predictions(spark)
    m = metrics.summary(metrics.per_class(metrics.confusion(frame))).first()
    truth, pred = [r[2] for r in rows], [r[3] for r in rows]
    recall = [sum(t == p == c for t, p in zip(truth, pred, strict=True)) / truth.count(c) for c in "abc"]
    f1 = [2 * sum(t == p == c for t, p in zip(truth, pred, strict=True)) / (truth.count(c) + pred.count(c)) for c in "abc"]
    assert math.isclose(m["balanced_accuracy"], np.mean(recall)) and math.isclose(m["macro_f1"], np.mean(f1))
    assert math.isclose(m["weighted_f1"], sum(f * truth.count(c) for f, c in zip(f1, "abc", strict=True)) / 200)
    place = F.array_position(F.array(*[F.lit(c) for c in "abc"]), F.col("y_true")).cast("int")
    got = frame.agg(F.avg(metrics.log_loss(F.element_at("scores", place))).alias("l"), F.avg(metrics.brier(F.col("scores"), place)).alias("b")).first()
    assert math.isclose(got["l"], np.mean([-math.log(s["abc".index(t)]) for *_, t, _, s in rows]))
    assert math.isclose(got["b"], np.mean([sum((x - (c == t)) ** 2 for x, c in zip(s, "abc", strict=True)) for *_, t, _, s in rows]))


def test_unit_predictions_and_mixed_truth(spark):
    rows, frame = predictions(spark)
    got = {r["unit"]: r["y_pred"] for r in metrics.by_unit(frame, "unit", list("abc")).collect()}
    for u in {r[1] for r in rows}:
        mean = np.mean([r[4] for r in rows if r[1] == u], axis=0)
        assert got[u] == "abc"[int(mean.argmax())]
    with pytest.raises(Exception, match="differ in truth"):
        metrics.by_unit(frame.withColumn("y_true", F.col("i").cast("string")), "unit", list("abc")).collect()


def test_bins_keep_empty_ones_and_close_the_last(spark):
    frame = spark.createDataFrame([(1.0, 1), (0.95, 0), (0.05, 1)], "confidence double, correct int")
    table = {r["bin"]: r["n"] for r in metrics.reliability(frame, 10).collect()}
    assert table == {i: {0: 1, 9: 2}.get(i, 0) for i in range(10)}
    assert math.isclose(metrics.calibration_error(metrics.reliability(frame, 10)).first()["ece"], (2 * abs(0.5 - 0.975) + 0.95) / 3)


def test_matched_null_floor_ties_and_missing_baseline(spark):
    observed = spark.createDataFrame([("s", 0.8, 0.7)], "k string, baseline double, value double")
    null = lambda *v: spark.createDataFrame([("s", x) for x in v], "k string, value double")
    assert inference.matched_null(observed, null(0.79, 0.81, 0.8), ["k"]).first()["p_value"] == 0.25
    tied = inference.matched_null(observed, null(0.7, 0.81, 0.82), ["k"]).first()
    assert tied["p_value"] == 0.5 and tied["n_ties"] == 1
    assert inference.matched_null(observed.limit(0), null(0.7), ["k"]).count() == 0


def test_bootstrap_is_centred_and_repeatable(spark):
    _, frame = predictions(spark)
    frame = frame.withColumn("run", F.lit("r"))
    one = [tuple(r) for r in inference.cluster_bootstrap(frame, "unit", "run", 300, 5).orderBy("metric").collect()]
    two = [tuple(r) for r in inference.cluster_bootstrap(frame.repartition(6), "unit", "run", 300, 5).orderBy("metric").collect()]
    assert one == two and all(low <= estimate <= high for _, _, estimate, low, _, high in one)


def test_scaler_sees_training_rows_only():
    train, test = models.scaled(pd.DataFrame({"x": [0, 1, 2, 3]}), pd.DataFrame({"x": [1000, 2000]}))
    assert math.isclose(train.mean(), 0, abs_tol=1e-12) and math.isclose(test[0, 0], (1000 - 1.5) / np.std([0, 1, 2, 3]))


def test_logistic_regression_is_the_penalised_optimum(spark):
    r = np.random.default_rng(0)
    x = np.r_[r.normal(0, 1, (40, 2)), r.normal(2, 1, (40, 2))]
    frame = spark.createDataFrame([(i, v.tolist(), "a" if i < 40 else "b") for i, v in enumerate(x)], "i long, v array<double>, y string")
    got = models.logistic_fold(frame, frame, "v", "y").toPandas()
    assert (got.y_true == got.y_pred).mean() > 0.85 and np.allclose([sum(s) for s in got.scores], 1)
    svm = models.linear_svm(frame, frame, "v", "y").toPandas()
    assert (svm.y_true == svm.y_pred).mean() > 0.85


def test_metadata_features(spark):
    frame = spark.createDataFrame([(1.0, "A "), (None, "b"), (3.0, None), (5.0, "")], "w double, c string")
    got = models.metadata_features(frame, ["w"], ["c"]).collect()
    assert len({len(r["features"]) for r in got}) == 1 and got[0]["features"][0] < got[3]["features"][0]


# expressions


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_missing_numbers_take_the_default(spark):
    for x in (None, float("nan"), float("inf")):
        assert value(spark, X.finite(F.lit(x).cast("double"), -1.0)) == -1.0
        assert value(spark, X.clip01(F.lit(x).cast("double"))) == 0.0
    assert value(spark, X.clip01(F.lit(1.7))) == 1.0


def test_deciles_are_not_ntiles(spark):
    got = [r["d"] for r in spark.range(1, 14).select(X.decile(F.col("id"), F.lit(13)).alias("d"), "id").orderBy("id").collect()]
    assert got[1:5] == [2, 3, 4, 4]


def test_names_and_paths(spark):
    assert value(spark, X.normal_path(F.lit(".\\A//b/./C"))) == "a/b/./c"
    assert value(spark, X.slug(F.lit("  Big, Name! "))) == "big-name"
    prefix, moment = X.timestamp_key(F.lit("img_20240229_235959120"))
    assert value(spark, prefix) == "img_20240229_" and value(spark, moment) == 1709251199.12
    for name in ("scan 20240131_235959", "img_20240131_240000", "img_20240131_235960", "", None):
        assert value(spark, X.timestamp_key(F.lit(name).cast("string"))[0]) is None
    assert value(spark, X.timestamp_key(F.lit(" Farm_PXL_20240131_000000_jpg.rf.0aF "))[0]) == "farm_img_20240131_"
    assert value(spark, X.clean_origin(F.lit("A_jpg.rf.12ab"))) == "a" and value(spark, X.sequence_key(F.lit("Frame12.PNG"))[1]) == 12
    assert value(spark, X.timestamp_key(F.lit("img_20230229_000000"))[1]) is None
    assert (value(spark, X.sequence_key(F.lit("frame0012"))[0]), value(spark, X.sequence_key(F.lit("frame0012"))[1])) == ("frame", 12)
    assert value(spark, X.sequence_key(F.lit("a1"))[0]) is None
    assert value(spark, X.pair_key(F.lit("b"), F.lit("a"))) == "a||b"
    assert value(spark, X.seed_of("20260731", "S3A0001", "")) == 4145527585


def test_student_quantiles_meet_their_definition(spark):
    from kinfold.operators.inference import student_cdf, student_column, student_quantile

    for df, want in ((1, 12.706204736), (2, 4.302652730), (11, 2.200985160), (15, 2.131449546), (16, 2.119905299), (100, 1.983971519)):
        assert abs(student_quantile(0.975, df) - want) < 1e-8 and abs(student_cdf(want, df) - 0.975) < 1e-9
    for df in (200, 201, 1000):
        assert abs(value(spark, student_column(F.lit(df))) - student_quantile(0.975, df)) < 1e-8
    assert value(spark, student_column(F.lit(0))) is None


def test_scores_and_labels(spark):
    soft = value(spark, X.softmax(F.array(F.lit(1000.0), F.lit(1000.0))))
    assert soft == [0.5, 0.5]
    assert value(spark, X.argmax(F.array(F.lit("x"), F.lit("y")), F.array(F.lit(2.0), F.lit(2.0)))) == "x"
    scores = F.create_map(F.lit("b"), F.lit(0.7), F.lit("a"), F.lit(0.3))
    assert value(spark, X.aligned(scores, ["a", "b"])) == [0.3, 0.7]
    with pytest.raises(Exception, match="no score for label c"):
        value(spark, X.aligned(scores, ["a", "c"]))


def test_bins_have_the_right_edges(spark):
    names = [value(spark, X.right_closed(F.lit(x), [0, 1, 2, 4], ["a", "b", "c"], "-")) for x in (0, 1, 1.5, 2, 4, 5)]
    assert names == ["a", "a", "b", "b", "c", "-"]
    assert [value(spark, X.left_closed(F.lit(x), [0, 1, 2], ["a", "b"], "-")) for x in (0, 1, 2)] == ["a", "b", "-"]


def test_wilson_stays_in_bounds(spark):
    low, high = X.wilson(F.lit(0), F.lit(600))
    assert 0 <= value(spark, low) <= value(spark, high) < 0.01
    assert value(spark, X.wilson(F.lit(0), F.lit(0))[0]) is None


def test_relations_of_plain_cases(spark):
    def relation(**evidence):
        frame = spark.createDataFrame([{"entropy_a": 7.0, "entropy_b": 7.0, "coverage_a": 0.5, "coverage_b": 0.5, **evidence}])
        return frame.select(X.relation(frame.columns, F.lit(False)).alias("r")).first()["r"]

    strong = relation(direct_ncc=1.0, direct_grad=1.0, direct_ssim=1.0)
    assert strong["relation"] == X.DERIVATIVE[0] and math.isclose(strong["score"], 100.0)
    assert relation(direct_ncc=float("nan"))["relation"] == X.RELATIONS[4]
    assert relation(direct_ncc=0.91)["relation"] == X.RELATIONS[3]
    assert relation(inliers=20.0, ratio=0.5, reproj=1.0, overlap=0.5)["relation"] == X.SAME_SCENE


def test_exact_components_and_conflicts(spark):
    items = spark.createDataFrame([(1, "s", "h1", "a"), (2, "t", "h1", "b"), (3, "s", "h2", ""), (4, "s", None, "a")], "doc_id long, source string, content string, label string")
    got = {r["content"]: r for r in groups.conflicts(groups.exact_components(items, "doc_id", "content", ["label", "source"]), ["label", "source"]).collect()}
    assert got.keys() == {"h1", "h2"} and got["h1"]["labels"] == "a|b" and got["h1"]["cross_source"] == "YES" and got["h2"]["n_labels"] == 0
    assert groups.missing_content(items, "content").first()[0] == 1
    numbered = groups.numbered(items.filter("content is not null").select("doc_id").repartition(3), "doc_id", "N", "name").orderBy("doc_id").collect()
    assert [r["name"] for r in numbered] == ["N000001", "N000002", "N000003"]


def test_contracts(spark):
    items = spark.createDataFrame([(1, 2), (1, 3)], "a int, b int")
    assert groups.require(items, ["a", "b"], count=2) is items
    with pytest.raises(ValueError, match="missing columns: c"):
        groups.require(items, ["c"])
    with pytest.raises(ValueError, match="repeated keys"):
        groups.require(items, [], unique=["a"])


def test_ledger_keeps_the_strongest_relation(spark):
    edges = spark.createDataFrame([(2, 1, X.RELATIONS[3], "x"), (1, 2, X.RELATIONS[0], "y"), (3, 4, X.RELATIONS[4], "x")], "item_a long, item_b long, relation string, stage string")
    got = {r["edge_key"]: r for r in units.edge_ledger(edges).collect()}
    assert got["1||2"]["relation"] == X.RELATIONS[0] and got["1||2"]["disagreement"] == "YES" and got["3||4"]["n_rows"] == 1


def test_ids_do_not_depend_on_partitions(spark):
    edges = [(i, i + 1) for i in range(0, 40, 2)] + [(1, 2)]
    nodes = spark.range(45).withColumnRenamed("id", "n")
    ids = []
    for parts in (1, 7):
        g = graph.grouped(nodes.repartition(parts), edges_frame(spark, edges).repartition(parts), "n", "a", "b")
        ids.append(sorted((r["n"], r["group_id"]) for r in graph.named_groups(g, "n", "G_").collect()))
    assert ids[0] == ids[1]
