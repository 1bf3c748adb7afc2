"""Queries over study designs: splits, grids, metrics, inference, models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.functions import exprs as X
from kinfold.operators import inference as I
from kinfold.operators import metrics as M
from kinfold.operators import models as L
from kinfold.operators import splits as S
from kinfold.plans.views import ITEMS, PREDICTIONS, draw_sql, items, predictions, table, unit_draw

LABELS = [str(i) for i in range(10)]


def stratified_kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.stratified_folds(items(spark, sf_dir), "doc_id", "label", 20).select("doc_id", "label", "fold")


_FOLDS = "folds as (select doc_id, content, source, label, ((row_number() over (partition by label order by sha256('20|' || doc_id::varchar), doc_id) - 1) % 5)::int as fold from items)"


def group_kfold_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds of whole components: nothing crosses, and each fold's share of each label."""
    i = items(spark, sf_dir)
    joined = i.join(S.group_folds(i, "content", "label", 20), "content")
    crossing = joined.groupBy("content").agg(F.countDistinct("fold").alias("f")).agg(F.count_if(F.col("f") > 1).alias("n_crossing"), F.count("*").alias("n_components"))
    shares = joined.groupBy("label", "fold").agg(F.count("*").alias("n")).groupBy("label").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.count("*").alias("folds"))
    return shares.withColumn("n_crossing", F.lit(crossing.first()["n_crossing"]))


def fold_crossing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = S.stratified_folds(items(spark, sf_dir), "doc_id", "label", 20)
    return S.crossings(f, "content")


def shared_group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir)
    return S.shared_groups(i.filter("split = 'train'"), i.filter("split = 'test'"), "content")


def fixed_test_designs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = S.designs(items(spark, sf_dir), F.col("split") == "test", {"naive": None, "content_safe": "content", "length_safe": "n_chars"})
    return d.groupBy("design", "role", "label").agg(F.count("*").alias("n"))


def source_holdout_designs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.holdouts(items(spark, sf_dir), "source", "content")


def rotated_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = S.stratified_folds(items(spark, sf_dir), "doc_id", "label", 20).select("doc_id", "fold", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("test_fold"))
    return f.groupBy("test_fold", S.rotated_role(F.col("fold"), F.col("test_fold")).alias("role")).agg(F.count("*").alias("n"))


_SEEDS, _FEW = list(range(1, 21)), list(range(1, 11))
_DESIGNS = ["random", "exact", "lineage", "scene", "ambiguity"]
_SAFE = ["scene", "ambiguity"]
_FEATURES, _FITS = ["metadata", "first", "second", "both"], ["logistic", "svm"]
_TWO, _SOURCES = ["three_class", "four_stage"], ["x", "y", "z"]
#: The study's grids as parts, each the combinations of a few axes; their sizes (176, 656, 1,406, 168 and 40) are the study's.
GRIDS = {
    "frozen": [
        {"task": _TWO, "design": _DESIGNS, "features": _FEATURES, "fit": _FITS},
        {"design": ["train_to_validation", "trainval_to_test"], "features": _FEATURES, "fit": _FITS},
        {"held_out": _SOURCES, "design": ["naive", "strict", "scene"], "features": _FEATURES, "fit": _FITS},
        {"design": _SAFE, "features": _FEATURES},
    ],
    "design": [
        {"task": _TWO, "design": _DESIGNS, "seed": _SEEDS},
        {"task": _TWO, "design": _DESIGNS, "features": ["both"], "seed": _FEW},
        {"task": _TWO, "design": _SAFE, "mode": ["weighted", "representative"], "seed": _SEEDS},
        {"design": _SAFE, "mode": ["all", "weighted", "representative"], "seed": _SEEDS},
        {"design": _SAFE, "features": ["both"], "seed": _FEW},
        {"design": _DESIGNS, "features": ["second", "both"]},
        {"design": _SAFE, "mode": ["weighted", "representative"]},
        {"held_out": _SOURCES, "design": _DESIGNS, "features": ["second", "both"]},
        {"held_out": _SOURCES, "design": _SAFE, "mode": ["weighted", "representative"]},
    ],
    "null": [{"scenario": _SOURCES, "kind": ["baseline", "safe"]}, {"scenario": ["public"], "replicate": list(range(500))}, {"scenario": ["x", "y", "z"], "replicate": list(range(300))}],
    "shortcut": [{"features": list("abcdefghijklmnopqrstuvwx"), "seed": list(range(7))}],
    "end_to_end": [{"task": _TWO, "model": ["first", "second"], "seed": list(range(5)), "design": ["random", "scene"]}],
}


def config_grid_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, parts in GRIDS.items():
        for i, axes in enumerate(parts):
            part = S.grid(spark, **axes).agg(F.lit(name).alias("grid"), F.lit(i).alias("part"), F.count("*").alias("n_configs"), F.max("array_index").cast("long").alias("last_index"))
            out = part if out is None else out.unionByName(part)
    return out.groupBy("grid").agg(F.count("*").alias("n_parts"), F.sum("n_configs").alias("n_configs"), F.max("last_index").alias("largest_part"))


def control_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.round_robin(items(spark, sf_dir), "doc_id", ["source", "label"], 11, 120).select("doc_id", "source", "label", "turn")


def _wanted(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("de", 3), ("en", 8), ("es", 2), ("fr", 4)], "label string, n int")


def removal_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.removal_sets(items(spark, sf_dir).select("doc_id", "label"), "doc_id", "label", _wanted(spark), 25, 5)


def removal_set_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.set_hashes(removal_sets(spark, sf_dir), "doc_id")


_SETS = "d as (select r as replicate, label, doc_id, n, row_number() over (partition by r, label order by sha256('5|' || r::varchar || '|' || doc_id::varchar), doc_id) as k from items join (values ('de', 3), ('en', 8), ('es', 2), ('fr', 4)) w(label, n) using (label), range(1, 26) t(r)), sets as (select replicate::int as replicate, label, doc_id from d where k <= n)"


def lineage_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = S.lineage_weights(items(spark, sf_dir).filter("split = 'train'"), "content")
    return w.groupBy("source").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("weight"), F.round(I.effective_size(F.col("weight")), 6).alias("effective_n"))


def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.class_weights(items(spark, sf_dir), "label").withColumn("weight", F.round("weight", 9))


def confusion_matrix_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.confusion(predictions(spark, sf_dir), ["run"])


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.per_class(M.confusion(predictions(spark, sf_dir), ["run"]), ["run"])


def per_class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classes(spark, sf_dir).select("run", "label", "support", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


def multiclass_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.summary(_classes(spark, sf_dir), ["run"]).select("run", "n", *[F.round(c, 9).alias(c) for c in ("accuracy", "balanced_accuracy", "macro_f1", "weighted_f1")])


#: Labels given beforehand: ten that occur, but not in every unit's rows, and one that never does.
FIXED_LABELS = [str(x) for x in range(11)]


def fixed_label_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of small groups under a given list of labels: most groups lack some classes, and one class never occurs."""
    p = predictions(spark, sf_dir).withColumn("part", (F.col("vec_id") % 61).cast("int"))
    by = ["run", "part"]
    return M.summary(M.per_class(M.confusion(p, by, FIXED_LABELS), by), by).select(*by, "n", *[F.round(c, 9).alias(c) for c in ("accuracy", "balanced_accuracy", "macro_f1", "weighted_f1")])


def student_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of means of groups of 1, 2, 12, 16 and 301 values."""
    v = predictions(spark, sf_dir).filter("run = 'base'").select("vec_id", F.col("top").alias("value"))
    v = v.select("value", "vec_id", F.explode(F.array(*[F.lit(n) for n in (1, 2, 12, 16, 301)])).alias("size")).filter("vec_id < size")
    return I.t_interval(v, ["size"]).select("size", "n", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "low", "high")])


def sequence_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time and sequence keys of names made from the ids of events, some of them no such names."""
    i = F.col("event_id")
    digits = F.lpad((20230101 + i % 2400).cast("string"), 8, "0")
    clock = F.lpad((i * 7919 % 250000).cast("string"), 6, "0")
    forms = F.array(
        F.concat(F.lit("IMG_"), digits, F.lit("_"), clock, F.lit("12.JPG")), F.concat(F.lit("farm a pxl_"), digits, F.lit("_"), clock, F.lit("_jpg.rf.0a1b")),
        F.concat(F.lit("scan "), digits, F.lit("_"), clock), F.concat(F.lit(" Frame-"), (i % 977).cast("string"), F.lit(".png")), F.concat(F.lit("x"), (i % 5).cast("string")),
    )
    e = table(spark, sf_dir, "events").select("event_id", F.element_at(forms, (i % 5 + 1).cast("int")).alias("name"))
    (a, moment), (b, number) = X.timestamp_key(F.col("name")), X.sequence_key(F.col("name"))
    return e.select("event_id", "name", a.alias("time_prefix"), moment.alias("moment"), b.alias("prefix"), number.alias("number"))


_CLASSES = f"""with {PREDICTIONS}, ls as (select distinct run, unnest([y_true, y_pred]) as label from preds), per as (select run, label,
  (select count(*) from preds p where p.run = ls.run and p.y_true = label) as support, (select count(*) from preds p where p.run = ls.run and p.y_pred = label) as predicted, (select count(*) from preds p where p.run = ls.run and p.y_true = label and p.y_pred = label) as hits from ls),
c as (select run, label, support, hits, case when predicted > 0 then hits / predicted else 0.0 end as precision, case when support > 0 then hits / support else 0.0 end as recall from per),
classes as (select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0.0 end as f1 from c)"""


def logloss_brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.col("y_true").cast("int") + 1
    p = predictions(spark, sf_dir)
    return p.groupBy("run").agg(F.round(F.avg(M.log_loss(F.element_at("scores", place))), 9).alias("log_loss"), F.round(F.avg(M.brier(F.col("scores"), place)), 9).alias("brier"))


def _bins(spark: SparkSession, sf_dir: str, bins: int) -> DataFrame:
    p = predictions(spark, sf_dir).select("run", F.col("top").alias("confidence"), (F.col("y_true") == F.col("y_pred")).cast("int").alias("correct"))
    return M.reliability(p, bins, ["run"])


def reliability_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bins(spark, sf_dir, 10).select("run", "bin", "n", F.round("mean_confidence", 9).alias("mean_confidence"), F.round("accuracy", 9).alias("accuracy"))


def calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.calibration_error(_bins(spark, sf_dir, 15), ["run"]).withColumn("ece", F.round("ece", 9))


def unit_aggregated_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = M.by_unit(predictions(spark, sf_dir), "unit", LABELS, ["run"])
    return u.groupBy("run").agg(F.count("*").alias("n_units"), F.round(F.avg((F.col("y_true") == F.col("y_pred")).cast("int")), 9).alias("accuracy"))


def _fold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).groupBy("run", "fold").agg(F.count("*").alias("n"), F.round(F.avg((F.col("y_true") == F.col("y_pred")).cast("int")), 9).alias("value"))


_FOLD = f"with {PREDICTIONS}, fm as (select run, fold, count(*) as n, round(avg((y_true = y_pred)::int), 9) as value from preds group by 1, 2)"


def seed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = I.seed_summary(_fold_metrics(spark, sf_dir), ["run"])
    return s.select("run", "n", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "median", "low", "high", "least", "largest")])


def weighted_fold_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fold_metrics(spark, sf_dir).groupBy("run").agg(F.round(F.sum(F.col("n") * F.col("value")) / F.sum("n"), 9).alias("accuracy"))


def paired_delta_t_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _fold_metrics(spark, sf_dir)
    out = None
    for other in ("safe", "strict"):
        d = I.paired(f.filter("run = 'base'"), f.filter(F.col("run") == other), ["fold"]).withColumn("comparison", F.lit(f"base_to_{other}"))
        out = d if out is None else out.unionByName(d)
    t = I.t_interval(out.withColumnRenamed("delta", "value"), ["comparison"])
    s = I.delta_summary(out, ["comparison"]).drop("n", "mean_delta")
    return t.join(s, "comparison").select("comparison", "n", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "low", "high", "least", "largest")], "n_negative", "n_positive", "all_negative")


def matched_null_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy by label against made-up removals of 200 replicates."""
    p = predictions(spark, sf_dir)
    acc = p.groupBy(F.col("y_true").alias("label"), "run").agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("int")).alias("v"))
    obs = acc.filter("run = 'base'").select("label", F.round("v", 6).alias("baseline")).join(acc.filter("run = 'safe'").select("label", F.round("v", 6).alias("value")), "label")
    null = obs.select("label", F.explode(F.sequence(F.lit(1), F.lit(200))).alias("replicate"), "baseline")
    null = null.select("label", F.round(F.col("baseline") + 0.1 * (unit_draw(F.col("label"), F.col("replicate").cast("string"), "null") - 0.5), 6).alias("value"))
    t = I.matched_null(obs, null, ["label"])
    return t.select("label", "n_null", "n_ties", *[F.round(c, 6).alias(c) for c in ("observed_delta", "null_mean", "null_low", "null_high", "p_value")])


def cluster_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.cluster_bootstrap(predictions(spark, sf_dir), "unit", "run", 500, 1)


def bootstrap_mean_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.bootstrap_mean(_fold_metrics(spark, sf_dir), "run", "value", 5000, 1)


def paired_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir).withColumn("hit", (F.col("y_true") == F.col("y_pred")).cast("int"))
    c = p.groupBy("unit").agg(F.count_if(F.col("run") == "base").alias("n"), F.sum(F.when(F.col("run") == "base", F.col("hit")).otherwise(0)).alias("hits_a"), F.sum(F.when(F.col("run") == "safe", F.col("hit")).otherwise(0)).alias("hits_b"))
    return I.paired_cluster_bootstrap(c, "unit", 2000, 1)


def logistic_oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold predictions of the vectors' labels by multinomial logistic regression."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("string").alias("label"), "embedding")
    folds = S.stratified_folds(e, "vec_id", "label", 3, folds=3)
    return L.out_of_fold(folds, "embedding", "label").select("vec_id", "fold", "y_true", "y_pred")


def centroid_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's label by the nearest mean of the vectors of other folds, counted."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding", (F.col("vec_id") % 2).alias("fold"))
    size = 64
    means = e.groupBy("label", "fold").agg(F.array(*[F.avg(F.element_at("embedding", i + 1).cast("double")) for i in range(size)]).alias("c"))
    by = means.select(F.col("label").alias("c_label"), (1 - F.col("fold")).alias("fold"), "c")
    from kinfold.functions.exprs import dot

    scored = e.join(F.broadcast(by), "fold").withColumn("s", F.round(dot(F.col("embedding"), F.col("c")), 9))  # one row for each label and fold
    best = scored.groupBy("vec_id", "label").agg(F.min(F.struct((-F.col("s")).alias("s"), "c_label")).alias("b"))
    return best.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("b.c_label") == F.col("label")).alias("n_hits"))


_ROUND = lambda *cols: ", ".join(f"round({c}, 6) as {c}" for c in cols)
ORACLE = {
    "stratified_kfold": f"with {ITEMS}, {_FOLDS} select doc_id, label, fold from folds",
    "fold_crossing_counts": f"with {ITEMS}, {_FOLDS}, g as (select content, count(distinct fold) as n from folds group by 1) select count(*) filter (n > 1) as n_crossing, count(*) as n_groups from g",
    "shared_group_counts": f"with {ITEMS} select count(*) as n_shared from (select content from items where split = 'train' intersect select content from items where split = 'test')",
    "fixed_test_designs": f"with {ITEMS}, t as (select * from items where split = 'test'), r as (select * from items where split <> 'test'), d as (select 'naive' as design, 'TRAIN' as role, label from r union all select 'content_safe', 'TRAIN', label from r where content not in (select content from t) union all select 'length_safe', 'TRAIN', label from r where n_chars not in (select n_chars from t) union all select d.d, 'TEST', label from t, (values ('naive'), ('content_safe'), ('length_safe')) d(d)) select design, role, label, count(*) as n from d group by all",
    "source_holdout_designs": f"with {ITEMS}, s as (select distinct content, source as held_out from items), u as (select held_out, count(*) as n_unsafe from items join s using (content) where source <> held_out group by 1), n as (select source as held_out, count(*) as n_test from items group by 1) select held_out, n_test, ((select count(*) from items) - n_test)::bigint as n_train_naive, ((select count(*) from items) - n_test - coalesce(n_unsafe, 0))::bigint as n_train_safe from n left join u using (held_out)",
    "rotated_roles": f"with {ITEMS}, {_FOLDS}, r as (select fold, t::int as test_fold, case when fold = t then 'TEST' when fold = (t + 1) % 5 then 'VALIDATION' else 'TRAIN' end as role from folds, range(5) x(t)) select test_fold, role, count(*) as n from r group by all",
    "config_grid_counts": "select * from (values ('frozen', 4::bigint, 176::bigint, 80::bigint), ('design', 9, 656, 200), ('null', 3, 1406, 900), ('shortcut', 1, 168, 168), ('end_to_end', 1, 40, 40)) t(grid, n_parts, n_configs, largest_part)",
    "control_round_robin": f"with {ITEMS}, r as (select doc_id, source, label, row_number() over (partition by source, label order by sha256('11|' || doc_id::varchar), doc_id)::int as turn from items) select doc_id, source, label, turn from r order by turn, source, label, doc_id limit 120",
    "removal_sets": f"with {ITEMS}, {_SETS} select * from sets",
    "removal_set_hashes": f"with {ITEMS}, {_SETS}, h as (select replicate, count(*) as n_units, sha256(string_agg(doc_id::varchar, '|' order by doc_id::varchar)) as set_hash from sets group by 1) select *, row_number() over (partition by set_hash order by replicate) > 1 as repeated from h",
    "lineage_weights": f"with {ITEMS}, t as (select source, 1.0::double / count(*) over (partition by content) as w from items where split = 'train'), m as (select source, w / (select avg(w) from t) as weight from t) select source, count(*) as n, round(sum(weight), 6) as weight, round(sum(weight) * sum(weight) / sum(weight * weight), 6) as effective_n from m group by 1",
    "class_weights": f"with {ITEMS}, c as (select label, count(*) as n from items group by 1) select label, n, round((select sum(n) from c)::double / ((select count(*) from c) * n), 9) as weight from c",
    "confusion_matrix_long": f"with {PREDICTIONS}, l as (select distinct run, unnest([y_true, y_pred]) as x from preds) select a.run, a.x as y_true, b.x as y_pred, (select count(*) from preds p where p.run = a.run and p.y_true = a.x and p.y_pred = b.x) as n from l a join l b on a.run = b.run",
    "per_class_metrics": _CLASSES + " select run, label, support, round(precision, 9) as precision, round(recall, 9) as recall, round(f1, 9) as f1 from classes",
    "multiclass_metrics": _CLASSES + " select run, sum(support)::bigint as n, round(sum(hits) / sum(support), 9) as accuracy, round(avg(recall), 9) as balanced_accuracy, round(avg(f1), 9) as macro_f1, round(sum(f1 * support) / sum(support), 9) as weighted_f1 from classes group by run",
    "fixed_label_metrics": f"""with {PREDICTIONS}, p as (select run, (vec_id % 61)::int as part, y_true, y_pred from preds), g as (select distinct run, part from p),
 c as (select g.run, g.part, x::varchar as label, count(*) filter (y_true = x::varchar) as support, count(*) filter (y_pred = x::varchar) as predicted, count(*) filter (y_true = x::varchar and y_pred = x::varchar) as hits
   from g cross join range(11) t(x) join p on p.run = g.run and p.part = g.part group by 1, 2, 3),
 r as (select *, case when support > 0 then hits / support else 0.0 end as recall, case when support + predicted > 0 then 2 * hits / (support + predicted) else 0.0 end as f1 from c)
 select run, part, sum(support)::bigint as n, round(sum(hits) / sum(support), 9) as accuracy, round(sum(recall) / 11, 9) as balanced_accuracy, round(sum(f1) / 11, 9) as macro_f1, round(sum(f1 * support) / sum(support), 9) as weighted_f1 from r group by run, part""",
    # Student's quantiles for 1, 11, 15 and 300 degrees of freedom, fixed values
    "student_intervals": f"""with {PREDICTIONS}, q(size, t) as (values (1, null::double), (2, 12.706204736), (12, 2.200985160), (16, 2.131449546), (301, 1.967903011)),
 s as (select size, count(*) as n, avg(top) as mean, stddev_samp(top) as sd, max(t) as t from preds join q on vec_id < size where run = 'base' group by size)
 select size, n, round(mean, 6) as mean, round(sd, 6) as sd, round(mean - t * sd / sqrt(n), 6) as low, round(mean + t * sd / sqrt(n), 6) as high from s""",
    "sequence_names": r"""with e as (select event_id, case event_id % 5 when 0 then 'IMG_' || d || '_' || c || '12.JPG' when 1 then 'farm a pxl_' || d || '_' || c || '_jpg.rf.0a1b' when 2 then 'scan ' || d || '_' || c
   when 3 then ' Frame-' || (event_id % 977) || '.png' else 'x' || (event_id % 5) end as name from (select event_id, (20230101 + event_id % 2400)::varchar as d, lpad((event_id * 7919 % 250000)::varchar, 6, '0') as c from events)),
 k as (select *, regexp_replace(regexp_replace(regexp_replace(lower(trim(name)), '\.rf\.[0-9a-f]+$', ''), '_jpg$', ''), '\.(jpg|jpeg|png)$', '') as o from e),
 m as (select *, regexp_extract(o, '^(.*?)(?:img|pxl)_(\d{8})_(\d{6})(\d{0,3})', 2) as d, regexp_extract(o, '^(.*?)(?:img|pxl)_(\d{8})_(\d{6})(\d{0,3})', 3) as c, regexp_extract(o, '^(.*?)(?:img|pxl)_(\d{8})_(\d{6})(\d{0,3})', 4) as f,
   regexp_extract(o, '^(.*?)(?:img|pxl)_(\d{8})_(\d{6})(\d{0,3})', 1) as before, regexp_extract(o, '^(.*?)(\d{1,7})$', 1) as p, regexp_extract(o, '^(.*?)(\d{1,7})$', 2) as num from k),
 t as (select *, case when d <> '' then try_strptime(d || c, '%Y%m%d%H%M%S') end as moment_at from m)
 select event_id, name, case when moment_at is not null then before || 'img_' || d || '_' end as time_prefix, case when moment_at is not null then epoch(moment_at) + rpad(f, 3, '0')::double / 1000 end as moment,
   case when length(p) >= 2 then p end as prefix, case when length(p) >= 2 then num::bigint end as number from t""",
    "logloss_brier": f"with {PREDICTIONS} select run, round(avg(-ln(greatest(least(scores[y_true::int + 1], 1), 1e-15))), 9) as log_loss, round(avg(list_sum(list_transform(range(10), lambda c: (scores[c + 1] - (c = y_true::int)::int) * (scores[c + 1] - (c = y_true::int)::int)))), 9) as brier from preds group by run",
    "reliability_table": f"with {PREDICTIONS}, b as (select run, least(floor(top * 10), 9)::int as bin, count(*) as n, avg(top) as c, avg((y_true = y_pred)::int) as a from preds group by 1, 2) select r.run, k::int as bin, coalesce(n, 0) as n, round(c, 9) as mean_confidence, round(a, 9) as accuracy from (select distinct run from preds) r, range(10) t(k) left join b on b.run = r.run and b.bin = k",
    "calibration_error": f"with {PREDICTIONS}, b as (select run, least(floor(top * 15), 14)::int as bin, count(*) as n, avg(top) as c, avg((y_true = y_pred)::int) as a from preds group by 1, 2) select run, round(sum(abs(a - c) * n) / sum(n), 9) as ece from b group by run",
    "unit_aggregated_metrics": f"with {PREDICTIONS}, u as (select run, unit, min(y_true) as y_true, " + ", ".join(f"avg(scores[{i + 1}]) as s{i}" for i in range(10)) + " from preds group by 1, 2), b as (select run, y_true, [" + ", ".join(f"s{i}" for i in range(10)) + "] as s from u) select run, count(*) as n_units, round(avg((y_true = (list_position(s, list_max(s)) - 1)::varchar)::int), 9) as accuracy from b group by run",
    "seed_summary": _FOLD + " select run, count(*) as n, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as sd, round(quantile_cont(value, 0.5), 6) as median, round(quantile_cont(value, 0.025), 6) as low, round(quantile_cont(value, 0.975), 6) as high, round(min(value), 6) as least, round(max(value), 6) as largest from fm group by run",
    "weighted_fold_mean": _FOLD + " select run, round(sum(n * value) / sum(n), 9) as accuracy from fm group by run",
    "paired_delta_t_interval": _FOLD + ", d as (select 'base_to_' || b.run as comparison, b.value - a.value as delta from fm a join fm b using (fold) where a.run = 'base' and b.run <> 'base'), s as (select comparison, count(*) as n, avg(delta) as mean, stddev_samp(delta) as sd, min(delta) as least, max(delta) as largest, count(*) filter (delta < 0) as n_negative, count(*) filter (delta > 0) as n_positive, bool_and(delta < 0) as all_negative from d group by 1) select comparison, n, round(mean, 6) as mean, round(sd, 6) as sd, round(mean - 3.182446 * sd / sqrt(n), 6) as low, round(mean + 3.182446 * sd / sqrt(n), 6) as high, round(least, 6) as least, round(largest, 6) as largest, n_negative, n_positive, all_negative from s",
    "matched_null_inference": f"with {PREDICTIONS}, a as (select y_true as label, run, avg((y_true = y_pred)::int) as v from preds group by 1, 2), o as (select x.label, round(x.v, 6) as baseline, round(y.v, 6) as value from a x join a y on x.label = y.label and x.run = 'base' and y.run = 'safe'), n as (select label, baseline, value - baseline as observed_delta, round(baseline + 0.1 * ({draw_sql('label', 'r::varchar', chr(39) + 'null' + chr(39))} - 0.5), 6) - baseline as d from o, range(1, 201) t(r)) select label, count(*) as n_null, count(*) filter (d = observed_delta) as n_ties, round(observed_delta, 6) as observed_delta, round(avg(d), 6) as null_mean, round(quantile_cont(d, 0.025), 6) as null_low, round(quantile_cont(d, 0.975), 6) as null_high, round((1 + count(*) filter (d <= observed_delta)) / (count(*) + 1), 6) as p_value from n group by label, observed_delta",
}
QUERIES = {name: globals()[name] for name in (*ORACLE, "group_kfold_audit", "cluster_bootstrap_ci", "bootstrap_mean_ci", "paired_bootstrap_ci", "logistic_oof", "centroid_predictions")}
