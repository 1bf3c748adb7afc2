"""Scalar expressions: plain Columns in, plain Columns out, all inside generated code.

Missing values follow one rule: an empty string is a value of its own in text
columns, and a number that is null, NaN or infinite takes the default that the
caller names, since NaN compares as the largest number here.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str, default: float) -> Column:
    x = col(c).cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(default)).otherwise(x)


def clip01(c: Column | str) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), finite(c, 0.0)))


def blank(c: Column | str) -> Column:
    """Text with null as the empty string, trimmed."""
    return F.trim(F.coalesce(col(c).cast("string"), F.lit("")))


def number(c: Column | str) -> Column:
    """Text as a number; null where it is none."""
    return F.expr(f"try_cast({c} as double)") if isinstance(c, str) else c.try_cast("double")


def yes(c: Column | str) -> Column:
    return F.upper(blank(c)) == "YES"


def yes_no(condition: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), "YES").otherwise("NO")


def set_join(c: Column | str, skip: Sequence[str] = ("",)) -> Column:
    """Aggregate: the distinct values, sorted, joined by |; the skipped ones left out."""
    kept = F.when(~F.coalesce(col(c).cast("string"), F.lit("")).isin(*skip), col(c).cast("string"))
    return F.array_join(F.array_sort(F.collect_set(kept)), "|")


def atoms(c: Column | str) -> Column:
    """The parts of a |-joined set."""
    return F.filter(F.split(blank(c), r"\|"), lambda x: x != "")


# paths and names


def normal_path(c: Column | str) -> Column:
    """Lower case, forward slashes, no ./ at the start and no doubled slashes."""
    slashes = F.regexp_replace(F.regexp_replace(blank(c), r"\\", "/"), "/{2,}", "/")
    return F.lower(F.regexp_replace(slashes, r"^(\./)+", ""))


def path_part(c: Column | str, names: Mapping[str, str], default: str) -> Column:
    """What the first path component stands for that is one of the names."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    hits = F.filter(F.transform(F.split(F.lower(col(c)), "/"), lambda x: table[x]), lambda x: x.isNotNull())
    return F.coalesce(F.try_element_at(hits, F.lit(1)), F.lit(default))


def extension(c: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(c), r"(\.[^./]+)$", 1))


def file_name(c: Column | str) -> Column:
    return F.regexp_extract(col(c), r"([^/]*)$", 1)


def stem(c: Column | str) -> Column:
    return F.regexp_replace(file_name(c), r"\.[^.]+$", "")


def slug(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def clean_origin(c: Column | str) -> Column:
    """Lower case, without outer white space, an export's mark (.rf. and hex digits), a tail _jpg and an image extension, in this order."""
    text = F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), r"^\s+|\s+$", "")
    for pattern in (r"\.rf\.[0-9a-f]+$", "_jpg$", r"\.(jpg|jpeg|png)$"):
        text = F.regexp_replace(text, pattern, "")
    return text


def timestamp_key(c: Column | str) -> tuple[Column, Column]:
    """(prefix with the day, epoch seconds in UTC) of a name with img_ or pxl_, a day and a time, as img_20240131_235959123; null where
    there is no valid moment. The session's time zone plays no part."""
    pattern = r"^(.*?)(?:img|pxl)_(\d{8})_(\d{2})(\d{2})(\d{2})(\d{0,3})"
    start, day, hour, minute, second, fraction = (F.regexp_extract(clean_origin(c), pattern, i) for i in range(1, 7))
    date = F.concat_ws("-", F.substr(day, F.lit(1), F.lit(4)), F.substr(day, F.lit(5), F.lit(2)), F.substr(day, F.lit(7), F.lit(2))).try_cast("date")
    valid = (day != "") & date.isNotNull() & (hour < "24") & (minute < "60") & (second < "60")
    number = lambda x: x.try_cast("double")
    seconds = F.unix_date(date) * 86400.0 + number(hour) * 3600 + number(minute) * 60 + number(second) + number(F.rpad(fraction, 3, "0")) / 1000
    return F.when(valid, F.concat(start, F.lit("img_"), day, F.lit("_"))), F.when(valid, seconds)


def sequence_key(c: Column | str) -> tuple[Column, Column]:
    """(prefix of two characters at least, number) of a cleaned name that ends in digits, of which at most seven are the number; null where it doesn't."""
    pattern = r"^(.*?)(\d{1,7})$"
    prefix = F.regexp_extract(clean_origin(c), pattern, 1)
    good = F.length(prefix) >= 2
    return F.when(good, prefix), F.when(good, F.regexp_extract(clean_origin(c), pattern, 2).cast("long"))


# ids


def pair_key(a: Column | str, b: Column | str) -> Column:
    return F.concat_ws("||", F.least(col(a), col(b)), F.greatest(col(a), col(b)))


def group_id(prefix: str, members: Column) -> Column:
    """An id that depends on nothing but the set of members."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.array_join(F.array_sort(F.array_distinct(members)), "\n"), 256), 1, 16))


def short_hash(*parts: Column) -> Column:
    return F.substring(F.sha1(F.array_join(F.filter(F.array(*parts), lambda x: x != ""), "|")), 1, 12)


def seed_of(*parts: Column | str) -> Column:
    """A number below 2 ** 32 from the first eight hex digits of a SHA-256."""
    text = F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")


def draw(seed: Column | str | int, item: Column) -> Column:
    """A position for an item in the order that a seed deals: uniform hex, the same in any engine that has SHA-256."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)) if not isinstance(seed, Column) else seed.cast("string"), item.cast("string")), 256)


# bits and vectors


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hamming_sets(a: Column, b: Column, none: int = 999) -> Column:
    """The least distance between members of two arrays; `none` if one is empty."""
    every = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.bit_count(x.bitwiseXOR(y)))))
    return F.coalesce(F.array_min(every), F.lit(none))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normed(a: Column) -> Column:
    """The vector divided by its length; a zero vector stays."""
    size = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: x / F.when(size == 0, 1.0).otherwise(size))


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    weights = F.transform(scores, lambda x: F.exp(x - top))
    return F.transform(weights, lambda w: w / F.aggregate(weights, F.lit(0.0), lambda s, x: s + x))


def argmax(labels: Column, scores: Column) -> Column:
    """The label of the largest score, the first of several."""
    return F.element_at(labels, F.array_position(scores, F.array_max(scores)).cast("int"))


def aligned(scores: Column, labels: Sequence[str]) -> Column:
    """Scores of a map from label to score in the order of the labels; a missing label is an error."""
    return F.transform(F.array(*[F.lit(x) for x in labels]), lambda x: F.coalesce(F.try_element_at(scores, x), F.raise_error(F.concat(F.lit("no score for label "), x)).cast("double")))


# bins, ranks, risks


def decile(rank: Column, count: Column) -> Column:
    """ceil(10 * rank / count), at most 10: not what ntile gives."""
    return F.least(F.lit(10), F.ceil(rank * 10.0 / count).cast("int"))


def right_closed(c: Column | str, edges: Sequence[float], names: Sequence[str], outside: str = "") -> Column:
    """The name of the interval (low, high] that holds the value; the first interval also holds its low edge."""
    x, out = col(c), None
    for low, high, name in zip(edges, edges[1:], names, strict=False):
        inside = ((x > low) if out is not None else (x >= low)) & (x <= high)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out.otherwise(outside)


def left_closed(c: Column | str, edges: Sequence[float], names: Sequence[str], outside: str = "") -> Column:
    x, out = col(c), None
    for low, high, name in zip(edges, edges[1:], names, strict=False):
        inside = (x >= low) & (x < high)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out.otherwise(outside)


def risk(cross_split: Column, cross_archive: Column, label_conflict: Column) -> tuple[Column, Column]:
    """(label, weight) of what a pair would leak: splits 4, archives 2, labels 1."""
    parts = ((cross_split, "CROSS_SPLIT", 4), (cross_archive, "CROSS_ARCHIVE", 2), (label_conflict, "LABEL_CONFLICT", 1))
    name = F.array_join(F.array(*[F.when(c, n) for c, n, _ in parts]), "|")
    weight = sum((F.when(c, w).otherwise(0) for c, _, w in parts), F.lit(0))
    return F.when(name == "", "LOW").otherwise(name), weight


def gate(first: Column, second: Column, in_sequence: Column, primary: float = 0.80, dual: tuple[float, float] = (0.78, 0.85), sequence: tuple[float, float] = (0.70, 0.85)) -> Column:
    """Evidence tier of a candidate pair from two models' similarities, the first that holds: A primary, B both, C in a sequence, else D."""
    x, y = finite(first, -1.0), finite(second, -1.0)
    return F.when(x >= primary, "A").when((x >= dual[0]) & (y >= dual[1]), "B").when(in_sequence & (x >= sequence[0]) & (y >= sequence[1]), "C").otherwise("D")


def strength(p: Column, d: Column, w: Column, same_origin: Column, radius: int = 4) -> Column:
    """Strength of a pair by three hash distances."""
    other = F.least(d, w)
    return F.when((p <= 2) & (other <= 6), "HIGH").when((p <= radius) & (other <= 8), "MEDIUM").when(same_origin & (p > radius), "ORIGIN_ONLY").otherwise("PHASH_ONLY")


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Bounds of a rate's Wilson interval; null for n <= 0."""
    n = F.when(n > 0, n.cast("double"))
    p = k / n
    middle, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n.isNotNull(), F.greatest(F.lit(0.0), middle - half)), F.when(n.isNotNull(), F.least(F.lit(1.0), middle + half))


# relation of a pair from evidence

#: Least values (or, for reproj, the largest) that a test asks for; fixed values.
TESTS = {
    "same_scene": {"inliers": 18, "ratio": 0.30, "cov_min": 0.015, "cov_max": 0.08, "reproj": 5.0, "overlap": 0.08},
    "geom_strong": {"inliers": 18, "ratio": 0.35, "cov_min": 0.02, "cov_max": 0.08, "reproj": 4.5, "overlap": 0.10},
    "geom_moderate": {"inliers": 12, "ratio": 0.25, "cov_min": 0.008, "cov_max": 0.05, "reproj": 6.5, "overlap": 0.06},
    "photo_strong": {"aligned_ncc": 0.70, "aligned_grad": 0.55, "aligned_ssim": 0.40},
    "photo_moderate": {"aligned_ncc": 0.58, "aligned_grad": 0.40, "aligned_ssim": 0.28},
    "direct_strong": {"entropy": 4.0, "direct_ncc": 0.965, "direct_grad": 0.90, "direct_ssim": 0.78},
    "direct_moderate": {"entropy": 4.5, "direct_ncc": 0.94, "direct_grad": 0.82, "direct_ssim": 0.68},
}
#: What missing evidence counts as; columns not named count as 0.
MISSING = {"direct_ncc": -1.0, "direct_grad": -1.0, "direct_ssim": -1.0, "aligned_ncc": -1.0, "aligned_grad": -1.0, "aligned_ssim": -1.0, "reproj": 999.0}
#: (offset, span) that map evidence to [0, 1] for each part of the score; fixed values.
RAMPS = {
    "direct": {"direct_ncc": (0.7, 0.3), "direct_grad": (0.5, 0.5), "direct_ssim": (0.4, 0.6)},
    "geometry": {"inliers": (0.0, 40.0), "ratio": (0.0, 0.6), "cov_min": (0.0, 0.08), "cov_max": (0.0, 0.25), "reproj": (7.0, -7.0), "overlap": (0.0, 0.35)},
    "photo": {"aligned_ncc": (0.3, 0.7), "aligned_grad": (0.2, 0.8), "aligned_ssim": (0.15, 0.85)},
}
DERIVATIVE = ("VERIFIED_DERIVATIVE_STRONG", "VERIFIED_DERIVATIVE_MODERATE")
SAME_SCENE = "GEOMETRIC_SAME_SCENE_ONLY"
#: Relations from the strongest to the weakest.
RELATIONS = (*DERIVATIVE, SAME_SCENE, "AMBIGUOUS_MANUAL_REVIEW", "REJECTED_NOT_DERIVATIVE")


def evidence(columns: Sequence[str]) -> dict[str, Column]:
    """The evidence that the tests read, from columns entropy_a/_b, coverage_a/_b and the rest by name."""
    plain = ("inliers", "ratio", "reproj", "overlap", "direct_ncc", "direct_grad", "direct_ssim", "aligned_ncc", "aligned_grad", "aligned_ssim")
    x = {name: finite(name, MISSING.get(name, 0.0)) if name in columns else F.lit(MISSING.get(name, 0.0)) for name in plain}
    x["inliers"] = x["inliers"].cast("int")
    x["entropy"] = F.least(finite("entropy_a", 0.0), finite("entropy_b", 0.0))
    x["cov_min"] = F.least(finite("coverage_a", 0.0), finite("coverage_b", 0.0))
    x["cov_max"] = F.greatest(finite("coverage_a", 0.0), finite("coverage_b", 0.0))
    return x


def relation(columns: Sequence[str], in_sequence: Column) -> Column:
    """struct(relation, reason, score) of a pair: the first rule that holds, and a score from 0 to 100."""
    x = evidence(columns)

    def holds(test: str) -> Column:
        parts = [x[k] <= v if k == "reproj" else x[k] >= v for k, v in TESTS[test].items()]
        out = parts[0]
        for p in parts[1:]:
            out = out & p
        return out

    def mean(part: str) -> Column:
        return sum((clip01((x[k] - offset) / span) for k, (offset, span) in RAMPS[part].items()), F.lit(0.0)) / len(RAMPS[part])

    rules = (
        (in_sequence & holds("same_scene"), SAME_SCENE, "sequence_with_overlap"),
        (holds("direct_strong"), DERIVATIVE[0], "direct_match"),
        (holds("geom_strong") & holds("photo_strong"), DERIVATIVE[0], "geometry_and_photometry"),
        (holds("direct_moderate"), DERIVATIVE[1], "moderate_direct_match"),
        (holds("geom_moderate") & holds("photo_moderate"), DERIVATIVE[1], "moderate_geometry_and_photometry"),
        (holds("same_scene"), SAME_SCENE, "geometry_without_photometry"),
        ((x["inliers"] >= 8) | (x["direct_ncc"] >= 0.9), RELATIONS[3], "partial_support"),
    )
    name, reason = F, F
    for i, (condition, relation_name, why) in enumerate(rules):
        name, reason = (name.when(condition, relation_name), reason.when(condition, why)) if i else (F.when(condition, relation_name), F.when(condition, why))
    score = 100.0 * F.greatest(mean("direct"), 0.6 * mean("geometry") + 0.4 * mean("photo"))
    return F.struct(name.otherwise(RELATIONS[4]).alias("relation"), reason.otherwise("insufficient_support").alias("reason"), score.alias("score"))


# metadata and labels


def metadata_numbers(width: str = "width", height: str = "height", size: str = "bytes") -> dict[str, Column]:
    """Logs of width, height and bytes (1 at least), aspect ratio and megapixels; null sizes count as missing."""
    w, h, b = (F.greatest(F.col(c).cast("double"), F.lit(1.0)) for c in (width, height, size))
    return {"log_width": F.log(w), "log_height": F.log(h), "log_bytes": F.log(b), "aspect": w / h, "megapixels": w * h / 1e6}


def by_rules(rules: Sequence[tuple[Column, str, str]], default: Column) -> Column:
    """struct(label, rule): the first rule (condition, label, name) that holds, else the default by rule `unchanged`."""
    label = rule = F
    for condition, name, why in rules:
        label, rule = label.when(condition, name), rule.when(condition, why)
    return F.struct((label.otherwise(default) if rules else default).alias("label"), (rule.otherwise("unchanged") if rules else F.lit("unchanged")).alias("rule"))


def origin_key(name: Column, scope: Column, patterns: Sequence[tuple[str, str, str]]) -> Column:
    """struct(key, rule): where a file comes from, by the first pattern (name, regex, kind) that its lower-cased name matches.

    kind `text`: the first group; `number`: the first group and the second as a number; else the scope and the plain stem.
    """
    low = F.lower(name)
    plain = F.regexp_replace(F.regexp_replace(stem(low), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    key = rule = F
    for label, regex, kind in patterns:
        hit = low.rlike(regex)
        found = F.regexp_extract(low, regex, 1)
        if kind == "number":
            found = F.concat_ws(":", found, F.regexp_extract(low, regex, 2).try_cast("bigint").cast("string"))
        key, rule = key.when(hit, F.concat(F.lit(f"{label}:"), found)), rule.when(hit, label)
    other = F.concat_ws(":", F.lit("name"), scope, plain)
    return F.struct((key.otherwise(other) if patterns else other).alias("key"), (rule.otherwise("name") if patterns else F.lit("name")).alias("rule"))


def best_method(rows: str, value: str) -> Column:
    """Aggregate: of several methods' results (struct column `value`) the one with most inliers, then by ratio, aligned
    correlation, similarity, overlap and least error; what isn't finite counts as worst."""
    r = F.col(rows)
    key = F.struct(F.coalesce(r["inliers"], F.lit(0)).alias("a"), *[finite(r[c], -999.0).alias(c) for c in ("ratio", "aligned_ncc", "aligned_ssim", "overlap")], (-finite(r["reproj"], 999.0)).alias("z"))
    return F.max_by(F.col(value), key)


def histogram(label: str) -> Column:
    """Aggregate over one label column already counted (column n): label:count, sorted, joined by |."""
    return F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", F.col(label).cast("string"), F.col("n").cast("string")))), "|")


def shard_of(rank: Column, shards: int) -> Column:
    return F.pmod(rank - 1, F.lit(shards)).cast("int")
