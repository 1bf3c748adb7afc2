"""Secret scans: fixed patterns, and Markov models of characters (native: DataFrame expressions only).

The patterns' spans are the base. Besides, two first-order Markov models are
trained from samples whose labels the base gives: random strings are the values that
its patterns match in any document, ordinary ones the words of SAMPLE documents (by a
hash of the text) that neither they nor SUSPECT match. Every token of LENGTH characters
or more, of letters of any kind, becomes a span of kind model if its log-likelihood
ratio between the two is large enough, as a whole and by character. What a base span
leaves of a token is scored like any other.

Positions are code points. A pattern's matches and the pieces between them give
their positions by sums of lengths, taken block by block so that a text with very
many matches costs no square of their number.

Defined results: a null text is empty and has no spans. Repeated rows and null ids
are scanned row by row. Where nothing matches the base, the model of random strings
is uniform. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm._tables import column, free_names, quoted
from kinfold.runtime import written_table

#: kind: (pattern, group that must be long, its least length, cheap necessary condition). Fixed by the query's contract;
#: access and hex need no test of length after the match, since a run that is too short holds no other match.
KINDS = {
    "assign": (r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12, "lower(text) rlike 'passw|secret|token|api'"),
    "access": (r"AKIA[A-Z0-9]{14,}", 0, 18, "contains(text, 'AKIA')"),
    "hex": (r"[0-9a-f]{16,}", 0, 16, "true"),
}
ORDER = [*KINDS, "model"]
SAMPLE, LENGTH = 2_000, 12
TOKEN = rf"[A-Za-z0-9+/_=-]{{{LENGTH},}}"
#: Any base match. What it leaves of a text is searched for tokens.
BASE = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{12,}|AKIA[A-Z0-9]{14,}|[0-9a-f]{16,}"
#: Words that hold both letters and digits and are long: no sample of ordinary ones.
SUSPECT = r"(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=.-"
#: Least log-likelihood ratio of a token and of each of its steps on average; counts added to each step.
LEAST, LEAST_STEP, PRIOR = 14.0, 1.0, 0.5
BLOCK = 64


def _located(df: DataFrame, name: str, pattern: str, group: int, length: int, condition: str) -> DataFrame:
    """Adds the column name: array of struct(s, e, value) of the pattern's matches in the column text whose group is long enough; null if none."""
    text = F.col("text")
    hit = F.expr(condition) & text.rlike(pattern)
    inside = lambda i: f"aggregate(slice(_l, int({i} div {BLOCK}) * {BLOCK} + 1, {i} % {BLOCK} + 1), 0L, (a, x) -> a + x)"
    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("_m"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("_g"), F.split(text, pattern, -1).alias("_p"))
    # each step an explode, so that the optimizer doesn't write it out inside the next one's loops
    step = lambda df, of: df.select("*", F.inline(F.array(of)))
    found = step(df, F.when(hit, parts).otherwise(F.struct(*[F.lit(None).cast("array<string>").alias(c) for c in ("_m", "_g", "_p")])))
    # how far each match ends behind the one before it; that in blocks; where each block starts
    found = step(found, F.struct(F.expr("transform(_m, (m, i) -> cast(length(_p[i]) + length(m) as bigint))").alias("_l")))
    found = step(found, F.struct(F.expr(f"transform(sequence(0, (size(_l) - 1) div {BLOCK}), b -> aggregate(slice(_l, int(b) * {BLOCK} + 1, {BLOCK}), 0L, (a, x) -> a + x))").alias("_b")))
    found = step(found, F.struct(F.expr("transform(_b, (x, b) -> aggregate(slice(_b, 1, b), 0L, (a, y) -> a + y))").alias("_t")))
    ends = f"_t[int(i div {BLOCK})] + {inside('i')}"
    found = step(found, F.struct(F.expr(f"transform(_m, (m, i) -> named_struct('s', {ends} - length(m), 'e', {ends}, 'value', _g[i]))").alias("_x")))
    return found.withColumn(name, F.expr(f"filter(_x, x -> length(x.value) >= {length})")).drop("_m", "_g", "_p", "_l", "_b", "_t", "_x")


def _steps(of: Column) -> Column:
    """All pairs of neighbouring characters; a single character has none."""
    return F.when(F.length(of) > 1, F.transform(F.sequence(F.lit(1), F.length(of) - 1), lambda i: F.substring(of, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def ratios(random: DataFrame, ordinary: DataFrame) -> DataFrame:
    """(step, llr): log-likelihood ratio of the second character after the first, for all pairs of ALPHABET; from columns `value`."""
    counted = lambda df, name: df.select(F.explode(_steps(F.col("value"))).alias("step")).groupBy("step").agg(F.count("*").alias(name))
    letters = F.array(*[F.lit(c) for c in ALPHABET])
    every = random.sparkSession.range(1).select(F.explode(letters).alias("a")).select("a", F.explode(letters).alias("b")).select("a", F.concat("a", "b").alias("step"))
    both = every.join(counted(random, "r"), "step", "left").join(counted(ordinary, "o"), "step", "left").na.fill(0, ["r", "o"])
    total = both.groupBy("a").agg(F.sum("r").alias("rt"), F.sum("o").alias("ot"))
    rate = lambda n, t: (F.col(n) + PRIOR) / (F.col(t) + PRIOR * len(ALPHABET))
    return both.join(F.broadcast(total), "a").select("step", F.log(rate("r", "rt") / rate("o", "ot")).alias("llr"))


def _tokens(read: DataFrame) -> DataFrame:
    """(k, value): the tokens of LENGTH characters or more in what base matches leave of each text."""
    pieces = F.split("text", BASE, -1)
    return read.select("k", F.explode(F.flatten(F.transform(pieces, lambda p: F.regexp_extract_all(p, F.lit(TOKEN), F.lit(0))))).alias("value")).distinct()


def _located_tokens(read: DataFrame) -> DataFrame:
    """(doc_id, k, s, e, value): the same, and where they stand."""
    held = _located(read, "base", BASE, 0, 0, "true")
    parts = F.when(F.col("base").isNotNull(), F.split("text", BASE, -1)).otherwise(F.array("text"))
    held = held.select("doc_id", "k", F.inline(F.array(F.struct(parts.alias("parts"), F.expr("transform(base, x -> x.e)").alias("ends")))))
    pieces = held.select("doc_id", "k", "ends", F.posexplode("parts").alias("i", "text")).withColumn("start", F.expr("case when i = 0 then 0L else ends[greatest(i - 1, 0)] end")).drop("ends", "i")
    some = _located(pieces.filter(F.col("text").rlike(TOKEN)), "token", TOKEN, 0, LENGTH, "true")
    return some.select("doc_id", "k", "start", F.explode("token").alias("t")).select("doc_id", "k", (F.col("t.s") + F.col("start")).alias("s"), (F.col("t.e") + F.col("start")).alias("e"), "t.value")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """doc_id, k (hash of the text) and for each kind an array of struct(s, e), empty if there is none; for every row."""
    read = docs.select(column(key).cast("long").alias("doc_id"), F.coalesce(column(text).cast("string"), F.lit("")).alias("text")).withColumn("k", F.xxhash64("text"))
    found = read
    for kind, parts in KINDS.items():
        found = _located(found, kind, *parts)
    none = F.array().cast("array<struct<s: bigint, e: bigint, value: string>>")
    found = written_table(found.select("doc_id", "k", *KINDS))
    tokens = written_table(_tokens(read))
    # the words of the documents whose hashes are least; a text's spans are cut out by their values
    chosen = found.select("k").distinct().orderBy(F.abs(F.xxhash64("k")), "k").limit(sample)
    words = read.join(F.broadcast(chosen), "k", "left_semi").select(F.explode(F.split("text", r"[^A-Za-z0-9+/_=.-]+")).alias("value"))
    values = found.select(F.explode(F.concat(*[F.coalesce(kind, none) for kind in KINDS])).alias("v")).select("v.value").filter(F.length("value") > 1)
    ordinary = words.filter((F.length("value") > 3) & ~F.col("value").rlike(f"{BASE}|{SUSPECT}"))
    table = F.broadcast(ratios(values, ordinary))  # one row for each pair of ALPHABET
    distinct = tokens.select("value").distinct()
    sure = (
        distinct.select("value", F.explode(_steps(F.col("value"))).alias("step"))
        .join(table, "step")
        .groupBy("value")
        .agg(F.sum("llr").alias("sum"), F.avg("llr").alias("mean"))
        .filter((F.col("sum") >= LEAST) & (F.col("mean") >= LEAST_STEP))
        .select("value")
    )
    # only texts that hold such a token are read again, for where it stands
    sure = written_table(sure)
    telling = written_table(tokens.join(sure, "value", "left_semi").select("k").distinct())
    located = _located_tokens(read.join(telling, "k", "left_semi"))
    model = located.join(sure, "value", "left_semi").groupBy(F.col("doc_id").alias("m_id"), F.col("k").alias("m_k")).agg(F.collect_set(F.struct("s", "e")).alias("model"))
    pairs = lambda c: F.coalesce(F.transform(c, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))), F.array().cast("array<struct<s: bigint, e: bigint>>")).alias(c)
    return found.join(model, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("k") == F.col("m_k")), "left").select("doc_id", "k", *[pairs(c) for c in ORDER])


def listed(kinds: list[str]) -> Column:
    """kind:start:end of all spans by start, then kind as listed, joined by commas."""
    placed = lambda kind: F.transform(kind, lambda x: F.struct(x["s"].alias("s"), F.lit(ORDER.index(kind)).alias("o"), F.lit(kind).alias("kind"), x["e"].alias("e")))
    every = F.concat(*map(placed, kinds))
    return F.array_join(F.transform(F.sort_array(every), lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", mark: str = "[secret]") -> DataFrame:
    """All rows of docs with every span, of whatever kind, replaced by the mark; spans that overlap become one mark."""
    every, own, hashed, spans = free_names(docs, "all", "id", "k", "spans")
    found = scan(docs, key, text).withColumn(every, F.sort_array(F.concat(*ORDER))).filter(F.size(every) > 0)
    merged = F.expr(
        f"aggregate({every}, cast(array() as array<struct<s: bigint, e: bigint>>), (a, x) -> case when size(a) > 0 and element_at(a, -1).e >= x.s "
        "then concat(slice(a, 1, size(a) - 1), array(named_struct('s', element_at(a, -1).s, 'e', greatest(element_at(a, -1).e, x.e)))) else concat(a, array(x)) end)"
    )
    found = found.select(F.col("doc_id").alias(own), F.col("k").alias(hashed), merged.alias(spans)).dropDuplicates([own, hashed])
    joined = docs.join(found, column(key).cast("long").eqNullSafe(F.col(own)) & (F.xxhash64(F.coalesce(column(text), F.lit(""))) == F.col(hashed)), "left")
    of = quoted(text)
    cut = F.expr(f"array_join(transform(sequence(0, size({spans})), i -> substring({of}, int(case when i = 0 then 0 else {spans}[greatest(i - 1, 0)].e end) + 1, int(case when i = size({spans}) then length({of}) else {spans}[least(i, size({spans}) - 1)].s end - case when i = 0 then 0 else {spans}[greatest(i - 1, 0)].e end))), '{mark}')")
    return joined.select(*[F.when(F.col(spans).isNull(), column(c)).otherwise(cut).alias(c) if c == text else column(c) for c in docs.columns])
