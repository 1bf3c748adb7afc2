"""Quality rules by weak supervision (native: DataFrame expressions only).

Each rule reads a few signals of a text and votes good (1), bad (-1) or abstains
(0). The votes of all documents are counted by vote pattern (3 to the power of
the number of rules at most, whatever the input's size). Expectation-maximisation
over these counts estimates, for each rule, how often it votes good on good
documents and bad on bad ones; an abstention says nothing. The posterior
probability of good quality decides instead of an all-must-pass filter: a bad vote of
a rule that often misfires on good documents is outweighed by the other rules' good ones.
Which of the two classes is the good one is fixed by a single constraint: no rule votes
good on bad documents more readily than on good ones.

Defined results: a null, empty or blank text has no words and fails the base
test. Repeated rows and null ids are judged row by row. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm._tables import SPACES, count_of, two
from kinfold.runtime import written_table

#: (name, bad if, good if): else the rule abstains. Expressions over the columns of signals().
RULES = (
    ("symbols", "n_symbols > 0.10 * n_words", "n_symbols <= 0.02 * n_words"),
    ("repetition", "n_repeat_words > 0.20 * n_words", "n_repeat_words <= 0.05 * n_words"),
    ("lines", "n_lines >= 4 and n_dup_lines > 0.50 * n_lines", "n_dup_lines = 0 and n_lines >= 3"),
    ("capitals", "n_capitals > 0.40 * word_chars", "n_capitals <= 0.15 * word_chars"),
    ("exclamation", "n_exclaims > 0.10 * n_words", "n_exclaims = 0 and n_words >= 50"),
    ("word_length", "word_chars < 2.5 * n_words or word_chars > 15 * n_words", "word_chars >= 3 * n_words and word_chars <= 10 * n_words"),
    ("sentences", "n_words >= 50 and n_stops < 0.004 * n_words", "n_stops >= 0.02 * n_words"),
    ("plain_words", "n_words >= 30 and n_plain < 0.70 * n_words", "n_plain >= 0.85 * n_words"),
)
#: A word of letters, with one mark after it at most.
PLAIN = r"^[(\"']?\p{L}[\p{L}'’-]*[.,;:!?)\"']?$"
#: Rounds of expectation-maximisation.
ROUNDS = 40
#: What is believed of a rule before any vote is seen, worth as much as BELIEF documents: it votes good on good documents with
#: the first probability, bad on bad ones with the second.
GOOD_ON_GOOD, BAD_ON_BAD, BELIEF = 0.95, 0.5, 5


def signals(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the four base counts and what the rules read besides.

    Words that are in a 5-word window found twice or more are counted through
    window hashes of 64 bits, compared only within one text.
    """
    t = F.col("text")
    symbols = t
    for c in "#*$%&|<>":
        symbols = F.replace(symbols, F.lit(c), F.lit(""))
    read = two(docs, key, text).withColumn("text", F.coalesce("text", F.lit("")))
    return (
        read.select(
            "doc_id",
            F.filter(F.split("text", SPACES), lambda w: w != "").alias("words"),
            F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
            (F.length(t) - F.length(symbols)).cast("long").alias("n_symbols"),
            F.length(F.regexp_replace(t, "[^A-Z]+", "")).cast("long").alias("n_capitals"),
            count_of(t, "!!").cast("long").alias("n_exclaims"),
            count_of(t, ".").cast("long").alias("n_stops"),
        )
        .select(
            "*",
            F.size("words").cast("long").alias("n_words"),
            F.size(F.filter("words", lambda w: w.rlike(PLAIN))).cast("long").alias("n_plain"),
            F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
            F.size("lines").cast("long").alias("n_lines"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
        )
        .withColumn("windows", F.expr("case when n_words >= 5 then transform(sequence(0, size(h) - 5), i -> xxhash64(h[i], h[i + 1], h[i + 2], h[i + 3], h[i + 4])) else cast(array() as array<bigint>) end"))
        .withColumn("ranked", F.expr("case when size(array_distinct(windows)) < size(windows) then sort_array(transform(windows, (x, i) -> struct(x as x, i as i))) end"))
        .withColumn("starts", F.expr("sort_array(transform(filter(ranked, (r, k) -> (k > 0 and ranked[greatest(k - 1, 0)].x = r.x) or ranked[least(k + 1, size(ranked) - 1)].x = r.x and k < size(ranked) - 1), r -> r.i))"))
        .withColumn("n_repeat_words", F.expr("coalesce(aggregate(transform(starts, (s, k) -> case when k = size(starts) - 1 then 5 else least(5, starts[least(k + 1, size(starts) - 1)] - s) end), 0L, (a, x) -> a + x), 0L)"))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_exclaims", "n_stops", "n_plain")
    )


def votes(rules=RULES) -> list[Column]:
    return [F.expr(f"case when {bad} then -1 when {good} then 1 else 0 end") for _, bad, good in rules]


def posterior(patterns: DataFrame, rules: int, rounds: int = ROUNDS) -> DataFrame:
    """(code, p_good) from (code, v, n): vote patterns with their counts, at most 3 ** rules rows.

    All rounds are one higher-order expression over the gathered patterns. The
    first guess is the share of good votes, one of either kind being added.
    """
    state = estimated(patterns, rules, rounds)
    return state.select(F.expr(f"inline(transform(pats, p -> named_struct('code', p.code, 'p_good', {_score('fit', rules)})))"))


def _score(state: str, rules: int) -> str:
    """The posterior of a pattern p under estimates."""
    return (
        f"1 / (1 + exp(-greatest(-500D, least(500D, ln({state}.pi / (1 - {state}.pi)) + aggregate(sequence(0, {rules - 1}), 0D, (z, j) -> z + "
        f"case p.v[j] when 1 then ln({state}.a[j] / (1 - {state}.b[j])) when -1 then ln((1 - {state}.a[j]) / {state}.b[j]) else 0D end)))))"
    )


def estimated(patterns: DataFrame, rules: int, rounds: int = ROUNDS) -> DataFrame:
    """One row: pats, the patterns, and fit, the estimates: pi (share of good documents), a (each rule's probability to vote good on
    a good document, if it votes) and b (bad on a bad one)."""
    total = "aggregate(q, 0D, (z, p) -> z + p.n)"
    part = lambda vote, of: f"aggregate(q, 0D, (z, p) -> z + case when p.v[j] {vote} then p.n * {of} else 0D end)"
    bound = lambda x: f"greatest(1e-6D, least(1 - 1e-6D, {x}))"
    good = f"({part('= 1', 'p.g')} + {GOOD_ON_GOOD * BELIEF}) / ({part('<> 0', 'p.g')} + {BELIEF})"
    bad = f"({part('= -1', '(1 - p.g)')} + {BAD_ON_BAD * BELIEF}) / ({part('<> 0', '(1 - p.g)')} + {BELIEF})"
    estimate = (
        f"named_struct('pi', {bound(f'aggregate(q, 0D, (z, p) -> z + p.n * p.g) / {total}')}, "
        f"'a', transform(sequence(0, {rules - 1}), j -> {bound(good)}), 'b', transform(sequence(0, {rules - 1}), j -> {bound(f'greatest({bad}, 1 - {good})')}))"
    )
    # one step: the q of all patterns under the state, then the estimates from q
    fit = lambda q: f"element_at(transform(array({q}), q -> {estimate}), 1)"
    weigh = lambda state: f"transform(pats, p -> named_struct('v', p.v, 'n', p.n, 'g', {_score(state, rules)}))"
    first = "transform(pats, p -> named_struct('v', p.v, 'n', p.n, 'g', (size(filter(p.v, x -> x = 1)) + 1D) / (size(filter(p.v, x -> x <> 0)) + 2D)))"
    gathered = patterns.agg(F.sort_array(F.collect_list(F.struct("code", "v", F.col("n").cast("double").alias("n")))).alias("pats")).filter("size(pats) > 0")
    return gathered.withColumn("fit", F.expr(f"aggregate(sequence(1, {rounds}), {fit(first)}, (s, r) -> {fit(weigh('s'))})"))


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", rules=RULES) -> DataFrame:
    """Signals, base_failed, p_good (the posterior) and kept for every row.

    The text is read once; the signals are written to the shared folder, since
    both the counts of patterns and the verdicts need them.
    """
    code = sum((vote + 1) * 3**i for i, vote in enumerate(votes(rules)))
    found = written_table(signals(docs, key, text).withColumn("code", code.cast("int")))
    counts = found.groupBy("code").agg(F.count("*").alias("n")).withColumn("v", F.array(*[(F.floor(F.col("code") / 3**i) % 3 - 1).cast("int") for i in range(len(rules))]))
    table = F.broadcast(posterior(counts, len(rules)))  # 3 ** rules rows at most
    failed = F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")
    return found.join(table, "code").withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("p_good") >= 0.5)).drop("code")


def oracle() -> str:
    """DuckDB SQL of judge() over documents, the rounds of expectation-maximisation as a recursion."""
    m = len(RULES)
    score = lambda pi, a, b: (
        f"1 / (1 + exp(-greatest(-500, least(500, ln({pi} / (1 - {pi})) + list_sum(list_transform(range(1, {m + 1}), lambda j: case p.v[j] when 1 then ln({a}[j] / (1 - {b}[j])) when -1 then ln((1 - {a}[j]) / {b}[j]) else 0 end))))))"
    )
    bound = lambda x: f"greatest(1e-6, least(1 - 1e-6, {x}))"
    part = lambda vote, of: f"list_sum(list_transform(q, lambda p: case when p.v[j] {vote} then p.n * {of} else 0 end))"
    total = "list_sum(list_transform(q, lambda p: p.n))"
    good = f"({part('= 1', 'p.g')} + {GOOD_ON_GOOD * BELIEF}) / ({part('<> 0', 'p.g')} + {BELIEF})"
    bad = f"({part('= -1', '(1 - p.g)')} + {BAD_ON_BAD * BELIEF}) / ({part('<> 0', '(1 - p.g)')} + {BELIEF})"
    estimates = (
        f"{bound(f'list_sum(list_transform(q, lambda p: p.n * p.g)) / {total}')} as pi, "
        f"list_transform(range(1, {m + 1}), lambda j: {bound(good)}) as a, list_transform(range(1, {m + 1}), lambda j: {bound(f'greatest({bad}, 1 - {good})')}) as b"
    )
    votes_sql = ", ".join(f"case when {bad} then -1 when {good} then 1 else 0 end" for _, bad, good in RULES)
    plain = PLAIN.replace("'", "''")
    return f"""with recursive d as (select row_number() over () as i, doc_id, coalesce(text, '') as text from documents),
w as (select i, doc_id, text, list_filter(regexp_split_to_array(text, '{SPACES}'), lambda x: x <> '') as words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines from d),
grams as (select i, unnest(range(1, len(words) - 3)) as o, words from w where len(words) >= 5),
named as (select i, o, array_to_string(list_slice(words, o, o + 4), chr(32)) as g from grams),
often as (select i, g from named group by all having count(*) > 1),
covered as (select i, count(distinct p) as n from (select named.i, unnest(range(o, o + 5)) as p from named join often on often.i = named.i and often.g = named.g) group by i),
s as (select w.i, doc_id, len(words)::bigint as n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::bigint as word_chars, (length(text) - length(translate(text, '#*$%&|<>', '')))::bigint as n_symbols,
  (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(covered.n, 0)::bigint as n_repeat_words, len(lines) as n_lines, length(regexp_replace(text, '[^A-Z]+', '', 'g')) as n_capitals,
  (length(text) - length(replace(text, '!!', ''))) // 2 as n_exclaims, length(text) - length(replace(text, '.', '')) as n_stops, len(list_filter(words, lambda x: regexp_matches(x, '{plain}'))) as n_plain
  from w left join covered on covered.i = w.i),
voted as (select *, [{votes_sql}] as v from s),
pats as materialized (select list(struct_pack(v := v, n := n) order by v) as pats from (select v, count(*)::double as n from voted group by v)),
em(r, pi, a, b) as (
  select 0, {estimates} from (select list_transform(pats, lambda p: struct_pack(v := p.v, n := p.n, g := (len(list_filter(p.v, lambda x: x = 1)) + 1.0::double) / (len(list_filter(p.v, lambda x: x <> 0)) + 2))) as q from pats)
  union all
  select r + 1, {estimates} from (select r, list_transform(pats.pats, lambda p: struct_pack(v := p.v, n := p.n, g := {score('pi', 'a', 'b')})) as q from em, pats where r < {ROUNDS})),
fit as (select unnest(list_transform(pats.pats, lambda p: struct_pack(v := p.v, p_good := {score('pi', 'a', 'b')}))) as x from em, pats where r = {ROUNDS})
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed, not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and x.p_good >= 0.5 as kept
from voted join fit on fit.x.v = voted.v"""
