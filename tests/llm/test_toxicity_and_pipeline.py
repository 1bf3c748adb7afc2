import math
import random
import zlib

import pytest
from texts import corpus, frame, sentence

from kinfold.llm import toxicity

FOUL = ["idiot", "scumbag", "moron"]


def labelled(n=600, seed=7):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = sentence(r, r.randint(20, 60)).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(r.randint(1, 4)):
                words.insert(r.randrange(len(words)), r.choice(FOUL))
        rows.append((i, " ".join(words) + "."))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def tables(spark, rows, labels):
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    rows, labels = labelled()
    got = toxicity.score(*tables(spark, rows, labels)).collect()
    truth = {i: t for i, _, t in labels}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert held and sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.98


def test_disguised_words_are_read(spark):
    rows, labels = labelled()
    r = random.Random(1)
    hidden = ["1d10t", "m0ron", "id1ot", "scumb@g", "moooron", "i d i o t", "m.o.r.o.n", "s-c-u-m-b-a-g"]
    odd = [(9000 + i, f"{sentence(r, 30)} {h} {sentence(r, 20)}") for i, h in enumerate(hidden)]
    plain = [(9500 + i, sentence(r, 50)) for i in range(20)]
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(*tables(spark, rows + odd + plain, labels)).collect()}
    assert sum(got[i] for i, _ in odd) >= len(odd) - 1 and not any(got[i] for i, _ in plain)


def test_viterbi_equals_trying_all_readings():
    r = random.Random(5)
    model = [-r.random() * 6 for _ in range(toxicity.SYMBOLS**3)]
    reader = toxicity.Reader(model)
    code = lambda c: 0 if c == " " else ord(c) - 96 if "a" <= c <= "z" else 27

    def readings(span, i=0, before=""):
        if i == len(span):
            yield "", 0.0
            return
        for out, cost in reader._options(span[i], before):
            for rest, more in readings(span, i + 1, span[i]):
                yield out + rest, cost + more

    def value(text, cost):
        a, b = 0, 0
        for c in text:
            s = code(c)
            cost += (toxicity.EMIT if s else 0.0) + model[a * 784 + b * 28 + s]
            a, b = b, s
        return cost + model[a * 784 + b * 28]

    for span in ["1d10t", "a.b*c", "aab", "$t|", "é1é", "o0o", "x-y z"]:
        best = max(value(t, c) for t, c in readings(span))
        assert any(math.isclose(value(t, c), best) and t == reader.decode(span) for t, c in readings(span))


@pytest.mark.parametrize(("labels", "want"), [([], {0}), ([(1, 1, 1), (2, 1, 1), (3, 1, 1)], {1}), ([(i, 1, None) for i in range(9)], {0})])
def test_labels_of_one_kind(spark, labels, want):
    rows = [(i, f"text {i}") for i in range(8)] + [(None, None), (7, "")]
    got = toxicity.score(*tables(spark, rows, labels)).collect()
    assert len(got) == len(rows) and {r["predicted"] for r in got} == want


def test_an_empty_table(spark):
    docs, labels = tables(spark, [], [])
    assert toxicity.score(docs, labels).count() == 0 == toxicity.clean(docs, labels).count()


def test_the_pipeline_keeps_its_promises(spark, tmp_path):
    """Every stage against brute force on its own input; run() gives what the stages give one after another."""
    import corpus_pipeline
    import test_copies
    import test_secrets_and_licences as other

    rows, labels = labelled(200)
    rows = [(i + 1000, t) for i, t in rows] + [(i, t) for i, t in corpus() if i is not None]
    r = random.Random(2)
    rows += [(5000, sentence(r, 40) + " password=0123456789abcdef0123 " + sentence(r, 20))]
    labels = [(i + 1000, q, t) for i, q, t in labels]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows], columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = docs.columns
    held = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == names
        out.write.parquet(f"{tmp_path}/{i}")
        held[name] = (docs, spark.read.parquet(f"{tmp_path}/{i}"))
        docs = held[name][1]
    before, after = held["toxicity"]
    scores = {x["doc_id"]: x["predicted"] for x in toxicity.score(before, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()}
    assert {x["doc_id"] for x in after.collect()} == {i for i, p in scores.items() if not p}
    before, after = held["near-duplicates"]
    test_copies.copies_are_gone(*([(x["doc_id"], x["text"]) for x in df.collect()] for df in (before, after)))
    before, after = held["repeats"]
    texts = [(x["doc_id"], x["text"]) for x in before.collect()]
    want = {i: b.decode("utf-8", "ignore") for i, *_, b in test_copies.without_repeats(texts, test_copies.repeats.PASSAGES)}
    assert {str(x["doc_id"]): x["text"] for x in after.collect()} == want
    assert all(x["n_chars"] == len(x["text"]) for x in after.collect())
    before, after = held["secrets"]
    old, new = ({x["doc_id"]: x["text"] for x in df.collect()} for df in (before, after))
    assert old.keys() == new.keys()
    assert all("0123456789abcdef" not in t for t in new.values()) and all(new[i] == t for i, t in old.items() if not other.base(t))
    before, after = held["packing"]
    assert {x["doc_id"] for x in after.collect()} == set(new)
    again = corpus_pipeline.run(spark, str(tmp_path))
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(tuple, again.select(key).collect())) == sorted(map(tuple, after.select(key).collect()))
