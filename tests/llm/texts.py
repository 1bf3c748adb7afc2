"""A small corpus with copies, near copies, shared passages, long texts, nulls and odd characters."""

import random

WORDS = "the of and to in that was for with on thing er an re at en nd ti es or te ed is it al ar st nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur".split()


def sentence(r, n):
    return " ".join("".join(r.choice(WORDS) for _ in range(r.randint(1, 4))) for _ in range(n))


def corpus(seed=0, n=60):
    r = random.Random(seed)
    passage = sentence(r, 120)
    base = sentence(r, 300)
    rows = []
    for i in range(n):
        kind = i % 10
        if kind == 0:
            text = base
        elif kind == 1:
            words = base.split()
            words[r.randrange(len(words))] = "changed"
            text = " ".join(words)
        elif kind == 2:
            text = sentence(r, 40) + "\n" + passage + "\n" + sentence(r, 30)
        elif kind == 3:
            text = "é日本 " + sentence(r, 25) + " 🙂 " + passage[: 420 + i] + "ß"
        elif kind == 4:
            text = (sentence(r, 6) + ".\n") * r.randint(1, 6)
        elif kind == 5:
            text = ["", None, "   \n\t ", "a", "a a a a a a a a a a a a", "x" * 3000][(i // 10) % 6]
        elif kind == 6:
            text = sentence(r, 900)
        else:
            text = sentence(r, r.randint(1, 120)) + "."
        rows.append((i, text))
    rows.append((3, rows[3][1]))  # a repeated row
    rows.append((None, "no id " + sentence(r, 90)))
    rows.append((None, None))
    return rows


def frame(spark, rows, extra=True):
    """doc_id and text, among columns whose names operators use for themselves."""
    if not extra:
        return spark.createDataFrame(rows, "doc_id long, text string")
    named = [(i, t, "x", None, 7, "k", 1.5) for i, t in rows]
    return spark.createDataFrame(named, "doc_id long, text string, component_id string, score double, k int, ids string, n_words double").repartition(3)
