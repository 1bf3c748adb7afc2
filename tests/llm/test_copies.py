import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from texts import corpus, frame

from kinfold.llm import neardup, repeats


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_classes_equal_brute_force(spark):
    rows = [*corpus(), *[(i + 500, t) for i, t in corpus(3, 30) if i is not None]]
    got = neardup.near_duplicates(frame(spark, rows)).collect()
    prints = [fingerprint(t) for _, t in rows]
    assert sorted((str(r["doc_id"]), r["fingerprint"]) for r in got) == sorted((str(i), f"{f:016x}") for (i, _), f in zip(rows, prints, strict=True))
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                up[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in got) == sorted((str(doc), str(least.get(root(i)))) for i, (doc, _) in enumerate(rows))


def alike(a, b):
    """Jaccard similarity of five-word shingles (of all words, if there are fewer)."""
    sets = []
    for text in (a, b):
        words = (text or "").lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def copies_are_gone(before, after):
    """Of texts alike to 0.85 or more one is kept, at most; texts that are like no other are all kept."""
    kept = [t for _, t in after]
    assert all(alike(a, b) < 0.85 for i, a in enumerate(kept) for b in kept[:i])
    for i, (doc, t) in enumerate(before):
        if all(alike(t, other) < 0.5 for j, (_, other) in enumerate(before) if i != j):
            assert (doc, t) in after


def near_copies(seed=4, n=40):
    r = random.Random(seed)
    words = [f"w{r.randrange(4000)}" for _ in range(200)]
    rows = [(7000, " ".join(words))]
    for i in range(1, n):
        changed = list(words)
        for _ in range(r.choice([1, 2, 3])):
            changed[r.randrange(200)] = f"new{i}"
        rows.append((7000 + i, " ".join(changed)))
    return rows


def test_one_of_each_class(spark):
    rows = [*corpus(), *near_copies()]
    docs = frame(spark, rows)
    kept = neardup.one_of_each(docs)
    assert kept.columns == docs.columns
    copies_are_gone(rows, [(r["doc_id"], r["text"]) for r in kept.collect()])


def test_one_of_each_with_names_of_its_own(spark):
    rows = [*corpus(), *near_copies(n=5)]
    docs = frame(spark, rows).withColumnsRenamed({"text": "te.xt", "score": "_id", "ids": "_no", "k": "_k"})
    kept = neardup.one_of_each(docs, text="te.xt")
    assert kept.columns == docs.columns
    assert sorted(str(r["te.xt"]) for r in kept.collect()) == sorted(str(r["text"]) for r in neardup.one_of_each(frame(spark, rows)).collect())


def test_an_index_of_shingles_links_what_all_pairs_link():
    for seed in range(8):
        texts = [t for _, t in near_copies(seed, 80)] + ["", " ", "one two", "one two"] + [t for p in around(seed, n=20) for t in p]
        sets = [neardup.fives(neardup.shingles(t)) for t in texts]
        found, truth = neardup.Forest(), neardup.Forest()
        for a, b in neardup.alike_in(sets):
            assert neardup.similarity(sets[a], sets[b]) >= neardup.ALIKE - 1e-9
            found.join(a, b)
        for i in range(len(sets)):
            for j in range(i):
                if neardup.similarity(sets[i], sets[j]) >= neardup.ALIKE - 1e-9:
                    truth.join(i, j)
        assert all(found.root(i) == truth.root(i) for i in range(len(sets)))
    assert neardup.alike_in([]) == []


def test_the_trees_find_every_link(monkeypatch):
    monkeypatch.setattr(neardup, "LEAF", 1 << 9)
    for seed in range(12):
        r = np.random.default_rng(seed)
        values = []
        for v in r.integers(0, 2**64, 30, dtype=np.uint64):
            for _ in range(int(r.integers(1, 50 if seed % 3 else 6))):
                x = int(v)
                for _ in range(int(r.integers(0, 7))):
                    x ^= 1 << int(r.integers(0, 64))
                values.append(x)
        fps = np.unique(np.array(values, np.uint64))
        r.shuffle(fps)
        found, truth = neardup.Forest(), neardup.Forest()
        for tree, mask in enumerate(neardup.blocks(4)):
            stored_rows = 0
            for _, rows, stored in neardup.Router(fps[:200], mask, 4).route(fps):
                part = neardup.Forest()
                neardup.search(fps[rows][stored], fps[rows][~stored], mask, part)
                stored_rows += int(stored.sum())
                for a, b in part.links:
                    assert bin(a ^ b).count("1") <= 4
                    found.join(a, b)
            assert stored_rows == len(fps)
        for a, b in zip(*np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4), strict=True):
            truth.join(int(fps[a]), int(fps[b]))
        assert all(found.root(int(x)) == truth.root(int(x)) for x in fps)


def pieces(data, rule):
    """The elements of a text, and where each starts and ends."""
    if rule.words:
        found = [(m[0], m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
    else:
        found = [(data[i : i + 1], i, i + 1) for i in range(len(data))]
    return [x for x, _, _ in found], [a for _, a, _ in found], [b for _, _, b in found]


def runs_of_repeats(rows, rule):
    """The maximal runs of elements, by document, that long strings cover which start elsewhere too."""
    parts = [pieces((t or "").encode(), rule)[0] for _, t in rows]
    count = {}
    for x in parts:
        for i in range(len(x) - rule.span + 1):
            w = tuple(x[i : i + rule.span]) if rule.words else b"".join(x[i : i + rule.span])
            count[w] = count.get(w, 0) + 1
    out = []
    for x in parts:
        gone = np.zeros(len(x) + 2, bool)
        for i in range(len(x) - rule.span + 1):
            if count[tuple(x[i : i + rule.span]) if rule.words else b"".join(x[i : i + rule.span])] > 1:
                gone[i + 1 : i + 1 + rule.span] = True
        edges = np.flatnonzero(gone[1:] != gone[:-1]).reshape(-1, 2)
        out.append([(int(a), int(b)) for a, b in edges])
    return out


def without_repeats(rows, rule=repeats.BYTES):
    out = []
    for (doc, t), runs in zip(rows, runs_of_repeats(rows, rule), strict=True):
        data = (t or "").encode()
        _, low, high = pieces(data, rule)
        spans = [(low[a], high[b - 1]) for a, b in runs]
        edges = [0, *[x for s in spans for x in s], len(data)]
        kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
        out.append((str(doc), len(data), len(data) - len(kept), len(runs), kept))
    return sorted(out)


def with_a_common_passage():
    """The corpus, and half as many rows that hold one passage of 60 words, each among other words."""
    r = random.Random(9)
    passage = " ".join(f"{r.choice('abcdefg')}{r.randrange(900)}" for _ in range(60)) + " " + "common " * 4
    others = [f"o{r.randrange(9000)}" for _ in range(400)]
    shared = [(300 + i, " ".join(r.choices(others, k=30 + i)) + "\n" + passage * (1 + i % 2) + " ".join(r.choices(others[: 3 + i], k=60))) for i in range(30)]
    return [*corpus(), *shared, (200, "ab" * 900), (201, "q" * 399), (202, "z" * 400), (203, "z" * 401), (204, "w " * 49), (205, "v " * 120)]


@pytest.mark.parametrize("rule", [repeats.BYTES, repeats.PASSAGES])
@pytest.mark.parametrize("hot", [1 << 14, 8, 1])
def test_repeats_equal_brute_force(spark, monkeypatch, hot, rule):
    monkeypatch.setattr(repeats, "HOT", hot)
    rows = with_a_common_passage()
    other = repeats.PASSAGES if rule is repeats.BYTES else repeats.BYTES
    got = repeats.remove_repeats(frame(spark, rows), rule=rule, passages=other).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == without_repeats(rows, rule)
    assert sorted((str(r["doc_id"]), r["n_passages"]) for r in got) == sorted((str(i), len(x)) for (i, _), x in zip(rows, runs_of_repeats(rows, other), strict=True))


def test_repeats_carry_columns_and_text(spark):
    rows = corpus()
    docs = frame(spark, rows).withColumn("a.b", F.lit(1)).withColumn("ranges", F.lit(2))
    got = repeats.remove_repeats(docs, carry=["score", "ids", "a.b", "ranges"], as_text=True)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "carried"]
    assert got.schema["carried"].dataType.names == ["score", "ids", "a.b", "ranges"]
    assert sorted(r["kept"] for r in got.collect()) == sorted(b.decode("utf-8", "ignore") for *_, b in without_repeats(rows))


def test_words_are_hashed_by_their_bytes_alone():
    texts = ["one two", "two", "", " \t", "é one", "two\x0btwo"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    starts = np.cumsum([0, *[len(t.encode()) for t in texts]])
    values, low, high = repeats.words_of(data, starts)
    words = [data[a:b].tobytes() for a, b in zip(low, high, strict=True)]
    assert words == b"one two two \xc3\xa9 one two two".split()
    assert {(w, int(v)) for w, v in zip(words, values, strict=True)} == {(w, int(repeats.words_of(np.frombuffer(w, np.uint8), np.zeros(1, int))[0][0])) for w in words}
    assert repeats.elements(data, starts, repeats.PASSAGES)[1].tolist() == [0, 2, 3, 3, 3, 5, 7]


def test_extents_equal_all_pairs():
    for seed in range(200):
        r = random.Random(seed)
        base = bytes(r.choice(b"ab") for _ in range(30))
        left, right = [], []
        for _ in range(r.randrange(2, 14)):
            a = bytearray(base)
            for _ in range(r.randrange(0, 3)):
                a[r.randrange(30)] = ord("c")
            a[12:16] = b"GRAM"
            left.append(bytes(a[r.choice([0, 0, 3]) : 12])[::-1])
            right.append(bytes(a[12 : r.choice([30, 30, 27])]))
        for i, found in enumerate(repeats.extents(left, right, span=16, gram=4)):
            want = set()
            for j in range(len(left)):
                before, after = repeats.common(left[i], left[j]), repeats.common(right[i], right[j])
                if j != i and before + after >= 16:
                    want |= set(range(-before, after))
            assert {x for _, before, after in found for x in range(-before, after)} == want


def test_a_text_longer_than_the_index():
    """Anchors of texts in overlapping pieces are those of the whole."""
    data = np.random.default_rng(1).integers(97, 123, 40_000).astype(np.uint8)
    starts = np.array([0, 500, 700, 40_000])
    values = repeats.elements(data, starts, repeats.BYTES)[0]
    whole = repeats.every_anchor(values, starts, repeats.BYTES)
    parts = repeats.every_anchor(values, starts, repeats.BYTES, most=8192)
    assert parts[0].tolist() == whole[0].tolist() and parts[1].tolist() == whole[1].tolist()


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "short")]])
def test_tables_without_copies(spark, rows):
    docs = frame(spark, rows)
    assert neardup.near_duplicates(docs).count() == repeats.remove_repeats(docs).count() == neardup.one_of_each(docs).count() == len(rows)


def test_digest_of_the_query(spark):
    rows = [(1, "é" * 10)]
    got = repeats.remove_repeats(frame(spark, rows)).select(F.sha2("kept", 256)).first()[0]
    assert got == hashlib.sha256(("é" * 10).encode()).hexdigest()


def around(seed, lengths=(12, 20, 50, 100, 300), n=60):
    """Pairs of texts, the second with replaced words or an added tail, alike to between 0.65 and 0.9."""
    r = random.Random(seed)
    pairs = []
    while len(pairs) < n:
        size = lengths[len(pairs) % len(lengths)]
        words = [f"w{r.randrange(5000)}" for _ in range(size)]
        other = list(words)
        if r.random() < 0.5:
            other += [f"n{r.randrange(9999)}" for _ in range(r.randint(1, max(2, size // 3)))]
        else:
            for _ in range(r.randint(1, max(1, size // 16))):
                other[r.randrange(size)] = f"n{r.randrange(9999)}"
        pair = " ".join(words), " ".join(other)
        if 0.65 <= alike(*pair) < 0.9:
            pairs.append(pair)
    return pairs


def test_fingerprints_lose_hardly_a_pair_alike_to_four_fifths():
    pairs = [p for p in around(11, n=900) if 0.8 <= alike(*p) < 0.85]
    prints = [[neardup.prints(neardup.fives(neardup.shingles(t))) for t in p] for p in pairs]
    bits = [[bin(x ^ y).count("1") for x, y in zip(a, b, strict=True)] for a, b in prints]
    found = sum(min(x) <= neardup.WIDE and sum(x) <= neardup.TOGETHER for x in bits)
    assert len(pairs) > 150 and found >= 0.99 * len(pairs)


@pytest.mark.parametrize("group", [1 << 20, 500])
def test_one_of_each_is_exact_about_four_fifths(spark, monkeypatch, group):
    """Kept is the first row of each component of the links at 0.8 or more, and nothing under 0.8 is lost, at any length."""
    monkeypatch.setattr(neardup, "GROUP", group)
    texts = [t for p in around(12, n=120) for t in p]
    r = random.Random(13)
    base = [f"b{r.randrange(5000)}" for _ in range(100)]
    for _ in range(60):  # a group whose members are alike to each other to anything from 0.6 to 1
        changed = list(base)
        for _ in range(r.randint(0, 3)):
            changed[r.randrange(100)] = f"c{r.randrange(9999)}"
        texts.append(" ".join(changed))
    rows = list(enumerate(texts))
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if alike(texts[i], texts[j]) >= 0.8:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    kept = {x["doc_id"] for x in neardup.one_of_each(frame(spark, rows)).collect()}
    assert kept == {i for i in range(len(texts)) if root(i) == i}


@pytest.mark.parametrize("leaf", [1 << 10, 1 << 18])
def test_candidates_of_shards_are_whole(monkeypatch, leaf):
    monkeypatch.setattr(neardup, "LEAF", leaf)
    sets = [neardup.fives(neardup.shingles(t)) for _, t in near_copies(6, 150)]
    sizes, every_print = np.array([len(s) for s in sets]), np.array([neardup.prints(s) for s in sets], np.uint64)
    fps = np.ascontiguousarray(every_print[:, 0])
    classes = np.arange(len(sets)) // 3
    every, spanning = set(), neardup.Forest()
    for mask in neardup.blocks(12):
        for _, rows, stored in neardup.Router(fps[:60], mask, 2).route(fps):
            for part in neardup.candidates(fps[rows], every_print[rows], sizes[rows], classes[rows], stored, mask, 12, None):
                every |= {tuple(sorted(x)) for x in rows[part].tolist()}
            for part in neardup.candidates(fps[rows], every_print[rows], sizes[rows], classes[rows], stored, mask, 12, neardup.Forest()):
                for a, b in rows[part].tolist():
                    spanning.join(a, b)
    want = {(i, j) for j in range(len(sets)) for i in range(j) if classes[i] != classes[j] and bin(int(fps[i] ^ fps[j])).count("1") <= 12 and int(np.bitwise_count(every_print[i] ^ every_print[j]).sum()) <= neardup.TOGETHER and min(sizes[i], sizes[j]) >= 0.8 * max(sizes[i], sizes[j])}
    assert want and every == want
    assert all(spanning.root(i) == spanning.root(j) for i, j in want)


def test_the_search_for_candidates_grows_far_slower_than_all_pairs():
    """Of 40,000 strangers a leaf holds a thirtieth of all pairs at most, and pairs alike to four fifths still meet in a tree."""
    fps = np.random.default_rng(3).integers(0, 2**64, 40_000, dtype=np.uint64)
    work = [[sum(len(a) * (len(a) + len(b)) for a, b in neardup.leaves(fps[:n], np.ones(n, bool), mask)) for mask in neardup.QUARTERS] for n in (10_000, 40_000)]
    assert sum(work[1]) * neardup.PRINTS < 40_000**2 / 2 and sum(work[1]) < 7 * sum(work[0])
    pairs = [p for p in around(23, n=600) if 0.8 <= alike(*p) < 0.85]
    met = 0
    for pair in pairs:
        a, b = (np.array(neardup.prints(neardup.fives(neardup.shingles(t))), np.uint64) for t in pair)
        met += any((np.bitwise_count((a ^ b) & np.uint64(mask)) <= 1).any() for mask in neardup.QUARTERS)
    assert len(pairs) > 100 and met >= 0.99 * len(pairs)


def test_texts_without_a_candidate_stay_out_of_the_join(spark):
    rows = spark.range(20_000).withColumn("k", F.col("id") % 7)
    wanted = rows.filter("id % 100 = 3")
    found = neardup._likely(rows, wanted, ["id", "k"], 200)
    assert found.columns == rows.columns and found.count() < 400
    assert found.join(wanted, ["id", "k"]).count() == 200
