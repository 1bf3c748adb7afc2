import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from texts import corpus, frame
from tokenizers import Tokenizer

from kinfold.llm import bpe, packing

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "<|endoftext|> a", "a\x01b", "Ünïcode ß ẞ İ ǅ", "日本語 テスト", "café", "1²3½ⅷ", "it's 'S don'T", "a\u0085b c d\x0be\x1cf", "é x", "__a_b..,,!!", "…“hi”–—’s", "emoji 😀👍🏽", "\x00", "x" * 5000, "١٢٣ ªº", "A​B", "ﬁ Ｆｕｌｌ", "<|START", "tail  \n\n "]


def odd_texts():
    r = random.Random(9)
    signs = [32, 32, 65, 66, 97, 98, 10, 13, 9, 0x85, 0xA0, 0x2028, 0x1C, 0x301, 0x661, 0xB2, 0x2167, 0x1F600, 0x39, 0x27, 0x73]
    return ODD + ["".join(chr(r.choice(signs)) for _ in range(2500)) for _ in range(20)] + [" ".join(r.choice(["a1", "日", "b", "\n", "  ", "é", "...", " ", "x" * 9]) for _ in range(4000))]


def test_words_are_encoded_as_by_the_tokenizer():
    encoder, texts = packing.WordEncoder(WORD), odd_texts()
    assert encoder.fast
    want = Tokenizer.from_file(WORD).encode_batch(texts, add_special_tokens=False)
    assert encoder(texts) == [np.array(e.ids, "<u4").tobytes() for e in want]


def test_bytes_are_encoded_and_decoded_as_by_the_tokenizer():
    encoder, texts = bpe.ByteEncoder(BYTE), odd_texts()
    tokenizer = Tokenizer.from_file(BYTE)
    for text, e in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert encoder.encode(text.encode(), {}).tolist() == e.ids
        assert encoder.decode(e.ids) == tokenizer.decode(e.ids, skip_special_tokens=False)


def test_chunks_depend_on_content_and_join_to_the_text():
    r = random.Random(2)
    body = " ".join("".join(r.choice("abcdeé") for _ in range(r.randint(1, 9))) for _ in range(4000))
    cut = lambda t: [t.encode()[a:b] for a, b in zip([0, *bpe.cuts(t.encode())], bpe.cuts(t.encode()), strict=False)]
    one, other = cut("first " + body), cut("quite another start " * 7 + body)
    assert b"".join(one) == ("first " + body).encode()
    assert len(set(one) & set(other)) > 0.8 * len(one)
    assert all(len(c) <= bpe.MOST + 3 and c.decode() for c in one)


def test_encode_and_decode_with_shared_chunks(spark):
    rows = corpus(4, 50)
    tokenizer = Tokenizer.from_file(BYTE)
    got = bpe.encode_and_decode(frame(spark, rows), BYTE).collect()
    want = sorted((str(i), tokenizer.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in rows)
    assert sorted((str(r["doc_id"]), r["ids"], r["decoded"]) for r in got) == want
    docs = frame(spark, rows).selectExpr("doc_id", "xxhash64(text) as k", "text")
    shared = bpe.shared_chunks(docs, BYTE)
    assert shared and all(ids.tolist() == tokenizer.encode(c.decode(), add_special_tokens=False).ids for c, ids in shared.items())


def test_pieces_and_sequences(spark):
    rows = corpus(5, 60)
    tokenizer = Tokenizer.from_file(WORD)
    got = packing.pack_documents(frame(spark, rows), WORD, window=256, with_ids=True).collect()
    ids = sorted([(str(i), [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in rows])
    joined, windows = {}, {}
    for r in got:
        own = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert len(own) == r["length"] <= 256 and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
        joined.setdefault((str(r["doc_id"]), r["doc_tokens"]), []).append((r["start"], own))
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    rebuilt = sorted((doc, sum((p for _, p in sorted(parts)), [])) for (doc, _), parts in joined.items() if doc not in ("3", "None"))
    assert rebuilt == [x for x in ids if x[0] not in ("3", "None")]
    assert sum(r["length"] for r in got) == sum(len(x) for _, x in ids)
    assert sorted(windows) == list(range(len(windows)))


def best_fit(lengths, window):
    space = []
    for length in sorted(lengths, reverse=True):
        fits = [i for i, c in enumerate(space) if c >= length]
        if fits:
            space[min(fits, key=space.__getitem__)] -= length
        else:
            space.append(window - length)
    return sorted(space)


def test_the_plan_is_best_fit_decreasing():
    for seed in range(150):
        r = random.Random(seed)
        window = r.choice([7, 16, 50, 100])
        lengths = [r.randint(1, window) if r.random() < 0.7 else r.choice([1, 2, 3, window // 2 + 1]) for _ in range(r.randrange(120))]
        counts = {x: lengths.count(x) for x in lengths}
        places, seen = {}, set()
        for length, low, high, width, first, offset in packing.plan(counts, window):
            for x in range(low, high):
                assert (length, x) not in seen
                seen.add((length, x))
                places.setdefault(first + (x - low) % width, []).append((offset + (x - low) // width * length, length))
        assert len(seen) == len(lengths)
        left = []
        for parts in places.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            left.append(window - at)
        assert sorted(left) == best_fit(lengths, window)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, "a"), (None, "a")]])
def test_small_tables(spark, rows):
    assert packing.pack_documents(frame(spark, rows), WORD).count() == len(rows)
    assert bpe.encode_and_decode(frame(spark, rows), BYTE).count() == len(rows)
