"""BPE, media, licenses, toxicity, LM scoring and leaks on edges and against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import bpe, leaks, licenses, media, toxicity


def test_bpe_equals_library(spark, edges, none):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.vocabulary_path())
    rows = bpe.tokenize(edges, bpe.vocabulary_path()).collect()
    texts = sorted((x["text"] or "" for x in edges.collect()), key=len)
    got = sorted((np.frombuffer(r["ids"], "<u4").tolist(), r["decoded"], r["n_tokens"]) for r in rows)
    want = sorted((e.ids, t.decode(e.ids, skip_special_tokens=False), len(e.ids)) for e in (t.encode(x, add_special_tokens=False) for x in texts))
    assert got == want
    assert bpe.tokenize(none, bpe.vocabulary_path()).count() == 0
    codec, rnd = bpe.Codec(bpe.load(bpe.vocabulary_path())), random.Random(1)
    letters = ["a", "e", "in", "th", "tion", "ing", " ", "'s", "'LL", "12", "!", "...", "é", "Σ", "İ", "ß", "<|endoftext|>", "<|", "漢", "🤗", "ﬁ", "́", "\U0001e030", "豈"]
    for _ in range(1500):
        x = "".join(rnd.choice(letters) for _ in range(rnd.randrange(25)))
        ids = t.encode(x, add_special_tokens=False).ids
        code = codec.encode(x)
        assert np.frombuffer(code, "<u4").tolist() == ids, x
        assert b"".join(codec.decode(code)).decode() == t.decode(ids, skip_special_tokens=False), x
    assert len(codec.encode("a" * 100_000)) // 4 == len(t.encode("a" * 100_000, add_special_tokens=False).ids)


def _slow_crc(data):
    c = 0
    for x in data:
        c ^= x << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
    return c


def test_media_round_trip(spark, edges, none):
    for n in (0, 1, 63, 64, 65, 255, 4999, 5000, 5001, 65_025, 70_000):
        data = random.Random(n).randbytes(n)
        read = media.decode(media.encode(data))
        assert read["payload"] == data + bytes(-n % 64 if n else 64) and read["n_bytes"] == n
        assert read["page_end_us"] == sorted(read["page_end_us"])
    assert media.page_crc(b"abc", b"def" * 30) == _slow_crc(b"abc" + b"def" * 30)
    good = media.encode(b"hello" * 999)
    for bad in (good[:-1], good[1:], good[:99] + b"?" + good[100:], b"", good + good):
        with pytest.raises(media.OggError):
            read = media.decode(bad)
    out = media.from_media(media.to_media(edges)).collect()
    assert sorted(r["payload"][: r["n_bytes"]] for r in out) == sorted((x["text"] or "").encode() for x in edges.collect())
    assert media.from_media(media.to_media(none)).count() == 0
    broken = spark.createDataFrame([(1, None), (2, bytearray(b"OggX"))], "doc_id bigint, media binary")
    assert {r["doc_id"]: r["payload"] for r in media.from_media(broken).collect()} == {1: None, 2: None}


def test_licenses(documents, edges, none):
    texts = ["Under the MIT license, CC BY-NC; under THE mit\nlicense!", "apache license version 2.0", "cc by", None, "x under the mit", "licensed under the apache license, version 2.0", "cc by nc " * 300]
    spans = licenses.scan(documents(texts, clash=True)).collect()
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").lower())
        want = sorted((k, label) for p, label in licenses.PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split())
        assert sorted((r["start"], r["label"]) for r in spans if r["doc_id"] == i and r["base"]) == want
    assert any(r["label"] == "apache-2" and not r["base"] and r["doc_id"] == 5 for r in spans)
    assert licenses.scan(edges).count() == 0 and licenses.scan(none).count() == 0
    twice = documents([(1, "cc by nc"), (1, "cc by nc"), (None, "cc by nc")])
    assert licenses.scan(twice).where("base").count() == 2


def _toxic_table(documents, spark, n=700):
    rnd = random.Random(4)
    plain = ["".join(rnd.choice("abcdefghi") for _ in range(rnd.randrange(2, 8))) for _ in range(400)]
    texts, labels = [], []
    for i in range(n):
        words = [rnd.choice(plain) for _ in range(rnd.randrange(5, 60))]
        if bad := int(i % 5 == 0):
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), rnd.choice(["zorkish", "zorkly", "zorkful", "vileword"]))
        texts.append(" ".join(words))
        labels.append((i, 1, bad))
    return documents(texts), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_toxicity(spark, documents, edges, none):
    docs, labels = _toxic_table(documents, spark)
    field = toxicity.train(docs, labels)
    got = toxicity.score(docs, field).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).collect()
    assert sum((r["score"] >= 0.5) == bool(r["toxic"]) for r in got) / len(got) > 0.97
    one = toxicity.score(documents(["fine words zorkness and more", "nothing here"]), field).orderBy("doc_id").collect()
    assert [s["start"] for s in one[0]["spans"]] == [11] and not one[1]["spans"]
    scores = toxicity.score(edges, field).collect()
    assert len(scores) == 9 and all(0 <= r["score"] <= 1 for r in scores)
    assert toxicity.score(none, field).count() == 0
    assert toxicity.train(docs, labels.where("toxic = 0")) is None and toxicity.train(none, labels) is None
    assert {r["score"] for r in toxicity.score(edges, None).collect()} == {0.0}
    p, _ = toxicity.marginals(np.array([[0.3, -1.0, 2.0]]), np.ones((1, 3), bool), {"move": np.array([[0.2, -0.5], [0.1, 0.4]]), "start": np.array([0.0, 0.3])})
    weigh = {}
    for y in np.ndindex(2, 2, 2):
        s = [0.0, 0.3][y[0]] + sum(v for v, k in zip((0.3, -1.0, 2.0), y, strict=True) if k) + sum([[0.2, -0.5], [0.1, 0.4]][a][b] for a, b in zip(y, y[1:], strict=False))
        weigh[y] = np.exp(s)
    assert np.allclose(p[0], [sum(w for y, w in weigh.items() if y[k]) / sum(weigh.values()) for k in range(3)])


def _least_edits(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, x in enumerate(t, 1):
            new.append(min(row[j - 1] + (c != x), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_leaks(spark, documents, edges, none):
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(2, 9))) for _ in range(300)]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    items = [say(n) for n in (15, 20, 30, 45)]
    texts, held = [], []
    for i in range(40):
        item, base = items[i % 4], say(60)
        if i % 2:
            e = list(item)
            for _ in range(rnd.randrange(len(item) // 12)):
                e[rnd.randrange(len(e))] = rnd.choice("qrst")
            cut = base.find(" ", len(base) // 2)
            base = f"{base[:cut]} {''.join(e).upper()}\n{base[cut:]}"
        texts.append(base)
        held.append(bool(i % 2))
    bench = spark.createDataFrame([*enumerate(items), (9, None), (10, ""), (11, "short one here")], "item_id bigint, text string")
    found = leaks.find_leaks(documents(texts, clash=True), bench).collect()
    for i in range(40):
        own = {r["item_id"] for r in found if r["doc_id"] == i}
        item, text = leaks.normalise(items[i % 4]), leaks.normalise(texts[i])
        assert own == ({i % 4} if _least_edits(item, text) <= len(item) // 10 else set()) and bool(own) == held[i]
    kept = leaks.clean(documents(texts), bench)
    assert {r["doc_id"] for r in kept.collect()} == {i for i in range(40) if not held[i]}
    assert leaks.clean(edges, bench).count() == 9 and leaks.find_leaks(none, bench).count() == 0
    assert leaks.find_leaks(edges, bench.where("false")).count() == 0
    assert leaks.find_leaks(documents(["a short one here!", "so a Short  one here it is", "a short one heres"]), bench).count() == 2  # at word borders
    for _ in range(60):
        p = bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(20, 40)))
        e = bytearray(p)
        for _ in range(rnd.randrange(4)):
            e[rnd.randrange(len(e))] = rnd.choice(b"abc")
        pre = bytes(rnd.choice(b"xyz") for _ in range(rnd.randrange(6)))
        got, want = leaks.align(p, pre + bytes(e) + b"zzz", 4, len(pre) - 8), _least_edits(p, pre + bytes(e) + b"zzz")
        assert got[2] == want if want <= 4 else got is None


def test_parts_of_items_are_found_wherever_cut(spark, documents):
    rnd = random.Random(9)
    say = lambda n, letters: " ".join("".join(rnd.choice(letters) for _ in range(rnd.randrange(2, 9))) for _ in range(n))
    item, middle = say(60, "abcdefgh"), say(12, "abcdefgh")[:70]
    bench = spark.createDataFrame([(1, item), (2, middle)], "item_id bigint, text string")
    parts = [(1, item[k : k + 60]) for k in range(1, 200, 7)] + [(2, middle[k : k + 52]) for k in range(len(middle) - 52)]
    texts = [f"{say(30, 'pqrstuv')} {part.strip()} {say(30, 'pqrstuv')}" for _, part in parts]
    found = {(r["doc_id"], r["item_id"]) for r in leaks.find_leaks(documents([*texts, say(90, "pqrstuv")]), bench).collect()}
    assert found == {(i, n) for i, (n, _) in enumerate(parts)}
