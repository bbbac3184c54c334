"""Repeated passages inside lines, against a list of all units made without digests."""

import random

import pytest

from brindle.llm import repeats


def _expected(docs):
    """What stays of each (doc_id, text), by comparing the units themselves."""
    seen, gone = {}, {i: set() for i, _ in docs}
    for i, text in docs:
        words, opens, lines = [], [], []
        for line in text.split("\n"):
            lines.append((len(words), len(words) + len(line.split())))
            for k, w in enumerate(line.split()):
                opens.append(k == 0 or w[0].isupper() or words[-1][-1] in ".!?")
                words.append(w)
        edges = [k for k, x in enumerate(opens) if x] + [len(words)]
        units = {(a, b) for a, b in lines if b - a >= 5}
        units |= {(a, min(x for x in edges if x >= a + 20)) for a in edges[:-1] if edges[-1] >= a + 20}
        for a, b in units:
            seen.setdefault(" ".join(words[a:b]).lower(), []).append((i, a, b))
    for places in seen.values():
        places.sort()
        for i, a, b in places:
            if (i, a) != places[0][:2]:
                gone[i].update(range(a, b))
    out = {}
    for i, text in docs:
        k, lines = 0, []
        for line in text.split("\n"):
            n = len(line.split())
            left = [w for j, w in enumerate(line.split(), k) if j not in gone[i]]
            if left or not n:
                lines.append(" ".join(left))
            k += n
        out[i] = "\n".join(lines)
    return out


def _corpus(seed, n=60):
    rnd = random.Random(seed)
    say = lambda k: " ".join(("".join(rnd.choice("abcdefg") for _ in range(rnd.randrange(1, 6))) + rnd.choice(["", "", "", ".", "!"])).capitalize() if rnd.random() < 0.2 else "".join(rnd.choice("abcdefg") for _ in range(rnd.randrange(1, 6))) for _ in range(k))
    passages = [say(k) for k in (51, 60, 75, 140)] + [f"{say(30)}\n{say(40)}"]
    texts = []
    for i in range(n):
        words = say(rnd.randrange(10, 120)).split()
        if i % 3:
            words.insert(rnd.randrange(len(words)), rnd.choice(passages).upper() if i % 7 == 0 else rnd.choice(passages))
        texts.append("\n".join(" ".join(words).split("\n")))
    return texts, passages


@pytest.mark.parametrize("cached", [1 << 16, 50])
def test_passages_inside_lines(documents, monkeypatch, cached):
    monkeypatch.setattr(repeats, "CACHED_UNITS", cached)
    texts, _ = _corpus(3)
    want = _expected([*enumerate(texts)])
    rows = repeats.remove_repeats(documents(texts).repartition(3)).collect()
    got = {r["doc_id"]: "\n".join(" ".join(x.split()) for x in r["text"].split("\n")) for r in rows}
    assert got == want
    for r in rows:
        assert "".join(texts[r["doc_id"]][s["start"] : s["end"]] for s in r["kept"]).split() == r["text"].split()


def test_words_of_repeated_passages_go(documents):
    texts, passages = _corpus(4)
    got = {r["doc_id"]: r["text"] for r in repeats.remove_repeats(documents(texts)).collect()}
    for p in passages[:4]:
        whole = [i for i, t in got.items() if p.lower().split()[10:40] == t.lower().split()[10:40] or " ".join(p.lower().split()[10:40]) in " ".join(t.lower().split())]
        assert len(whole) == 1


def test_columns_with_the_same_names_stay(spark, documents):
    line = "one line of words that stands in many documents"
    docs = spark.createDataFrame([(1, line, "mine", 7, 8), (2, line, "yours", 9, 10)], "doc_id bigint, text string, kept string, first int, offsets int")
    out = repeats.stage(spark, docs, "")
    assert out.schema == docs.schema and sorted(map(tuple, out.collect())) == [(1, line, "mine", 7, 8), (2, "", "yours", 9, 10)]


def test_hashes_tell_orders_apart():
    words = repeats.Words()
    a, b = "B a a b a b b a a b a b a b b a a b b a c", "A b b a b a a b b a b a b a a b b a a b c"
    units = [{x[2:] for x in zip(*(y.tolist() for y in words.units(t)), strict=True)} for t in (a, b, f"{a}\n{b}")]
    assert not units[0] & units[1] and units[0] | units[1] <= units[2]
