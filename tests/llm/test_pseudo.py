"""Masked pseudo-likelihood against sums made word by word."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from brindle.llm import pseudo


def _tables(texts):
    words, windows = Counter(), Counter()
    for t in texts:
        w = pseudo.words_of(t)
        words.update(w)
        keys = [0, *map(pseudo.key_of, w), 0]
        for i in range(len(w)):
            win = int(pseudo.window_of(np.array([keys[i]], np.uint64), np.array([keys[i + 2]], np.uint64))[0])
            if win % pseudo.MEMORY == 0:
                windows[win, keys[i + 1]] += 1
    return words, windows


def _log(model, tokens, sides, kind, slot):
    """log P(class, slot) by the network, one token at a time."""
    p = {k: x.astype(float) for k, x in model["network"].items()}
    h = np.tanh(np.concatenate([p["e"][k] for k in sides]) @ p["w"] + p["b"])
    z, y = h @ p["c"] + p["c0"], p["d"][kind] @ h + p["d0"][kind]
    return z[kind] - np.logaddexp.reduce(z) + y[slot] - np.logaddexp.reduce(y)


def _expected(model, corpus, text, inside):
    words, windows = _tables(corpus)
    own_words, own_windows = _tables([text]) if inside else (Counter(), Counter())
    tokens = pseudo.Tokens(model["vocabulary"], model["own"])
    placed = lambda w: tuple(tokens.read([w])[:3, 0].tolist())
    w = pseudo.words_of(text)
    numbers = [tokens.edge] * 2 + [placed(x)[0] for x in w] + [tokens.edge] * 2
    keys = [0, *map(pseudo.key_of, w), 0]
    total, asked, held = 0.0, 0, 0
    for i, x in enumerate(w):
        _, kind, slot = placed(x)
        log = _log(model, tokens, [numbers[i], numbers[i + 1], numbers[i + 3], numbers[i + 4]], kind, slot)
        if slot == tokens.rest:
            rest = [y for y in words if placed(y)[1:] == (kind, slot)]
            mass = sum(words[y] + pseudo.LEAST for y in rest) + pseudo.LEAST - sum(own_words[y] for y in own_words if placed(y)[1:] == (kind, slot))
            log += math.log((words[x] - own_words[x] + pseudo.LEAST) / mass)
        win = int(pseudo.window_of(np.array([keys[i]], np.uint64), np.array([keys[i + 2]], np.uint64))[0])
        if win % pseudo.MEMORY == 0:
            n = windows[win, keys[i + 1]] - own_windows[win, keys[i + 1]]
            around = sum(v - own_windows[k] for k, v in windows.items() if k[0] == win)
            log, asked, held = math.log((n + math.exp(log)) / (around + 1)), asked + 1, held + (n > 0)
        total += log
    return total, asked, held


@pytest.fixture()
def small(monkeypatch):
    """Few known words and outputs, so that every kind of lookup occurs."""
    monkeypatch.setattr(pseudo, "KNOWN", 30)
    monkeypatch.setattr(pseudo, "OWN", 12)
    monkeypatch.setattr(pseudo, "MEMORY", 3)


def _texts(seed, n=40):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(1, 5))) for _ in range(150)]
    return [" ".join(words[min(int(rnd.expovariate(0.05)), 149)] for _ in range(rnd.randrange(1, 30))) for _ in range(n)]


@pytest.mark.parametrize("inside", [True, False])
def test_scores_are_sums_over_words(documents, small, inside):
    corpus = [*_texts(1), *_texts(1)[:3], None, ""]
    model = pseudo.train(documents(corpus))
    assert 0 < model["own"] <= 12 < len(model["vocabulary"]) <= 30
    scored = corpus if inside else _texts(2)
    got = {r["doc_id"]: r for r in pseudo.score(documents(scored, clash=True), model, inside).collect()}
    asked = held = 0
    for i, text in enumerate(scored):
        want = _expected(model, corpus, text, inside)
        assert got[i]["n_tokens"] == len(pseudo.words_of(text)) and (got[i]["n_windows"], got[i]["n_recalled"]) == want[1:]
        assert np.isclose(got[i]["score"], want[0], rtol=1e-4, atol=1e-3)
        asked, held = asked + want[1], held + want[2]
    assert asked > held > 0 or not inside


def test_probabilities_of_all_words_sum_to_one(documents, small):
    corpus = _texts(3)
    model = pseudo.train(documents(corpus))
    left = corpus[0].split()[0]
    tokens = pseudo.Tokens(model["vocabulary"], model["own"])
    kinds = [(k, s) for k, row in enumerate(tokens.outputs()) for s, there in enumerate(row) if there]
    sides = [int(tokens.read([left])[0, 0])] * 2 + [tokens.edge] * 2
    total = sum(math.exp(_log(model, tokens, sides, k, s)) for k, s in kinds)
    assert abs(total - 1) < 1e-6


def test_text_that_repeats_elsewhere_scores_higher(documents):
    rnd = random.Random(5)
    texts = [" ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(1, 6))) for _ in range(300)) for _ in range(60)]
    docs = documents([*texts, *texts[:10]])
    rows = {r["doc_id"]: r for r in pseudo.score(docs, pseudo.train(docs)).collect()}
    assert min(rows[i]["mean"] for i in range(10)) > max(rows[i]["mean"] for i in range(10, 60))
    assert min(rows[i]["n_recalled"] / rows[i]["n_windows"] for i in range(10)) == 1


def test_both_sides_count(documents):
    """A word that follows from its neighbours is likelier between them than between others."""
    rnd = random.Random(6)
    pairs = [(f"a{i}", f"b{i}", f"c{i}") for i in range(8)]
    texts = [" ".join(x for _ in range(20) for x in rnd.choice(pairs)) for _ in range(200)]
    model = pseudo.train(documents(texts))
    new = documents(["a1 b1 c1 a2 b2 c2 a3 b3 c3", "a1 b2 c3 a2 b3 c1 a3 b1 c2"])
    score = {r["doc_id"]: r["score"] for r in pseudo.score(new, model, False).collect()}
    assert score[0] > score[1] + 5


def test_edges(documents, edges, none):
    out = pseudo.score(edges, pseudo.train(edges)).collect()
    assert len(out) == 9 and all((r["mean"] is None) == (r["n_tokens"] == 0) and (r["n_tokens"] or r["score"] == 0) for r in out)
    assert all(math.isfinite(r["score"]) for r in out)
    assert pseudo.score(none, pseudo.train(none)).count() == 0


def test_keys_are_sparks(spark):
    words = ["a", "the", "été", "漢字", "x" * 100]
    got = {r["w"]: r["k"] for r in spark.createDataFrame([(w,) for w in words], "w string").selectExpr("w", "xxhash64(w) as k").collect()}
    assert all(got[w] % (1 << 64) == pseudo.key_of(w) for w in words)


def test_every_window_is_remembered(documents):
    texts = [*_texts(7), *_texts(7)[:3]]
    docs = documents(texts)
    holders = Counter()
    windows = lambda t: {(["", *w, ""][i], w[i], ["", *w, ""][i + 2]) for w in [pseudo.words_of(t)] for i in range(len(w))}
    for t in texts:
        holders.update(windows(t))
    for r in pseudo.score(docs, pseudo.train(docs)).collect():
        w = pseudo.words_of(texts[r["doc_id"]])
        padded = ["", *w, ""]
        assert r["n_windows"] == len(w)
        assert r["n_recalled"] == sum(holders[padded[i], w[i], padded[i + 2]] > 1 for i in range(len(w)))


@pytest.mark.parametrize("sample", [40, 400])
@pytest.mark.parametrize("whole", [True, False])
def test_all_windows_fit_the_network_and_hot_ones_count(documents, monkeypatch, sample, whole):
    """Rounds beyond the start, several buckets, and a line that everyone has: of known words and of rare ones."""
    for name, value in (("KNOWN", 30), ("OWN", 12), ("SAMPLE", sample), ("HOT", 60), ("BUCKET", 100)):
        monkeypatch.setattr(pseudo, name, value)
    corpus = [f"{t} {line}" for line in ("one line that they all have", "x") for t in _texts(8)] + [None, ""]
    docs = documents(corpus).repartition(5, "doc_id").sortWithinPartitions("doc_id")
    model = pseudo.train(docs)
    assert model["fitted"] == model["total"] == sum(len(pseudo.words_of(t)) for t in corpus)
    assert len(model["hot"][0]) > 1 and len(model["hot"][2]) > 1
    got = {r["doc_id"]: r for r in pseudo.score(docs if whole else documents(corpus), model).collect()}
    for i in (*range(0, 80, 7), 80, 81):
        want = _expected(model, corpus, corpus[i], True)
        assert (got[i]["n_windows"], got[i]["n_recalled"]) == want[1:]
        assert np.isclose(got[i]["score"], want[0], rtol=1e-4, atol=1e-3)


def test_totals_of_nested_keys_come_from_one_order(monkeypatch):
    rng = np.random.default_rng(4)
    keys = tuple(rng.integers(0, n, 500) for n in (3, 5, 7))
    weights = [rng.random(500) < share for share in (0.5, 0.9, 0.2)]
    want = [pseudo._totals(*keys[2 - k :], weights=w) for k, w in enumerate(weights)]
    sorts, real = [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda *a: sorts.append(1) or real(*a))
    got = pseudo._nested_totals(keys, weights)
    assert len(sorts) == 1 and all((x == y).all() for x, y in zip(got, want, strict=True))
    assert all(len(x) == 0 for x in pseudo._nested_totals(tuple(k[:0] for k in keys), [w[:0] for w in weights]))


def test_texts_are_read_once_to_learn_and_score(documents, monkeypatch):
    """The rounds write every document's tokens; scores from these are those from texts."""
    for name, value in (("KNOWN", 30), ("OWN", 12), ("SAMPLE", 40), ("BUCKET", 100)):
        monkeypatch.setattr(pseudo, name, value)
    corpus = [*_texts(9), *_texts(9)[:3], None, "", "naïve Été\u2003x"]
    docs = documents(corpus).repartition(3, "doc_id").sortWithinPartitions("doc_id")
    model = pseudo.train(docs)
    tokens = pseudo.Tokens(model["vocabulary"], model["own"])
    keys = {}
    for r in model["codes"].withColumn("docs", pseudo.F.size("ids")).collect():
        ((rows, sizes, code, columns),) = pseudo._read_codes(tokens, iter([pa.RecordBatch.from_pylist([r.asDict()])]))
        assert (rows == r["first"] + np.arange(r["docs"])).all() and ((columns[3] < 0) == (code == pseudo.RARE)).all()
        keys |= zip(r["ids"], np.split(columns, np.cumsum(sizes)[:-1], axis=1), strict=True)
    assert sorted(keys) == list(range(len(corpus)))
    for i, text in enumerate(corpus):
        assert (keys[i] == tokens.read(pseudo.words_of(text))).all()
    columns = ["doc_id", "n_tokens", "n_windows", "n_recalled", "score"]
    got, want = (sorted(pseudo.score(docs, m).select(columns).collect()) for m in (model, model | {"codes": None}))
    assert len(got) == len(corpus) and [r[:4] for r in got] == [r[:4] for r in want]
    assert np.allclose([r[4] for r in got], [r[4] for r in want])


@pytest.mark.parametrize("far", [False, True])
def test_a_step_goes_along_the_gradient(far):
    """Against a softmax made row by row; with `far`, biases so large that the bound lies too far above the rows."""
    rng = np.random.default_rng(1)
    outputs = np.ones((pseudo.CLASSES, 5), bool)
    learner = pseudo.fit(np.empty((0, 6), np.int32), 9, outputs)
    learner.p["d"][...] = rng.normal(0, 1, learner.p["d"].shape)
    if far:
        learner.p["c"][...], learner.p["d"][...] = learner.p["c"] * 900, learner.p["d"] * 40
    rows = np.concatenate([rng.integers(0, 9, (1300, 4)), rng.integers(0, 7, (1300, 1)), rng.integers(0, 5, (1300, 1))], 1).astype(np.int32)
    p = {k: x.astype(float) for k, x in learner.p.items()}
    want = {k: np.zeros_like(x) for k, x in p.items()}
    for r in rows:
        x = p["e"][r[:4]].ravel()
        h = np.tanh(x @ p["w"] + p["b"])
        a, b = (pseudo.softmax(z[None])[0] for z in (h @ p["c"] + p["c0"], p["d"][r[4]] @ h + p["d0"][r[4]]))
        a[r[4]] -= 1
        b[r[5]] -= 1
        back = (p["c"] @ a + b @ p["d"][r[4]]) * (1 - h * h)
        for k, part in (("c", np.outer(h, a)), ("c0", a), ("w", np.outer(x, back)), ("b", back)):
            want[k] += part
        want["d"][r[4]] += np.outer(b, h)
        want["d0"][r[4]] += b
        np.add.at(want["e"], r[:4], (p["w"] @ back).reshape(4, -1))
    learner.learn(rows, 0.0)
    for k, m in learner._views(learner.p, learner.numbers[1]).items():
        assert np.allclose(m / 0.1, want[k] / len(rows), rtol=1e-3, atol=1e-5 * (1 + np.abs(want[k] / len(rows)).max()))


def test_gathered_are_all_words_and_often_seen_windows():
    texts = [f"{t} all rights reserved {t}" for t in _texts(10)] * 20 + [None, "", "a"]
    words, windows = _tables(texts)
    got = [r for b in pseudo._gather(1)(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])])) for r in b.to_pylist()]
    assert {r["word"]: r["n"] for r in got if r["word"] is not None} == words
    around = Counter()
    for (window, _), n in windows.items():
        around[window] += n
    often = {w: n for w, n in around.items() if n * pseudo.HOT >= words.total()}
    assert {r["window"] % (1 << 64): r["n"] for r in got if r["word"] is None} == often and len(often) > 20
