"""URL filters, language, repeats, near duplicates and the pipeline."""

import itertools
import random

import numpy as np
import pytest

from brindle.llm import langid, neardup, repeats, urls


def test_urls(spark):
    pages = [(1, "HTTP://WWW.Example.COM/en/8?x"), (2, "https://a.example.com/en/71"), (3, "http://x.example.net/de/8"), (4, "http://x.example.net/de/7"), (5, None), (6, "nothing"), (7, "http://notnet/de/"), (8, "https://m.site.io/a/b.html?utm_source=z&b=2&a=1#t"), (8, "https://m.site.io/a/b.html?utm_source=z&b=2&a=1#t"), (9, "https://site.io/a/c"), (None, "http://host"), (10, "")]
    df = spark.createDataFrame([(*p, "x", True) for p in pages], "page_id bigint, url string, canonical string, possible boolean")
    listed = spark.createDataFrame([("site.io/a/b?a=1&b=2",), (None,), ("other.io/" + "x" * 9,)], "url string")
    out = urls.filter_urls(df, listed).collect()
    assert len(out) == len(pages)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out}
    assert got[1] == ("www.example.com", "/en/8", "com/en/", "block")
    assert got[2] == ("a.example.com", "/en/71", "example.com/en/7", "allow")
    assert got[3][2:] == ("example.net/de/8", "block") and got[4][2:] == ("net/de/", "allow")
    assert got[5] == got[6] == got[10] == ("", "", None, "allow")
    assert got[7][2] is None and got[8][2:] == (None, "block") and got[9][3] == "allow" and got[None] == ("host", "", None, "allow")
    assert urls.filter_urls(df, listed.where("false")).where("verdict = 'block' and rule is null").count() == 0
    assert urls.filter_urls(df.where("false"), listed).count() == 0
    many = spark.range(3000).selectExpr("concat('site.io/', id) as url")
    test = spark.range(6000).selectExpr("id as page_id", "concat('https://site.io/', id) as url")
    seen = urls.filter_urls(test, many)
    assert seen.where("verdict = 'block'").count() == 3000
    assert 3000 <= seen.where("possible").count() < 3150


def test_language(spark, documents):
    words = {"en": ["the", "thing", "with", "that"], "fr": ["être", "leaux", "que", "dans"]}
    rnd = random.Random(2)
    say = lambda lang, n: " ".join(rnd.choice(words[lang]) for _ in range(n))
    docs = spark.createDataFrame([(i, say(lang, 30), lang) for i, lang in enumerate(["en", "fr"] * 20)], "doc_id bigint, text string, lang string")
    rows = [(i, f"http://{lang}.site.org/{lang}/{i}", f"<html lang='{lang}'><p>{say(lang, 20)}</p>") for i, lang in enumerate(["en", "fr"] * 15)]
    rows += [(100, "http://fr.site.org/x", None), (101, None, None), (102, "http://fr.site.org/fr/1", ""), (102, "http://fr.site.org/fr/1", ""), (103, "http://en.site.org/en/2", f"<html lang=fr><script>{say('en', 50)}</script>{say('fr', 40)}")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, lang string")
    out = {r["page_id"]: r for r in langid.identify(pages, docs).collect()}
    assert all(out[i]["lang"] == ("en", "fr")[i % 2] for i in range(30))
    assert out[100]["lang"] == out[102]["lang"] == out[103]["lang"] == "fr" and out[101]["lang"] in words
    assert langid.identify(pages, docs).count() == len(rows)
    assert langid.identify(pages.where("false"), docs).count() == 0
    assert {r["lang"] for r in langid.identify(pages, docs.where("false")).collect()} == {None}


def test_no_language_is_left_out(spark):
    codes = [a + b for a in "abcdefghij" for b in "klmnopq"][:66]
    docs = spark.createDataFrame([(2 * i + k, f"{c}{c} " * 40, c) for i, c in enumerate(codes) for k in range(1 if i == 65 else 2)], "doc_id bigint, text string, lang string")
    pages = spark.createDataFrame([(1, "http://a.site.org/x", f"<p>{(codes[65] * 2 + ' ') * 40}</p>")], "page_id bigint, url string, html string")
    assert langid.identify(pages, docs).first()["lang"] == codes[65]


def test_repeats(documents, edges, none):
    line, short = "one passage of words that stands in many documents", "too short"
    texts = [f"a first line of its own\n{line}\n{short}", f"{line.upper()}\nsomething else in this one here\n{short}", f"  {line}  ", None, "", "no repeats in this one at all"]
    out = {r["doc_id"]: (r["text"], [(s["start"], s["end"]) for s in r["kept"]]) for r in repeats.remove_repeats(documents(texts, clash=True)).collect()}
    assert out[0] == (texts[0], [(0, len(texts[0]))])
    assert out[1] == (f"something else in this one here\n{short}", [(len(line) + 1, len(texts[1]))])
    assert out[2] == ("", []) and out[3] == (None, []) and out[4] == ("", [(0, 0)]) and out[5][0] == texts[5]
    same = repeats.remove_repeats(documents([(1, line), (1, line), (2, line), (None, line)])).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in same) == [("1", line), ("1", line), ("2", ""), ("None", "")]
    assert repeats.remove_repeats(edges).count() == 9 and repeats.remove_repeats(none).count() == 0


def _components(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) > 3 else ({tuple(w)} if w else set()))
    label = list(range(len(sets)))
    for i, j in itertools.combinations(range(len(sets)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
            a, b = sorted((label[i], label[j]))
            label = [a if x == b else x for x in label]
    return [len(s) for s in sets], label


def test_near_duplicates(documents, edges, none, monkeypatch):
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for n in (1, 2, 3, 4, 5, 6, 8, 12, 20, 40, 80, 200, 600):
        base = [rnd.choice(words) for _ in range(n)]
        for k in range(12):
            new = list(base)
            for _ in range(rnd.randrange(1 + n // 25 + k // 6)):
                new[rnd.randrange(n)] = rnd.choice(words)
            if k % 4 == 3:
                new = new[: max(1, len(new) - rnd.randrange(1 + n // 12))]
            texts.append(" ".join(new).upper() if k % 5 == 0 else "  ".join(new))
    texts += [None, "", " \n"]
    sizes, want = _components(texts)
    monkeypatch.setattr(neardup, "CHUNK", 4)
    got = {r["doc_id"]: r for r in neardup.join(documents(texts, clash=True)).collect()}
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    out = neardup.join(edges).collect()
    assert len(out) == 9 and {r["component_id"] for r in out if r["class_id"] and r["n_shingles"] == 3} == {5}
    assert all(r["component_id"] == r["doc_id"] for r in out if not r["n_shingles"])
    assert neardup.join(none).count() == 0
    kept = neardup.stage(edges.sparkSession, edges, "")
    assert kept.columns == edges.columns and sorted(r["doc_id"] for r in kept.select("doc_id").collect() if r["doc_id"]) == [1, 2, 3, 5, 6, 7, 7]


def test_every_link_counts(documents, monkeypatch):
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join([*base[:k], "changed", *base[k + 1 :]]) for k in (10, 50, 90)]
    chain = [f"c{i}" for i in range(260)]
    texts += [" ".join(chain[k : k + 200]) for k in range(0, 61, 6)] + ["a pair of texts that differ at the very end of their words so that they link " * 9 + x for x in ("one", "two")] + [texts[0], "alone"]
    sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} or {tuple(w)} for w in (t.split() for t in texts)]
    kinds = {frozenset(s) for s in sets}
    want = [sum(100 * len(s & k) >= 85 * len(s | k) for k in kinds if k != s) for s in sets]
    assert want[:3] == [2, 2, 2] and len(set(want[3:14])) > 1
    for most in (512, 2):
        monkeypatch.setattr(neardup, "COUNTED", most)
        got = {r["doc_id"]: r["n_links"] for r in neardup.join(documents(texts)).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_signatures_lose_nothing():
    rnd = np.random.default_rng(1)
    for n in (6, 7, 9, 14, 30, 90, 300, 1500):
        for _ in range(40):
            a = np.unique(rnd.integers(0, 2**63, n).astype(np.uint64))
            drop = int(rnd.integers(0, neardup.most_apart(n, n) // 2 + 1))
            b = np.unique(np.concatenate((a[drop:] if rnd.random() < 0.5 else rnd.permutation(a)[drop:], rnd.integers(0, 2**63, drop).astype(np.uint64))))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 85 * (len(a) + len(b) - both) and both < max(len(a), len(b)):
                keys = [set(np.concatenate([neardup.signatures(x, y) for y in neardup.bands_of(len(x))]).tolist()) for x in (a, b)]
                assert keys[0] & keys[1]
                sketches = [{y.number: int.from_bytes(neardup.sketch(x, y), "big") for y in neardup.bands_of(len(x))} for x in (a, b)]
                assert neardup._near((len(a), len(b)), tuple(sketches))


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    at = docs
    for name, stage in pipeline.STAGES[:-1]:
        new = stage(spark, at, "/root/testdata/sf0.001")
        assert new.columns == docs.columns, name
        new.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
    left = {r["doc_id"] for r in at.collect()}
    assert 100 < len(left) < 200
    out = pipeline.run(spark, "/root/testdata/sf0.001")
    assert {r["doc_id"] for r in out.select("doc_id").collect()} == left
