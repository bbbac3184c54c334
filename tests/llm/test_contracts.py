"""Queries' own columns, classifiers and the pipeline against plain versions in Python."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import langid, leaks, media, neardup, toxicity, urls
from brindle.llm.common import free_name, shared_dir


def test_media_query_columns(spark, tmp_path):
    texts = ["", "a", "b" * 64, "é" * 33, "x" * 20_000, None, "漢字 🤗" * 999]
    spark.createDataFrame([*enumerate(texts)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in media.query(spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        data = (text or "").encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        stored = media.encode(data)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(stored), hashlib.sha256(stored).hexdigest(), media.decode(stored)["feature"])


def test_toxicity_query_columns(spark, tmp_path):
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    rows = [(i, " ".join([rnd.choice(words) for _ in range(30)] + ["vileness"] * (i % 4 == 0))) for i in range(500)]
    spark.createDataFrame([*rows, (500, ""), (501, None)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(500)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"]: r for r in toxicity.query(spark, str(tmp_path)).collect()}
    assert len(got) == 502 and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    assert np.mean([got[i]["predicted"] == int(i % 4 == 0) for i in range(500) if got[i]["held_out"]]) > 0.98 and got[500]["score"] == got[501]["score"] == 0


def test_chains_of_any_length():
    rng = np.random.default_rng(2)
    field = {"move": rng.normal(0, 1, (2, 2)), "start": rng.normal(0, 1, 2)}
    for lengths in ([1], [2, 1, 63], [64], [65, 200, 1, 1000]):
        score = rng.normal(0, 3, sum(lengths))
        first = np.zeros(len(score), bool)
        first[np.cumsum([0, *lengths[:-1]])] = True
        whole = [toxicity.marginals(x[None], np.ones((1, len(x)), bool), field)[0][0] for x in np.split(score, np.cumsum(lengths)[:-1])]
        assert np.allclose(toxicity.chances(score, first, field), np.concatenate(whole), atol=1e-12)


def test_telling_words():
    tell = toxicity.telling
    assert tell(30, 0, 100, 900, 10_000) and not tell(30, 5, 100, 900, 10_000) and not tell(2, 0, 100, 900, 10_000)
    assert not tell(5, 0, 900, 100, 10_000)


def test_words_beyond_forty_letters_differ():
    assert toxicity.word_features("x" * 41) != toxicity.word_features("x" * 42)


def test_language_posterior(spark):
    rnd = random.Random(7)
    say = {"en": lambda n: " ".join(rnd.choice(["the", "thing", "with", "that"]) for _ in range(n)), "fr": lambda n: " ".join(rnd.choice(["être", "leaux", "que", "dans"]) for _ in range(n))}
    docs = spark.createDataFrame([(i, say[x](30), x) for i, x in enumerate(["en", "fr"] * 20)], "doc_id bigint, text string, lang string")
    rows = [(i, f"http://{x}{i % 3}.site.org/{x}/{i}", f"<html lang='{'en' if i % 7 == 0 else x}'><p>{say[x](i % 4)}</p>") for i, x in enumerate(["en", "fr", "fr"] * 15)]
    rows += [(90, "http://fr1.site.org/x", ""), (91, "http://new.org/fr/", None), (92, "http://long.org/", "<p>" + say["en"](20_000))]
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id bigint, url string, html string, first int, sure string")
    got = {r["page_id"]: r for r in langid.identify(pages, docs).collect()}
    langs, model = langid.fit(docs)
    seen = []
    for i, url, html in rows:
        host = url.split("//")[1].split("/")[0]
        domain = ".".join(host.split(".")[-2:])
        end = url.rstrip("/").split("/")[-1 if url.endswith("/") else -2]
        code = end if end in langs else "" if "/" + end not in url.split("//")[1] or not end.isalpha() or len(end) != 2 else "?"
        declared = html.split("lang='")[1][:2] if html and "lang='" in html else ""
        n = np.bincount(langid.trigrams(langid.page_text(html or "")), minlength=langid.BUCKETS) if html else np.zeros(langid.BUCKETS)
        x = langid.TEMPER * (model @ n)
        x = x - x.max()
        seen.append((i, host, domain, f"org/{code}", declared, x, int(np.argmax(x)), bool(np.exp(x).sum() < 1.2)))
    count = lambda keep: np.array([sum(s[7] and s[6] == k and keep(s) for s in seen) for k in (0, 1)], float)
    top = count(lambda s: True) + 0.5
    top /= top.sum()
    for i, host, domain, suffix, declared, x, _, _ in seen:
        above = count(lambda s, d=domain: s[2] == d)
        above = (above + langid.DOMAIN_WEIGHT * top) / (above.sum() + langid.DOMAIN_WEIGHT)
        own = count(lambda s, h=host: s[1] == h)
        prior = (own + langid.HOST_WEIGHT * above) / (own.sum() + langid.HOST_WEIGHT)
        score = x + np.log(prior)
        for at, value in ((4, declared), (3, suffix)):
            values = {s[at] for s in seen if s[7]}
            if value in values:
                score = score + np.log((count(lambda s, a=at, v=value: s[a] == v) + 0.5) / (count(lambda s: True) + 0.5 * len(values)))
        best = int(np.argmax(score))
        assert got[i]["suffix"] == suffix and got[i]["lang"] == langs[best], (i, got[i], score)
        assert math.isclose(got[i]["confidence"], 1 / np.exp(score - score.max()).sum(), rel_tol=1e-6)


def test_short_items_stand_anywhere(spark, documents):
    bench = spark.createDataFrame([(1, "Oslo"), (2, "of the sea"), (3, "Oslo")], "item_id bigint, text string")
    docs = documents(["oslo, OSLO! (oslo) oslos", "off the sea", "all of the sea.", "nothing"])
    found = sorted((r["doc_id"], r["item_id"], r["start"], r["end"]) for r in leaks.find_leaks(docs, bench).collect())
    assert found == [(0, n, a, a + 4) for n in (1, 3) for a in (0, 6, 13)] + [(2, 2, 4, 14)]
    assert sorted(r["doc_id"] for r in leaks.clean(docs, bench).collect()) == [0, 1, 3]


def test_long_urls_empty_tables_and_repeats(spark):
    long = "http://a.example.com/en/" + "x" * 100_000
    pages = spark.createDataFrame([(1, long), (1, long), (2, "https://h.io/a.html"), (3, "http://www.h.io/a/")], "page_id bigint, url string")
    out = urls.filter_urls(pages, urls.listed_urls(pages)).collect()
    assert sorted((r["page_id"], len(r["path"]), r["verdict"]) for r in out) == [(1, 100_004, "block")] * 2 + [(2, 7, "block"), (3, 3, "block")]
    assert urls.filter_urls(pages.where("false"), urls.listed_urls(pages.where("false"))).count() == 0


def test_copies_without_an_id_are_one(documents):
    docs = documents([(None, "one two three four five"), (None, "one two three four five"), (None, "other words that stand here")])
    assert neardup.stage(docs.sparkSession, docs, "").count() == 2


def test_chains_of_links_are_contracted(spark):
    n = 3000
    edges = spark.range(n).selectExpr("id as a", "id + 1 as b")
    roots = neardup.contract(edges)
    assert roots.count() == n and [r["root"] for r in roots.select("root").distinct().collect()] == [0]


def test_names():
    assert free_name(["a", "B", "_b"], "b") == "__b" and free_name([], "x") == "x"


def test_a_shared_folder_is_asked_for(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_keeps_columns_and_takes_edges(spark, tmp_path, empty):
    pipeline = pytest.importorskip("corpus_pipeline")
    line = "a passage of many words that two documents have in common and that is long enough"
    rows = [(1, None), (2, ""), (3, f"{line}\nand something of its own here that differs"), (4, f"other words to begin with at first\n{line}"), (5, "same text twice in this table of ours"), (5, "same text twice in this table of ours"), (None, "a row without any id at all"), (7, "w " * 30_000)]
    made = spark.createDataFrame([(*r, "en", "s", len(r[1] or ""), "k", 1, 2, 3) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, _th int, _n int, spans int")
    docs = made.where("false") if empty else made
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns, name
        at.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
    left = {r["doc_id"]: r["text"] for r in at.collect()}
    out = pipeline.STAGES[-1][1](spark, at, str(tmp_path))
    if empty:
        assert not left and out.count() == 0
        return
    assert at.count() == 7 and left[1] is None and left[4] == "other words to begin with at first" and left[5] == rows[4][1]
    assert {r["kept"] for r in at.collect()} == {"k"} and {r["doc_id"]: r["n_tokens"] for r in out.collect()}[2] == 0
    assert at.where(F.col("n_chars") != F.length("text")).count() == 0
