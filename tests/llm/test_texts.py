"""Tokens, mixing, reading levels, rankings."""

import base64
import collections
import math
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodevec.llm import mixing, queries, ranking, reading, tokens
from lodevec.session import table
from compare import rows, rows_sql

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
REFERENCE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODER = tokens.PieceEncoder(tokens.vocabulary_path(), tokens.vocabulary_pattern())


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    assert ENCODER.encode(text) == REFERENCE.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abct heionsr1'\n", max_size=200))
def test_wordlike(text):
    got = ENCODER.encode(text)
    assert got == REFERENCE.encode_ordinary(text)
    assert b"".join(ENCODER.bytes_of[t] for t in got).decode() == text


@pytest.mark.parametrize("text", ["<|endoftext|>", "a" * 5000, " " * 3000, "ab" * 4000, "=" * 999, "́" * 500, "日本" * 500, "x" * 20 + "\r\n\r\n" + "y" * 20, "﻿​\x00"])
def test_odd_texts(text):
    assert ENCODER.encode(text) == REFERENCE.encode_ordinary(text)


def test_other_vocabulary():
    e = tokens.PieceEncoder(tokens.vocabulary_path("byte_bpe_multi_50k"), tokens.vocabulary_pattern())
    r = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    ref = tiktoken.Encoding("multi", pat_str=P.PATTERN, mergeable_ranks=r, special_tokens={})
    for t in ("Über die Größenprüfung", "não há dados suficientes", "検索結果は距離の小さい順", "naïve café"):
        assert e.encode(t) == ref.encode_ordinary(t)


def test_long_runs_take_linear_time():
    import time

    def took(n):
        best = math.inf
        for _ in range(3):
            t = time.perf_counter()
            ENCODER.piece(b"abcabd" * n)
            best = min(best, time.perf_counter() - t)
        return best

    took(100)
    assert took(8000) < 40 * max(took(1000), 1e-3)


def test_corpus_is_encoded_exactly(spark, data):
    got = queries.p7_ids(spark, data)
    assert got.columns == ["doc_id", "ids"]
    texts = {r["doc_id"]: r["text"] for r in table(spark, data, "documents").select("doc_id", "text").collect()}
    out = got.collect()
    assert len(out) == len(texts)
    assert all(r["ids"] == (REFERENCE.encode_ordinary(texts[r["doc_id"]]) if texts[r["doc_id"]] else []) for r in out)
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x")], "doc_id long, text string, ids string")
    assert [r["ids"] for r in tokens.encode_corpus(odd).collect()] == [[], []]


DOCS = "doc_id long, text string, source string, tokens long, position double"


def corpus(spark, sizes):
    rng, rows, n = random.Random(1), [], 0
    for source, docs in sizes.items():
        for _ in range(docs):
            rows.append((n, " ".join(["word"] * rng.randrange(5, 60)), rng.choice([source, source.upper(), f" {source}", source.replace("_", "-")]), 7, 0.5))
            n += 1
    rows += [(n, None, "big", 1, 0.1), (n + 1, "", "big", 1, 0.1), (n + 2, "text", None, 1, 0.1), (n + 3, "text", "untargeted", 1, 0.1)]
    return spark.createDataFrame(rows, DOCS)


TARGETS = [("m", "big_one", 0.5, 1), ("m", "Small", 0.3, 4), ("m", "mid", 0.1, 2), ("m", "absent", 0.1, 9), ("n", "mid", 1.0, 3)]


def test_mix(spark):
    docs = corpus(spark, {"big_one": 2000, "small": 100, "mid": 300})
    targets = spark.createDataFrame(TARGETS, "mix_name string, source string, target_share double, max_repeats int")
    mix, report = mixing.mix_sources(docs, targets, {"small": [(0, 1.9), (1, 0.1)], "big_one": [(0, 0), (0.25, 0), (0.75, 1)]})
    chosen, rep = mix.collect(), {(r["mix_name"], r["source"]): r for r in report.collect()}
    caps = {("m", "big_one"): 1, ("m", "small"): 4, ("m", "mid"): 2, ("n", "mid"): 3}
    seen, times = collections.Counter(), collections.Counter()
    for r in chosen:
        assert 1 <= r["copy_no"] <= caps[r["mix_name"], r["source"]] and 0 <= r["position"] <= 1
        seen[r["mix_name"], r["source"]] += r["tokens"]
        times[r["mix_name"], r["doc_id"], r["copy_no"]] += 1
    assert max(times.values()) == 1
    total = sum(v for (m, _), v in seen.items() if m == "m")
    for s, share in (("big_one", 0.5), ("small", 0.3), ("mid", 0.1)):
        assert abs(seen["m", s] / total - share / 0.9) < 0.01
        assert math.isclose(rep["m", s]["actual_share"], seen["m", s] / total) and rep["m", s]["tokens"] == seen["m", s]
    assert rep["m", "absent"]["actual_share"] == 0 and rep["m", "absent"]["n_docs"] == 0
    # the one that is short is used in full
    assert rep["m", "small"]["n_copies"] == 400
    early = lambda s: sum(r["tokens"] for r in chosen if r["mix_name"] == "m" and r["source"] == s and r["position"] < 0.5) / seen["m", s]
    # by t = 1/2 the integrals are (1.9 + 1) / 4 of 1, and 1/16 of 1/2
    assert abs(early("small") - 0.725) < 0.03 and abs(early("big_one") - 0.125) < 0.03 and abs(early("mid") - 0.5) < 0.05
    assert min(r["position"] for r in chosen if r["mix_name"] == "m" and r["source"] == "big_one") > 0.25
    parts = mix.select("mix_name", "position", F.spark_partition_id().alias("p")).collect()
    order = sorted(parts, key=lambda r: r["p"])
    assert [(r["mix_name"], r["position"]) for r in order] == sorted((r["mix_name"], r["position"]) for r in parts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.sampled_from([0.0, 0.5, 1.0, 7.0])), min_size=1, max_size=5))
def test_schedules_integrate_to_one(points):
    if max(w for _, w in points) == 0:
        return
    try:
        pieces = mixing.schedule_segments(points)
    except ValueError:  # a weight of no length
        return
    assert math.isclose(sum(h * (v + w) / 2 for _, h, v, w, _ in pieces), 1) and pieces[0][0] == 0 and math.isclose(pieces[-1][0] + pieces[-1][1], 1)


def test_position_inverts_the_demand(spark):
    for points in ([(0, 1)], [(0, 0), (1, 2)], [(0.3, 2), (0.3, 0), (0.6, 0), (0.8, 5)], [(0, 3), (1, 0)]):
        pieces = mixing.schedule_segments(points)
        column = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(("start", "length", "first", "last", "before"), p)]) for p in pieces])
        got = spark.range(101).select((F.col("id") / 100).alias("f")).select("f", mixing.position(F.col("f"), column).alias("t")).collect()
        for f, t in got:
            done = sum(min(max(t - a, 0), h) * (v + v + (w - v) * min(max(t - a, 0), h) / h) / 2 for a, h, v, w, _ in pieces)
            assert 0 <= t <= 1 and abs(done - f) < 1e-7
    for wrong in ([], [(0, 0)], [(2, 1)], [(0, -1)]):
        with pytest.raises(ValueError):
            mixing.schedule_segments(wrong)


def test_mix_of_given_size_and_empty_inputs(spark):
    docs = corpus(spark, {"big_one": 500, "small": 20, "mid": 100})
    targets = spark.createDataFrame(TARGETS[:3], "mix_name string, source string, target_share double, max_repeats int")
    _, report = mixing.mix_sources(docs, targets, total_tokens=12_000)
    rep = {r["source"]: r for r in report.collect()}
    assert abs(sum(r["tokens"] for r in rep.values()) - 12_000) < 100
    assert rep["small"]["n_copies"] == 80 and rep["small"]["actual_share"] < 0.3
    assert abs(rep["big_one"]["tokens"] / rep["mid"]["tokens"] - 5) < 0.2
    for d, t in ((docs.where("false"), targets), (docs, targets.where("false"))):
        mix, report = mixing.mix_sources(d, t)
        assert mix.count() == 0 and report.where("n_copies > 0").count() == 0


def test_layout_covers_every_token_once(spark):
    sized = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("source"), (F.col("id") % 17 + 1).alias("tokens"))
    for s in ("hot", "cold"):
        spans = sorted((r["before"], r["tokens"]) for r in mixing.lay_out(sized, buckets=16).where(F.col("source") == s).collect())
        at = 0
        for b, t in spans:
            assert b == at
            at += t


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_with_sql(name, spark, data, duck):
    got = queries.QUERIES[name](spark, data)
    names, want = rows_sql(duck, queries.SQL[name])
    assert sorted(got.columns) == names and rows(got) == want


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_other_queries_run(name, spark, data):
    assert queries.QUERIES[name](spark, data).count() > 0


SCORES = "query_id long, row_id long, arm string, score double"


def combined(spark, rows, weights=None, **how):
    df = spark.createDataFrame(rows, SCORES).withColumn("combined", F.lit("clash")).withColumn("rank", F.lit(1))
    return [(r["row_id"], r["rank"]) for r in ranking.combine_scores(df, weights or {"a": 1.0, "b": 1.0}, **how).orderBy("query_id", "rank").collect()]


def test_no_arm_dominates_by_its_range(spark):
    a = [(1, i, "a", 1.0 - i / 10) for i in range(10)] + [(1, 50, "a", 5e6)]
    b = [(1, i, "b", 1000.0 - i) for i in range(10)] + [(1, 51, "b", -1e9)]
    assert [r for r, _ in combined(spark, a + b)][:5] == [0, 1, 2, 3, 4]


def test_missing_is_worse_than_the_worst(spark):
    rows = [(1, 1, "a", 0.9), (1, 2, "a", 0.9), (1, 3, "a", 0.9), (1, 1, "b", -5.0), (1, 4, "b", 3.0), (1, 5, "b", 3.1), (1, 6, "b", 3.2), (1, 2, "b", float("nan")), (1, 3, "b", None)]
    order = [r for r, _ in combined(spark, rows)]
    assert order.index(1) < order.index(2) < order.index(3)


def test_odd_scores(spark):
    rows = [
        (1, 1, "a", float("inf")), (1, 2, "a", 2.0), (1, 3, "a", 2.0), (1, 4, "a", float("-inf")), (1, 2, "a", 1.0), (2, 1, "a", 7.0), (3, 1, "c", 7.0), (None, 1, "a", 1.0), (4, None, "a", 1.0),
        (5, 1, "a", None),
    ]
    got = combined(spark, rows)
    assert got[:4] == [(1, 1), (2, 2), (3, 3), (4, 4)] and len(got) == 5
    assert combined(spark, [], top=5) == []


LANGUAGES = {
    "nl": "De eerste stap is het lezen van de handleiding. Daarna kunt u de instellingen van het systeem in het menu wijzigen, en als er iets fout gaat, wordt de oude versie hersteld.",
    "it": "Il primo passo è leggere il manuale. Poi si possono cambiare le impostazioni del sistema nel menu, e se qualcosa va storto la versione precedente viene ripristinata.",
    "fr": "La première étape consiste à lire le manuel. Ensuite, on peut modifier les paramètres du système dans le menu, et si une erreur se produit, l'ancienne version est restaurée.",
    "sv": "Det första steget är att läsa handboken. Sedan kan man ändra inställningarna i menyn, och om något går fel återställs den gamla versionen. Filen sparas i användarens mapp.",
    "es": "El primer paso es leer el manual. Después se pueden cambiar los ajustes del sistema en el menú, y si algo sale mal se restaura la versión anterior.",
    "ru": "Первый шаг заключается в том, чтобы прочитать руководство. Затем можно изменить настройки системы в меню.",
}
ENGLISH = [
    "The old man walked slowly along the beach every morning. His dog ran ahead, chasing gulls that always flew off before it reached them.",
    "Wash your hands, chop two onions and fry them gently in butter until they are golden brown. Then add the garlic to the pan.",
    "Localisation requires incremental thresholds. Please read the normalisation instructions before changing certificates and dashboards.",
]


@pytest.fixture(scope="module")
def levels(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = table(spark, d, "documents"), table(spark, d, "level_labels").where("reading_level is not null")
    held = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(4)) == 0
    grades = labels.where(held).groupBy("doc_id").agg(F.collect_list("reading_level").alias("l")).where("size(array_distinct(l)) = 1")
    cases = grades.join(docs.select("doc_id", "text"), "doc_id").orderBy("doc_id").collect()
    return docs, labels.where(~held), cases


def test_level_model_on_held_out_grades(levels):
    docs, labels, cases = levels
    model = reading.fit_levels(docs, labels)
    hits = model.score([r["text"] for r in cases]) == np.array([r["l"][0] for r in cases])
    assert len(hits) > 100 and hits.mean() >= 0.9
    assert hits[[len(r["l"]) > 1 for r in cases]].mean() >= 0.95
    # one text at a time gives what a batch gives
    assert [int(model.score([r["text"]])[0]) for r in cases[:50]] == model.score([r["text"] for r in cases[:50]]).tolist()
    assert not model.score([*LANGUAGES.values(), None, ""]).any() and model.score(ENGLISH).all()
    assert len(model.score([])) == 0


def test_the_texts_own_numbers_carry_the_levels(levels):
    docs, labels, cases = levels
    model = reading.fit_levels(docs, labels, use=slice(0, 9))
    hits = model.score([r["text"] for r in cases]) == np.array([r["l"][0] for r in cases])
    assert hits.mean() >= 0.8


def test_what_is_prose(levels):
    model = reading.fit_language(levels[0])
    english = "The setting controls how the queue works, and it is safe to change it."
    assert model.is_english(english) and model.is_english(english.upper()) and model.is_english("- " + english.replace(", ", ",\n"))
    assert model.is_english(f"# T\n\n```\n2025-01-01 10:00:00.1 INFO x id=1 took=3ms\n```\n{english}")
    assert model.is_english("Run the tool with the option --quick when you want to see it at once, and look at what it says.")
    for no in (
        None, "", "  \n", "2025-01-01 10:00:00.123 INFO a.b id=1 took=3ms\n" * 5, "| a_b | 3 | yes |\n" * 9, "lake a --b=1 --out data/a/b-1.parquet\n" * 5,
        "Der Vektorindex benötigt vor der nächsten Zusammenführung 68 Partitionen und ist nicht bereit.", "A equipe ainda não decidiu como apagar as linhas repetidas do arquivo.",
        "検索結果は距離の小さい順に並べます。バージョン0.28では既定値が変わりました。", "```\nthe is are was were be been\n```", "12:03:04 worker started now for you\n" * 3, "user=ann host=db1 state=open\n" * 9,
    ):
        assert not model.is_english(no), no
    for text in LANGUAGES.values():
        assert not model.is_english(text), text
    for text in ENGLISH:
        assert model.is_english(text), text


def test_language_without_labels():
    texts = ["The queue is full and you can see it in the log of the day."] * 5 + ["Die Warteschlange ist voll und steht im Protokoll des Tages."] * 5
    model = reading.LanguageModel.fit(texts, [None] * 10)
    assert model.is_english(texts[0]) and not model.is_english(texts[-1])
    assert reading.LanguageModel.fit(texts[5:], [None] * 5) is None and reading.LanguageModel.fit([], []) is None


def test_language_model_is_that_of_all_documents(levels):
    docs = levels[0]
    rows = docs.select("text", "lang").collect()
    assert len(rows) > 6000
    want = reading.LanguageModel.fit([r["text"] for r in rows], [r["lang"] for r in rows])
    for parts in (docs, docs.repartition(7)):
        got = reading.fit_language(parts)
        assert np.array_equal(got.grams, want.grams) and math.isclose(got.least, want.least, abs_tol=1e-9)


def test_level_model_is_that_of_all_grades(spark):
    letters = lambda i: "".join("abcdefghij"[int(c)] for c in str(i))
    texts = [f"You can see the {letters(i)} in the log, and it is {'easy' if i % 2 else 'intricate'} to change it." for i in range(4500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, "a", 1 if i % 2 else 4) for i in range(4500)] + [(0, "b", 3), (1, "b", None), (2, "b", 7)], "doc_id long, annotator string, reading_level int")
    apart = reading.take_apart(docs, more=())
    model = reading.fit_levels(docs, labels, apart=apart.withColumn("lang", F.transform("doc_id", lambda _: F.lit(None).cast("string"))))
    assert model.total.tolist() == [2250.5, 0.5, 1.0, 2250.0] and {letters(i) for i in range(4500)} <= set(model.number)
    assert model.counts[model.number["easy"]].tolist() == [2250, 0, 0, 0]
    got = {r["doc_id"]: r["reading_level"] for r in reading.reading_levels(docs, model, apart=apart).collect()}
    assert {i: v for i, v in got.items() if i} == {i: 1 if i % 2 else 4 for i in range(1, 4500)} and 0 in got  # graders differ on 0
    assert got == {r["doc_id"]: r["reading_level"] for r in reading.reading_levels(docs, model).collect()}


@pytest.mark.parametrize("most", [1, 20, 100_000])
def test_exact_quantile(spark, most):
    rng = np.random.default_rng(5)
    for v in (rng.normal(size=700), np.repeat(rng.normal(size=9), 50), np.r_[-9.0, np.full(60, 1.5), 1e6], np.array([3.0]), np.array([1.0, 2.0]), np.zeros(5)):
        df = spark.createDataFrame([(float(a),) for a in rng.permutation(v)], "v double").coalesce(2).cache()
        for q in (0.0, 0.002, 0.3, 0.998, 1.0):
            assert math.isclose(reading.exact_quantile(df, q, most), np.quantile(v, q), rel_tol=1e-12, abs_tol=1e-12)
    assert reading.exact_quantile(df.where("v > 5"), 0.5, most) is None


def test_word_rarity_counts_every_word(spark):
    docs = spark.createDataFrame([(1, "One two"), (2, "one three's"), (3, None), (4, "")], "doc_id long, text string")
    got = reading.word_rarity(docs)
    assert got[reading.word_bucket("one")] == np.float32(-np.log(2 / 3)) and got[reading.word_bucket("two")] == np.float32(-np.log(1 / 3))
    assert got[reading.word_bucket("unseen")] == np.float32(np.log(3) + 1)


def test_levels_without_grades(spark):
    docs = spark.createDataFrame([(1, "It is a big pile of cards and we see it."), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, annotator string, reading_level int")
    assert reading.fit_levels(docs, none) is None
    assert reading.reading_levels(docs, None).count() == 0
    assert reading.fit_levels(docs.where("false"), none.union(spark.createDataFrame([(1, "a", 2)], none.schema))) is None


def test_ordinal_regression_recovers_order():

    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    z = x @ np.array([2.0, -1.0, 0.0]) + rng.logistic(size=2000)
    y = np.eye(4)[np.digitize(z, [-2, 0, 2])]
    beta, cut = reading.fit_ordinal(x, y, np.ones(2000), 1.0)
    assert np.allclose(beta, [2, -1, 0], atol=0.25) and np.allclose(cut, [-2, 0, 2], atol=0.3)
    p = reading.level_shares(x, beta, cut)
    assert np.allclose(p.sum(1), 1) and (p >= 0).all()
