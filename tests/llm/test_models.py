"""Language ID and toxicity against plain versions that share no code with them, and on odd rows."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from clausewright.llm import language_id, queries, toxicity


# --- maximal segments ------------------------------------------------------------------------------------------------
def brute_segments(scores):
    """The best segment (the shortest and first of equals), then the same left and right of it."""

    def best(low, high):
        found = max(((sum(scores[a:b]), -(b - a), -a) for a in range(low, high) for b in range(a + 1, high + 1)), default=(0, 0, 0))
        if found[0] <= 0:
            return []
        a, b = -found[2], -found[2] - found[1]
        return [*best(low, a), (a, b - 1, found[0]), *best(b, high)]

    return best(0, len(scores))


@pytest.mark.parametrize("seed", range(60))
def test_all_maximal_segments(seed):
    rnd = random.Random(seed)
    # odd multiples of 1/1024 rule out ties between segments
    scores = [(rnd.randrange(1, 4096, 2) / 1024 + 2 ** -rnd.randint(20, 40)) if rnd.random() < 0.4 else -toxicity.DRIFT for _ in range(rnd.randint(1, 24))]
    at = [i for i, s in enumerate(scores) if s > 0]
    got = toxicity.maximal_segments(at, [scores[i] for i in at])
    want = brute_segments(scores)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(abs(g[2] - w[2]) < 1e-9 for g, w in zip(got, want))


def test_segments_take_linear_time():
    def seconds(n):
        began = time.perf_counter()
        toxicity.maximal_segments(list(range(0, 40 * n, 40)), [1.0] * n)
        return time.perf_counter() - began

    def least(n):  # one run may be held up by the machine
        return min(seconds(n) for _ in range(5))

    assert least(64_000) < 40 * max(least(4_000), 2e-3)


def test_likeliest_k():
    n, best = [100.0] * 5, [0.0, 1.0, 2.0, 0.5, 0.0]
    law = lambda k: sum(math.log(k) - k * m * math.exp(-1.5 * s) for m, s in zip(n, best))
    import numpy as np

    k = toxicity.likeliest_k(np.array(n), np.array(best), 1.5)
    assert law(k) > max(law(k * 1.05), law(k / 1.05))


# --- toxicity --------------------------------------------------------------------------------------------------------
def toxic_rows(n):
    rnd = random.Random(8)
    usual = ["".join(rnd.choice("bcdfglmn") + rnd.choice("aeiou") for _ in range(rnd.randint(1, 4))) for _ in range(500)]
    bad = ["zorkish", "grubwit", "vexling", "snarbag"]
    rows = []
    for i in range(n):
        words = [rnd.choice(usual) for _ in range(rnd.randint(5, 60))]
        toxic = i % 5 == 0
        if toxic:
            at = rnd.randrange(len(words))
            words[at:at] = [rnd.choice(bad) for _ in range(rnd.randint(2, 6))]
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = toxic_rows(900)
    docs = spark.createDataFrame([(i, t, "old", 0.5) for i, t, _ in rows] + [(5000, None, "old", 0.5), (5001, "", "old", 0.5), (None, "gone zorkish grubwit zorkish", "old", 0.5), (5002, "da " * 300_000 + "zorkish grubwit vexling snarbag zorkish", "old", 0.5)], "doc_id long, text string, toxicity string, score double")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows if i % 3] + [(1, None), (None, 1)], "doc_id long, toxic int")
    # a row that occurs often trains once
    model = toxicity.fit(toxicity.labelled_sample(docs.union(docs.where("doc_id = 1")).union(docs.where("doc_id = 1")), labels))
    got = toxicity.score(docs, model, passages=True)
    assert got.columns == ["doc_id", "text", "score", "toxicity", "passages"]  # the clashing column gave way
    found = {r.doc_id: r for r in got.collect()}
    held = [(i, x) for i, _, x in rows if i % 3 == 0]
    hit = sum(found[i].toxicity >= 0.7 for i, x in held if x)
    assert hit >= 0.9 * sum(x for _, x in held) and sum(found[i].toxicity >= 0.7 for i, x in held if not x) <= 2
    assert found[5000].toxicity == found[5001].toxicity < 0.5 and found[None].toxicity >= 0.7 and found[5002].toxicity >= 0.7
    span = found[5002].passages[0]
    assert "zorkish" in ("da " * 300_000 + "zorkish grubwit vexling snarbag zorkish")[span.low : span.high]
    kept = toxicity.drop_toxic(docs, model, 0.7)
    assert kept.columns == docs.columns and kept.count() == sum(r.toxicity < 0.7 for r in got.collect())


def test_lexicon_by_hand(spark):
    """Scores of words as a plain count gives them: log-odds with the two priors, less a standard error and the drift."""
    rows = [(0, "bad", 1), (1, "bad", 1), (2, "bad fine", 1), (3, "fine", 0), (4, "fine", 0), (5, "fine", 0), (6, "x", 0), (7, "y", 0)]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    q, kappa = 3.5 / 9, 5.0
    centre = (3 + kappa * q) / (3 + kappa)
    a, b = 3 + kappa * centre, kappa * (1 - centre)
    want = math.log(a / b) - math.log(q / (1 - q)) - math.sqrt(1 / a + 1 / b) - toxicity.DRIFT
    assert any(abs(s - want) < 1e-9 for s in model.lexicon.scores)


# --- language ---------------------------------------------------------------------------------------------------------
def plain_shares(texts, model_texts, least=2, dominance=0.2):
    """Share of each text's n-grams that each language has, with sets in place of filters."""

    def grams(text):
        letters = "".join(c.lower()[0] if c.isalpha() else " " for c in text)
        line = " " + " ".join(letters.split()) + " "
        return {n: [line[k : k + n] for k in range(len(line) - n + 1)] for n in (3, 4)} if line.strip() else {3: [], 4: []}

    rates = {}
    for lang, of in model_texts.items():
        seen = {}
        for t in of:
            for g in {(n, x) for n, found in grams(t).items() for x in found}:
                seen[g] = seen.get(g, 0) + 1
        rates[lang] = {g: (c / len(of), c) for g, c in seen.items()}
    best = {}
    for of in rates.values():
        for g, (r, _) in of.items():
            best[g] = max(best.get(g, 0), r)
    sets = {lang: {g for g, (r, c) in of.items() if c >= least and r >= dominance * best[g]} for lang, of in rates.items()}
    out = []
    for t in texts:
        all_of = [(n, x) for n, found in grams(t).items() for x in found]
        out.append({lang: sum(g in s for g in all_of) / max(1, len(all_of)) for lang, s in sets.items()})
    return out


def language_rows(n):
    rnd = random.Random(5)
    kinds = {"aa": ["ba", "be", "lo", "mi"], "bb": ["str", "ich", "ung", "gen"], "cc": ["éa", "ñu", "çô", "zé"]}
    return [(i, " ".join("".join(rnd.choice(kinds[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(5, 60))), lang) for i in range(n) for lang in [list(kinds)[i % 3]]]


def test_language_equals_plain_sets(spark):
    rows = language_rows(240)
    model = language_id.fit(spark.createDataFrame(rows[:180], "doc_id long, text string, lang string"))
    docs = spark.createDataFrame([(i, t, "clash", 1.0) for i, t, _ in rows[180:]], "doc_id long, text string, lang_pred string, known double")
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    of = {lang: [t for _, t, x in rows[:180] if x == lang] for lang in ("aa", "bb", "cc")}
    for (i, _, lang), share in zip(rows[180:], plain_shares([t for _, t, _ in rows[180:]], of)):
        best = max(share, key=share.get)
        assert got[i].lang_pred == best == lang
        assert abs(got[i].known - share[best]) < 0.02 and abs(got[i].score - share[best] / sum(share.values())) < 0.02


def test_texts_without_letters(spark):
    model = language_id.fit(spark.createDataFrame(language_rows(90), "doc_id long, text string, lang string"))
    odd = [None, "", "  \n", "123 !?", "🙂🙂", "𝟙𝟚", "①²", "́"]
    letters = ["a", "𝐚𝐛𝐜 𝐛𝐚", "漢字", "𠀀", "🙂 ba be lo"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(odd + letters)], "doc_id long, text string")
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    assert [(got[i].lang_pred, got[i].score) for i in range(len(odd))] == [("und", 0.0)] * len(odd)
    assert all(got[len(odd) + k].lang_pred in ("aa", "bb", "cc") for k in range(len(letters)))
    assert {r.doc_id for r in language_id.drop_unknown(docs, model, 0.0).collect()} == {len(odd) + k for k in range(len(letters))}


def test_held_out_of_null_ids(spark, tmp_path):
    rows = language_rows(120) + [(None, "ba be lo mi", "aa"), (None, None, None), (7, "ba be", "aa")]
    spark.createDataFrame([(i, t, x, "s", 1) for i, t, x in rows], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op3_language_id(spark, str(tmp_path))
    assert got.count() == len(rows) and got.where("held_out is null or lang_pred is null or score is null").count() == 0
    assert got.where("doc_id is null").agg(F.bool_or("held_out")).first()[0] is False
