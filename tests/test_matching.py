"""Hand examples and a random comparison with a plain Python version of the assignment rules."""

import random

from graphloom.functions.similarity import jaccard
from graphloom.functions.text import tokens
from graphloom.operators import matching, metrics
from pyspark.sql import functions as F

SCORES = [("d", 0, 0, 0.9), ("d", 0, 1, 0.9), ("d", 1, 0, 0.8), ("d", 1, 1, 0.3), ("d", 2, 1, 0.1)]
SCHEMA = "key string, i int, j int, score double"


def pairs(df):
    return sorted((r.i, r.j) for r in df.collect())


def test_greedy_takes_best_pairs_once(spark):
    assert pairs(matching.greedy(spark.createDataFrame(SCORES, SCHEMA), "key", 0.2)) == [(0, 0), (1, 1)]


def test_gold_only_uses_each_gold_once(spark):
    found = matching.gold_only(spark.createDataFrame(SCORES, SCHEMA), "key", 0.2)
    assert sorted(r.j for r in found.collect()) == [0, 1]


def test_soft_triples_share_the_separator(spark):
    row = spark.range(1).select(matching.triple_text(F.lit("a"), F.lit("b")).alias("x"), matching.triple_text(F.lit("c"), F.lit("d")).alias("y"))
    assert row.select(jaccard(tokens(F.col("x")), tokens(F.col("y")))).first()[0] == 0.2


def test_empty_texts_are_equal_and_one_empty_is_not(spark):
    row = spark.range(1).select(tokens(F.lit("--")).alias("a"), tokens(F.lit("!")).alias("b"), tokens(F.lit("x")).alias("c"))
    assert tuple(row.select(jaccard(F.col("a"), F.col("b")), jaccard(F.col("a"), F.col("c"))).first()) == (1.0, 0.0)


def test_folds_equal_a_plain_version(spark):
    rng = random.Random(3)
    rows = [(f"d{d}", i, j, rng.choice([0.1, 0.2, 0.5, 0.5, 0.9])) for d in range(20) for i in range(rng.randint(1, 5)) for j in range(rng.randint(1, 5))]

    def plain(order):
        out = []
        for key in {r[0] for r in rows}:
            used_i, used_j = set(), set()
            for k, i, j, s in sorted((r for r in rows if r[0] == key and r[3] >= 0.2), key=order):
                if i not in used_i and j not in used_j:
                    used_i.add(i), used_j.add(j), out.append((k, i, j))
        return sorted(out)

    df = spark.createDataFrame(rows, SCHEMA)
    got = lambda f: sorted((r.key, r.i, r.j) for r in f(df, "key", 0.2).collect())
    assert got(matching.greedy) == plain(lambda r: (-r[3], r[1], r[2]))
    assert got(matching.first_fit) == plain(lambda r: (r[1], r[2]))


def test_judge_answers_out_of_range_are_dropped(spark):
    rows = [("d", 2, 2, 'ok [{"pred": 1, "gold": 2}, {"pred": 3, "gold": 1}] and [x]'), ("e", 1, 1, "nothing")]
    got = matching.judged_pairs(spark.createDataFrame(rows, "key string, n int, m int, response string"), "key", "n", "m")
    assert [(r.key, r.i, r.j) for r in got.collect()] == [("d", 0, 1)]


def test_worked_metric_example_and_zero_counts(spark):
    rows = [("a", 3, 4, 6), ("b", 0, 0, 5)]
    got = {r.k: r for r in metrics.with_prf(spark.createDataFrame(rows, "k string, tp int, predicted int, gold int")).collect()}
    assert (got["a"].precision, got["a"].recall, round(got["a"].f1, 10)) == (0.75, 0.5, 0.6)
    assert (got["b"].precision, got["b"].recall, got["b"].f1) == (0.0, 0.0, 0.0)
    none = metrics.with_prf(spark.createDataFrame([(0, 0, 3)], "tp int, predicted int, gold int"), none=1.0).first()
    assert (none.precision, none.recall, none.f1) == (1.0, 0.0, 0.0)


def test_texts_without_tokens_meet(spark, tmp_path):
    from graphloom.plans.similarity import token_jaccard_join

    rows = [(1, "", "en"), (2, "!!! ...", "en"), (3, "", "de"), (4, "word", "en"), (5, None, "en"), (6, "Word.", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(tuple(r) for r in token_jaccard_join(spark, str(tmp_path)).collect()) == [(1, 2, 1.0), (4, 6, 1.0)]


def test_families_of_copies_are_compared_once(spark, tmp_path, monkeypatch):
    """Before, each two copies were a candidate whose tokens were joined; their documents still pair all."""
    from graphloom.operators import search
    from graphloom.plans.similarity import token_jaccard_join

    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdefghijkl") for _ in range(14)) for _ in range(60)]
    rows = [(i, t, "ende"[i % 2 * 2 :][:2]) for i, t in enumerate(texts + texts[:30] + [x + " new" for x in texts[:30]])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    compared, own = [], search.prefixes
    monkeypatch.setattr(search, "prefixes", lambda d, *rest: compared.append(d.count()) or own(d, *rest))
    got = sorted(tuple(r) for r in token_jaccard_join(spark, str(tmp_path)).collect())
    sets = [(i, set(t.split()), lang) for i, t, lang in rows]
    score = lambda a, b: len(a & b) / len(a | b)
    want = [(i, j, round(score(a, b), 6)) for i, a, m in sets for j, b, n in sets if i < j and m == n and score(a, b) >= 0.8]
    assert got == sorted(want) and compared == [len({(frozenset(a), m) for _, a, m in sets})]
