import numpy as np
from pyspark.sql import functions as F

from tonelake.llm.quality import Rules, fit_quality, fit_rules, score_quality, statistics


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1


def tables(spark, prose, n=600):
    junk = [lambda i: "same same " * 40, lambda i: prose(i, 60).upper() + "!!", lambda i: "### ".join(prose(i, 60).split()), lambda i: " | ".join(prose(i, 60).split())]
    rows = [(i, junk[i // 4 % 4](i) if i % 4 == 0 else ". ".join(prose(i + k, 12).capitalize() for k in range(6)) + ".", int(i % 4 != 0)) for i in range(n)]
    return spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")


def test_held_out_accuracy(spark, prose):
    docs, labels = tables(spark, prose)
    rules = fit_quality(docs, labels, held_out())
    assert 0 < len(rules.rules) < 200
    got = score_quality(docs, rules).join(labels, "doc_id").filter(held_out())
    right = got.filter((F.col("score") >= 0.5).cast("int") == F.col("quality")).count()
    assert right >= 0.97 * got.count() > 0
    # the compiled expression is the rules
    stats = statistics(docs["text"])
    x = docs.select(*[v.alias(n) for n, v in stats.items()], rules.column(stats).alias("s")).toPandas()
    assert np.allclose(rules.score(x[list(stats)].to_numpy(), list(stats)), x["s"])


def test_odd_rows(spark, clashing):
    rules = Rules(0.5, (((("upper", True, 0.3),), -2.0),))
    got = {r.doc_id: r.score for r in score_quality(clashing([(1, None), (2, ""), (None, "X"), (3, "é " * 50_000)]), rules).collect()}
    assert got[1] == got[2] == got[3] and got[None] < 0.5
    assert score_quality(clashing([]), rules).count() == 0


def test_one_label_or_none():
    assert fit_rules(np.zeros((5, 2)), np.ones(5), ["a", "b"]).rules == ()
    assert 0 < fit_rules(np.zeros((0, 2)), np.zeros(0), ["a", "b"]).score(np.zeros((1, 2)), ["a", "b"])[0] < 1


def test_fit_without_rows(spark, clashing, prose):
    docs, labels = tables(spark, prose, 12)
    assert fit_quality(docs, labels.limit(0), held_out()).rules == ()
    assert fit_quality(clashing([]), labels, held_out()).rules == ()
