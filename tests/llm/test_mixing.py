import math
import os

import pytest

from axisframe.llm.mixing import budgets, draw, mixture
from axisframe.llm.tokenizer import VOCABULARY

SIZED = "doc_id long, source string, weight double, n_tokens long"


def plain(rows, targets, keys):
    """The definition, source by source."""
    total = sum(r[3] for r in rows if r[1] in targets)
    out = {}
    for source, (share, cap) in targets.items():
        own = sorted((keys[r[0]], r[0], r[3]) for r in rows if r[1] == source)
        have, budget = sum(r[2] for r in own), total * share
        epochs = min(cap, math.floor(budget / have)) if have else 0
        rest, run = (budget - epochs * have if epochs < cap else 0.0), 0
        for _, doc, n in own:
            extra = int(run + n / 2 < rest)
            run += n
            if epochs + extra:
                out[doc] = epochs + extra
    return out


def test_against_definition(spark):
    from pyspark.sql import functions as F

    from axisframe.llm.mixing import sampling_key

    rows = [(i, "abc"[i % 7 % 3], 0.1 + (i % 5) / 5, 1 + i * 37 % 91) for i in range(3000)] + [(9000, None, 0.5, 10), (9001, "z", 0.5, 10)]
    targets = {"a": (0.2, 1), "b": (0.5, 3), "c": (0.2, 5), "none": (0.1, 2)}
    sized = spark.createDataFrame(rows, SIZED)
    keys = {r.doc_id: r.key for r in sized.select("doc_id", sampling_key("doc_id", F.col("weight"), 3).alias("key")).collect()}
    plan = budgets(sized, spark.createDataFrame([(s, *t) for s, t in targets.items()], "source string, target_share double, max_repeats int"))
    got = {r.doc_id: r.n_times for r in draw(sized, plan, 3).collect()}
    assert got == plain(rows, targets, keys)
    assert draw(sized.limit(0), plan, 3).count() == 0


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")
def test_report(spark):
    box = [(0, 0, 1, 1, 0.9)]
    rows = [(i, "word " * (i % 9), "ab"[i % 2], box, "clash") for i in range(200)] + [(300, None, "a", [], None), (301, "x", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, boxes array<struct<x0:int,y0:int,x1:int,y1:int,conf:float>>, key string")
    targets = spark.createDataFrame([("a", 0.75, 1), ("b", 0.25, 4), ("c", 0.0, 1)], "source string, target_share double, max_repeats int")
    drawn, report = mixture(docs, targets)
    shares = {r.source: r for r in report.collect()}
    assert shares["a"].tokens == shares["a"].available and shares["a"].most_repeats == 1
    assert abs(shares["b"].tokens - shares["b"].budget) <= 9 and shares["c"].tokens == 0
    assert abs(sum(r.actual_share for r in shares.values()) - 1) < 1e-9
    assert 300 not in {r.doc_id for r in drawn.collect()}
