import random

import numpy as np
import pytest

from axisframe.llm import spans as S


def plain(docs, span=120):
    """Every window of every text, by definition."""
    seen = {}
    for d, t in docs:
        for i in range(len(t) - span + 1):
            seen.setdefault(t[i : i + span], set()).add(d)
    out = {}
    for d, t in docs:
        cover = np.zeros(len(t) + 1, int)
        for i in range(len(t) - span + 1):
            if len(seen[t[i : i + span]]) > 1:
                cover[i : i + span] = 1
        if cover.sum():
            out[d] = int(cover.sum())
    return out


def corpus(seed):
    draw = random.Random(seed)
    words = ["".join(draw.choice("abcdeéß漢") for _ in range(draw.randrange(1, 9))) for _ in range(60)]
    text = lambda n: " ".join(draw.choice(words) for _ in range(n)).replace(" ", "\n", n // 30)
    solid = "".join(draw.choice("xyz") for _ in range(900))  # no blanks at all
    passages = [text(60), text(25), text(140), solid, solid[300:520], "ab" * 200, text(19)[:121]]
    docs = []
    for i in range(60):
        parts = [text(draw.randrange(5, 60))]
        for _ in range(draw.randrange(3)):
            p = draw.choice(passages)
            a = draw.randrange(0, max(1, len(p) // 2))
            parts += [p[a : a + draw.randrange(60, len(p) + 60)], text(draw.randrange(1, 30))]
        docs.append((i, "".join(parts) if i % 4 else " ".join(parts)))
    docs += [(100, docs[3][1]), (101, docs[3][1]), (102, docs[5][1][:119]), (103, ""), (105, " " * 400), (106, " " * 300 + "q")]
    return docs


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_all_windows(spark, seed):
    docs = corpus(seed)
    rows = [(d, t, "x", "y") for d, t in docs] + [(104, None, "x", "y"), (None, docs[3][1], "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, h string, at string")
    got = {r.doc_id: r.shared_chars for r in S.shared_characters(df).collect()}
    assert got == plain(docs)


def test_long_text_and_empty_table(spark):
    draw = random.Random(9)
    long = " ".join(str(draw.random()) for _ in range(40_000))
    df = spark.createDataFrame([(1, long), (2, "z " + long[200_000:200_500] + " z")], "doc_id long, text string")
    assert {r.doc_id: r.shared_chars for r in S.shared_characters(df).collect()} in ({1: 500, 2: 500}, {1: 501, 2: 501}, {1: 502, 2: 502})
    assert S.shared_characters(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        S.shared_characters(df, span=50)


def test_kept_kmers_are_local():
    """Every stretch of SPAN characters keeps the same k-mers, whatever stands around it, and at least one."""
    draw = random.Random(4)
    for _ in range(80):
        core = "".join(draw.choice("ab c  defgh漢") if draw.random() < 0.5 else draw.choice("ijklmnop") for _ in range(S.SPAN))
        found = []
        for _ in range(2):
            left = "".join(draw.choice("ab cdq") for _ in range(draw.randrange(200)))
            t = S.Texts(["pad", left + core + "".join(draw.choice("xy z") for _ in range(150))])
            at, h = t.kept()
            at = at - 3 - len(left)
            inside = (at >= 0) & (at + S.KMER <= S.SPAN)
            found.append(set(zip(at[inside].tolist(), h[inside].tolist())))
        assert found[0] & found[1]


def test_paths_are_compacted(spark):
    # Two documents run along a b c d e, a third leaves after c: a-b-c and d-e are paths.
    runs = {1: [1, 2, 3, 4, 5], 2: [1, 2, 3, 4, 5], 3: [1, 2, 3, 9], 4: [9, 8], 5: [9, 8]}
    rows = [(d, i, i * 10, h, 1 + h % 2) for d, hs in runs.items() for i, h in enumerate(hs)]
    heads = {r.h: r.head for r in S.compact(spark.createDataFrame(rows, "doc long, ordinal int, at int, h long, ways int")).collect()}
    assert heads[1] == heads[2] == heads[3] and heads[4] == heads[5] != heads[1]
    assert heads[9] == heads[8] != heads[4]
    # A closed path ends too.
    loop = [(d, i, i, 1 + i % 3, 1) for d in (1, 2) for i in range(9)]
    assert S.compact(spark.createDataFrame(loop, "doc long, ordinal int, at int, h long, ways int")).count() == 3


def test_hashes_decide_nothing(spark):
    """With few bits nearly all windows collide; texts are compared, so the result is the same."""
    docs = corpus(2)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = plain(docs)
    for seed, bits in ((5, 64), (0, 10)):
        rows = S.shared_stretches(df, "doc_id", "text", seed=seed, bits=bits).collect()
        got = {}
        for r in rows:
            got[r.doc] = got.get(r.doc, 0) + r.last - r.first + 1
        assert got == want


def test_texts_that_collide(spark):
    """A sequence and its complement have one polynomial hash modulo 2^64 at this length, whatever the base."""
    morse = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = morse.translate(str.maketrans("ab", "ba"))
    t = S.Texts([morse, other])
    assert len(set(t.hashes(t.starts[:2], 1024).tolist())) == 1
    found = spark.createDataFrame([(1, 0, 2, 0), (2, 0, 1, 0)], "doc long, at int, pdoc long, pat int")
    docs = spark.createDataFrame([(1, morse), (2, other)], "doc long, text string")
    assert S.unequal(docs, S.cut(found), 1024)
    assert not S.unequal(docs.withColumn("text", S.F.lit(morse)), S.cut(found), 1024)
    df = docs.withColumnRenamed("doc", "doc_id")
    assert S.shared_characters(df, span=1024).count() == 0


def test_popular_passages_are_split(spark):
    """Rows of a key that most documents share are met in parts, and each row still meets its key once."""
    rows = S.cut(spark.range(60_000).selectExpr("id as doc", "cast(id % 7 as int) as at", "case when id % 3 < 2 then 1 else id end as h").unionByName(spark.range(60_000).selectExpr("id + 1 as doc", "cast(0 as int) as at", "case when id % 3 < 2 then 2 else id end as h")))
    keys = S.shared_keys(rows, "h")
    ways = {r.h: r.ways for r in keys.where("ways > 1").collect()}
    assert set(ways) == {1, 2} and min(ways.values()) >= 4
    joined = S.split_join(rows, keys, "h")
    assert joined.where("h <= 2").count() == 80_002 and joined.count() == rows.join(keys, "h").count()
    assert S.split_join(rows, keys, "h", "left").count() == rows.count()
