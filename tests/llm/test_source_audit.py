"""The divergence audit beside a plain Python version."""

import re
from collections import Counter

import pytest

from caseloom.llm import source_audit
from caseloom.llm.source_audit import divergence_audit, pair_divergence, run_length_columns, share, shares, terms_of, vocabulary

SCHEMA = "doc_id bigint, text string, lang string, source string"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain_audit(rows, min_docs, top):
    docs = [(lang or "", source or "", TERM.findall(lowered(text or ""))) for _, text, lang, source in rows]
    result = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        frequency = Counter(t for _, _, terms in own for t in set(terms))
        kept = [t for t, n in frequency.items() if n >= min_docs]
        counts = {s: Counter() for s in {d[1] for d in own}}
        for _, source, terms in own:
            counts[source].update(t for t in terms if t in set(kept))
        every = sum(counts.values(), Counter())

        def p(counter):
            whole = sum(counter.values()) + 2 * len(kept)
            return {t: 1 + 10**9 * (counter[t] + 2) // whole for t in kept}

        def f(x, y):
            return (x - y) ** 2 // (x + y)

        by_source, q = {s: p(c) for s, c in counts.items()}, p(every)
        for s, own_p in by_source.items():
            pairs = [(o, sum(f(own_p[t], other[t]) for t in kept)) for o, other in by_source.items() if o != s]
            terms = [(t, f(own_p[t], q[t])) for t in kept if counts[s][t] and own_p[t] > q[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                ordered = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                result += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(ordered, 1)]
    return sorted(result)


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.fixture
def rows():
    import random

    pick = random.Random(4)
    words = ["alpha", "Beta", "gämma", "delta", "été", "zz", "ÉTÉ", "x", "word", "日本"]
    made = []
    for k in range(150):
        lang = pick.choice(["en", "en", "de", None, ""])
        text = " ".join(pick.choice(words[: 3 + k % 8]) for _ in range(pick.randint(0, 25)))
        made.append((k, text, lang, pick.choice(["a", "b", "c", "é", None])))
    return made + [(900, None, "en", "only null"), (901, "1234 ,;", "xx", "lone"), (902, "", "yy", "p"), (903, "q", "yy", "r")] + made[:20]


def test_same_as_plain_version(frame, rows):
    df = frame(rows, SCHEMA)
    assert found(divergence_audit(df, min_docs=6, top=4)) == plain_audit(rows, 6, 4)


def test_many_segments_and_source_blocks(frame, rows, monkeypatch):
    monkeypatch.setattr(source_audit, "SOURCE_BLOCK", 2)
    df = frame(rows, SCHEMA)
    assert found(divergence_audit(df, min_docs=3, top=10, cells=4)) == plain_audit(rows, 3, 10)


def test_clashing_columns_and_empty_tables(spark, rows):
    clashing = ["term", "n", "docs", "total", "rank", "part", "value", "_segment", "size", "item"]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("other") for c in clashing})
    assert found(divergence_audit(df, min_docs=6)) == plain_audit(rows, 6, 10)
    assert found(divergence_audit(df.limit(0))) == []
    # No language has a term in ten documents: all pairs with 0.
    few = [(1, "a b", "en", "s"), (2, "c", "en", "t")]
    assert found(divergence_audit(spark.createDataFrame(few, SCHEMA))) == [("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]


def test_long_texts_are_read_whole(frame, monkeypatch):
    monkeypatch.setattr(source_audit, "PIECE", 7)
    text = "Abc déf" * 50 + " " + "x" * 100
    assert [t.decode() for part in terms_of(text.encode()) for t in part] == TERM.findall(lowered(text))
    monkeypatch.setattr(source_audit, "REMEMBERED", 5)
    rows = [(k, ("word%s " % "abcdef"[k % 6]) * 3000, "en", "st"[k % 2]) for k in range(30)]
    assert found(divergence_audit(frame(rows, SCHEMA), min_docs=2)) == plain_audit(rows, 2, 10)


def test_runs_are_few_and_cover_the_vocabulary(frame, rows):
    vocab = vocabulary(frame(rows, SCHEMA), min_docs=3)
    sizes = {(r["lang"], str(r["_segment"])): r["size"] for r in vocab.segments.collect()}
    columns = run_length_columns(vocab.entries).collect()
    assert columns
    for r in columns:
        assert r["ends"][-1] == sizes[r["lang"], str(r["_segment"])]
        assert all(x < y for x, y in zip(r["ends"], r["ends"][1:]))
        assert all(x != y for x, y in zip(r["counts"], r["counts"][1:]))
    assert pair_divergence(vocab).count()


def test_shares_do_not_overflow(spark):
    import numpy as np
    from pyspark.sql import functions as F

    cases = [(0, 0, 1), (5, 100, 7), (2 * 10**14, 2 * 10**14 + 5, 10**9), (10**10, 3 * 10**10, 10**7)]
    df = spark.createDataFrame(cases, "n bigint, total bigint, v bigint")
    got = [r[0] for r in df.select(share(F.col("n"), F.col("total"), F.col("v"))).collect()]
    expected = [1 + 10**9 * (n + 2) // (total + 2 * v) for n, total, v in cases]
    assert got == expected
    assert [int(shares(np.array([n]), t, v)[0]) for n, t, v in cases] == expected
