"""The pipeline's stages on the smallest tables, each held against a plain version on its own input."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_operators import PATH, SF, base_spans, brute_classes, check_packing, repeated_windows

from polarframe.llm import toxicity
from polarframe.llm.shared import stored
from polarframe.llm.tokens import encode


@pytest.fixture(scope="module")
def stages(spark):
    """What goes into each stage and comes out, with a null in every column, a null id and clashing columns."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, "no id " * 60, None, None, None), (10_000, None, None, "src0", 0), (10_001, "", "en", None, None)], docs.schema)
    docs = docs.unionByName(odd).withColumns({c: F.lit(c) for c in ("row", "spans", "toxic", "piece", "cluster", "_n")})
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], SF), name))
    return out


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_columns_stay(stages):
    assert all(s.columns == stages[0].columns for s in stages[1:-1])


def test_toxicity(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", (1 - F.col("quality")).alias("junk"), F.col("toxic").alias("toxicity"))
    scored = toxicity.fit_chain(stages[0], labels, ["junk", "toxicity"]).score(stages[0])
    assert Counter(pairs(stages[1])) == Counter((r.doc_id, r.text) for r in scored.where("not toxic").collect())


def test_one_of_each_group_stays(stages):
    rows = pairs(stages[1])
    want = {d for d, n, c in brute_classes(rows, 5, 80) if not n or d is None or d == c}
    assert Counter(pairs(stages[2])) == Counter((d, t) for d, t in rows if d in want)


def test_repeated_passages_go(stages):
    before, after = dict(pairs(stages[2])), dict(pairs(stages[3]))
    assert before.keys() == after.keys()
    repeats = repeated_windows({d: t for d, t in before.items() if d is not None})
    assert not repeated_windows({d: t for d, t in after.items() if d is not None})
    assert all(after[d] != before[d] for d in repeats) and after[None] == before[None]
    assert sum(after[d] != before[d] for d in before) <= len(repeats) + 5


def test_personal_data_goes(stages):
    before, after = dict(pairs(stages[3])), dict(pairs(stages[4]))
    assert before.keys() == after.keys()
    for d, text in before.items():
        assert not base_spans(after[d] or "")
        if not base_spans(text or "") and "@" not in (text or "") and not any(c.isdigit() for c in text or ""):
            assert after[d] == text


def test_packing_of_what_is_left(stages):
    ids = {d: encode(PATH, t).tolist() + [2] for d, t in pairs(stages[4])}
    check_packing(stages[5].collect(), ids, 1024)


def test_rows_that_repeat(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "A b c d e f g"), (3, None), (3, None)], "doc_id long, text string")
    kept = corpus_pipeline.one_of_each(spark, docs, SF)
    assert Counter(pairs(kept)) == Counter({(1, "a b c d e f g"): 1, (3, None): 2})
    assert corpus_pipeline.one_of_each(spark, docs.limit(0), SF).count() == 0
