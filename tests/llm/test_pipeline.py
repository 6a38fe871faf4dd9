"""The stages of the corpus pipeline, each against plain Python on its own input."""

from collections import Counter

import corpus_pipeline
from test_text_operators import DOCS, WORD, check_packing, groups_by_hand, lines_by_hand
from tickweave.llm import mixing
from tickweave.llm.common import written

SF_DIR = "/root/testdata/sf0.001"


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text", "source").collect()]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    extra = spark.createDataFrame([(9001, None, "en", "src0", 0), (9002, "12 34 !", "en", "src1", 7)], DOCS)
    docs = written(docs.unionByName(extra), "start")
    before, columns = rows(docs), docs.columns
    for (name, stage), after in zip(corpus_pipeline.STAGES, corpus_pipeline.STAGES[1:]):
        docs = written(stage(spark, docs, SF_DIR), name)
        now = rows(docs)
        assert docs.columns == columns and now
        if name == "language_id":
            assert {9001, 9002} == {r[0] for r in before} - {r[0] for r in now}
        elif name == "line_dedup":
            want = lines_by_hand(before)
            assert {r[0]: r[1] for r in now} == {d: t for d, t in want.items() if t.strip() or t == dict(r[:2] for r in before)[d]}
        elif name == "near_duplicates":
            want = [d for d, _, c in groups_by_hand([r[:2] for r in before], 5, 80) if d == c]
            assert sorted(r[0] for r in now) == sorted(want)
        elif name == "mixing":
            assert max(Counter(r[0] for r in now).values()) <= mixing.MOST_EPOCHS
            words = [sum(len(WORD.findall(r[1])) for r in part) for part in (before, now)]
            assert abs(words[0] - words[1]) < 0.25 * words[0]
        before = now
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).collect()
    check_packing([r[:2] for r in before], packed)
