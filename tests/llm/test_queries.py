"""The registered queries: against their SQL where there is one, and the pipeline's stages one by one."""

import os

import pytest

from gridlore.llm import jaccard, packing, quality, registry, winnow
from gridlore.llm.common import stash, table
from oracle import same

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, name):
    same(registry.QUERIES[name](spark, SF), registry.ORACLE_SQL[name], SF)


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))


def test_pipeline(spark):
    import corpus_pipeline as C
    from edge import docs, empty

    held = table(spark, SF, "documents")
    for name, stage in C.STAGES:
        before, held = held, stash(stage(spark, held, SF), name)
        ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
        assert ids(held) <= ids(before)
        if name != "packed_ids":
            assert held.columns == before.columns
        if name == "quality_rules":
            assert ids(held) == ids(quality.judge(before).filter("rejected_by IS NULL"))
        if name == "near_duplicates":
            assert ids(held) == ids(jaccard.links(before).filter("doc_id = component_id"))
        if name == "decontamination":
            bad = winnow.contamination(before, table(spark, SF, "benchmark")).filter("n_hit > 0 AND 20 * n_hit >= n_words")
            assert ids(held) == ids(before) - ids(bad)
        if name == "mixing":
            assert max(r["count"] for r in held.groupBy("doc_id").count().collect()) <= 3
        if name == "packed_ids":
            assert held.count() == before.count()
            enc, ends = packing.encoder(packing.default_tokenizer()).encode(before.select("text").toArrow().column("text").combine_chunks(), 2)
            assert held.agg({"n_tokens": "sum"}).first()[0] == len(enc) == ends[-1]
    for rows in (empty(spark).select(*table(spark, SF, "documents").columns), docs(spark, extra=False)):
        for _, stage in C.STAGES:
            rows = stash(stage(spark, rows, SF), "edge")
