"""The pipeline against a plain version of every stage, on a small table with cases of each kind."""

import hashlib
import os

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import __spark_entry__ as entry
import corpus_pipeline
from marquee.llm import bpe, pii, tiling, toxicity

from .conftest import SCHEMA, prose
from .test_simhash import classes, fingerprint
from .test_tiling import brute
from .test_toxicity import corpus

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("tables"))
    pairs, labels = corpus(300)
    item = prose(25, 99)
    pairs += [(1000, pairs[3][1]), (1001, pairs[3][1]), (1002, None), (1003, ""), (None, prose(30, 50)), (1004, prose(40, 51) + " " + item), (1005, prose(30, 52) + " mail a@b.co now"), (1005, prose(30, 52) + " mail a@b.co now")]
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in pairs], SCHEMA).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out, pairs, item


def test_stages_equal_plain_ones(spark, folder, tmp_path):
    out, pairs, item = folder
    df = spark.read.parquet(f"{out}/documents.parquet")
    model = toxicity.fit(df, spark.read.parquet(f"{out}/labels.parquet"))
    kept = [(i, t) for i, t in pairs if model.score(model.votes(t or "", {})) < 0.7]
    group = classes([fingerprint(t) for _, t in kept])
    least = {}
    for p, g in zip(kept, group, strict=True):
        least[g] = min(least.get(g, p), p, key=lambda x: (x[0] is None, x[0] or 0))
    kept = list(least.values())
    leaked = {r[0] for r in brute(kept, [(1, item)])}
    kept = [p for p in kept if p[0] not in leaked]
    assert 1004 in leaked and len(kept) < len(pairs) - 20
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        after = stage(spark, df, out)
        assert after.columns == df.columns
        after.write.parquet(str(tmp_path / name))
        df = spark.read.parquet(str(tmp_path / name))
    assert sorted(((r.doc_id, r.text) for r in df.collect()), key=str) == sorted(kept, key=str)
    weights = pii.fit(df)
    masked = sorted(((i, None if t is None else pii.masked(t, weights)) for i, t in kept), key=str)
    after = corpus_pipeline.STAGES[3][1](spark, df, out)
    assert sorted(((r.doc_id, r.text) for r in after.collect()), key=str) == masked and not any("a@b.co" in (t or "") for _, t in masked)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = []
    for i, t in masked:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), ids))
    assert sorted((tuple(r) for r in corpus_pipeline.run(spark, out).collect()), key=str) == sorted(want, key=str)


def test_empty_documents(spark, folder, tmp_path):
    out = folder[0]
    for name in ("labels", "benchmark"):
        os.symlink(f"{out}/{name}.parquet", tmp_path / f"{name}.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
@pytest.mark.parametrize("name", sorted(entry.TEXT_QUERIES))
def test_registered_queries_return_their_columns(spark, name):
    df = entry.queries()[name](spark, SF)
    rows = df.collect()
    documents = spark.read.parquet(f"{SF}/documents.parquet").count()
    if name == "op12_spelling_variants":  # a row for each word
        assert len({r.word for r in rows}) == len(rows)
    elif name == "op13_ranked_search":  # a row for each rank of an item
        assert len({(r.item_id, r["rank"]) for r in rows}) == len(rows)
    elif name not in ("op5_url_filters", "op9_decontamination", "pipeline"):
        assert len(rows) == documents and {r.doc_id for r in rows} == set(range(documents))
    assert rows and all(kind != "void" for _, kind in df.dtypes)
