"""run() against the same stages in plain Python."""

import math
from collections import Counter

import corpus_pipeline
from plain import DOCS, awkward, near_components, poisson, prose, uniform, without_repeats
from pyspark.sql import functions as F
from test_quality_and_mix import corpus, plain_verdicts

from boreline.llm import robust_outliers as ro
from boreline.llm.chunks import default_path
from boreline.llm.shared import new_path


def plain_run(rows):
    import sentencepiece
    ok, distance = plain_verdicts(rows)
    gone = {r[0] for r, good, d in zip(rows, ok, distance) if not good or (d is not None and d > ro.CUTOFF)}
    rows = [r for r in rows if r[0] not in gone]
    gone = {k for k, _, _, kept in near_components([(r[0], r[1]) for r in rows if r[0] is not None]) if not kept}
    rows = [r for r in rows if r[0] not in gone]
    cut = {k: (n, b.decode("utf-8", "ignore")) for k, _, n, _, b in without_repeats(sorted({(r[0], r[1]) for r in rows if r[0] is not None}))}
    rows = [(r[0], cut[r[0]][1] if r[0] in cut else r[1], *r[2:]) for r in rows]
    rows = [r for r in rows if r[1] or not (r[0] in cut and cut[r[0]][0])]
    size = Counter()
    for r in rows:
        size[r[3]] += len(r[1])
    share = {s: n ** 0.7 for s, n in size.items()}
    library = sentencepiece.SentencePieceProcessor(model_file=default_path("piece_bpe_32k.model"))
    out = Counter()
    for r in rows:
        rate = share[r[3]] / sum(share.values()) * sum(size.values()) / size[r[3]]
        assert rate < 8
        n = poisson(rate, uniform(0, "count", 1, "null" if r[0] is None else r[0]))
        if n:
            out[r[0], tuple(library.encode(r[1]))] += n
    assert all(math.isfinite(v) for v in share.values())
    return out


def test_stages_keep_the_columns_of_documents():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "MinHash near-dedup", "suffix-array dedup", "mixing sources to target weights",
                                                      "SentencePiece encoding and decoding"]


def test_run(spark):
    rows = corpus(160) + [(1000 + (r[0] or 0), *r[1:]) for r in awkward()]
    shared = prose("shared", 40)
    rows += [(3000 + i, prose(f"t{i}", 70) + "\n" + shared + "\n" + prose(f"z{i}", 60), "en", "src0", 1) for i in range(10)]
    folder = new_path(spark, "documents-test")
    spark.createDataFrame([(*r, "other") for r in rows], DOCS + ", extra string").write.parquet(f"{folder}/documents.parquet")
    got = Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, folder).collect())
    assert got == plain_run(rows)


def test_each_stage_on_empty_and_null_rows(spark):
    nothing = spark.createDataFrame([], DOCS)
    nulls = spark.createDataFrame([(None, None, None, None, None), (1, None, None, None, None), (None, None, None, None, None)], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, "").count() == 0
        assert stage(spark, nulls.withColumn("kept", F.lit("other")), "").count() <= 9
