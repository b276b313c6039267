"""The pipeline over the smallest documents against the stages' plain meaning."""

from collections import defaultdict

import corpus_pipeline
from tests.llm.test_ngram_join import brute
from veilstat.llm import lang_id, packing, pii, toxicity
from veilstat.sources.tables import table

FOLDER = "/root/testdata/sf0.001"


def test_stages_and_run(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "near_copies", "personal_data", "packing"]
    docs = table(spark, FOLDER, "documents")
    inputs = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        inputs[name] = docs
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    rows = {name: [tuple(r) for r in df.select("doc_id", "text").collect()] for name, df in {**inputs, "end": docs}.items()}

    rejected = {r.doc_id for r in lang_id.identify(inputs["language"], lang_id.fit(inputs["language"])).collect() if r.rejected}
    assert sorted(rows["toxicity"]) == sorted(r for r in rows["language"] if r[0] not in rejected)
    model = toxicity.fit(inputs["toxicity"], table(spark, FOLDER, "labels"))
    toxic = {r.doc_id for r in toxicity.score(inputs["toxicity"], model).collect() if r.predicted}
    assert sorted(rows["near_copies"]) == sorted(r for r in rows["toxicity"] if r[0] not in toxic)
    keep = {d for d, _, c in brute(rows["near_copies"]) if d == c}
    assert sorted(rows["personal_data"]) == sorted(r for r in rows["near_copies"] if r[0] in keep)
    found = pii.fit(inputs["personal_data"])
    assert sorted(rows["end"]) == sorted((d, pii.redacted(t, pii.all_spans(t, pii.base_spans(t), found))) for d, t in rows["personal_data"])

    lengths = {d: len(t) for d, t in rows["end"]}
    pieces, bins = defaultdict(list), defaultdict(int)
    got = corpus_pipeline.run(spark, FOLDER).collect()
    for r in got:
        pieces[r.doc_id].append((r.start, r.stop))
        bins[r.shard, r.bin] += r.stop - r.start
    assert {d: max(e for _, e in p) for d, p in pieces.items()} == lengths
    assert max(bins.values()) <= packing.CAPACITY


def test_odd_tables_through_all_stages(spark, tmp_path):
    """Nulls in any column, repeated rows, one id many times, long texts, and columns whose names the stages use."""
    docs = table(spark, FOLDER, "documents")
    odd = [(None, None, None, None, None), (9001, None, "en", "s", 0), (9002, "", "en", "s", 0), (None, docs.filter("lang = 'en'").first().text, "en", None, None), (9003, "12 34 %%", "de", "s", 8)]
    odd += [(9004, docs.filter("lang = 'de'").first().text, "de", "s", 1)] * 3
    long = " ".join(r.text for r in docs.filter("lang = 'en' and text is not null").select("text").limit(60).collect())
    odd += [(9005, long, "en", "s", len(long))]
    more = docs.union(spark.createDataFrame(odd, docs.schema))
    names = ["lang_pred", "score", "rejected", "predicted", "component_id", "n_shingles", "fp1", "length", "cluster", "piece", "shard", "bin", "spans", "_fp1"]
    for n in names:
        more = more.withColumn(n, more["source"])
    more.write.parquet(str(tmp_path / "odd/documents.parquet"))
    table(spark, FOLDER, "labels").write.parquet(str(tmp_path / "odd/labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "odd/documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path / "odd"))
        assert out.columns == now.columns
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
    rows = now.collect()
    assert not [r for r in rows if r.doc_id in (9001, 9002, 9003)] and sum(r.doc_id == 9004 for r in rows) <= 1
    assert sum(r.doc_id == 9005 for r in rows) == 1 and len(rows) > 50
    got = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in rows}


def test_empty_tables_through_all_stages(spark, tmp_path):
    for t in ("documents", "labels"):
        table(spark, FOLDER, t).limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_folders_are_gone_after_the_run(spark):
    from pathlib import Path

    from veilstat.functions.session import shared_folder

    corpus_pipeline.run(spark, FOLDER).count()
    assert not list(Path(shared_folder(spark)).glob("pipeline-*"))
