import corpus_pipeline as C
import pyarrow as pa
from conftest import SF_SMALL
from llm.test_jaccard_join import plain as all_pairs
from tokenizers import Tokenizer

from dqlens.llm import jaccard_join as JJ
from dqlens.llm import pii_surrogates as PII
from dqlens.llm.common import stored
from dqlens.llm.queries import VOCABULARY


def test_stages_are_named_in_order():
    assert [n for n, _ in C.STAGES] == ["language_id", "near_duplicates", "pii", "mix", "encode"]


def test_each_stage_on_its_own_input(spark, small_docs):
    docs, steps = small_docs, {}
    for name, stage in C.STAGES:
        steps[name] = (docs, docs := stored(stage(spark, docs, SF_SMALL), "test-stage"))
    for name in ("language_id", "near_duplicates", "pii", "mix"):
        assert steps[name][1].columns == small_docs.columns
    before, after = steps["language_id"]
    assert after.count() == before.where("text rlike '[a-zA-Z]'").count()

    before, after = steps["near_duplicates"]
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    assert {r["doc_id"] for r in after.collect()} == {i for i, (_, c) in all_pairs(rows, 5, 80, 100).items() if i == c}
    assert after.count() < before.count()

    before, after = (({r["doc_id"]: r for r in d.collect()}) for d in steps["pii"])
    assert set(before) == set(after)
    for i, r in after.items():
        for _, _, kind, mention in PII.mentions(before[i]["text"]):
            assert mention not in r["text"]
        assert r["n_chars"] == len(r["text"])

    from dqlens.llm.source_mixing import mix_sources
    before, after = steps["mix"]
    want = {r["doc_id"]: r["copies"] for r in mix_sources(before).collect()}
    got = {r["doc_id"]: r["count"] for r in after.groupBy("doc_id").count().collect()}
    assert got == {i: n for i, n in want.items() if n}

    before, after = steps["encode"]
    library = Tokenizer.from_file(VOCABULARY)
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    rows = after.collect()
    assert len(rows) == before.count()
    assert all(r["ids"] == library.encode(texts[r["doc_id"]], add_special_tokens=False).ids for r in rows)


def test_awkward_rows(spark, awkward, no_docs):
    docs = awkward
    for _, stage in C.STAGES[:-1]:
        docs = stored(stage(spark, docs, ""), "test-awkward")
        assert docs.columns == awkward.columns
    ids = {r["doc_id"] for r in docs.collect()}
    assert 3 not in ids and 4 not in ids and 1 not in ids
    assert C.encode(spark, docs, "").count() == docs.count()
    for _, stage in C.STAGES:
        assert stage(spark, no_docs, "").count() == 0


def test_no_labels_keep_every_text_with_a_letter(spark, awkward):
    from pyspark.sql import functions as F
    docs = awkward.withColumn("lang", F.lit(None).cast("string"))
    kept = C.language_id(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r["text"] for r in kept.collect()) == sorted(
        r["text"] for r in docs.collect() if r["text"] and any(c.isalpha() for c in r["text"]))


def test_texts_go_to_python_in_small_batches(spark, monkeypatch):
    """Each task is one batch of some 12 MB by Spark's own limits."""
    from pyspark.sql import functions as F

    from dqlens.llm import common
    limit = int(common.BATCH_BYTES[1])
    docs = stored(spark.range(8000, numPartitions=2).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("mail jane.doe@mail.example.com "), F.repeat(F.lit("the word "), 350)).alias("text"),
        F.when(F.col("id") % 2 == 0, "en").otherwise("fr").alias("lang"), F.lit("a").alias("source")), "test-large")

    def sizes():
        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_pydict({"bytes": [b.nbytes]})
        return [r["bytes"] for r in docs.mapInArrow(run, "bytes long").collect()]

    assert max(sizes()) > 8 << 20
    met = []
    for module in (C, PII, JJ):
        def written(df, name, at=module.__name__):
            met.append((at, name, spark.conf.get(common.BATCH_BYTES[0])))
            return stored(df, name)
        monkeypatch.setattr(module, "stored", written)
    before = spark.conf.get(common.BATCH_BYTES[0])
    few = docs.limit(300)
    for name, stage in C.STAGES:
        if name != "mix":
            stage(spark, few, "")
    assert {n for at, n, v in met if v == common.BATCH_BYTES[1]} >= {"kept", "encoded", "gram-sets", "matrix-open", "pii-found", "pii-replaced"}
    assert spark.conf.get(common.BATCH_BYTES[0]) == before
    with common.small_batches(spark):
        assert max(sizes()) < limit + 10_000


def test_run_writes_each_stage_once_and_keeps_the_last_result(spark, monkeypatch):
    from dqlens.session import shared_root
    written, gone = [], []
    real_stored, real_forget = C.stored, C.forget
    monkeypatch.setattr(C, "stored", lambda df, name: written.append(name) or real_stored(df, name))
    monkeypatch.setattr(C, "forget", lambda *t: gone.extend(d._dqlens_path for d in t) or real_forget(*t))
    out = C.run(spark, SF_SMALL)
    assert written == ["kept", "duplicates", "pipeline-near_duplicates", "pipeline-pii", "pipeline-mix", "encoded"]
    assert len(gone) == 4 and all(p.startswith(shared_root(spark)) for p in gone)
    assert out._dqlens_path not in gone and out.count() > 0
