import zlib

from pyspark.sql import functions as F

from conftest import SF_MID
from dqlens.llm import language_id as LID
from dqlens.llm.common import fold


def test_fold_is_crc32_of_the_id_as_text(spark):
    got = spark.range(50).select("id", fold(F.col("id"), 5).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in got)


def test_held_out_accuracy(spark):
    from dqlens.llm.queries import op2_language_id
    out = op2_language_id(spark, SF_MID).join(spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = out.where("held_out").collect()
    assert len(rows) > 150
    assert sum(r["lang_pred"] == r["lang"] for r in rows) >= .97 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_table_forward_equals_convolution():
    import numpy as np
    model = LID.ByteCNN(["a", "b", "c"])
    x = np.random.default_rng(1).integers(0, 256, (5, LID.WINDOW)).astype(np.uint8)
    e = model.p["emb"][x]
    out = [np.matmul(model._columns(e, w), model.p[f"conv{w}"]).max(axis=1) + model.p[f"bias{w}"] for w in model.widths]
    want = np.maximum(np.concatenate(out, axis=1), 0)
    assert np.allclose(model.pooled(x), want, atol=1e-5)


def test_awkward_rows(awkward, no_docs):
    model = LID.train_on(awkward)
    rows = LID.predicted(awkward, model, F.col("text"), "guess").collect()
    assert len(rows) == awkward.count()
    for r in rows:
        if r["text"] is None or not LID.LETTER.search(r["text"]):
            assert (r["guess"]["lang"], r["guess"]["score"]) == ("und", 0.0)
        else:
            assert r["guess"]["lang"] in ("en", "fr", "de") and 0 < r["guess"]["score"] <= 1
    assert LID.train_on(no_docs) is None
    assert {r["guess"]["lang"] for r in LID.predicted(awkward, None, F.col("text"), "guess").collect()} == {"und"}
    assert LID.predicted(no_docs, model, F.col("text"), "guess").count() == 0


def test_gradients_equal_finite_differences():
    import numpy as np
    model = LID.ByteCNN(["a", "b", "c"], embedding=3, filters={2: 2, 3: 3})
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 256, (6, 20)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])

    def loss():
        e = model.p["emb"][x]
        out = [np.matmul(model._columns(e, w), model.p[f"conv{w}"]).max(axis=1) + model.p[f"bias{w}"] for w in model.widths]
        z = np.maximum(np.concatenate(out, axis=1), 0) @ model.p["out"] + model.p["out_bias"]
        z -= z.max(axis=1, keepdims=True)
        return -(z - np.log(np.exp(z).sum(axis=1, keepdims=True)))[np.arange(len(y)), y].mean()
    grads = {k: v.copy() for k, v in model._gradients(x, y).items()}
    for name, g in grads.items():
        flat = model.p[name].reshape(-1)
        places = rng.choice(flat.size, min(12, flat.size), replace=False) if name != "emb" else (x[0, :4].astype(int)[:, None] * 3 + np.arange(3)).reshape(-1)
        for k in places:
            keep, step = flat[k], 1e-6
            flat[k] = keep + step
            up = loss()
            flat[k] = keep - step
            down = loss()
            flat[k] = keep
            assert abs((up - down) / (2 * step) - g.reshape(-1)[k]) < 1e-5, name


def test_many_junk_languages_do_not_flood_the_driver(spark, monkeypatch):
    monkeypatch.setattr(LID, "MAX_LANGUAGES", 3)
    rows = spark.range(200).selectExpr("id AS doc_id", "concat('some words ', id) AS text", "if(id < 150, 'en', concat('junk', id)) AS lang")
    sample = LID.training_windows(rows, "doc_id", "text", "lang")
    assert len(set(sample["lang"])) == 3 and (sample["lang"] == "en").sum() >= 100
