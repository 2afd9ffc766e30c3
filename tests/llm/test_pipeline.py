"""The stages of corpus_pipeline against brute force, with null and repeated ids, empty tables and clashing columns."""

import random

import corpus_pipeline as cp
from frostline.llm import quality_classifier
from frostline.llm.common import documents

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, seed long, item_id long, spans string, base string, quality_score double, first string, component long, _row string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), False, 0.1, 7, 3, "x", "b", 0.2, "f", 1, "r") for i, t in rows], SCHEMA)


def prose(rng, n):
    return " ".join(f"w{rng.randrange(4000)}" for _ in range(n))


def similarity(a, b, k):
    a, b = ({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def edited(text, at):
    return " ".join("other" if k == at else w for k, w in enumerate(text.split()))


def ids(df):
    return sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in df.collect())


def test_near_copies_are_judged_by_five_words(spark):
    rng = random.Random(1)
    bases = [prose(rng, 42) for _ in range(6)] + [prose(rng, 60) for _ in range(6)]
    texts = bases + [edited(t, 20) for t in bases]
    assert similarity(texts[0], texts[12], 4) >= 0.8 > similarity(texts[0], texts[12], 5)
    rows = list(enumerate(texts))
    left = [i for i, t in rows if not any(similarity(t, u, 5) >= 0.8 for u in texts[:i])]
    assert left == list(range(18))
    rows += [(None, texts[0]), (None, None), (40, prose(rng, 30)), (40, prose(rng, 30)), (41, ""), (42, None)] + [(43, t) for t in [prose(rng, 60)] * 2]
    rows += [(44, rows[-1][1] + " more"), (43, rows[-1][1] + " again")]
    docs = docs_of(spark, rows)
    got = cp.drop_near_copies(spark, docs, "")
    assert got.columns == docs.columns
    assert ids(got) == [(False, 0)] * 2 + [(True, i) for i in [*left, 40, 40, 41, 42, 43]]
    assert cp.drop_near_copies(spark, docs.where("false"), "").count() == 0


def test_other_stages_and_run(spark, tmp_path):
    rng = random.Random(2)
    items = [prose(rng, 40) for _ in range(3)]
    good, bad = [prose(rng, 60) for _ in range(30)], ["zz yy " * 30 + prose(rng, 5) for _ in range(30)]
    key = "AKIA" + "ABCDEFGH12345678"
    rows = list(enumerate(good + bad)) + [(70, f"{prose(rng, 20)} {items[0]}"), (71, f"{prose(rng, 20)} {key} {prose(rng, 20)}"), (72, None), (72, ""), (None, prose(rng, 50)), (73, "")]
    docs_of(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*enumerate(items), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, int(i < 30), 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = documents(spark, str(tmp_path))

    clean = cp.drop_contaminated(spark, docs, str(tmp_path))
    assert ids(clean) == sorted((i is not None, i or 0) for i, _ in rows if i != 70)
    masked = cp.mask_secrets(spark, docs, str(tmp_path))
    assert masked.columns == clean.columns == docs.columns
    texts = {r["doc_id"]: r for r in masked.collect()}
    assert masked.count() == len(rows) and key not in texts[71]["text"] and texts[71]["n_chars"] == len(texts[71]["text"])
    assert all(texts[i]["text"] == t for i, t in rows if i is not None and i < 71)
    model = quality_classifier.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    kept = cp.keep_quality(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and ids(kept) == ids(quality_classifier.score(docs, model).where("quality_score >= 0.5"))
    packed = cp.pack_sequences(spark, masked, str(tmp_path))
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
    want, got = cp.pack_sequences(spark, docs, str(tmp_path)), cp.run(spark, str(tmp_path))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and 0 < got.count() < packed.count()
