"""Embeddings, chats, toxicity, languages, quality and the pipeline, on small tables."""

import random

import corpus_pipeline
import helpers
import numpy as np
import pytest
from pyspark.sql import functions as F

from citetide.llm import chats, embeddings, languages, quality, toxicity


def vectors():
    rng = np.random.default_rng(5)
    rows = [rng.normal(size=16) for _ in range(40)]
    for centre in list(rows[:4]):
        rows += [centre + rng.normal(size=16) * 0.15 for _ in range(15)]
        rows += [centre * 3] * 5
    rows = [list(map(float, r)) for r in rows]
    rows += [None, [0.0] * 16, [float("nan")] * 16, [1.0] * 15 + [float("inf")], [1.0] * 15 + [None], [], rows[0][:8], rows[0][:8]]
    return [(3 * i % 1000, r, "cat") for i, r in enumerate(rows)]


def brute_links(rows, cosine=0.95):
    units = {}
    for i, (_, r, _) in enumerate(rows):
        if r and all(x is not None and np.isfinite(x) for x in r) and any(r):
            units[i] = np.array(r) / np.linalg.norm(r)
    near = {i: [j for j in units if j != i and len(units[i]) == len(units[j]) and units[i] @ units[j] >= cosine] for i in units}
    out = []
    for i, (v, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min(rows[j][0] for j in seen)
        out.append((v, len(near.get(i, [])), least, v == least))
    return sorted(out)


@pytest.mark.parametrize("block", [4096, 7])
def test_embedding_links(spark, block):
    rows = vectors()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").repartition(3)
    found = embeddings.near_duplicates(frame, block=block).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in found) == brute_links(rows)
    assert embeddings.near_duplicates(frame.limit(0)).count() == 0


def test_embedding_links_of_singles(spark):
    rng = np.random.default_rng(8)
    rows = [rng.normal(size=16) for _ in range(60)]
    for centre in rows[:5]:  # cosines just above and just below the limit
        side = rng.normal(size=16)
        side -= (side @ centre) / (centre @ centre) * centre
        side *= np.linalg.norm(centre) / np.linalg.norm(side)
        rows += [c * centre + np.sqrt(1 - c * c) * side for c in (0.9499, 0.949999, 0.950001, 0.9501)]
    rows += [rows[5]] * 40 + [rows[6] * 1e-38, rows[6] * 1e36, -rows[6]]
    rows = [(i % 90, np.asarray(r, np.float32).tolist(), i) for i, r in enumerate(rows)]
    frame = spark.createDataFrame(rows, "vec_id int, embedding array<float>, label int").repartition(3)
    found = embeddings.near_duplicates(frame, block=16)
    assert found.schema["vec_id"].dataType.simpleString() == "int"
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in found.collect()) == brute_links(rows)


@pytest.mark.parametrize("spread", [1.0, 0.1])
def test_bounds_of_products(spread):
    """Products of bounds are never less than the vectors' own, whether the rows differ in a few directions or in all."""
    rng = np.random.default_rng(10)
    rows = rng.normal(size=(900, 64)) * np.where(np.arange(64) < 10, 1, spread)
    rows = np.concatenate([rows, rows[:100] + rng.normal(size=(100, 64)) * 0.2 * spread])
    units = (rows / np.linalg.norm(rows, axis=1)[:, None]).astype(np.float32)
    geometry = embeddings.Geometry(embeddings.fit_centres(units, 9), 0.95, units)
    assert geometry.basis is not None and geometry.basis.shape[1] <= 32
    bounds, exact = geometry.bounds(units), units.astype(float) @ units.T.astype(float)
    assert ((bounds @ bounds.T >= geometry.floor()) | (exact < 0.95)).all()
    assert (bounds @ bounds.T >= exact - geometry.margin - geometry.loose()).all()


def test_embeddings_are_shuffled_once(spark):
    """What shuffles write does not grow with the number of blocks that a vector is compared with."""

    def written():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return sum(files.apply(i).length() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle"))

    rng = np.random.default_rng(9)
    rows = [(i, x.tolist()) for i, x in enumerate(rng.normal(size=(3000, 64)))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4).cache()
    assert frame.count() == len(rows)
    before = written()
    found = embeddings.near_duplicates(frame, block=256)
    assert written() - before < 4 * 3000 * 64 * 8
    assert found.where("n_links = 0 and component_id = vec_id and kept").count() == len(rows)
    frame.unpersist()


def test_chats_become_legal(spark):
    rng = random.Random(3)
    schema = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").schema
    rows = []
    for conv in range(30):
        for turn in range(rng.randint(1, 9)):
            held = {"conv_id": conv, "turn": turn, "role": rng.choice(["system", "user", "assistant", "tool?", None]), "text": rng.choice(["hi", "", None])}
            rows.append(tuple(held.get({"turn_idx": "turn", "content": "text"}.get(c, c)) for c in schema.names))
    frame = spark.createDataFrame(rows, schema)
    found = chats.format_chats(frame).orderBy("conv_id", "place").collect()
    assert len(found) == len(rows)
    again = chats.format_chats(frame, partitions=1).orderBy("conv_id", "place").collect()
    assert found == again
    assert chats.format_chats(frame.limit(0)).count() == 0


def labelled_texts():
    clean = [helpers.prose(i, 40) for i in range(300)]
    toxic = [helpers.prose(1000 + i, 20) + " you vile scumbag " + helpers.prose(2000 + i, 20) for i in range(60)]
    return clean + toxic, [0] * 300 + [1] * 60


def test_toxicity_finds_disguised_words(spark):
    texts, marks = labelled_texts()
    more = ["you v1le scumb@g", "", None, "plain words only"]
    docs = helpers.documents(spark, texts + more)
    kinds = {"doc_id": "long", "toxic": "int"}
    labels = spark.createDataFrame(list(enumerate(marks)), ", ".join(f"{c} {t}" for c, t in kinds.items()))
    found = {r.doc_id: r for r in toxicity.report(docs, labels).collect()}
    assert len(found) == len(texts) + len(more)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found.values())
    held = [i for i in range(len(texts)) if found[i].held_out]
    assert held and sum(found[i].predicted == marks[i] for i in held) >= 0.95 * len(held)
    assert [found[len(texts) + i].predicted for i in range(4)] == [1, 0, 0, 0]
    assert toxicity.report(docs.limit(0), labels.limit(0)).count() == 0


def test_languages(spark):
    letters = {"aa": "abcdefgh", "bb": "ijklmnop", "cc": "éèàüößñç"}
    rows = [(i, helpers.prose(i, 30, letters[lang]), lang) for i, lang in enumerate(list(letters) * 60)]
    rows += [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 !?", None), (1003, helpers.prose(7, 30, letters["bb"]), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in languages.report(docs).collect()}
    assert all(found[i].lang_pred == lang for i, t, lang in rows if i < 1000)
    assert [found[i].lang_pred for i in range(1000, 1004)] == ["und", "und", "und", "bb"]
    assert all(0 <= r.score <= 1 for r in found.values())
    assert languages.report(docs.limit(0)).count() == 0


def test_quality_prefers_the_target(spark):
    texts = [helpers.prose(i, 60) for i in range(150)] + [helpers.prose(i, 60, "qrstuvwx") for i in range(150)] + ["", None]
    docs = helpers.documents(spark, texts)
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(300)], "doc_id long, quality int")
    found = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(found) == len(texts)
    assert min(found[i].log_weight for i in range(150)) > max(found[i].log_weight for i in range(150, 300))
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, r in found.items() if r.kept}


def test_quality_of_odd_tables(spark):
    texts = [helpers.prose(i, 60) for i in range(60)] + [helpers.prose(i, 60, "qrstuvwx") for i in range(60)] + [helpers.prose(0, 60)] * 200
    ids = list(range(120)) + [0] * 200
    docs = helpers.documents(spark, texts, ids).withColumn("_id", F.lit(7)).withColumn("_good", F.lit(None).cast("boolean"))
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)] + [(None, 1), (3, 1)], "doc_id long, quality int")
    weights = spark.createDataFrame([(0, 1.0)] * 500 + [(i, 1.0 if i < 60 else -1.0) for i in range(1, 120)], "doc_id long, log_weight double")
    assert quality.cut_of(weights, quality.labelled(labels)) == 0.0
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert rows and all(r._id == 7 and r._good is None for r in rows)
    # rows alike in id and text have one key, so they stay or go together
    assert sum(r.doc_id == 0 for r in rows) in (0, 201)
    assert quality.keep_good(docs, labels.limit(0)).count() == len(texts)


def test_pipeline_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = {r.doc_id for r in docs.select("doc_id").collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "sentencepiece_encoding"
    ]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, folder)
        assert kept.columns == docs.columns, name
        assert stage(spark, docs.limit(0), folder).count() == 0, name
    rows = corpus_pipeline.run(spark, folder)
    ids = [r.doc_id for r in rows.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and set(ids) <= before and ids
    assert rows.where(F.col("text").isNotNull() & ~F.col("lossless")).count() == 0
