import zlib

from pyspark.sql import functions as F

from caseloom.llm import toxicity


def test_held_out_accuracy(spark, documents):
    """Invented insults among invented words; learned from rows that are not held out."""
    insults = ["zorkface", "blemmish", "gruntwit", "smarfle", "dungleton"]
    rows = []
    base = [r.text for r in documents.select("text").collect()]
    for i in range(600):
        words = base[i % len(base)].split()[i % 7:i % 7 + 80] or ["word"]
        if i % 4 == 0:
            words[len(words) // 2:len(words) // 2] = [insults[i // 4 % 5], insults[i // 4 % 3]]
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i in got if got[i].held_out} == set(held)
    right = [got[i].predicted == rows[i][2] for i in held]
    assert sum(right) / len(right) > 0.97
    # Held-out labels teach nothing.
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    same = {r.doc_id: r.score for r in toxicity.classify(docs, turned).collect()}
    assert all(same[i] == got[i].score for i in same)


def test_odd_rows(odd_docs, odd_labels, documents, labels):
    rows = toxicity.classify(odd_docs, odd_labels).collect()
    assert len(rows) == odd_docs.count() and all(r.score == 0 and r.predicted == 0 for r in rows)
    model = toxicity.fit(documents, labels)
    assert toxicity.drop_toxic(odd_docs, model).columns == odd_docs.columns
    scored = odd_docs.select("text", toxicity.score(F.col("text"), model).alias("score")).collect()
    assert all(0 <= r.score <= 1 for r in scored)
    assert len({r.score for r in scored if not (r.text or "").strip()}) == 1


def test_empty(no_docs, labels):
    assert toxicity.classify(no_docs, labels.limit(0)).collect() == []
