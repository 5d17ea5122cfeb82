"""Text queries that have to pass over a text few times: results on odd texts, and what their plans may not hold."""

import re

import pyarrow as pa
from pyspark.sql import functions as F

from tessera.operators import corpus
from tessera.plans import registry
from tessera.plans.corpus_queries import STOP
from tessera.sources import storage


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_detect_language(spark):
    texts = [None, "", " " * 60, "word " * 30, "The cat and the dog are in the house of the man, and that is all. ÄÖ", "1234567890" * 8, "Съешь ещё этих мягких французских булок, да выпей же чаю немедленно", "҂" * 60 + "Ж", "the 李白 " * 20, "İ the of and " * 10, "😀" * 49, "😀" * 50 + "the", "\nthe\tof\n" * 9]
    english = set(storage.ENGLISH)

    def plain(text):
        if text is None or len(text) < 50:
            return "unknown"
        letters = sum(c.isalpha() for c in text)
        share = lambda found: len(found) / letters if letters else 0.0
        if share(re.findall("[Ѐ-ӿ]", text)) >= 0.7:
            return "ru"
        words = re.findall("[a-z]+", text.lower())
        return "en" if share(re.findall("[A-Za-z]", text)) >= 0.7 and sum(w in english for w in words) / max(1, len(words)) >= 0.02 else "unknown"

    rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    found = rows.select("i", storage.detect_language(F.col("text")).alias("language"))
    assert [r.language for r in found.orderBy("i").collect()] == [plain(t) for t in texts]
    assert "regexp_count" not in plan(found) and "regexp_extract_all" not in plan(found)  # an array of single characters for each


def test_top_ngrams(spark):
    texts = [("en", "The cat3sat on the mat; cats sat on a mat mat"), ("en", "x"), ("de", "Der Hund und die Katze und der Hund"), (None, "The cat sat, the cat sat"), ("it", "")] * 2
    docs = spark.createDataFrame([(i, lang, text) for i, (lang, text) in enumerate(texts)], "doc_id long, lang string, text string")
    for n in (1, 2, 3):
        counts = {}
        for lang, text in texts:
            words = [w for w in re.findall(r"[^\W\d_]+|[0-9]+", text.lower()) if len(w) >= 2 and w.isalpha() and w not in STOP.get(lang, [])]
            for i in range(len(words) - n + 1):
                key = (lang, " ".join(words[i : i + n]))
                counts[key] = counts.get(key, 0) + 1
        found = registry_query(spark, f"top_ngrams_{n}", docs)
        assert {(r.lang, r.gram): r.n for r in found.collect()} == counts
        text = plan(found)
        assert "array_contains" not in text and "regexp_extract_all" not in text and text.count("[^\\p{L}]+") == 1


def registry_query(spark, name, docs):
    import tempfile

    folder = tempfile.mkdtemp(prefix="spark-")
    docs.write.parquet(f"{folder}/documents.parquet")
    return registry.QUERIES[name](spark, folder)


def test_batches_of_texts_are_small(spark):
    """Workers see few rows at a time, for the operators that send whole texts to Python."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["id"])

    docs = spark.createDataFrame([(1, "One. Two.", "en")], "doc_id long, text string, lang string")
    for operator in (corpus.chunk_documents, corpus.clean_report):
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        assert operator(docs).count() == 1
        seen = spark.range(0, 3000, 1, 1).mapInArrow(sizes, "id long")
        assert max(r.id for r in seen.collect()) <= 512
