"""The words that have a class of their own in the log-bilinear model, however the table is partitioned."""

from collections import Counter

from tessera.llm import logbilinear


def test_frequent_words_dont_depend_on_partitions(spark):
    rows = [(k, " ".join(f"w{j}" for j in range(40) if k % (j + 1) == 0)) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts = Counter()
    for r in logbilinear.blocks(docs, 7, 7, 1000).where("word is not null").collect():  # no id is in fold 7
        counts[bytes(r.word)] += r.c
    right = sorted(counts, key=lambda w: (-counts[w], w))[:20]
    for parts in (1, 30):
        assert logbilinear.frequent_words(logbilinear.blocks(docs.repartition(parts), 7, 7, 1000), 20) == right
