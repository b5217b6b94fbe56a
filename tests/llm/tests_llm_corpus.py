"""A small corpus with labels, written as the tables that the pipeline reads."""

import random

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def write(spark, folder):
    rng = random.Random(11)
    en = ["the", "of", "and", "river", "stone", "walking", "lantern", "quiet", "under", "bridge"] + [f"{a}{b}ing" for a in "bcdfgh" for b in ("al", "or", "un")]
    passage = "this is the passage that stands in many documents and is longer than fifty bytes for sure"
    docs, labels = [], []
    for i in range(120):
        good = i % 5 != 4
        words = [rng.choice(en) for _ in range(rng.randint(80, 160))]
        text = " ".join(words) if good else " ".join(w + "$$$ ###" for w in words)
        if good and i % 4 == 0:
            text = f"{text} {passage} {i}"
        docs.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, int(good), 0))
    docs += [(500, docs[1][1] + " end", "en", "s0", len(docs[1][1]) + 4), (900, None, "en", "s0", 0), (901, "123 !!", None, "s0", 6)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    return folder
