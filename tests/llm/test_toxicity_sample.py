"""Which windows the ordinary dictionary is trained on."""

from locusflow.llm import toxicity


def test_every_window_of_the_sample_is_used(spark, monkeypatch):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(40)) + (" badword vileterm" * 4 if i % 3 == 0 else "")) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id bigint, toxic int")
    seen, train = {}, toxicity._train

    def held(size, samples):
        seen[size] = samples
        return train(size, samples)

    monkeypatch.setattr(toxicity, "_train", held)
    toxicity.fit(docs, labels)
    used = seen[toxicity.ORDINARY_BYTES]
    ids = {int(w.split()[0][1:].split(b"x")[0]) for w in used}
    want = {w[len(toxicity.ANCHOR) :] for i in ids for w in toxicity.windows(rows[i][1])}
    assert len(ids) > 10 and set(used) == want and len(used) == len(want)
