"""Mixing: rows that are alike, columns of maps, nulls that change places."""

from collections import Counter

from locusflow.llm import mixing


def test_equal_rows_maps_and_nulls(spark):
    rows = [(1, "a b c", "x", {"k": 1})] * 7 + [(2, "d e", "y", None), (2, "d e", "y", {"k": 2}), (None, "f g h", None, None), (3, None, "f g h", None), (4, " ", "y", {})]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string, `a map` map<string,int>")
    got = mixing.mix(frame, ["doc_id", "text", "source", "a map"]).collect()
    plain = lambda r: (r["doc_id"], r["text"], r["source"], tuple((r["a map"] or {"none": 0}).items()))
    assert Counter(map(plain, got)) == Counter(map(plain, frame.collect()))
    assert all(r["taken"] == r["copies"] * r["size"] <= 2 * r["size"] for r in got)
    assert {r["size"] for r in got if r["doc_id"] in (3, 4)} == {0}
    # Sizes are 21, 4 and 3; 42 words are shared 3 : 1 : 2, and none takes more than twice its size.
    for source in ("x", "y", None):
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) < 3
        assert sum(r["size"] for r in own) == own[0]["source_size"]
    again = mixing.mix(frame.repartition(3), ["doc_id", "text", "source", "a map"]).collect()
    count = lambda found: Counter((plain(r), r["copies"]) for r in found)
    assert count(again) == count(got)
