import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusflow.llm import bpe, extract, jaccard, jpeg, media, mixing, pretoken, quality, rlz, tokens, toxicity, warc
from locusflow.llm.components import components

from . import data

SCHEMA = "doc_id bigint, text string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(data.corpus(), SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# -- 1: substring dedup


def test_substring_dedup_matches_brute_force(docs):
    want = data.substring_dedup(data.corpus())
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in rlz.clean(docs).collect()}
    assert got == want


def test_substring_dedup_edge_cases(spark, empty):
    assert rlz.clean(empty).collect() == []
    text = data.prose(1, 50)
    # Repeated rows are one document; a null id comes first; other columns, also odd ones, pass through.
    rows = spark.createDataFrame([(5, text, "x", 1), (5, text, "x", 2), (None, text, "y", 3)], "doc_id bigint, text string, bucket string, row int")
    got = {r["row"]: r["n_removed"] for r in rlz.clean(rows).collect()}
    assert got == {1: 50, 2: 50, 3: 0}
    with pytest.raises(ValueError):
        rlz.clean(rows.withColumn("kept", F.lit(1)))


def test_substring_dedup_very_long_text(spark):
    long = data.prose(3, 250_000)
    part = " ".join(long.split()[200_000:200_090])
    got = {r["doc_id"]: r for r in rlz.clean(spark.createDataFrame([(1, long), (2, "before " + part + " after")], "doc_id bigint, text string")).collect()}
    assert (got[1]["n_words"], got[2]["n_removed"], got[2]["kept"]) == (250_000, 90, "before after")


# -- 2: media


def test_jpeg_round_trip_and_bit_reader(monkeypatch):
    r = random.Random(1)
    payloads = [bytes(64), b"\xff" * 640, *[r.randbytes(64 * n) for n in (1, 5, 6, 7, 30, 200)]]
    files = jpeg.encode(payloads)
    fast = jpeg.decode(files)
    assert [x[0] for x in fast] == payloads
    monkeypatch.setattr(jpeg.Scan, "script", lambda s: None)
    assert jpeg.decode(files[:6]) == fast[:6]


def test_jpeg_gray_is_flat_and_chroma_is_upsampled():
    payload = bytearray([128] * 64 * 6)
    comps, h, w = (p := jpeg.parse(jpeg.encode([bytes(payload)])[0])).components()
    assert (h, w, [c.stride for c in comps]) == (16, 16, [2, 1, 1]) and len(p.scans) == 12
    c = jpeg.Component(1, 1, 1, 0, 1, 1, 1, 1)
    c.coef = np.zeros((1, 1, 64), np.int16)
    c.coef[0, 0, 0] = 80
    assert (jpeg._plane(c, np.ones(64)) == 10).all()  # DC of 80 is 10 everywhere


def test_media_columns(spark, docs, empty):
    rows = media.load(media.store(docs.select("doc_id", "text"))).collect()
    texts = {i: t for i, t, _ in data.corpus()}
    assert len(rows) == len(texts)
    for row in rows:
        raw = (texts[row["doc_id"]] or "").encode()
        assert row["n_bytes"] == len(raw) and row["payload"] == raw + bytes(-len(raw) % 64 if raw else 64)
        assert media.tensor(row).shape == (3, row["height"], row["width"])
    by_text = {}
    for row in rows:
        assert by_text.setdefault(row["payload"], (row["media"], row["rgb"])) == (row["media"], row["rgb"])
    assert media.load(media.store(empty)).collect() == []
    with pytest.raises(ValueError):
        media.store(docs.withColumn("media", F.lit(1)))


# -- 3: main text


def test_blocks_and_main_text(spark):
    page = '<html><head><title>no</title></head><body><nav><ul><li>Menu</ul></nav><div class="cookie-notice">No</div><article><header><h1>Big &amp; bold</h1></header><p>One\n two<p>Three<br>four<div class="ad">Buy</div><script>var t="</p>";</script></article><section id="comments"><p>First!</p></section><footer>&copy;</footer>'
    plain = "<body><div>All rights reserved by the very big company of hosts here</div><p>Only on page {}. {}</p></body>"
    rows = [(1, "http://a/x", page), (2, "http://a/y", None), (3, None, "<p>bare &lt;text"), (3, None, "<p>bare &lt;text"), (4, "http://c/", "")]
    rows += [(10 + i, f"https://b.org:80/p{i}", plain.format(i, data.prose(i, 20))) for i in range(5)]
    got = extract.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    text = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(rows)
    assert text[1] == "Big & bold\nOne two\nThree\nfour"
    assert (text[2], text[3], text[4]) == ("", "bare <text", "")
    assert [text[10 + i] for i in range(5)] == [f"Only on page {i}. {data.prose(i, 20)}" for i in range(5)]
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert extract.main_text(spark.createDataFrame([], "page_id bigint, url string, html string")).collect() == []


def test_repeated_runs_match_brute_force():
    r = random.Random(2)
    streams = [[r.choice("abc") for _ in range(r.randint(0, 40))] for _ in range(12)]
    got = extract.repeated(streams, run=5, pages=3)
    for i, s in enumerate(streams):
        want = [False] * len(s)
        for j in range(len(s) - 4):
            k = s[j : j + 5]
            if sum(any(t[m : m + 5] == k for m in range(len(t) - 4)) for t in streams) >= 3:
                want[j : j + 5] = [True] * 5
        assert list(got[i]) == want


# -- 4: quality


def test_quality_features_and_verdicts(spark, empty):
    rows = data.corpus() + [(200 + i, " ".join(w + "$$$" for w in data.prose(i, 60).split()), "s1") for i in range(12)] + [(300 + i, data.prose(i, 60).upper().replace(" ", "!! "), "s1") for i in range(12)]
    rows += [(400 + i, "x y z w " * 3 + data.prose(i, 30) + " x y z w" * 3, "s1") for i in range(3)]
    got = {r["doc_id"]: r for r in quality.score(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, text, _ in rows:
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (want := data.base_features(text)), i
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert 0 <= r["quality"] <= 1 and not (r["base_failed"] and r["kept"])
    assert all(got[i]["kept"] for i in range(30)) and not any(got[i]["kept"] for i in (*range(200, 212), *range(300, 312)))
    assert quality.score(empty).collect() == []
    for name in ("quality", "votes", "kept", "N_Words"):
        with pytest.raises(ValueError, match="are added"):
            quality.score(empty.withColumn(name, F.lit(1)))


# -- 5 and 7: tokens


def strange_texts() -> list[str]:
    r = random.Random(3)
    made = ["".join(r.choice("ab'sTrelvdm  \n\t 12é字!?.-'") for _ in range(r.randint(0, 40))) for _ in range(400)]
    return [*made, "", "a" * 700, " " * 300 + "x", "字" * 200, "<|endoftext|>a<|endoftext|>", "!" * 99, "😀 it's we'll I'D"]


def test_token_counts_match_the_library(spark, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path, texts = public_tokenizers.path("byte_bpe_50k.json"), strange_texts() + [t for _, t, _ in data.corpus() if t]
    rows = spark.createDataFrame(list(enumerate(texts)) + [(-1, None)], "doc_id int, text string").repartition(2)
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in tokens.counted(rows, path).collect()}
    want = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    assert got == {-1: (0, 0)} | {i: (len(t.encode()), len(e.ids)) for i, (t, e) in enumerate(zip(texts, want))}
    assert tokens.counted(empty, path).collect() == []


def test_pieces_match_the_pattern():
    import public_tokenizers
    import regex

    for t in strange_texts():
        raw = t.encode()
        assert list(pretoken.starts(raw, np.zeros(min(1, len(raw)), int))) == [len(t[: m.start()].encode()) for m in regex.finditer(public_tokenizers.PATTERN, t)]


def test_bpe_matches_the_library_and_decodes(spark, empty):
    import public_tokenizers
    import tiktoken

    path, texts = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), strange_texts()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = spark.createDataFrame(list(enumerate(texts)) + [(-1, None)], "doc_id int, text string").repartition(2)
    back = bpe.decoded(bpe.encoded(rows, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN).collect()
    for r in back:
        assert list(np.frombuffer(r["ids"], "<u4")) == library.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode()
    assert bpe.encoded(empty, path, public_tokenizers.PATTERN).collect() == []


# -- 6: WARC


def test_warc_archive(spark, tmp_path):
    rows = [(1, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>é\r\nWARC/1.1\r\n\r\n</p>"), (3, None, "<p>x</p>"), (4, "http://b/\n4", None), (5, "http://b/5", ""), (None, "http://c", "<p>x</p>"), (6, "http://d", "z" * 300_000)]
    warc.archive(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(2), str(tmp_path / "w"))
    got = {r["page_id"]: r for r in warc.read(spark, str(tmp_path / "w")).collect()}
    assert {k: (r["record_type"], r["refers_to"]) for k, r in got.items()} == {1: ("revisit", 3), None: ("revisit", 3), 2: ("response", None), 3: ("response", None), 4: ("revisit", 5), 5: ("response", None), 6: ("response", None)}
    for i, _, html in rows:
        raw = (html or "").encode()
        assert got[i]["payload_bytes"] == len(raw) and got[i]["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert got[i]["payload"] is None if got[i]["record_type"] == "revisit" else bytes(got[i]["payload"]) == raw
    some = warc.read(spark, str(tmp_path / "w"), payload=False).where("record_type = 'response' AND page_id IN (2, 4)")
    assert [(r["page_id"], r["payload"]) for r in some.collect()] == [(2, None)]
    import gzip

    whole = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("*.warc.gz"))
    assert whole.count(b"WARC-Type: ") == 7
    warc.archive(spark.createDataFrame([], "page_id bigint, url string, html string"), str(tmp_path / "none"))
    assert warc.read(spark, str(tmp_path / "none")).collect() == []


# -- 8: toxicity


def test_toxicity_learns_and_holds_out(spark, empty):
    bad, r, rows, labels = ["scumword", "nastyterm", "viletalk"], random.Random(4), [], []
    for i in range(900):
        words = data.prose(i, 60).split()
        toxic = i % 5 in (1, 3) if i % 2 else 0
        if toxic:
            for _ in range(5):
                words.insert(r.randrange(60), r.choice(bad))
        rows.append((i, " ".join(words), "s"))
        labels.append((i, int(toxic)))
    rows += [(5000, None, "s"), (5001, "", "s")]
    docs = spark.createDataFrame(rows, SCHEMA)
    known = spark.createDataFrame(labels + [(7, None), (99999, 1)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, known)
    got = {x["doc_id"]: x for x in toxicity.score(docs.repartition(3), model).collect()}
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum(got[i]["predicted"] == y for i, y in held)
    assert right / len(held) > 0.9
    assert got[5000]["score"] == got[5001]["score"] and all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.5) for x in got.values())
    assert toxicity.score(empty, model).collect() == []
    none = toxicity.fit(empty, known)
    assert [x["score"] for x in toxicity.score(docs.limit(1), none).collect()] == [0.0]
    with pytest.raises(ValueError):
        toxicity.score(docs.withColumn("score", F.lit(1)), model)


# -- 9: n-gram Jaccard


def test_jaccard_matches_brute_force(docs, empty):
    want = data.classes(data.corpus())
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(docs.select("doc_id", "text")).collect()}
    assert got == want
    assert jaccard.join(empty.select("doc_id", "text")).collect() == []


def test_jaccard_second_round_links_what_hubs_miss(spark):
    """Pairs that share grams with a hub which links to neither, and rows without an id."""
    r, hub = random.Random(9), data.prose(500, 100).split()
    rows = [(1, " ".join(hub))]
    for k in range(6):
        own = hub[:60] + data.prose(600 + k, 40).split()
        rows.append((10 + 2 * k, " ".join(own)))
        own[r.randrange(60, 100)] = "changed"
        rows.append((11 + 2 * k, " ".join(own)))
    want = data.classes(rows)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == want
    odd = spark.createDataFrame([(None, "a b c d e f"), (4, "A b c d e f"), (4, "other words are here now too"), (6, "other words are here now too")], "doc_id bigint, text string")
    assert sorted((x["doc_id"] or -1, x["component_id"]) for x in jaccard.join(odd).collect()) == [(-1, None), (4, None), (4, None), (6, None)]


def test_jaccard_sends_few_pairs_of_a_group_without_a_centre(spark, monkeypatch):
    """Copies of a text that isn't there: any of them links to some of the others only, so that hubs leave many apart."""
    r, base, counts, write = random.Random(4), data.prose(700, 200).split(), [], jaccard.written
    rows = []
    for i in range(300):
        own = list(base)
        for k in r.sample(range(200), r.choice([3, 4, 4, 4])):
            own[k] = f"edit{i}x{k}"
        rows.append((i, " ".join(own)))

    def counted(df, label, by=None):
        out = write(df, label, by)
        if label == "across":
            counts.append(out.where("b is not null").count())
        return out

    monkeypatch.setattr(jaccard, "written", counted)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.join(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)).collect()}
    assert got == data.classes(rows)
    assert sum(counts) < 4 * len(rows), counts


def test_least_forest():
    """Against Kruskal's way, edge by edge."""
    r = np.random.default_rng(3)
    for nodes, edges in ((1, 0), (5, 3), (40, 200), (200, 150)):
        u, v = r.integers(nodes, size=edges), r.integers(nodes, size=edges)
        of, want = list(range(nodes)), []
        for i, (x, y) in enumerate(zip(u, v)):
            if of[x] != of[y]:
                want.append(i)
                of = [of[x] if c == of[y] else c for c in of]
        assert jaccard._forest(u, v, nodes).tolist() == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {got.get(i, i) for i in range(41)} == {0} and {got.get(100 + k, 100) for k in range(30)} == {100}


# -- 10: mixing


def test_mix_keeps_targets_and_bounds(spark, docs, empty):
    rows = [(i, data.prose(i, 5 + i % 37), f"s{i % 7}" if i % 11 else None) for i in range(600)] + data.corpus()[:0] + [(5, "twice", "s1"), (5, "twice", "s1"), (9000, None, "s2"), (9001, "", "empty")]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(frame.repartition(4), ["doc_id", "source"]).collect()
    want = data.targets(rows)
    assert len(got) == len(rows)
    for source, target in want.items():
        own = [r for r in got if r["source"] == source]
        assert all(abs(r["target"] - target) < 1e-6 and r["source_size"] == sum(x["size"] for x in own) for r in own)
        assert abs(sum(r["taken"] for r in own) - target) <= max(r["size"] for r in own)
    assert all(r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"] for r in got)
    again = mixing.mix(frame.repartition(2), ["doc_id", "source"]).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.mix(empty, ["doc_id"]).collect() == []
