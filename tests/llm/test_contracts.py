"""The registered queries over the smallest tables against plain versions of what they must return."""

import base64
import hashlib
import zlib

import numpy as np
import pytest

from locusflow.llm import bpe, extract, jaccard, media, mixing, tokens, toxicity
from tests.llm import data

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def rows(query, spark, key="doc_id"):
    return {r[key]: r.asDict() for r in query(spark, SF).collect()}


def test_media(spark, texts):
    got = rows(media.query, spark)
    assert set(got) == set(texts)
    for i, t in texts.items():
        raw = t.encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    same: dict = {}
    for i, t in texts.items():
        assert same.setdefault(t, (got[i]["media_sha256"], got[i]["feature"])) == (got[i]["media_sha256"], got[i]["feature"])


def test_token_counts(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    library, got = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), rows(tokens.query, spark)
    for i, t in texts.items():
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len(t.encode()), n, n > 512)


def test_byte_bpe(spark, texts):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library, got = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), rows(bpe.query, spark)
    for i, t in texts.items():
        ids = library.encode_ordinary(t)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_toxicity(spark, texts):
    got = rows(toxicity.query, spark)
    assert set(got) == set(texts)
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def test_source_mix(spark, texts):
    got = rows(mixing.query, spark)
    source = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source").collect()}
    want = data.targets([(i, t, source[i]) for i, t in texts.items()])
    for i, t in texts.items():
        r = got[i]
        assert r["size"] == len(data.WORD.findall(t)) and abs(r["target"] - want[source[i]]) < 1e-6 and 0 <= r["taken"] <= 2 * r["size"]
    for s, target in want.items():
        own = [got[i] for i in got if source[i] == s]
        assert abs(sum(r["taken"] for r in own) - target) <= max(r["size"] for r in own) and all(r["source_size"] == sum(x["size"] for x in own) for r in own)


def test_main_text(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = rows(extract.query, spark, "page_id")
    assert set(got) == set(pages)
    for i, r in got.items():
        assert r["url"] == pages[i]["url"] and r["n_chars"] == len(r["text"])
        assert all(x == x.strip() and "  " not in x and x for x in r["text"].split("\n")) or r["text"] == ""


def test_toxicity_of_held_out_documents():
    import pyarrow.parquet as pq

    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table("/root/testdata/sf0.1/labels.parquet").to_pylist()}
    known = [(zlib.crc32(str(r["doc_id"]).encode()) % 5, labels[r["doc_id"]], r["text"] or "") for r in pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text"]).to_pylist() if labels.get(r["doc_id"]) is not None]
    model = toxicity.learn([r for r in known if r[0] and len(r[2]) <= toxicity.MAX_CHARS])
    held = [(y, toxicity.savings(model, t)) for f, y, t in known if f == 0]
    z = (np.array([x for _, x in held]) - np.array(model.mean)) / np.array(model.scale)
    found, y = model.weights[0] + z @ np.array(model.weights[1:]) >= 0, np.array([y for y, _ in held])
    assert found[y == 1].mean() > 0.8 and (~found[y == 0]).mean() > 0.95


def test_large_group_of_near_copies_and_a_common_line(spark, monkeypatch):
    """Copies that drift apart, so that hubs link some and miss others; a line in every document; blocks of a few members."""
    import random

    monkeypatch.setattr(jaccard, "BLOCK", 16)
    r, base, line = random.Random(2), data.prose(900, 90).split(), data.prose(901, 12)
    rows_ = []
    for i in range(160):
        words = list(base)
        for _ in range(r.randint(0, 7)):
            words[r.randrange(len(words))] = f"edit{i}x{r.randrange(999)}"
        rows_.append((i, " ".join(words) + " " + line))
    rows_ += [(200 + i, data.prose(2000 + i, 30 + i % 50) + " " + line) for i in range(120)] + [(400 + i, line) for i in range(30)] + [(500 + i, line + f" tail{i % 3}") for i in range(9)]
    want = data.classes(rows_)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.join(spark.createDataFrame(rows_, "doc_id bigint, text string").repartition(7)).collect()}
    assert got == want
