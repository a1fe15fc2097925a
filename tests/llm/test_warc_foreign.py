"""Archives of other writers: plain files, and gzip members without lengths."""

import gzip

from locusflow.llm import warc


def block(kind, uri, content, body, more=()):
    head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Target-URI: {uri}", f"Content-Type: {content}", *more, f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def test_plain_and_ordinary_members(spark, tmp_path):
    page = b"<p>" + bytes(range(32, 127)) * 9000 + b"</p>\r\n\r\nend"
    records = [
        block("warcinfo", "x", "application/warc-fields", b"software: other\r\n"),
        block("response", "http://a/1", "application/http; msgtype=response", b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + page, ["WARC-Payload-Digest: sha1:ABC"]),
        block("request", "http://a/1", "application/http; msgtype=request", b"GET / HTTP/1.1\r\n\r\n"),
        block("resource", "http://a/2", "text/html", b""),
    ]
    for name, raw in (("one.warc", b"".join(records)), ("two.warc.gz", b"".join(gzip.compress(r) for r in records)), ("three.warc.gz", gzip.compress(b"".join(records)))):
        folder = tmp_path / name.replace(".", "-")
        folder.mkdir()
        (folder / name).write_bytes(raw)
        got = {(r["record_type"], r["target_uri"]): r for r in warc.read(spark, str(folder)).collect()}
        assert set(got) == {("warcinfo", "x"), ("response", "http://a/1"), ("request", "http://a/1"), ("resource", "http://a/2")}
        assert bytes(got["response", "http://a/1"]["payload"]) == page and got["response", "http://a/1"]["payload_bytes"] == len(page)
        assert got["resource", "http://a/2"]["payload_bytes"] == 0 and got["response", "http://a/1"]["payload_digest"] == "ABC" and got["response", "http://a/1"]["page_id"] is None
        some = warc.read(spark, str(folder), payload=False).where("record_type = 'response'").collect()
        assert [(r["target_uri"], r["payload"]) for r in some] == [("http://a/1", None)]
