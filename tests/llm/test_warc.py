import base64
import gzip
import hashlib

from xpspark.llm import warc


def test_round_trip(spark, tmp_path):
    rows = [(5, "http://a/\r\nX: y", "<p>é\r\n\r\nWARC/1.1\r\n</p>"), (2, None, "same"), (9, "u", "same"), (9, "u", "same"), (7, "v", None), (3, "w", ""), (None, "n", "same"), (None, "n", "alone"), (11, "z", "q" * 100_000), (2, "again", "same")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, payload string")
    got = warc.archive(df, str(tmp_path / "w")).collect()
    assert len(got) == len(rows)
    want = []
    for page, _, html in rows:
        body = (html or "").encode()
        least = min((p for p, _, h in rows if (h or "") == (html or "") and p is not None), default=None)
        revisit = page is not None and page != least
        want.append((page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", least if revisit else None))
    key = lambda r: str(tuple(r))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(want, key=key)
    assert {r.payload for r in got if r.page_id == 5} == {rows[0][2]}
    files = list((tmp_path / "w").glob("*.gz"))
    parsed = [[h for h, _ in warc.records(gzip.open(f))] for f in files]
    assert all(p[0]["warc-type"] == "warcinfo" and [h["warc-type"] for h in p].count("warcinfo") == 1 for p in parsed)
    heads = [h for p in parsed for h in p if h["warc-type"] != "warcinfo"]
    ids = [h["warc-record-id"] for p in parsed for h in p]
    assert len(heads) == len(rows) and len(set(ids)) == len(ids)
    responses = {h["warc-record-id"]: h for h in heads if h["warc-type"] == "response"}
    for h in heads:
        assert h["warc-date"][:2] == "20" and (h["warc-type"] == "revisit") == ("warc-refers-to" in h)
        assert h["warc-type"] == "response" or responses[h["warc-refers-to"]]["warc-payload-digest"] == h["warc-payload-digest"]
    assert warc.archive(df.limit(0), str(tmp_path / "e")).count() == 0


def test_revisit_is_resolved_from_what_was_read(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "same"), (2, "b", "same")], "page_id long, url string, html string")
    path = warc.write(warc.resolve(df), str(tmp_path / "w"))
    for f in (tmp_path / "w").glob("*.gz"):
        body = gzip.open(f).read().replace(b"\r\n\r\nsame", b"\r\n\r\nSAME")
        with gzip.open(f, "wb") as out:
            out.write(body)
        (tmp_path / "w" / f".{f.name}.crc").unlink(missing_ok=True)
    found = warc.read(spark, path, payloads=False).collect()
    got = {r.page_id: r for r in found}
    digest = base64.b32encode(hashlib.sha1(b"SAME").digest()).decode()
    assert len(found) == 2, found
    assert got["2"].record_type == "revisit" and got["2"].refers_to == "1" and got["2"].payload_digest == digest == got["1"].payload_digest
