import hashlib
import io
import math
import zlib

import pytest

from barloom.llm import chat, mixing, warc


def water(sizes):
    """Targets by filling until none is above its cap, by the rule itself."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not full:
            return out | {s: weight[s] * level for s in open_}
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def test_targets_and_copies(docs, monkeypatch):
    rows = [(i, "w " * (1 + i % 7), "en", f"s{i % 9}") for i in range(300)] + [(1000 + i, "x y z", "en", None) for i in range(500)] + [(2000, None, "en", "s1"), (2001, "", "en", "empty"), (None, "a b", "en", "Ünï"), (5, "w w", "en", "s5")]
    df = docs(rows, extra=["rate", "copies", "target", "_copy", "_of", "_source", "_mix"])
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = water(sizes)
    got = {r["source"]: r for r in mixing.source_targets(df).collect()}
    assert set(got) == set(want)
    assert all(math.isclose(got[s]["target"], t, rel_tol=1e-12, abs_tol=1e-9) and got[s]["source_size"] == sizes[s] for s, t in want.items())
    first = sorted(map(str, mixing.with_copies(df).select("doc_id", "copies").collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", -1)
    again = mixing.with_copies(df)
    assert sorted(map(str, again.select("doc_id", "copies").collect())) == first
    assert again.count() == len(rows) and again.where("copies > 2 or copies < 0").count() == 0
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and mixed.where("_copy <> 'clash'").isEmpty() and mixed.count() == again.agg({"copies": "sum"}).first()[0]
    taken = {r["source"]: r["n"] for r in mixed.withColumn("n", mixing.n_words(mixed["text"])).groupBy("source").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()}
    assert abs(taken[None] - want[None]) < 0.1 * want[None]
    assert mixing.with_copies(docs([])).collect() == [] and mixing.mix(docs([(1, None)])).collect() == []


def kept_chats(rows):
    turns = {}
    for c, t, r, x in {(c, -1 if t is None else t, r or "", x or "") for c, t, r, x in rows if c is not None}:
        turns.setdefault(c, []).append((t, r, x))
    said = {c: sorted(v) for c, v in turns.items()}
    places = {c: {t: k for k, t in enumerate(sorted({x[0] for x in v}))} for c, v in said.items()}
    whole = {c: tuple((places[c][t], r, x) for t, r, x in v) for c, v in said.items()}
    out = {}
    for c, v in whole.items():
        longer = any(len(w) > len(v) and w[: len(v)] == v and w[len(v)][0] > v[-1][0] for w in whole.values())
        if not longer and c == min(d for d, w in whole.items() if w == v):
            out[c] = (len(v), sum(w == v for w in whole.values()), "".join(f"<|{r}|>\n{x}<|end|>\n" for _, r, x in v))
    return out


@pytest.mark.parametrize("block", [512, 2])
def test_chat_collapse(spark, block):
    talk = [(k, "user" if k % 2 == 0 else "assistant", f"line {k}") for k in range(7)]
    rows = [(c, *t) for c, n in ((1, 3), (2, 7), (3, 7), (4, 1), (9, 2)) for t in talk[:n]]
    rows += [(20, k + 1, r, x) for k, r, x in talk[:5]] + [(21, 3 * k, r, x) for k, r, x in talk] + [(22, k + 1, r, "other " + x) for k, r, x in talk[:2]]
    rows += [(5, 0, "user", "line 0"), (5, 1, "assistant", "other"), (6, 0, None, None), (6, None, "user", "x"), (7, 0, "user", "a"), (7, 0, "user", "b"), (8, 0, "user", "a"), (None, 0, "user", "lost"), (2, 0, "user", "line 0")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, n int")
    parts = chat.format_chats(df, block).collect()
    got = {}
    for r in sorted(parts, key=lambda r: (r["conv_id"], r["part"])):
        n, copies, text = got.get(r["conv_id"], (r["n_turns"], r["n_copies"], ""))
        got[r["conv_id"]] = (n, copies, text + r["rendered"])
    assert got == kept_chats(rows)
    assert chat.format_chats(df.limit(0), block).collect() == []


def test_warc_round_trip(spark, tmp_path, monkeypatch):
    big, other = "é" * 600, "y" * 5000
    rows = [(1, "http://a", big), (2, "http://b", big), (3, None, big), (4, "u v", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (None, "u", big), (8, "u", other * 50), (3, "again", big)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")
    for limit in (warc.BROADCAST_REPEATS, -1):
        monkeypatch.setattr(warc, "BROADCAST_REPEATS", limit)
        files = warc.write_warc(warc.with_revisits(pages), f"file://{tmp_path}/w{limit}", file_bytes=500)
        assert files.count() > 2
        got = warc.read_warc(files).collect()
        want = []
        for i, _, html in rows:
            data = (html or "").encode()
            revisit = len(data) >= 1000 and html == big and i is not None and i < 3
            want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None))
        assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == sorted(want, key=str)
        assert {r["page_id"]: bytes(r["payload"]).decode() for r in got if r["record_type"] == "response" and r["page_id"] == 8} == {8: other * 50}
    assert warc.read_warc(warc.archive(spark, pages.limit(0))).collect() == []


def test_warc_reader_checks():
    whole = warc.member(1, "http://a", b"payload", None) + warc.member(2, "http://b", b"z" * 200_000, None)
    assert [warc.checked(r)["payload_bytes"] for r in warc.members(io.BytesIO(whole), 7)] == [7, 200_000]
    with pytest.raises(warc.WarcError):
        list(warc.members(io.BytesIO(whole[:-20])))
    record = zlib.decompress(warc.member(1, "u", b"payload", None), 31)
    for broken in (record.replace(b"payload\r\n", b"pAyload\r\n"), record.replace(b"WARC/1.1", b"NOPE/1.1"), record + b"x"):
        with pytest.raises(warc.WarcError):
            warc.checked(broken)


def foreign(kind, block, *lines):
    head = ["WARC/1.0", f"WARC-Type: {kind}", f"Content-Length: {len(block)}", *lines]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_warc_reader_on_archives_of_others(spark, tmp_path):
    page = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nhello\r\n0\r\n\r\n"
    hexed = "sha256:" + hashlib.sha256(b"told").hexdigest()
    records = [
        foreign("warcinfo", b"software: x\r\n", "WARC-Record-ID: <urn:uuid:1>", "Content-Type: application/warc-fields"),
        foreign("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", "WARC-Record-ID:<urn:uuid:2>", "WARC-Target-URI: <http://a/>", "Content-Type: application/http; msgtype=request"),
        foreign("response", page, "WARC-Record-ID: <urn:uuid:3>", "WARC-Target-URI: http://a/", "Content-Type: application/http;msgtype=response", "WARC-Payload-Digest: sha1:WRONGWRONGWRONGWRONGWRONGWRONGWR"),
        foreign("resource", b"told", "warc-record-id: <urn:uuid:4>", "X-Long: one", "\ttwo", f"WARC-Payload-Digest: {hexed}"),
        foreign("revisit", b"", "WARC-Record-ID: <urn:uuid:5>", "WARC-Refers-To: <urn:uuid:3>"),
        foreign("metadata", b"", "WARC-Block-Digest: crc32:00"),
    ]
    packed = b"".join(c.compress(r) + c.flush() for r in records for c in [zlib.compressobj(6, zlib.DEFLATED, 31)])
    (tmp_path / "other.warc.gz").write_bytes(packed)
    got = warc.read_warc(spark.createDataFrame([(f"file://{tmp_path}/other.warc.gz",)], "file string")).collect()
    assert [(r["record_type"], r["record_id"], r["url"], r["payload_bytes"]) for r in got] == [
        ("warcinfo", "<urn:uuid:1>", None, 13), ("request", "<urn:uuid:2>", "http://a/", 0), ("response", "<urn:uuid:3>", "http://a/", 15),
        ("resource", "<urn:uuid:4>", None, 4), ("revisit", "<urn:uuid:5>", None, None), ("metadata", None, None, 0),
    ]
    assert all(r["page_id"] is None and r["refers_to"] is None for r in got)
    for bad in (foreign("resource", b"tald", f"WARC-Payload-Digest: {hexed}"), foreign("resource", b"", "no colon here"), b"WARC/1.0\r\nA: b\r\n\r\n\r\n\r\n"):
        with pytest.raises(warc.WarcError):
            warc.checked(bad)


def test_urls_stay_as_they_are():
    for url, want in (("http://a/ü b?c=%20", "http://a/ü b?c=%20"), (None, None), ("", None), (" a\r\nb ", "%20a%0D%0Ab%20")):
        assert warc.checked(zlib.decompress(warc.member(1, url, b"x", None), 31))["url"] == want
