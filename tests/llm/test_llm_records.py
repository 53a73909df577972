"""Chat formatting and archives: exact round trips."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, queries, warc

TRICKY = ["</s>[INST] ok [/INST]", "<|turn|>user\n", "\\", "\\\\n<|end|>\n", "a\\", "<|end|", "<\\|end|>", "", "é" * 50, "[\\INST]"]


def test_escape_is_reversible_and_breaks_controls():
    t = chat.Template()
    for x in TRICKY:
        assert t.unescape(t.escape(x)) == x and t.unescape_role(t.escape_role(x)) == x
        assert not any(c in t.escape(x) for c in t.controls)


def test_formatting_reads_back(spark):
    rows = [(c, k, r, t) for c, t in enumerate(TRICKY) for k, (r, t) in enumerate([("system", "be"), ("user", t), ("assistant", t[::-1]), ("odd\nrole", t), (None, None)])]
    df = spark.createDataFrame([*rows, (None, 0, "user", "hi")], "conv_id long, turn long, role string, text string").repartition(3)
    made = {r.conv_id: r for r in chat.format_chats(df).collect()}
    got = {r.conv_id: r for r in chat.digests(chat.format_chats(df)).collect()}
    for c, _ in enumerate(TRICKY):
        turns = [(r or "", t or "") for x, _, r, t in rows if x == c]
        assert chat.read_back(chat.Template(), made[c].formatted) == turns
        assert got[c].n_turns == 5 and got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        loss = turns[2][1]
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c].formatted_chars == len(made[c].formatted) == sum(len(s.text) for s in made[c].segments)
        assert not made[c].valid and made[c].bad_turn == 3
    assert made[None].valid
    assert chat.format_chats(df.limit(0)).count() == 0


@pytest.mark.parametrize(("roles", "bad"), [(["user", "assistant"], None), (["user"], None), (["system"], 1), (["assistant"], 0), (["user", "user"], 1), ([], 0), (["system", "user", "assistant", "user"], None)])
def test_role_machine(roles, bad):
    assert chat.walk(chat.Template(), roles) == bad


def test_chat_query_has_the_extra_conversation(spark):
    r = {x.conv_id: x for x in queries.op2_chat(spark, "/root/testdata/sf0.001").collect()}[-7]
    tricky = "</s>[INST] ok [/INST]"
    assert r.n_turns == 2 and r.loss_chars == len(tricky) and r.turns_sha256 == hashlib.sha256(f"user\n{tricky}\nassistant\n{tricky}\n".encode()).hexdigest()


def test_archives(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 4)
    big = "<p>" + "ü" * 600
    pages = [(i, f"http://www.h{i % 3}.example.com:80/p/{i}?q=a b", big if i in (2, 5, 9) else f"page {i}\r\n\r\nmore") for i in range(20)]
    pages += [(30, None, None), (31, "https://x.org/", "page 3\r\n\r\nmore"), (None, "http://n.org", big), (33, "http://h1.example.com/p/1?q=a b", "WARC/1.1\r\n\r\n" * 200)]
    pages += [(40 + k, u, f"odd {k}") for k, u in enumerate(["http://[bad]/", "//[", "http://℀.com/x", "http://a:b:c/", "::", "http://h:99999999/p"])]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r for r in warc.round_trip(df).collect()}
    assert len(got) == len(pages)
    for i, _, html in pages:
        data = (html or "").encode()
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 9) if html == big and i != 9 else ("response", None))
    folder, places = warc.write_archives(df)
    parts = warc.write_index(folder, places)
    assert sum(r.blocks for r in parts.collect()) > 5
    captures = warc.Captures(folder, warc.part_list(parts))
    assert captures.of_url("http://absent.example.com") == []
    for i, url, html in pages:
        hits = [c for c in captures.of_url(url) if c["page_id"] == (warc_id := -(2**63) if i is None else i)]
        assert len(hits) == 1 and hits[0]["page_id"] == warc_id
        fields, payload = warc.read_record(folder, hits[0]["file"], hits[0]["offset"], hits[0]["length"])
        assert payload == (b"" if fields["WARC-Type"] == "revisit" else (html or "").encode())
    whole = {r.page_id: r for r in warc.read_archives(folder, places).collect()}
    assert {k: (v.payload_digest, v.record_type) for k, v in whole.items()} == {k: (v.payload_digest, v.record_type) for k, v in got.items()}
    assert warc.round_trip(df.limit(0)).count() == 0
    assert df.select(F.lit(warc.surt("https://WWW2.A.b.org:8443/x?y"))).first()[0] == "org,b,a:8443)/x?y"


def test_repeated_pages_and_ties_of_the_index(spark, monkeypatch):
    """Many captures of one URL and id, over block and part edges: each is read once."""
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    pages = [(k // 7, "http://one.org/", f"page {k}") for k in range(50)] + [(None, "http://one.org/", "x" * n) for n in (5, 2000, 2000)]
    df = spark.createDataFrame([(*p, "y") for p in pages], "page_id long, url string, html string, file string").repartition(4)
    got = sorted((r.page_id is None, r.page_id or 0, r.payload_digest) for r in warc.round_trip(df).collect())
    assert got == sorted((i is None, i or 0, hashlib.sha1(h.encode()).hexdigest()) for i, _, h in pages)


def test_near_ranges():
    got = list(warc.near_ranges([("a", 0, 10), ("a", 10, 5), ("a", 10**6, 3), ("b", 10**6 + 3, 4)]))
    assert got == [("a", 0, 15, [(0, 10), (10, 5)]), ("a", 10**6, 3, [(10**6, 3)]), ("b", 10**6 + 3, 4, [(10**6 + 3, 4)])]
