"""PDF files made here: numbered lines, cleaned copies, broken files."""

import zlib

import pytest
from pyspark.sql import functions as F

from tessera.sources import pdf


def made(contents, packed=False, flate=True, resources=b"<< /Font << /F1 5 0 R >> >>", fonts=None, junk=b""):
    """A file with a page per content; packed puts all objects but streams into an object stream."""
    objects, streams = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 5: b"<< /Type /Font /Subtype /Type1 /BaseFont /Times >>", **(fonts or {})}, {}
    kids = []
    for k, c in enumerate(contents):
        page, stream = 10 + 2 * k, 11 + 2 * k
        kids.append(b"%d 0 R" % page)
        objects[page] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % stream
        streams[stream] = (b"/Filter /FlateDecode ", zlib.compress(c)) if flate else (b"", c)
    objects[2] = b"<< /Type /Pages /Resources " + resources + b" /Kids [" + b" ".join(kids) + b"] /Count %d >>" % len(kids)
    streams |= {k: (b"", v[1]) for k, v in objects.items() if isinstance(v, tuple)}
    objects = {k: v for k, v in objects.items() if not isinstance(v, tuple)}
    out = junk + b"%PDF-1.5\n"
    if packed:
        bodies, heads, at = [], [], 0
        for k, v in objects.items():
            heads.append(b"%d %d" % (k, at))
            bodies.append(v + b"\n")
            at += len(bodies[-1])
        head = b" ".join(heads) + b"\n"
        streams[90] = (b"/Type /ObjStm /N %d /First %d /Filter /FlateDecode " % (len(objects), len(head)), zlib.compress(head + b"".join(bodies)))
        objects = {}
    for k, v in objects.items():
        out += b"%d 0 obj\n%s\nendobj\n" % (k, v)
    for k, (entries, body) in streams.items():
        out += b"%d 0 obj\n<< %s/Length %d >>\nstream\n%s\nendstream\nendobj\n" % (k, entries, len(body), body)
    return out + b"trailer << /Root 1 0 R >>\nstartxref\n0\n%%EOF\n"


def page(first, texts, author=False):
    """Lines of text with their numbers at the right, as the numbered review style prints them."""
    out = [b"BT /F1 11 Tf"]
    if author:
        out.append(b"1 0 0 1 72 760 Tm [(Anon) 10 (ymous) -300 (A) 40 (CL) -300 (submission)] TJ")
    for i, t in enumerate(texts):
        y = 700 - 12 * i
        out.append(b"1 0 0 1 72 %d Tm [%s] TJ" % (y, t))
        out.append(b"1 0 0 1 500 %d Tm [(%03d)] TJ" % (y, first + i))
    return b"\n".join([*out, b"ET"])


LINES = [b"(The) -333 (\\(first\\)) -333 (line)", b"(hy) 20 (phen-)", b"(ates)", b"(in 1234 tokens)"]
WANT = {0: "The (first) line", 1: "hyphen-", 2: "ates", 3: "in 1234 tokens", 4: "The (first) line", 5: "hyphen-", 6: "ates", 7: "in 1234 tokens"}
NO_NUMBER = b"BT /F1 9 Tf 72 40 Td (Proceedings) Tj ET"


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("pdf")
    pages = [page(0, LINES, author=True), page(4, LINES) + b"\n" + NO_NUMBER]
    for name, data in {
        "flate": made(pages), "plain": made(pages, flate=False), "packed": made(pages, packed=True), "junk": made(pages, junk=b"HTTP/1.1 200 OK\r\n\r\n"),
    }.items():
        (root / f"{name}.pdf").write_bytes(data)
    return pdf.pdf_files(spark, str(root)).withColumn("path", F.regexp_extract("path", r"([^/]+)\.pdf$", 1))


def test_numbered_lines(files):
    got = {}
    for r in pdf.pdf_lines(files).collect():
        got.setdefault(r.path, {})[r.line_no] = r.text
    assert set(got) == {"flate", "plain", "packed", "junk"}
    assert all(x == WANT for x in got.values())


def test_cleaned_copies_have_no_numbers_and_cleaning_twice_changes_nothing(files):
    once = pdf.cleaned_files(files)
    assert once.where("error is not null").count() == 0
    ops = pdf.text_operations(once, content="cleaned")
    said = {r.path: r.all for r in ops.orderBy("ord").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ord", "bare"))).alias("all")).collect()}
    want = [*(w.replace(" ", "") for w in WANT.values()), "Proceedings"]
    for x in said.values():
        assert [y.bare.replace(" ", "") for y in x] == want
    twice = pdf.cleaned_files(once.select("path", F.col("cleaned").alias("content")))
    assert twice.join(once.withColumnRenamed("cleaned", "first"), "path").where("cleaned = first").count() == 4
    # the same operations are left by the joins over rows
    rows = pdf.unnumbered_operations(pdf.text_operations(files))
    left = rows.join(ops.select("path", F.col("bare").alias("b")).distinct(), (rows.path == ops.path) & (rows.bare == F.col("b")), "left_semi")
    assert rows.count() == left.count() == ops.count()


def test_fonts(spark):
    cmap = b"/CIDInit begincmap 2 beginbfchar <0003> <0020> <0041> <00660069> endbfchar 1 beginbfrange <0010> <0012> <0061> endbfrange 1 beginbfrange <0020> <0021> [<0041> <D83DDE00>] endbfrange endcmap"
    fonts = {
        5: b"<< /Type /Font /Subtype /Type0 /ToUnicode 6 0 R >>", 6: (b"", cmap),
        7: b"<< /Type /Font /Subtype /Type1 /Encoding << /Differences [1 /fi /eacute 200 /zero /uni00DF /odd] >> >>",
    }
    content = b"BT /F1 9 Tf <00100011000300410020 0021> Tj T* /F2 9 Tf (\\001\\002\\310\\311\\312\\223) ' ET"
    data = made([content], resources=b"<< /Font << /F1 5 0 R /F2 7 0 R >> >>", fonts=fonts)
    got = [r.text for r in pdf.text_operations(spark.createDataFrame([("a", data)], "path string, content binary")).orderBy("ord").collect()]
    assert got == ["ab fiA\U0001f600", "fié0ß“"]


def test_broken_files_have_a_reason_and_strict_raises(spark):
    good = made([page(0, LINES)])
    rows = [("empty", b""), ("null", None), ("text", b"no file"), ("cut", good[:150]), ("locked", good.replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt 3 0 R")), ("other", good.replace(b"/FlateDecode", b"/LZWDecode  ")), ("good", good), ("none", made([NO_NUMBER]))]
    df = spark.createDataFrame(rows, "path string, content binary")
    ops = pdf.text_operations(df)
    bad = {r.path for r in ops.where("error is not null").collect()}
    assert bad >= {"empty", "null", "text", "locked", "other"} and not bad & {"good", "none"}
    assert {r.path for r in pdf.pdf_lines(df, strict=False).collect()} == {"good"}
    with pytest.raises(Exception, match="no line numbers"):
        pdf.pdf_lines(df.where("path = 'none'")).collect()
    with pytest.raises(Exception, match="no PDF header"):
        pdf.pdf_lines(df.where("path = 'text'")).collect()
    assert {r.path for r in pdf.cleaned_files(df).where("error is null").collect()} >= {"good", "none"}


def test_forms_and_moves(spark):
    fonts = {6: (b"", b"BT /F1 9 Tf 10 20 Td (inside) Tj ET")}
    data = made([b"q 1 0 0 1 5 5 cm /X1 Do Q BT /F1 9 Tf 12 TL 1 0 0 1 50 100 Tm (a) Tj T* (b) Tj 0 -3 TD (c) Tj (d) ' ET"], fonts=fonts, resources=b"<< /Font << /F1 5 0 R >> /XObject << /X1 6 0 R >> >>")
    data = data.replace(b"6 0 obj\n<< ", b"6 0 obj\n<< /Subtype /Form ")
    got = [(r.text, r.x, r.y) for r in pdf.text_operations(spark.createDataFrame([("a", data)], "path string, content binary")).orderBy("ord").collect()]
    assert got == [("inside", 15, 25), ("a", 50, 100), ("b", 50, 88), ("c", 50, 85), ("d", 50, 82)]


def test_small_files_share_batches_and_odd_tokens_are_read():
    import pyarrow as pa

    names = [f"f{i}" for i in range(300)]
    batch = pa.RecordBatch.from_pydict({"_key": names, "_content": [b"%PDF-1.4\n", None] * 150})
    out = list(pdf._operations(iter([batch, batch])))  # a batch a file before
    assert len(out) == 1 and out[0].column(0).to_pylist() == names * 2
    data = b"%x\n 12 -.5 " + b" " * 50_000 + b"< <4 1> <414> /A#42 [1 0 R (a(b)\\051)] <</K true>> Tj" + b"\n" * 50_000
    got = list(pdf.values(data))
    assert [v for v, _, _ in got] == [12, -0.5, b"A", b"A@", "AB", [pdf.Ref(1, 0), b"a(b))"], {"K": True}, b"Tj"]
    assert [data[a:b] for _, a, b in got][:5] == [b"12", b"-.5", b"<4 1>", b"<414>", b"/A#42"]
