import struct
import zipfile
from io import BytesIO

import pytest
from pyspark.sql import functions as F

from quarry.operators import catalog, ingest
from quarry.sources import readers, tables
from quarry.sources.files import in_body, is_readable_image, read_elements, read_files


def to_chunks(files):
    return files.select(F.concat("document_id", F.lit("#0")).alias("chunk_id"), "document_id", F.decode("content", "UTF-8").alias("content")).where("content <> ''")


def files(spark, rows):
    return spark.createDataFrame([(i, n, b.encode()) for i, (n, b) in enumerate(rows)], "file_no int, file_name string, content binary")


def state(log):
    return [(r.file_no, r.status, r.chunk_count) for r in log.orderBy("file_no").collect()]


def test_ingest_is_idempotent_and_replaces(spark, tmp_path):
    store = ingest.Store(spark, str(tmp_path))
    batch = files(spark, [("a.md", "one"), ("b.md", "one"), ("c.txt", "x"), ("d.md", ""), ("e.md", "old"), ("e.md", "new")])
    log = ingest.ingest(batch, store, to_chunks, task_id="t1")
    assert state(log) == [(0, "imported", 1), (1, "skipped", 0), (2, "rejected", 0), (3, "imported", 0), (4, "imported", 0), (5, "imported", 1)]
    stored = {(r.document_id, r.content) for r in store.read().collect()}
    assert stored == {("a.md", "one"), ("e.md", "new")}
    again = ingest.ingest(batch, store, to_chunks, task_id="t2")
    assert [s for _, s, _ in state(again)][:2] == ["skipped", "skipped"]
    assert {(r.document_id, r.content) for r in store.read().collect()} >= {("a.md", "one")}
    ingest.ingest(files(spark, [("a.md", "two")]), store, to_chunks, task_id="t3")
    assert ("a.md", "two") in {(r.document_id, r.content) for r in store.read().collect()}
    assert store.delete(["a.md"]) == 1 and store.delete(["a.md"]) == 0
    assert ingest.tasks(log.unionByName(again)).where("task_id = 't1'").first().status == "completed"


def test_versions_add_up(spark, tmp_path, monkeypatch):
    store = ingest.Store(spark, str(tmp_path), "chunk_id string, document_id string, content string")
    rows = lambda *xs: spark.createDataFrame(xs, "chunk_id string, document_id string, content string")
    now = lambda: sorted(tuple(r) for r in store.read().select("chunk_id", "document_id", "content").collect())
    store.upsert(rows(("1", "a", "x"), ("2", "a", "y"), ("3", "b", "z"), ("4", None, "n")))
    store.upsert(rows(("5", "a", "new")))
    store.upsert(rows(("6", "c", "w")), spark.createDataFrame([("b",)], "document_id string"))
    want = [("4", None, "n"), ("5", "a", "new"), ("6", "c", "w")]
    assert sorted(map(str, now())) == sorted(map(str, want)) and store.part(3).count() == 1
    assert store.read(1).count() == 4
    assert store.compact() == 4 == store.compact() and sorted(map(str, now())) == sorted(map(str, want))
    store.vacuum()
    assert store._pointers() == [4] and sorted(map(str, now())) == sorted(map(str, want))
    monkeypatch.setattr(ingest, "MOST_DELTAS", 1)
    for i in range(3):
        store.upsert(rows((str(i), "d", str(i))))
    assert ("2", "d", "2") in now() and len(now()) == 4
    # types are those of the schema
    store.write(spark.createDataFrame([(1, "a", 5)], "chunk_id long, document_id string, content int"))
    assert store.read().schema["chunk_id"].dataType.simpleString() == "string"


def test_files_that_fail(spark, tmp_path):
    """A row with an error fails its file; a fault that breaks the job fails the file that has it."""
    store = ingest.Store(spark, f"{tmp_path}/a")
    told = lambda f: to_chunks(f).withColumn("error", F.when(F.col("content") == "bad", "cannot be read"))
    log = ingest.ingest(files(spark, [("a.md", "one"), ("b.md", "bad"), ("c.md", "two")]), store, told, task_id="t")
    assert state(log) == [(0, "imported", 1), (1, "failed", 0), (2, "imported", 1)]
    assert log.where("status = 'failed'").first().error == "cannot be read" and store.read().count() == 2
    assert ingest.tasks(log).first().status == "partial_failed"
    other = ingest.Store(spark, f"{tmp_path}/b")
    broken = lambda f: to_chunks(f).withColumn("content", F.when(F.col("content") == "bad", F.raise_error(F.lit("broken file"))).otherwise(F.col("content")))
    batch = files(spark, [("a.md", "one"), ("b.md", "bad"), ("c.md", "two"), ("a.md", "three"), ("d.md", "two")])
    log = ingest.ingest_each(batch, other, broken, task_id="t", attempts=2, delay=0)
    assert [s for _, s, _ in state(log)] == ["imported", "failed", "imported", "imported", "skipped"]
    assert "broken file" in log.where("status = 'failed'").first().error
    assert {(r.document_id, r.content) for r in other.read().collect()} == {("a.md", "three"), ("c.md", "two")}


def test_failed_version_is_never_seen(spark, tmp_path):
    store = ingest.Store(spark, str(tmp_path))
    with pytest.raises(Exception, match=r"(?i)division|divide"):
        store.write(spark.range(5).select(F.expr("1 div (id - 3)").cast("string").alias("chunk_id")))
    assert store.version() == 0 and store.read().count() == 0


def test_retry():
    calls = []

    def run():
        calls.append(1)
        if len(calls) < 3:
            raise ValueError
        return "done"

    assert ingest.retried(run, delay=0) == "done" and len(calls) == 3
    with pytest.raises(ValueError):
        ingest.retried(lambda: (_ for _ in ()).throw(ValueError()), attempts=1)


def test_catalog_of_unknown_documents(spark):
    rows = spark.createDataFrame([("c1", None, "x", "2024-01-01"), ("c2", "d", "y", None)], "chunk_id string, document_id string, content string, uploaded_at string")
    assert [(r.document_id, r.chunk_count) for r in catalog.catalog(rows).collect()] == [("(未知)", 1), ("d", 1)]
    got = {r.document_id: r.previews for r in catalog.detail(rows).collect()}
    assert got == {None: ["x"], "d": ["y"]}


def docx(body):
    space = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    out = BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {space}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def para(text, style=None):
    style = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f"<w:p>{style}<w:r><w:t>{text}</w:t></w:r></w:p>"


def table(rows):
    cell = lambda c: f"<w:tc>{para(c)}</w:tc>"
    return "<w:tbl>" + "".join("<w:tr>" + "".join(map(cell, r)) + "</w:tr>" for r in rows) + "</w:tbl>"


def test_docx():
    got = readers.read_docx(docx(para("Title", "Heading2") + para(" ") + para("body") + table([["a", "b"], ["", ""], ["c"]]) + para("w " * 800, "Heading1")))
    assert [(kind, level) for _, _, kind, level, _ in got] == [("header", 2), ("para", None), ("table", None), ("para", None), ("para", None)]
    assert got[2][4] == "| a | b |\n| --- | --- |\n| c |  |\n"
    assert [len(x[4].split()) for x in got[3:]] == [700, 100]


def test_table_groups():
    count = readers.count_tokens
    assert [len(r) for _, r in tables.group_rows([["x"]] * 25, count)] == [10, 10, 5]
    long = ["w " * 720, "cell", ""]
    assert [k for k, _ in tables.group_rows([["a"], long, ["b"]], count)] == ["table", "para", "para", "table"]


def test_markdown():
    got = readers.read_markdown("# T #\nline\r\n\r\nnext\n####### no\n".encode())
    assert [(k, lv, t) for _, _, k, lv, t in got] == [("header", 1, "T"), ("para", None, "line"), ("para", None, "next\n####### no")]


def compound(streams):
    """A compound file of sectors of 512 bytes; every stream is long enough for them."""
    names, chains, body = list(streams), [], b""
    fat = [0xFFFFFFFD, 0xFFFFFFFE]  # table and directory
    for data in streams.values():
        data = data.ljust(max(4096, -(-len(data) // 512) * 512), b"\0")
        first = len(fat)
        n = len(data) // 512
        fat += [first + i + 1 for i in range(n - 1)] + [0xFFFFFFFE]
        chains.append((first, len(data)))
        body += data
    entry = lambda name, kind, first, size: (name.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HBB", 2 * len(name) + 2, kind, 1) + b"\xff" * 12 + b"\0" * 36 + struct.pack("<IQ", first, size))
    directory = entry("Root Entry", 5, 0xFFFFFFFE, 0) + b"".join(entry(n, 2, *c) for n, c in zip(names, chains, strict=True))
    directory = directory.ljust(512, b"\0")
    head = bytes.fromhex("d0cf11e0a1b11ae1") + b"\0" * 16 + struct.pack("<HHHHH6x7I", 62, 3, 0xFFFE, 9, 6, 0, 1, 1, 0, 4096, 0xFFFFFFFE, 0)
    head += struct.pack("<2I", 0xFFFFFFFE, 0)[:4] + b""
    head = head[:68] + struct.pack("<II", 0xFFFFFFFE, 0) + struct.pack("<109I", 0, *[0xFFFFFFFF] * 108)
    table = struct.pack(f"<{len(fat)}I", *fat).ljust(512, b"\xff")
    return head + table + directory + body


def test_doc():
    texts = ["高血压 one\r", "ansi\x07cell\r\rlast"]
    raw = texts[0].encode("utf-16-le"), texts[1].encode("cp936")
    word = bytearray(0x800)
    struct.pack_into("<H", word, 0, 0xA5EC)
    at = [0x600, 0x700]
    word[at[0] : at[0] + len(raw[0])] = raw[0]
    word[at[1] : at[1] + len(raw[1])] = raw[1]
    cps = [0, len(texts[0]), len(texts[0]) + len(texts[1])]
    pcds = struct.pack("<HiH", 0, at[0], 0) + struct.pack("<HIH", 0, at[1] * 2 | 0x40000000, 0)
    plc = struct.pack("<3i", *cps) + pcds
    clx = b"\x01" + struct.pack("<h", 2) + b"zz" + b"\x02" + struct.pack("<i", len(plc)) + plc
    struct.pack_into("<ii", word, 154 + 33 * 8, 16, len(clx))
    data = compound({"WordDocument": bytes(word), "0Table": b"\0" * 16 + clx})
    assert [t for *_, t in readers.read_doc(data)] == ["高血压 one", "ansi cell", "last"]
    with pytest.raises(ValueError, match="compound"):
        readers.read_doc(b"plain")


def test_files_of_a_folder(spark, tmp_path):
    (tmp_path / "a.md").write_text("# h\nbody")
    (tmp_path / "b.DOCX").write_bytes(docx(para("x")))
    (tmp_path / "c.pdf").write_bytes(b"none")
    (tmp_path / "e.png").write_bytes(b"?")
    (tmp_path / "d.bin").write_bytes(b"?")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "e.md").write_text("not listed")
    got = read_elements(read_files(spark, str(tmp_path))).orderBy("document_id", "element_no").collect()
    assert [(r.document_id, r.kind, r.text) for r in got] == [("a.md", "header", "h"), ("a.md", "para", "body"), ("b.DOCX", "para", "x"), ("c.pdf", None, None), ("e.png", None, None)]
    assert "PDF" in got[3].error and "no reader for .png" in got[4].error


def pdf(pages, pack=False):
    """A PDF of (content, resources) pages."""
    import zlib

    def stream(data, head=b""):
        data = zlib.compress(data) if pack else data
        return b"<< %s%s /Length %d >>\nstream\n%s\nendstream" % (head, b"/Filter /FlateDecode" if pack else b"", len(data), data)

    kids = b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(pages)))
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /MediaBox [0 0 100 1000] /Kids [%s] >>" % kids}
    cmap = b"1 begincodespacerange <0000><ffff> endcodespacerange 2 beginbfchar <0001> <9ad8> <0002> <8840> endbfchar 1 beginbfrange <0003> <0004> <538b> endbfrange"
    objects |= {3: b"<< /Type /Font /Subtype /Type0 /ToUnicode 4 0 R >>", 4: stream(cmap), 5: b"<< /Subtype /Image /Width 90 /Height 90 /Filter /DCTDecode /Length 4 >>\nstream\nJPEG\nendstream"}
    for i, content in enumerate(pages):
        objects[10 + 2 * i] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R /Resources << /Font << /F1 6 0 R /F2 3 0 R >> /XObject << /I 5 0 R >> >> >>" % (11 + 2 * i)
        objects[11 + 2 * i] = stream(content)
    objects[6] = b"<< /Type /Font /Subtype /Type1 >>"
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in objects.items()) + b"trailer << /Root 1 0 R >>"


@pytest.mark.parametrize("pack", [False, True])
def test_pdf(pack):
    from quarry.sources.pdf import pdf_reader

    one = rb"""BT /F1 10 Tf 1 0 0 1 10 980 Tm (header) Tj 1 0 0 1 10 500 Tm (First \(line\)\041) Tj 0 -12 Td [(sec) -50 (ond) -400 (line)] TJ
0 -40 Td (other block) Tj 1 0 0 1 10 20 Tm (footer) Tj ET % comment"""
    two = b"q 1 0 0 1 0 100 cm BT /F2 10 Tf 14 TL 10 300 Td <000100020003> Tj T* <0004> Tj ET Q"
    data = pdf([one, two, b""], pack)
    want = [(0, 1, "para", None, "First (line)!\nsecond line"), (0, 1, "para", None, "other block"), (1, 2, "para", None, "高血压\n厌".replace("厌", chr(0x538C)))]
    assert pdf_reader()(data) == want
    long = "recognised text of a page that has no letters of its own"
    read = pdf_reader(lambda picture: f"{long}\n\n next " if picture == b"JPEG" else "")
    assert [x[4] for x in read(data)] == [long, "next"] * 3
    drawn = pdf_reader(lambda picture: f"page {picture!r} {long}" if picture != b"JPEG" else "", lambda data, page: str(page).encode())
    assert [x[4] for x in drawn(data)] == [f"page b'{i}' {long}" for i in (1, 2, 3)]
    with pytest.raises(ValueError, match="not a PDF"):
        pdf_reader()(b"text")


def test_readings(spark):
    from quarry.functions import text as T
    from quarry.sources.pdf import best_reading, image_reader, reading_score

    readings = [("abc noise words", 0.9), ("高血压 患者", 0.5), ("高血压 患者", 0.4), (" ", 1.0)]
    assert best_reading(readings) == "高血压 患者" and best_reading([]) == ""
    df = spark.createDataFrame(readings, "t string, c double")
    assert [r[0] for r in df.select(T.ocr_score(F.col("t"), F.col("c"))).collect()] == pytest.approx([reading_score(*r) for r in readings])
    best = df.agg(F.array_agg(F.struct(F.col("t").alias("text"), F.col("c").alias("confidence"))).alias("r")).select(T.ocr_best(F.col("r"))).first()[0]
    assert best == "高血压 患者"
    assert image_reader(lambda data: data.decode())(b"a\n\n b ") == [(0, 1, "para", None, "a"), (0, 1, "para", None, "b")]


def test_geometry(spark):
    row = spark.range(1).select(in_body(F.lit(8.0), F.lit(92.0), F.lit(100.0)), in_body(F.lit(7.0), F.lit(20.0), F.lit(100.0)), is_readable_image(F.lit(80), F.lit(80), F.lit(40), F.lit(40))).first()
    assert tuple(row) == (True, False, True)


def test_embedding_in_calls(spark):
    from quarry.operators.embedding import batch_size, embed

    class Lengths:
        def embed(self, texts):
            assert len(texts) <= 2
            return [[float(len(t))] for t in texts]

    got = embed(spark.createDataFrame([("a",), ("bbb",), (None,)], "content string").coalesce(1), Lengths(), call=2)
    assert sorted(r.embedding[0] for r in got.collect()) == [0.0, 1.0, 3.0]
    assert (batch_size(0), batch_size(500), batch_size()) == (1, 128, 32)


def shuffled(spark, run):
    """Bytes that the stages of a run wrote to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    total = lambda: sum(x.shuffleWriteBytes() for x in map(stages.apply, range(stages.size())))
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    before = total()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return total() - before


def test_contents_are_not_shuffled(spark, tmp_path):
    """Deciding on files, storing and compacting them moves hashes and names only."""
    import random

    r = random.Random(5)
    content = lambda: "".join(chr(33 + r.randrange(90)) for _ in range(100_000))
    batch = files(spark, [(f"{i}.md", content()) for i in range(20)]).repartition(4).localCheckpoint()
    store = ingest.Store(spark, str(tmp_path))
    stamped = lambda f: to_chunks(f.withColumn("content", F.col("content"))) if "stamp" not in f.columns else f.select(F.col("document_id").alias("chunk_id"), "document_id", F.decode("content", "UTF-8").alias("content"), "stamp")

    def run():
        ingest.ingest(batch, store, stamped, task_id="a")
        ingest.ingest(batch.withColumn("content", F.when(F.col("file_no") < 5, F.encode(F.lit("new"), "UTF-8")).otherwise(F.col("content"))), store, stamped, task_id="b")
        store.compact()

    assert shuffled(spark, run) < 200_000
    assert store.read().count() == 20 and {r.file_size for r in store.read().where("content = 'new'").collect()} == {3}


@pytest.mark.parametrize("bound", [1 << 20, 0])
def test_files_of_one_number(spark, tmp_path, monkeypatch, bound):
    """Repeated rows, and files without a number, are taken once; also where keys are too many to be broadcast."""
    from quarry import storage

    monkeypatch.setattr(storage, "FEW", bound)
    monkeypatch.setattr(ingest, "FEW", bound)
    store = ingest.Store(spark, f"{tmp_path}/a")
    rows = spark.createDataFrame([(1, "a.md", b"one"), (1, "a.md", b"one"), (None, "b.md", b"two"), (None, "b.md", b"two"), (2, "c.md", b"one")], "file_no int, file_name string, content binary")
    log = ingest.ingest(rows, store, to_chunks, task_id="t")
    assert sorted((r.document_id, r.status, r.chunk_count) for r in log.collect()) == [("a.md", "imported", 1), ("a.md", "skipped", 0), ("b.md", "imported", 1), ("b.md", "skipped", 0), ("c.md", "skipped", 0)]
    assert sorted((r.document_id, r.content, r.file_size) for r in store.read().collect()) == [("a.md", "one", 3), ("b.md", "two", 3)]
    other = ingest.Store(spark, f"{tmp_path}/b")
    log = ingest.ingest(files(spark, [("a.md", "one"), ("b.md", "one"), ("c.md", "x"), ("d.txt", "y")]), other, to_chunks, task_id="t")
    assert state(log) == [(0, "imported", 1), (1, "skipped", 0), (2, "imported", 1), (3, "rejected", 0)]
    assert sorted(r.document_id for r in other.read().collect()) == ["a.md", "c.md"]
