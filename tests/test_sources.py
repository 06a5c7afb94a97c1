import io
import json
import zipfile

import pytest

from acervo.sources.files import binary_files, detected, parsed_blocks
from acervo.sources.snapshots import current_snapshot, digest, pinned, promote, publish_snapshot, recover, verify
from acervo.sources.tables import checked_overrides, manifest_faults, read_manifest, read_samples, read_sheet, write_manifest, write_sheet
from acervo.sources.vault import VaultSource, flat_properties

DOCX = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Contrato</w:t></w:r></w:p><w:p><w:del><w:r><w:delText>fora</w:delText></w:r></w:del><w:ins><w:r><w:t>dentro</w:t></w:r></w:ins></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>célula</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'


def docx(part="word/document.xml"):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(part, DOCX)
    return out.getvalue()


@pytest.fixture
def folder(tmp_path):
    files = {"a.docx": docx(), "b.doc": docx(), "c.docx": docx()[:-30], "d.zip": docx("x"), "e.pdf": b"%PDF-1.4 /Encrypt", "f.rtf": b"{\\rtf1", "g.png": b"\x89PNG....", "h.doc": bytes.fromhex("D0CF11E0A1B11AE1"), "i.bin": b"", "j.wpd": b"\xffWPC", "k.xyz": b"what"}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    return tmp_path


def test_formats(spark, folder):
    got = {r.path.rsplit("/", 1)[1]: (r.format, r.corrupt, r.encrypted, r.extension_mismatch) for r in detected(binary_files(spark, str(folder))).collect()}
    assert got["a.docx"] == ("docx", False, False, False) and got["b.doc"] == ("docx", False, False, True)
    assert got["c.docx"][1] and got["d.zip"][0] == "zip" and got["e.pdf"] == ("pdf", False, True, False)
    assert [got[x][0] for x in ("f.rtf", "g.png", "h.doc", "j.wpd", "k.xyz")] == ["rtf", "image", "ole", "wordperfect", "unknown"]
    # Spark's binary source leaves out files without a byte; given as a row they are known too.
    none = spark.createDataFrame([("/x/i.bin", 0, b""), ("/x/j.bin", 0, None)], "path string, length long, content binary")
    assert {r.format for r in detected(none).collect()} == {"empty"}


def test_blocks_and_failures(spark, folder):
    rows = parsed_blocks(binary_files(spark, str(folder))).collect()
    by = {}
    for r in rows:
        by.setdefault(r.path.rsplit("/", 1)[1], []).append((r.status, r.block_type, r.text))
    assert by["a.docx"] == [("parsed", "title", "Contrato"), ("parsed", "paragraph", "dentro"), ("parsed", "table_cell", "célula")]
    assert by["c.docx"][0][0] == by["k.xyz"][0][0] == "failed" and len(by) == 10


def test_manifest_and_sheet(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, "=a"), (2, 1, "b;c"), (1, 2, 'new "x"')], "id int, seq int, name string")
    write_manifest(df, str(tmp_path / "m"), "id")
    got = read_manifest(spark, str(tmp_path / "m"), "id int, seq int, name string", "id", "seq")
    assert {(r.id, r.name) for r in got.collect()} == {(1, 'new "x"'), (2, "b;c")}
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/a.json").write_text('{"id": 1, "seq": 1, "name": "a"}\n{"id": "x"\n', encoding="utf-8")
    assert [r.line for r in manifest_faults(spark, str(tmp_path / "bad"), "id int, seq int, name string").collect()] == ['{"id": "x"']
    with pytest.raises(Exception, match="(?i)malformed"):
        read_manifest(spark, str(tmp_path / "bad"), "id int, seq int, name string", "id", "seq").collect()
    for name, text in (("array.json", '\n[{"id": 1},\n {"id": 2}]'), ("lines.json", '{"id": 1}\n{"id": 2}\n')):
        (tmp_path / name).write_text(text)
        assert sorted(r.id for r in read_samples(spark, str(tmp_path / name), "id int").collect()) == [1, 2]
    write_sheet(df, str(tmp_path / "s"))
    assert {r.name for r in read_sheet(spark, str(tmp_path / "s")).collect()} == {"=a", "b;c", 'new "x"'}
    (tmp_path / "t.csv").write_text("﻿ ID ,Name\n1,'=x\n", encoding="utf-8")
    assert read_sheet(spark, str(tmp_path / "t.csv")).first().asDict() == {"id": "1", "name": "=x"}


def test_override_problems(spark):
    df = spark.createDataFrame([("1", "include", "ana"), ("x", "maybe", None), ("2", "exclude", "rui"), ("2", "exclude", "rui")], "id string, decision string, reviewed_by string")
    got = [set(r.problems) for r in checked_overrides(df, "id", ["include", "exclude"]).orderBy("id", "decision").collect()]
    assert got == [set(), {"repeated_key"}, {"repeated_key"}, {"bad_key", "bad_decision", "no_reviewer"}]


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "g")
    assert current_snapshot(spark, path) is None
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    publish_snapshot(df, path, "v1")
    publish_snapshot(df.where("id = 1"), path, "v2")
    assert current_snapshot(spark, path).count() == 1 and verify(spark, path, "v1")
    promote(spark, path, "v1")
    assert current_snapshot(spark, path).count() == 2
    df.union(df).write.mode("overwrite").parquet(path + "/v2")
    with pytest.raises(ValueError):
        promote(spark, path, "v2")
    assert digest(df) == digest(df.repartition(3)) != digest(df.union(df))


def test_a_crash_leaves_the_old_snapshot(spark, tmp_path, monkeypatch):
    """Dying before the pointer is renamed keeps the version before; a broken one is recovered from."""
    from acervo.sources import snapshots

    path = str(tmp_path / "g")
    assert recover(spark, path) is None
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    publish_snapshot(df, path, "v1")
    whole = snapshots._write_text
    monkeypatch.setattr(snapshots, "_write_text", lambda s, p, t: whole(s, p + ".new" if p.endswith("/current") else p, t))
    publish_snapshot(df.where("id = 1"), path, "v2")
    monkeypatch.undo()
    assert pinned(spark, path)[0] == "v1" and current_snapshot(spark, path).count() == 2 and recover(spark, path) == "v1"
    df.union(df).write.mode("overwrite").parquet(path + "/v1")
    assert recover(spark, path) == "v2" and current_snapshot(spark, path).count() == 1


def test_vault_source(spark, tmp_path):
    (tmp_path / "structure").mkdir()
    (tmp_path / "objects").mkdir()
    (tmp_path / "structure/properties.json").write_text(json.dumps({"Items": [{"ID": 7, "Name": "Client"}]}))
    item = {"ID": 1, "Version": 2, "Title": "t", "Properties": [{"PropertyDef": 7, "TypedValue": {"DisplayValue": "c"}}, {"PropertyDef": 8, "TypedValue": {"DisplayValue": ""}}]}
    assert flat_properties(item["Properties"], {"7": "Client"}) == {"Client": "c"}
    assert VaultSource.name() == "vault" and "mfiles_id" in VaultSource({}).schema()


def test_vault_over_http(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    answers = {"/structure/properties.json": {"Items": [{"ID": 7, "Name": "Client"}]}, "/objects/10.json?limit=5": {"Items": [{"ID": 1, "Version": 2, "Title": "t", "Properties": [{"PropertyDef": 7, "TypedValue": {"DisplayValue": "c"}}]}, {"ID": 2, "Deleted": True}]}}
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            seen.append(self.path)
            refuse = seen.count(self.path) == 1
            body = json.dumps(answers[self.path]).encode()
            self.send_response(503 if refuse else 200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(VaultSource)
    rows = spark.read.format("vault").option("url", f"http://127.0.0.1:{server.server_port}").option("classes", "10").option("limit", "5").load().collect()
    server.shutdown()
    assert [(r.mfiles_id, r.mfiles_version, r.properties) for r in rows] == [(1, 2, {"Client": "c"})]
