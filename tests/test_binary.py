import io
import zipfile
import zlib

from weftgraph.sources import binary


def archive(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), body)
    return out.getvalue()


DOCX = archive(word__document_xml='<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>One </w:t></w:r><w:r><w:t>two</w:t></w:r></w:p><w:p><w:r><w:t>three</w:t></w:r></w:p></w:body></w:document>')
XLSX = archive(xl__sharedStrings_xml="<sst><si><t>bolt</t></si><si><t>nut</t></si></sst>", xl__worksheets__sheet1_xml='<ws><row><c t="s"><v>0</v></c><c><v>4</v></c></row><row><c t="s"><v>1</v></c><c t="inlineStr"><is><t>few</t></is></c></row></ws>')
PPTX = archive(ppt__slides__slide2_xml='<a xmlns:a="a"><a:p><a:t>second</a:t></a:p></a>', ppt__slides__slide1_xml='<a xmlns:a="a"><a:p><a:t>first</a:t></a:p></a>')


def pdf(*pages):
    out = b"%PDF-1.4\n"
    for i, p in enumerate(pages):
        body = zlib.compress(p)
        out += b"%d 0 obj\n<< /Length %d /Filter /FlateDecode >>\nstream\n" % (i, len(body)) + body + b"\nendstream\nendobj\n"
    return out + b"%%EOF"


PDF = pdf(rb"BT /F1 12 Tf (Paid \(in full\)) Tj T* [(to )-20(date)] TJ ET", rb"BT (Page two \351) Tj ET")


def test_parsers():
    assert binary.docx_text(DOCX) == "One two\nthree" and binary.xlsx_text(XLSX) == "bolt\t4\nnut\tfew" and binary.pptx_text(PPTX) == "first\n\nsecond"
    assert binary.pdf_pages(PDF) == ["Paid (in full)\nto date", "Page two é"] and binary.pdf_text(b"%PDF-1.4 nothing") is None and binary.pdf_pages(b"x") == []


def test_files_by_suffix(spark, tmp_path):
    for name, body in {"a.docx": DOCX, "b.pdf": PDF, "c.txt": "grün".encode("latin-1"), "d.docx": b"broken", "e.bin": b"1", "f.txt": b"x" * 5000}.items():
        (tmp_path / name).write_bytes(body)
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.problem) for r in binary.parsed_files(spark, str(tmp_path), most_bytes=4000).collect()}
    assert got["a.docx"] == ("One two\nthree", None) and got["c.txt"] == ("grün", None) and got["d.docx"] == (None, "broken: BadZipFile") and got["e.bin"] == (None, "no parser") and got["f.txt"] == (None, "too large")
    assert {r.path.rsplit("/", 1)[1] for r in binary.parsed_files(spark, str(tmp_path), most_bytes=4000, strict=True).collect()} == {"a.docx", "b.pdf", "c.txt"}
    assert {(r.page, r.text) for r in binary.pdf_page_rows(spark, str(tmp_path)).collect()} == {(0, "Paid (in full)\nto date"), (1, "Page two é")}
