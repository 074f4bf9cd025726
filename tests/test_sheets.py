import zipfile

from newsloom.sources import sheets

M = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def workbook(path, late=False):
    parts = {
        "xl/workbook.xml": f'<workbook {M} {R}><workbookPr{" date1904=\'1\'" if late else ""}/><sheets><sheet name="Review" sheetId="1" r:id="rId1"/><sheet name="More" sheetId="2" r:id="rId2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId2" Target="/xl/worksheets/b.xml"/><Relationship Id="rId1" Target="worksheets/a.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {M}><si><t>url</t></si><si><r><t>final</t></r><r><t> keep</t></r><rPh><t>no</t></rPh></si><si><t>https://a.in/é &amp; b</t></si></sst>",
        "xl/styles.xml": f'<styleSheet {M}><numFmts><numFmt numFmtId="170" formatCode="0.0 &quot;days&quot;"/><numFmt numFmtId="171" formatCode="[$-409]yyyy/mm/dd hh:mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>',
        "xl/worksheets/a.xml": f'<worksheet {M}><sheetData><row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c><c r="D2" t="inlineStr"><is><t> day </t></is></c></row>'
        '<row r="3"><c r="A3" t="s"><v>2</v></c><c r="C3"><v>1</v></c><c r="D3" s="1"><v>45356</v></c></row><row r="4"><c r="B4"/></row><row r="6"><c r="A6" t="str"><f>1</f><v>x</v></c><c r="C6" t="b"><v>0</v></c><c r="D6" s="3"><v>45356.5</v></c><c r="AB6" s="2"><v>2.5</v></c></row></sheetData></worksheet>',
        "xl/worksheets/b.xml": f'<worksheet {M}><sheetData><row><c><v>7</v></c></row></sheetData></worksheet>',
    }
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in parts.items():
            book.writestr(name, text)


def test_sheets_with_gaps_and_dates(spark, tmp_path):
    workbook(tmp_path / "a.xlsx")
    got = sorted((r.sheet, r.row, r.cells) for r in sheets.read_sheets(spark, f"file://{tmp_path}/*.xlsx").collect())
    last = ["x", None, "false", "2024-03-05 12:00:00", *[None] * 23, "2.5"]
    assert got == [("More", 1, ["7"]), ("Review", 2, ["url", None, "final keep", " day "]), ("Review", 3, ["https://a.in/é & b", None, "1", "2024-03-05"]), ("Review", 4, [None, None]), ("Review", 6, last)]
    rows = sheets.records(sheets.read_sheets(spark, f"file://{tmp_path}/*.xlsx"), "Review", ["day", "url", "final keep", "other"]).orderBy("row").collect()
    assert [tuple(r)[1:] for r in rows] == [(3, "2024-03-05", "https://a.in/é & b", "1", None), (6, "2024-03-05 12:00:00", "x", "false", None)]
    workbook(tmp_path / "b.xlsx", late=True)
    assert sheets.read_sheets(spark, f"file://{tmp_path}/b.xlsx").where("row = 3").first().cells[3] == "2028-03-06"
