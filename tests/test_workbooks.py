"""Workbooks and R files, written here byte by byte, come back equal."""

import bz2
import gzip
import lzma
import struct
import zipfile

import pytest

from tidemark.sources import ingest
from tidemark.sources.workbooks import column_number, r_rows, sheet_rows

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def workbook(path, first, second="<row r='1'><c r='A1' t='inlineStr'><is><t>other</t></is></c></row>", date1904=False):
    parts = {
        "xl/workbook.xml": f"<workbook {MAIN}><workbookPr date1904='{int(date1904)}'/><sheets><sheet name='Data' sheetId='1' r:id='a'/><sheet name='More' sheetId='2' r:id='b'/></sheets></workbook>",
        "xl/_rels/workbook.xml.rels": "<Relationships xmlns='http://schemas.openxmlformats.org/package/2006/relationships'><Relationship Id='b' Target='/xl/worksheets/two.xml'/><Relationship Id='a' Target='worksheets/one.xml'/></Relationships>",
        "xl/sharedStrings.xml": f"<sst {MAIN}><si><t>run</t></si><si><r><t>fl</t></r><r><t>ow</t></r></si><si><t>x &amp; y</t></si></sst>",
        "xl/styles.xml": f"<styleSheet {MAIN}><numFmts><numFmt numFmtId='170' formatCode='yyyy\\-mm\\-dd'/><numFmt numFmtId='171' formatCode='0.0\"day\"'/></numFmts><cellXfs><xf numFmtId='0'/><xf numFmtId='14'/><xf numFmtId='170'/><xf numFmtId='171'/></cellXfs></styleSheet>",
        "xl/worksheets/one.xml": f"<worksheet {MAIN}><sheetData>{first}</sheetData></worksheet>",
        "xl/worksheets/two.xml": f"<worksheet {MAIN}><sheetData>{second}</sheetData></worksheet>",
    }
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)


HEAD = "<row r='1'><c r='A1' t='s'><v>0</v></c><c r='B1' t='s'><v>1</v></c><c r='D1' t='s'><v>2</v></c></row>"


def test_cells(tmp_path):
    body = HEAD + "<row r='2'><c r='A2'><v>1</v></c><c r='B2'><v>2.5</v></c><c r='C2' t='b'><v>1</v></c><c r='D2' s='1'><v>45292.5</v></c></row>"
    body += "<row r='4'><c r='A4' t='str'><v>t</v></c><c r='B4' t='e'><v>#N/A</v></c><c r='D4' s='3'><v>7</v></c></row><row r='5'><c r='B5' s='2'><v>45293</v></c></row>"
    workbook(tmp_path / "a.xlsx", body)
    content = (tmp_path / "a.xlsx").read_bytes()
    assert list(sheet_rows(content)) == [["run", "flow", None, "x & y"], ["1", "2.5", "true", "2024-01-01 12:00:00"], [], ["t", None, None, "7"], [None, "2024-01-02 00:00:00"]]
    assert list(sheet_rows(content, "More")) == list(sheet_rows(content, 1)) == [["other"]]
    with pytest.raises(ValueError, match="no sheet"):
        list(sheet_rows(content, "None"))
    workbook(tmp_path / "b.xlsx", "<row r='1'><c r='A1' s='1'><v>1</v></c></row>", date1904=True)
    assert list(sheet_rows((tmp_path / "b.xlsx").read_bytes())) == [["1904-01-02 00:00:00"]]
    assert [column_number(x) for x in ("A1", "Z9", "AA10", "XFD1")] == [0, 25, 26, 16383]


def test_runs_of_workbooks(spark, tmp_path):
    for k in range(2):
        rows = "".join(f"<row r='{i + 2}'><c r='A{i + 2}'><v>{i % 2 + 2 * k}</v></c><c r='B{i + 2}'><v>{i + 0.25}</v></c></row>" for i in range(10))
        workbook(tmp_path / f"{k}.xlsx", HEAD + rows)
    one = ingest.load_runs(spark, str(tmp_path / "0.xlsx"), run_col="run")
    assert one.variables[0] == "flow" and one.obs.where("variable = 'flow' and value is not null").count() == 10
    both = ingest.read_table(spark, str(tmp_path / "*.xlsx"))
    assert sorted((r["run"], r["flow"]) for r in both.collect())[:2] == [("0", "0.25"), ("0", "2.25")] and both.count() == 20
    with pytest.raises(ValueError, match="old binary form"):
        ingest.read_table(spark, "x.xls")


# --- R ------------------------------------------------------------------------------------------------
NIL = struct.pack(">i", 254)


def chars(text):
    return struct.pack(">ii", 9, -1) if text is None else struct.pack(">ii", 9 | 8 << 12, len(text.encode())) + text.encode()


def vector(kind, body, n, attributes=()):
    return struct.pack(">ii", kind | (512 if attributes else 0), n) + body + (pairs(attributes) if attributes else b"")


def strings(values, attributes=()):
    return vector(16, b"".join(map(chars, values)), len(values), attributes)


def reals(values, attributes=()):
    return vector(14, struct.pack(f">{len(values)}d", *(float("nan") if v is None else v for v in values)), len(values), attributes)


def ints(values, attributes=(), kind=13):
    return vector(kind, struct.pack(f">{len(values)}i", *(-(1 << 31) if v is None else v for v in values)), len(values), attributes)


def pairs(items):
    return b"".join(struct.pack(">i", 2 | 1024) + (tag if isinstance(tag, bytes) else struct.pack(">i", 1) + chars(tag)) + value for tag, value in items) + NIL


def frame(columns):
    return vector(19, b"".join(columns.values()), len(columns), [("names", strings(list(columns))), ("class", strings(["data.frame"])), ("row.names", ints([None, -3]))])


COLUMNS = {
    "run": ints([1, None, 3]),
    "flow": reals([0.1, None, 1e300]),
    "ok": ints([1, 0, None], kind=10),
    "kind": ints([2, 1, None], [("levels", strings(["low", "hi é"])), ("class", strings(["factor"]))]),
    "day": reals([19723.0, None, -1.0], [("class", strings(["Date"]))]),
    "at": reals([0.5, 1704067200.0, None], [("class", strings(["POSIXct", "POSIXt"]))]),
    "text": strings(["a", None, ""]),
    # a compact sequence: its class, its state, no attributes
    "count": struct.pack(">i", 238) + pairs([("x", struct.pack(">i", 1) + chars("compact_intseq"))]) + reals([3, 5, 1]) + NIL,
}
WANT = [list(COLUMNS), ["1", "0.1", "true", "hi é", "2024-01-01", "1970-01-01 00:00:00.500000", "a", "5"], [None, None, "false", "low", None, "2024-01-01 00:00:00", None, "6"], ["3", "1e+300", None, None, "1969-12-31", None, "", "7"]]


def header(version):
    return b"X\n" + struct.pack(">iii", version, 0x040200, 0x020300) + (struct.pack(">i", 5) + b"UTF-8" if version == 3 else b"")


@pytest.mark.parametrize(("version", "pack"), [(2, gzip.compress), (3, gzip.compress), (3, bz2.compress), (3, lzma.compress), (2, bytes)])
def test_r_frames(version, pack):
    name = struct.pack(">i", 1) + chars("mine")
    again = struct.pack(">i", 255 | 2 << 8)  # the second symbol once more: the frame's "names"
    whole = pack(f"RDX{version}\n".encode() + header(version) + pairs([("note", strings(["no frame"])), (name, frame(COLUMNS))]))
    assert list(r_rows(whole)) == list(r_rows(whole, "mine")) == WANT
    assert list(r_rows(pack(header(version) + frame(COLUMNS)))) == WANT
    two = pack(f"RDX{version}\n".encode() + header(version) + pairs([("a", frame({"x": reals([1.0])})), (again, strings(["b"]))]))
    assert list(r_rows(two)) == list(r_rows(two, "a")) == [["x"], ["1.0"]]
    with pytest.raises(ValueError, match="no data frame"):
        list(r_rows(whole, "note"))


def test_r_files_by_spark(spark, tmp_path):
    (tmp_path / "x.RData").write_bytes(gzip.compress(b"RDX3\n" + header(3) + pairs([("d", frame(COLUMNS))])))
    df = ingest.read_table(spark, str(tmp_path / "x.RData"))
    assert df.columns == list(COLUMNS) and [list(r) for r in df.collect()] == WANT[1:]
    obs = ingest.load(spark, str(tmp_path / "x.RData")).obs
    assert {r["variable"] for r in obs.collect()} >= {"run", "flow"}
