"""Small packages for tests and examples: sheets of given cells as the bytes of a workbook."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape, quoteattr

from ..plans.references import a1

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"


def _cell(r: int, c: int, value, shared: list[str]) -> str:
    """value: a constant, or a dict with `f` (formula), `v` (stored value), `t`, `si`, `ref`, or raw `xml`."""
    at = f'r="{a1(r, c)}"'
    if not isinstance(value, dict):
        value = {"v": value}
    if "xml" in value:
        return value["xml"]
    f = ""
    if "f" in value or "si" in value:
        extra = "".join(f" {k}={quoteattr(str(value[k]))}" for k in ("t", "si", "ref") if k in value)
        f = f"<f{extra}>{escape(value.get('f') or '')}</f>"
    v = value.get("v")
    if v is None:
        return f"<c {at}>{f}</c>"
    if isinstance(v, bool):
        return f'<c {at} t="b">{f}<v>{int(v)}</v></c>'
    if isinstance(v, (int, float)):
        return f"<c {at}>{f}<v>{v!r}</v></c>"
    if v.startswith("#"):
        return f'<c {at} t="e">{f}<v>{escape(v)}</v></c>'
    if f:
        return f'<c {at} t="str">{f}<v>{escape(v)}</v></c>'
    shared.append(v)
    return f'<c {at} t="s"><v>{len(shared) - 1}</v></c>'


def build(sheets: dict[str, dict[tuple[int, int], object]], names: dict[str, str] | None = None, hidden: dict[str, set[int]] | None = None, date1904: bool = False, iterate: bool = False, extra: dict[str, bytes] | None = None) -> bytes:
    """The bytes of a workbook. sheets: name -> (row, column), from 0 -> value."""
    shared: list[str] = []
    parts: dict[str, bytes] = {}
    for i, (name, cells) in enumerate(sheets.items()):
        rows: dict[int, list[str]] = {}
        for (r, c), value in sorted(cells.items()):
            rows.setdefault(r, []).append(_cell(r, c, value, shared))
        gone = (hidden or {}).get(name, set())
        body = "".join(f'<row r="{r + 1}"{" hidden=" + chr(34) + "1" + chr(34) if r in gone else ""}>{"".join(x)}</row>' for r, x in sorted(rows.items()))
        parts[f"xl/worksheets/sheet{i + 1}.xml"] = f'<worksheet xmlns="{_MAIN}"><sheetData>{body}</sheetData></worksheet>'.encode()
    listed = "".join(f'<sheet name={quoteattr(n)} sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, n in enumerate(sheets))
    defined = "".join(f"<definedName name={quoteattr(k)}>{escape(v)}</definedName>" for k, v in (names or {}).items())
    defined = f"<definedNames>{defined}</definedNames>" if defined else ""
    parts["xl/workbook.xml"] = f'<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><workbookPr date1904="{int(date1904)}"/><sheets>{listed}</sheets>{defined}<calcPr iterate="{int(iterate)}"/></workbook>'.encode()
    relations = "".join(f'<Relationship Id="rId{i + 1}" Type="{_OFFICE}/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(sheets)))
    relations += f'<Relationship Id="rIdS" Type="{_OFFICE}/sharedStrings" Target="sharedStrings.xml"/>'
    parts["xl/_rels/workbook.xml.rels"] = f'<Relationships xmlns="{_PACKAGE}">{relations}</Relationships>'.encode()
    parts["xl/sharedStrings.xml"] = f'<sst xmlns="{_MAIN}">{"".join(f"<si><t>{escape(s)}</t></si>" for s in shared)}</sst>'.encode()
    parts["_rels/.rels"] = f'<Relationships xmlns="{_PACKAGE}"><Relationship Id="r1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>'.encode()
    parts |= extra or {}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()
