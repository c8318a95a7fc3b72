"""Bindings as a wide table, and its CSV and XLSX files."""

from __future__ import annotations

import zipfile
from dataclasses import dataclass, field
from functools import reduce
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..log import Log, rendered
from ..model import EVENT, Variable
from ..plans.engine import EvalResult


@dataclass
class TableOptions:
    include_violation_status: bool = True
    include_ids: bool = True
    omit_header: bool = False
    labels: list[str] = field(default_factory=list)
    format: str = "CSV"


def _attributes(log: Log, result: EvalResult, node: int, v: Variable) -> DataFrame:
    """Attributes of elements that a variable may be bound to: of its types, so other types' are not read."""
    attrs, kind = (log.event_attrs, "ev_type") if v.kind == EVENT else (log.object_attrs, "ob_type")
    parents, at = result.tree.parents(), node
    while at is not None and v not in result.tree.nodes[at].box.new_vars:
        at = parents.get(at)
    return attrs if at is None else attrs.where(F.col(kind).isin(list(result.tree.nodes[at].box.new_vars[v])))


def _names_seen(log: Log, result: EvalResult, node: int) -> dict[str, list[str]]:
    """The attributes that the elements bound to each variable have."""
    parts, r = [], result.evaluation.results[node]
    for v in r.visible:
        ident, attrs = "ev_id" if v.kind == EVENT else "ob_id", _attributes(log, result, node, v)
        parts.append(attrs.join(r.full.select(F.col(v.name).alias(ident)), ident, "left_semi").select(F.lit(v.name).alias("variable"), "name"))
    out: dict[str, list[str]] = {}
    for x in reduce(DataFrame.union, parts).distinct().toLocalIterator() if parts else ():
        out.setdefault(x["variable"], []).append(x["name"])
    return {k: sorted(names) for k, names in out.items()}


def wide_table(log: Log, result: EvalResult, node: int = 0, options: TableOptions | None = None) -> DataFrame:
    """For objects, then events: the id and a column for each attribute seen (by name): an object's earliest value, an
    event's first; then labels, then Satisfied. The attributes seen are names of the log's schema: one job over the
    bindings finds them, which are kept in the session's cache for it and for the table."""
    options = options or TableOptions()
    r = result.evaluation.results[node]
    df = r.full = r.full.persist()
    out = []
    seen = _names_seen(log, result, node)
    for v in sorted(r.visible, key=lambda v: (v.kind == EVENT, v)):
        ident = "ev_id" if v.kind == EVENT else "ob_id"
        attrs = _attributes(log, result, node, v)
        ids = df.select(F.col(v.name).alias(ident)).distinct()
        own = attrs.join(ids, ident, "left_semi")
        names = seen.get(v.name, [])
        order = F.col("seq") if v.kind == EVENT else F.struct("time", "seq")
        if options.include_ids:
            out.append(F.col(v.name).alias(v.name))
        if names:
            values = own.groupBy(F.col(ident).alias(v.name)).pivot("name", names).agg(F.min_by(rendered(F.col("v")), order))
            values = values.select(v.name, *[F.col(f"`{n}`").alias(f"{v.name}_{n}") for n in names])
            df = df.join(values, v.name, "left")
            out += [F.col(f"`{v.name}_{n}`") for n in names]
    out += [F.coalesce(F.col(x).cast("string"), F.lit("null")).alias(x) if x in r.label_kinds else F.lit("null").alias(x) for x in options.labels]
    if options.include_violation_status:
        out.append(F.col("violation").isNull().alias("Satisfied"))
    return df.select(*out)


def write_csv(table: DataFrame, path: str, options: TableOptions | None = None) -> bool:
    """Write the table; an empty one writes nothing, no header either."""
    if table.isEmpty():
        return False
    table.write.mode("overwrite").option("header", not (options and options.omit_header)).csv(path)
    return True


def write_xlsx(table: DataFrame, path: str, options: TableOptions | None = None) -> bool:
    """Write the table as a workbook on the driver, row by row: a workbook holds a million rows at most."""
    if table.isEmpty():
        return False
    kinds = dict(table.dtypes)

    def cell(name: str, value) -> str:
        if value is None:
            return "<c/>"
        if name == "Satisfied":
            return f'<c s="{2 if value else 3}" t="inlineStr"><is><t>{"true" if value else "false"}</t></is></c>'
        if kinds[name] in ("bigint", "int", "double"):
            return f"<c><v>{value}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'

    last = ""
    n = len(table.columns)
    while n:
        n, k = divmod(n - 1, 26)
        last = chr(65 + k) + last
    fills = "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="{c}"/></patternFill></fill>' for c in ("FFD9D9D9", "FFC6EFCE", "FFFFC7CE"))
    styles = f'<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><fonts count="1"><font/></fonts><fills count="5"><fill/><fill/>{fills}</fills><borders count="1"><border/></borders><cellXfs count="4"><xf/>' + "".join(f'<xf fillId="{k}" applyFill="1"/>' for k in (2, 3, 4)) + "</cellXfs></styleSheet>"
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/></Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Bindings" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Type="{rel}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", styles)
        with z.open("xl/worksheets/sheet1.xml", "w") as sheet:
            sheet.write(f'<worksheet xmlns="{main}"><sheetData>'.encode())
            rows = 0
            if not (options and options.omit_header):
                rows = 1
                sheet.write(("<row>" + "".join(f'<c s="1" t="inlineStr"><is><t>{escape(c)}</t></is></c>' for c in table.columns) + "</row>").encode())
            for r in table.toLocalIterator():
                rows += 1
                sheet.write(("<row>" + "".join(cell(c, r[c]) for c in table.columns) + "</row>").encode())
            sheet.write(f'</sheetData><autoFilter ref="A1:{last}{rows}"/></worksheet>'.encode())
    return True
