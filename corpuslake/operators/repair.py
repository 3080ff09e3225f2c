"""Repairs and exports of stored tables."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslake.functions import urls


def repaired_urls(bronze: DataFrame) -> DataFrame:
    """``bronze`` with temporary download paths replaced by watch pages (K9); a LIKE comes before the pattern."""
    return bronze.withColumn("source_url", F.when(F.col("source_url").like("%youtube_dl_%"), F.coalesce(urls.video_url("source_url"), F.col("source_url"))).otherwise(F.col("source_url")))


def url_repairs(bronze: DataFrame) -> DataFrame:
    """doc_id, source_url, repaired_url of the rows that repaired_urls() would change: its dry run."""
    rows = bronze.where(F.col("source_url").like("%youtube_dl_%")).select("doc_id", "source_url", urls.video_url("source_url").alias("repaired_url"))
    return rows.where("repaired_url is not null")


def merged_metadata(old: Column, new: Column, speaker: str | None = None) -> Column:
    """Two maps as one, the new one's entries win even if null; the speaker is set in any case."""
    parts = [F.coalesce(old, F.expr("cast(map() as map<string,string>)")), new]
    if speaker is not None:
        parts.append(F.create_map(F.lit("speaker"), F.lit(speaker)))
    def without(m: Column, other: Column) -> Column:
        return F.map_filter(m, lambda k, _: ~F.map_contains_key(other, k))

    out = parts[0]
    for p in parts[1:]:
        out = F.map_concat(without(out, p), p)
    return out


def export_rows(bronze: DataFrame, silver: DataFrame) -> DataFrame:
    """doc_id, title, transcript ("" without one), has_transcript (yes, no) of all documents, by id."""
    rows = bronze.select("doc_id").join(silver.select("doc_id", "title", "transcript"), "doc_id", "left")
    blank = F.trim(F.coalesce("transcript", F.lit(""))) == ""
    return rows.select("doc_id", "title", F.when(blank, "").otherwise(F.col("transcript")).alias("transcript"), F.when(blank, "no").otherwise("yes").alias("has_transcript"))


def export_csv(rows: DataFrame, path: str) -> tuple[int, int]:
    """Writes export_rows() as CSV with a header, in ranges of ids; (documents, documents with a transcript)."""
    rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.mode("overwrite").option("header", "true").option("quoteAll", "true").csv(path)
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("has_transcript") == "yes").alias("w")).first()
    return n["n"], n["w"]


#: Rows that one sheet can hold, its header apart.
SHEET_ROWS = 1_048_575
_WIDTHS = (10, 40, 100, 16)
#: UTF-16 units that a cell can hold.
CELL = 32_767


def _cells(text: str) -> list[str]:
    """A text without what a sheet can not hold, cut into cells."""
    text = "".join(c for c in text if c >= " " or c in "\n\t")
    size = CELL if not text or max(text) <= "\uffff" else CELL // 2
    return [text[k : k + size] for k in range(0, len(text), size)]


def export_xlsx(rows: DataFrame, path: str) -> tuple[int, int]:
    """Writes export_rows() as a workbook with one sheet "Documents": frozen header, column widths (K8).

    Rows stream to the driver one partition at a time. A text that a cell can not hold goes on below, in rows whose
    other cells are empty. More rows than a sheet can hold are an error; export_csv() has no bound. Returns (documents, documents with a transcript).
    """
    n = rows.count()
    if n > SHEET_ROWS:
        raise ValueError(f"{n} rows do not fit a sheet; use export_csv")

    def cell(v: object) -> str:
        if isinstance(v, int):
            return f"<c><v>{v}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(v or "")}</t></is></c>'

    def lines(values: tuple) -> Iterator[str]:
        """The sheet's rows of one row: texts that a cell can not hold go on in the rows below."""
        cells = [v if isinstance(v, int) else _cells(str(v if v is not None else "")) for v in values]
        for k in range(max([1, *(len(c) for c in cells if isinstance(c, list))])):
            parts = [(c if k == 0 else None) if isinstance(c, int) else (c[k] if k < len(c) else "") for c in cells]
            yield "<row>" + "".join(cell(p) for p in parts) + "</row>"

    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with_text = written = 0
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(
            "[Content_Types].xml",
            '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
            '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
            '<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        )
        pack = "http://schemas.openxmlformats.org/package/2006/relationships"
        z.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="{pack}"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="{pack}"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Documents" sheetId="1" r:id="r1"/></sheets></workbook>')
        with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as f:
            columns = "".join(f'<col min="{k}" max="{k}" width="{w}" customWidth="1"/>' for k, w in enumerate(_WIDTHS, 1))
            head = f'<?xml version="1.0"?><worksheet xmlns="{main}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews><cols>{columns}</cols><sheetData>'
            f.write(head.encode())
            f.write(("<row>" + "".join(cell(c) for c in rows.columns) + "</row>").encode())
            for r in rows.orderBy("doc_id").toLocalIterator():
                with_text += r["has_transcript"] == "yes"
                for line in lines(r):
                    written += 1
                    if written > SHEET_ROWS:
                        raise ValueError("the texts, cut into cells, do not fit a sheet; use export_csv")
                    f.write(line.encode())
            f.write(b"</sheetData></worksheet>")
    return n, with_text
