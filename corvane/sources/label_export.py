"""Problem 5: comma-separated label records, loaded where valid and set apart with a reason where not.

Every row is read permissively under an explicit schema that retains the corrupt
raw text. A row that the reader took and that has the strict shape, where its
leniency (a quote inside a cell, a signed size) cannot matter, keeps the reader's
fields; corrupt and doubtful rows are classed anew by quoting, cell count and
casts. What is left are the boxes inside their cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS = ("label_path", "width", "height", "boxes", "errors", "annotator", "exported_at", "note")
_TYPES = {"width": "BIGINT", "height": "BIGINT", "exported_at": "TIMESTAMP"}
SCHEMA = ", ".join(f"_le_r_{name} {_TYPES.get(name, 'STRING')}" for name in CELLS) + ", _le_corrupt STRING"
#: In the order in which they are looked for.
REASONS = (
    "broken_quoting", "column_count", "bad_size", "bad_timestamp", "box_value_count", "non_numeric", "non_finite",
    "class_id", "outside_unit_range", "box_outside_image", "box_too_thin",
)
# A cell is quoted and closed, or has neither quote nor comma. Possessive, so no text makes the match slow or deep.
_CELL = r'"(?:[^"]++|"")*+"|[^",]*+'
_ROW = rf"(?s)\A(?:{_CELL})(?:,(?:{_CELL}))*+\z"
_NUMBER = r"[+-]?(?:[0-9]++(?:\.[0-9]*+)?|\.[0-9]++)(?:[eE][+-]?[0-9]++)?+"
_WORD = r"[+-]?(?i:nan|inf|infinity)"
_TIME = r"(?!0000)[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z"
# Eight well-quoted cells, sizes in plain digits that fit a bigint and a time of the right form.
_SIZE, _STAMP = r'(?:[0-9]{1,18}+|"[0-9]{1,18}+")', rf'(?:{_TIME}|"{_TIME}")'
_STRICT = rf"(?s)\A(?:{_CELL}),{_SIZE},{_SIZE},(?:{_CELL}),(?:{_CELL}),(?:{_CELL}),{_STAMP},(?:{_CELL})\z"
_BOX = rf"[ \t]*+{_NUMBER}(?:[ \t]++{_NUMBER}){{4}}[ \t]*+"
_BOXES = rf"\A{_BOX}(?:;{_BOX})*+\z"


def _unquoted(cell: Column) -> Column:
    inner = F.replace(F.substring(cell, F.lit(2), F.length(cell) - 2), F.lit('""'), F.lit('"'))
    return F.when(cell.startswith('"'), inner).otherwise(cell)


def split_cells(raw: Column) -> Column:
    """The cells of a well-quoted row, quotes resolved. Each match but the first eats the comma before it."""
    return F.transform(F.regexp_extract_all(F.concat(F.lit(","), raw), F.lit(rf"(?s),({_CELL})"), F.lit(1)), _unquoted)


def box_faults(cell: Column) -> Column:
    """Of a boxes cell that is not plain, the first fault of the shape of its boxes, as a position in REASONS; null if there is none.

    Boxes are parted by ``;``, values by blanks or tabs. A plain cell, five numbers
    a box, has no such fault, and each cell that is neither plain nor blank has one.
    """
    trimmed = lambda c: F.regexp_replace(c, r"\A[ \t]+|[ \t]+\z", "")
    boxes = F.transform(F.split(cell, ";", -1), lambda b: F.split(trimmed(b), r"[ \t]+", -1))
    return (
        F.when(F.exists(boxes, lambda b: (F.size(b) != 5) | (F.get(b, F.lit(0)) == "")), REASONS.index("box_value_count"))
        .when(~F.forall(F.flatten(boxes), lambda v: F.regexp_like(v, F.lit(rf"\A(?:{_NUMBER}|{_WORD})\z"))), REASONS.index("non_numeric"))
        .otherwise(REASONS.index("non_finite"))
    )


def _box_fault(b: Column, width: Column, height: Column) -> Column:
    """Of one box of five numbers the first fault, as a position in REASONS."""
    c, x, y, w, h = (b[k] for k in ("c", "x", "y", "w", "h"))
    inf = float("inf")
    return (
        F.when((F.abs(c) == inf) | (F.abs(x) == inf) | (F.abs(y) == inf) | (F.abs(w) == inf) | (F.abs(h) == inf), REASONS.index("non_finite"))
        .when((c < 0) | (c != F.rint(c)), REASONS.index("class_id"))
        .when((x < 0) | (x > 1) | (y < 0) | (y > 1) | (w <= 0) | (w > 1) | (h <= 0) | (h > 1), REASONS.index("outside_unit_range"))
        .when((x - w / 2 < 0) | (x + w / 2 > 1) | (y - h / 2 < 0) | (y + h / 2 > 1), REASONS.index("box_outside_image"))
        .when((w * width <= 1) | (h * height <= 1), REASONS.index("box_too_thin"))
    )


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with ``columns``, computed once a row: the optimizer neither copies them into what follows nor moves filters before them."""
    made = F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items()))))
    return df.select("*", made)


def read_label_export(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """``rows`` with ``reason`` (null where valid) and, of valid rows, the typed ``record``.

    record: label_path, width, height, boxes array<struct<class_id, center_x,
    center_y, width, height>>, errors array<string> (parted by ``;``), annotator,
    exported_at, note, width_text, height_text, class_texts. A whole number that a
    bigint cannot hold is null in width, height or class_id and stands as
    delivered in width_text, height_text or, one entry a box, class_texts, which
    are null otherwise.
    ``reason`` is the first of REASONS that holds for the row or for any of its
    boxes. One carriage return at the end of ``raw`` is not part of it. A null
    ``raw`` has no cells and so the reason ``column_count``, an empty one likewise.
    Columns of ``rows`` are kept; those named reason, record or with a leading
    ``_le_`` are replaced.
    """
    text = F.regexp_replace(F.coalesce(F.col(raw), F.lit("")), r"\r\z", "")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_le_corrupt", "quote": '"', "escape": '"', "multiLine": "true", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss'Z'", "timeZone": "UTC", "emptyValue": "", "nullValue": "\u0000"}
    kept = [c for c in rows.columns if c not in ("reason", "record") and not c.startswith("_le_")]
    df = rows.select(*kept, text.alias("_le_text"))
    df = df.select("*", F.inline(F.array(F.from_csv("_le_text", SCHEMA, options))))
    # The reader decides where it took the row and its leniency cannot have mattered: a row of the strict shape.
    accepted = F.col("_le_r_label_path").isNotNull() & F.col("_le_corrupt").isNull()
    took, doubted = F.col("_le_took"), ~F.col("_le_took")
    df = _once(df, _le_took=accepted & F.regexp_like("_le_text", F.lit(_STRICT)))
    quoted = F.regexp_like("_le_text", F.lit(_ROW))
    df = _once(df, _le_cells=F.when(doubted, F.when(quoted, split_cells(F.col("_le_text"))).otherwise(F.array().cast("array<string>"))))
    cell = {name: F.get("_le_cells", F.lit(k)) for k, name in enumerate(CELLS)}
    value = lambda name: F.when(took, F.col(f"_le_r_{name}")).otherwise(cell[name])
    plain = lambda c: F.regexp_like(c, F.lit(r"\A[0-9]*[1-9][0-9]*\z"))
    stamp = F.try_to_timestamp(cell["exported_at"], F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))
    time = F.when(took, F.col("_le_r_exported_at")).when(F.regexp_like(cell["exported_at"], F.lit(rf"\A{_TIME}\z")), stamp)
    small = took & ((F.col("_le_r_width") < 1) | (F.col("_le_r_height") < 1))
    row = (
        F.when(doubted & (F.size("_le_cells") == 0), REASONS.index("broken_quoting"))
        .when(doubted & (F.size("_le_cells") != len(CELLS)), REASONS.index("column_count"))
        .when(small | (doubted & (~plain(cell["width"]) | ~plain(cell["height"]))), REASONS.index("bad_size"))
    )
    df = _once(df, _le_time=time, _le_row=row)
    df = _once(df, _le_row2=F.coalesce("_le_row", F.when(F.col("_le_time").isNull(), REASONS.index("bad_timestamp"))))
    df = _once(df, _le_cell=F.when(F.col("_le_row2").isNull(), value("boxes")))
    # 0 a blank cell, 1 a plain one, 2 one with a box of the wrong shape
    df = _once(df, _le_kind=F.when(F.regexp_like("_le_cell", F.lit(r"\A\s*\z")), 0).when(F.regexp_like("_le_cell", F.lit(_BOXES)), 1).when(F.col("_le_cell").isNotNull(), 2))
    # The numbers of a plain cell, all boxes in one list, cast in one go; then five of them to a box, each read once.
    df = _once(df, _le_words=F.when(F.col("_le_kind") == 1, F.split(F.trim(F.translate("_le_cell", ";\t", "  ")), " +")))
    pixels = lambda name: F.when(took, F.col(f"_le_r_{name}").cast("double")).otherwise(cell[name].try_cast("double"))
    df = _once(df, _le_numbers=F.col("_le_words").try_cast("array<double>"), _le_w=pixels("width"), _le_h=pixels("height"))
    at = lambda i, k: F.get("_le_numbers", i * 5 + k)
    places = F.sequence(F.lit(0), F.floor(F.size("_le_numbers") / 5).cast("int") - 1)
    box = lambda i: F.struct(*(at(i, k).alias(n) for k, n in enumerate("cxywh")), F.get("_le_words", i * 5).alias("text"))
    df = _once(df, _le_boxes=F.when(F.col("_le_kind") == 1, F.transform(places, box)))
    faults = F.array_min(F.transform("_le_boxes", lambda b: _box_fault(b, F.col("_le_w"), F.col("_le_h"))))
    fault = F.coalesce("_le_row2", F.when(F.col("_le_kind") == 2, box_faults(F.col("_le_cell"))), faults)
    df = _once(df, reason=F.get(F.array(*map(F.lit, REASONS)), fault))

    def typed(b: Column) -> Column:
        whole = F.coalesce(b["text"].try_cast("bigint"), F.when(F.abs(b["c"]) <= 2.0**53, b["c"].cast("bigint")))
        sides = (b[k].alias(n) for k, n in (("x", "center_x"), ("y", "center_y"), ("w", "width"), ("h", "height")))
        return F.struct(whole.alias("class_id"), *sides)

    boxes = F.coalesce(F.transform("_le_boxes", typed), F.array().cast("array<struct<class_id:bigint,center_x:double,center_y:double,width:double,height:double>>"))
    unheld = F.when(F.exists("_le_boxes", lambda b: typed(b)["class_id"].isNull()), F.transform("_le_boxes", lambda b: F.when(typed(b)["class_id"].isNull(), b["text"])))
    errors = F.filter(F.transform(F.split(value("errors"), ";"), lambda e: F.trim(e)), lambda e: e != "")
    digits = lambda name: F.when(took, F.col(f"_le_r_{name}")).otherwise(cell[name].try_cast("bigint"))
    long = lambda name: F.when(doubted & cell[name].try_cast("bigint").isNull(), cell[name]).alias(f"{name}_text")
    record = F.struct(
        value("label_path").alias("label_path"), digits("width").alias("width"), digits("height").alias("height"), boxes.alias("boxes"), errors.alias("errors"),
        value("annotator").alias("annotator"), F.col("_le_time").alias("exported_at"), value("note").alias("note"), long("width"), long("height"), unheld.alias("class_texts"),
    )
    return df.select(*kept, "reason", F.when(F.col("reason").isNull(), record).alias("record"), "_le_corrupt")


def loaded(rows: DataFrame) -> DataFrame:
    """The valid rows, their record's fields as columns beside the keys source_file, line_no and raw_id."""
    return rows.filter("reason is null").select("raw_id", "source_file", "line_no", "record.*")


def rejected(rows: DataFrame) -> DataFrame:
    """The bad rows with their reason and the raw text as delivered."""
    return rows.filter("reason is not null").select("raw_id", "source_file", "line_no", "reason", "raw")
