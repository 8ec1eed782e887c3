"""Line formats: memory images in hexadecimal records, and XML trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywire.functions.bits import line_checksum


def hex_records(lines: DataFrame, *, key: str | None = None) -> DataFrame:
    """Records ``:LLAAAATT<data>CC`` of lines (line_no, text): (key, line_no, type, address, data, sound).

    Record type 4 carries the high half of addresses from there on, within its key. ``sound`` is false where the sum
    of a line's bytes is not 0 modulo 256 or its length is not as stated.
    """
    number = lambda at, n: F.conv(F.substring("text", at, n), 16, 10).cast("long")
    rows = lines.filter(F.col("text").startswith(":")).select(
        *([key] if key else []), "line_no", number(2, 2).alias("_n"), number(4, 4).alias("_low"), number(8, 2).alias("type"), "text",
        F.expr("substring(text, 10, cast(conv(substring(text, 2, 2), 16, 10) as int) * 2)").alias("data"),
    )
    w = Window.partitionBy(*([key] if key else [])).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    base = F.last(F.when(F.col("type") == 4, F.conv("data", 16, 10).cast("long")), ignorenulls=True).over(w)
    digits = F.expr("substring(text, 2)")
    sound = (line_checksum(digits) == 0) & (F.length("text") == 11 + 2 * F.col("_n"))
    return rows.select(*([key] if key else []), "line_no", "type", (F.coalesce(base, F.lit(0)) * 65536 + F.col("_low")).alias("address"), "data", sound.alias("sound"))


def read_hex(spark: SparkSession, path: str) -> DataFrame:
    """Records of the memory images in text files; each file is an image, lines are numbered by their place in it."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "text"))
    return hex_records(whole, key="file")


def flatten_xml(documents: DataFrame, *, id_col: str = "id", xml_col: str = "xml") -> DataFrame:
    """Leaves of XML trees: (id, path, value). A path is ``a:b(1):c``; an ``index`` attribute gives the number in brackets.

    A document that is no XML gives no leaves. One small document is parsed at a time, in a task.
    """
    schema = T.StructType([documents.schema[id_col], T.StructField("path", T.StringType()), T.StructField("value", T.StringType())])

    def run(batches):
        import xml.etree.ElementTree as ET

        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)

        def leaves(node, path):
            name = f"{node.tag}({node.get('index')})" if node.get("index") is not None else node.tag
            path = f"{path}:{name}" if path else name
            if len(node):
                for child in node:
                    yield from leaves(child, path)
            else:
                yield path, (node.text or "").strip()

        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    root = ET.fromstring(text or "")
                except ET.ParseError:
                    continue
                rows += [(key, p, v) for p, v in leaves(root, "")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return documents.select(id_col, xml_col).mapInArrow(run, schema)


def to_xml(leaves: DataFrame, *, key: str, root: str) -> DataFrame:
    """One flat document for each key from leaves (key, name, value), in the order of names: (key, xml)."""
    escaped = F.replace(F.replace(F.replace(F.col("value"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    element = F.concat(F.lit("<"), "name", F.lit(">"), escaped, F.lit("</"), "name", F.lit(">"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("name", element.alias("e")))), lambda x: x["e"]), "")
    return leaves.groupBy(key).agg(F.concat(F.lit(f"<{root}>"), body, F.lit(f"</{root}>")).alias("xml"))
