"""Annotated questions: JSON lines, checked line by line."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.labels import resolve_label
from quarry.schema import GOLD, GoldError


def load(spark: SparkSession, path: str) -> DataFrame:
    """Items with expected labels resolved to ids.

    Blank lines are skipped; a line that is no item, an id met twice or a label
    that is not understood is an error that names the line.  A gold set is
    written by hand and small, so it is checked on the driver.
    """
    seen: dict[str, int] = {}
    rows = []
    lines = spark.read.text(path, wholetext=True).collect()
    for number, line in enumerate("\n".join(r["value"] for r in lines).splitlines(), 1):
        if not line.strip():
            continue
        try:
            item = json.loads(line)
            unknown = set(item) - set(GOLD.fieldNames())
            if unknown or "id" not in item or "pergunta" not in item or "data_referencia" not in item:
                raise ValueError(f"fields {sorted(unknown) or 'missing'}")
            if item["id"] in seen:
                raise ValueError(f"id {item['id']} also in line {seen[item['id']]}")
            expected = [e if e.startswith("urn:") else resolve_label(e) for e in item.get("dispositivos_esperados") or []]
        except (ValueError, TypeError) as error:
            raise GoldError(f"line {number}: {error}") from error
        seen[item["id"]] = number
        rows.append((item["id"], item.get("mecanismo"), item["pergunta"], item["data_referencia"], expected, bool(item.get("deve_abster", False)), item.get("notas")))
    frame = spark.createDataFrame(rows, "id string, mecanismo string, pergunta string, data_referencia string, dispositivos_esperados array<string>, deve_abster boolean, notas string")
    return frame.withColumn("data_referencia", F.to_date("data_referencia"))
