"""The tree of a norm from windows: wordings below superseded ones, headings met again, the second part, many blocks."""

import pytest
from pyspark.sql import functions as F

from quarry.plans import parse

SCHEMA = "norm_urn string, pos int, text string, struck boolean, anchors array<string>, note string, action string, year int"


def tree(spark, *norms):
    rows = [(f"n{n}", at, b if isinstance(b, str) else b[0], False, [] if isinstance(b, str) else [b[1]], None, None, None) for n, blocks in enumerate(norms) for at, b in enumerate(blocks)]
    found = parse.nodes(spark.createDataFrame(rows, SCHEMA)).collect()
    return [[(r.path, r.parent_path, r.base_path, r.ordinal, r.text) for r in sorted(found, key=lambda r: r.pos) if r.norm_urn == f"n{n}"] for n in range(len(norms))]


def test_wordings_headings_and_parts(spark):
    one = ["before", "TÍTULO I", "Art. 1º a", "I - x;", "I - y;", "and on", "Art. 1º b", "I - z;", "TÍTULO II", "TÍTULO I", "of the first", "Art. 2º c", "Art. 1º cited", ("Art. 1º d", "art1")]
    two = ["ATO DAS DISPOSIÇÕES CONSTITUCIONAIS", "Art. 5º e", "ATO DAS DISPOSIÇÕES CONSTITUCIONAIS TRANSITÓRIAS", "goes on", "Art. 1º f", "Art. 1º g"]
    first, second, none = tree(spark, one, two, ["only", "prose"])
    assert none == []
    assert first == [
        ("tit1", None, "tit1", 1, "of the first"),
        ("tit1/art1@1", "tit1", "tit1/art1", 1, "a"),
        ("tit1/art1@1/inc1@1", "tit1/art1@1", "tit1/art1@1/inc1", 1, "x;"),
        ("tit1/art1@1/inc1", "tit1/art1@1", "tit1/art1@1/inc1", 2, "y; and on"),
        ("tit1/art1@2", "tit1", "tit1/art1", 2, "b"),
        ("tit1/art1@2/inc1", "tit1/art1@2", "tit1/art1@2/inc1", 1, "z;"),
        ("tit2", None, "tit2", 2, ""),
        ("tit1/art2", "tit1", "tit1/art2", 3, "c Art. 1º cited"),
        ("tit1/art1", "tit1", "tit1/art1", 4, "d"),
    ]
    assert second == [("art5", None, "art5", 1, "e goes on"), ("adct/art1@1", None, "adct/art1", 2, "f"), ("adct/art1", None, "adct/art1", 3, "g")]


def test_a_norm_of_many_blocks(spark):
    n = 30_000
    number = (F.col("id") / 3).cast("int") + 1
    text = F.when(F.col("id") % 3 == 0, F.concat(F.lit("Art. "), number, F.lit(". t"))).when(F.col("id") % 3 == 1, F.lit("I - u;")).otherwise(F.lit("I - v;"))
    cut = spark.range(n).select(F.lit("n").alias("norm_urn"), F.col("id").cast("int").alias("pos"), text.alias("text"), F.lit(False).alias("struck"), F.array().cast("array<string>").alias("anchors"), *[F.lit(None).cast(k).alias(c) for c, k in (("note", "string"), ("action", "string"), ("year", "int"))])
    found = parse.nodes(cut).agg(F.count(F.lit(1)), F.count_if(F.endswith("path", F.lit("/inc1@1"))), F.max("ordinal")).first()
    assert tuple(found) == (n, n // 3, n // 3)


def test_warnings(spark):
    blocks = ["before", "TÍTULO I", "Art. 2º a", "TÍTULO I", "Art. 1º cited", "goes on"]
    cut = spark.createDataFrame([("n", at, b, False, [], None, None, None) for at, b in enumerate(blocks)], SCHEMA)
    got = sorted((r.pos, r.reason) for r in parse.warnings(cut).collect())
    assert got == [(0, "text before the first provision"), (3, "heading met again"), (4, "article number goes back")]


def test_quarantine(spark, tmp_path):
    from quarry import schema
    from quarry.sources import raw

    folder = f"file://{tmp_path}"
    urns = [entry[0] for entry in schema.CATALOGUE]
    for urn in urns:
        raw.save(spark, folder, urn, "http://x", "text/html", b"text")
    assert raw.quarantine(spark, folder).count() == 0 and raw.load(spark, folder, strict=True).count() == 3
    names = [raw.file_name(u) + ".htm" for u in urns]
    (tmp_path / "lost.htm").write_bytes(b"x")
    for name in (names[0], names[1]):
        (tmp_path / f".{name}.crc").unlink(missing_ok=True)
    (tmp_path / names[0]).write_bytes(b"changed")
    (tmp_path / names[1]).unlink()
    got = {r.path.rpartition("/")[2]: (r.urn, r.reason) for r in raw.quarantine(spark, folder).collect()}
    assert got == {"lost.htm": (None, "no record"), names[0]: (urns[0], "differs from its record"), names[1]: (urns[1], "no document")}
    with pytest.raises(schema.DownloadFailed, match="record|document"):
        raw.load(spark, folder, strict=True)
