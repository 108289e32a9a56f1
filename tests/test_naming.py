from pyspark.sql import functions as F
from quarry.operators import naming
from quarry.schema import CATALOGUE

CF, CDC = CATALOGUE[0][0], CATALOGUE[1][0]


def test_labels_addresses_and_links(spark):
    rows = [(CDC, "tit1", "titulo", "Título I"), (CDC, "tit1/art6", "artigo", "Art. 6º"), (CDC, "tit1/art6/inc8", "inciso", "VIII"), (CF, "adct/art1", "artigo", "Art. 1º"), (CF, "adct/art1/cpt", "caput", "caput")]
    nodes = spark.createDataFrame(rows, "norm_urn string, path string, type string, label string")
    got = {r.path: r.full_label for r in naming.full_labels(nodes).collect()}
    assert got["tit1"] == "Lei 8.078/1990" and got["tit1/art6/inc8"] == "Lei 8.078/1990, Art. 6º, VIII"
    assert got["adct/art1/cpt"] == "Constituição Federal de 1988, ADCT, Art. 1º, caput"
    other = spark.createDataFrame([("urn:lex:br:federal:decreto:2005;12345",)], "u string").select(naming.norm_label(F.col("u")).alias("l")).first()
    assert other.l == "Decreto 12.345/?"
    norms = spark.createDataFrame([(CF, "http://stored")], "urn string, source_url string")
    assert {r.norm_urn: r.source_url for r in naming.with_source_url(nodes, norms).collect()} == {CF: "http://stored", CDC: CATALOGUE[1][3]}
    links = spark.createDataFrame([("a", "b", True), ("b", "a", True), ("a", "c", False)], "origin_id string, target_id string, resolved boolean")
    hits = spark.createDataFrame([(1, "a")], "query_id long, id string")
    assert [(r.query_id, r.id) for r in naming.linked(hits, links).collect()] == [(1, "b")]
    row = spark.range(1).select(naming.preview(F.lit("a\nb\nc\nd\ne")).alias("p"), naming.preview(F.lit("a")).alias("q")).first()
    assert row.p == "a\nb\nc\n+2 lines" and row.q == "a"
    assert naming.as_json_lines(hits).first().value == '{"query_id":1,"id":"a"}'
