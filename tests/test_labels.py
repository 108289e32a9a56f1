import random
import uuid

import pytest
from pyspark.sql import functions as F
from quarry.functions import labels as L
from quarry.functions import text as X
from quarry.plans import parse


@pytest.mark.parametrize(
    "type_, label, expected",
    [("artigo", "Art. 103-A", "art103a"), ("artigo", "Art. 2.046.", "art2046"), ("paragrafo", "§ 2º-A", "par2a"), ("paragrafo", "Parágrafo único", "parunico"), ("alinea", "a)", "ali1"), ("alinea", "c", "ali3"), ("inciso", "LXXVIII", "inc78"), ("titulo", "Título II", "tit2"), ("parte", "Parte I", "prt1"), ("caput", "", "cpt")],
)
def test_segments(type_, label, expected):
    assert L.segment(type_, label) == expected


@pytest.mark.parametrize("type_, label", [("inciso", "IIII"), ("inciso", "VV"), ("artigo", "sem número")])
def test_segments_refused(type_, label):
    with pytest.raises(ValueError):
        L.segment(type_, label)


@pytest.mark.parametrize("path, expected", [("tit2/cap1/art5/inc78", "art5_inc78"), ("tit2/cap1", "tit2_cap1"), ("adct/art5/par1", "adct_art5_par1")])
def test_fragments(spark, path, expected):
    assert L.fragment(path) == expected
    assert spark.range(1).select(X.fragment_of(F.lit(path)).alias("f")).first().f == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("CC art. 206 § 3º V", "urn:lex:br:federal:lei:2002-01-10;10406!art206_par3_inc5"),
        ("CF/88 art. 7º XXVI a", "urn:lex:br:federal:constituicao:1988-10-05;1988!art7_inc26_ali1"),
        ("CF/88 ADCT art. 5º", "urn:lex:br:federal:constituicao:1988-10-05;1988!adct_art5"),
    ],
)
def test_labels_resolve(text, expected):
    assert L.resolve_label(text) == expected


@pytest.mark.parametrize("text", ["CDC", "art. 5º", "CPC art. 1009"])
def test_labels_refused(text):
    with pytest.raises(ValueError):
        L.resolve_label(text)


@pytest.mark.parametrize(
    "text, segment, label, rest",
    [
        ("Art. 2.046. Todas as remissões", "art2046", "Art. 2.046", "Todas as remissões"),
        ("Art. 6o São direitos", "art6", "Art. 6º", "São direitos"),
        ("LIVRO COMPLEMENTAR Das Disposições", "liv99", "LIVRO COMPLEMENTAR", "Das Disposições"),
        ("Parágrafo único. Texto", "parunico", "Parágrafo único", "Texto"),
        ("§ 2º-A. Texto", "par2a", "§ 2º-A", "Texto"),
        ("IV - texto", "inc4", "IV", "texto"),
        ("b) texto", "ali2", "b)", "texto"),
        ("3. texto", "ite3", "3.", "texto"),
    ],
)
def test_blocks_are_classified(text, segment, label, rest):
    found = L.classify(text)
    assert (found.segment, found.label, found.text) == (segment, label, rest)


@pytest.mark.parametrize("text", ["na forma do art. 37, § 6º", "IIII - texto", "1988. um ano", ""])
def test_prose_is_none(text):
    assert L.classify(text) is None


def test_numerals_both_ways(spark):
    rows = spark.range(1, 2000).select("id", X.int_to_roman(F.col("id")).alias("r"))
    back = rows.select("id", "r", X.roman_to_int(F.col("r")).alias("b")).collect()
    assert all(r.id == r.b == L.roman(r.r) for r in back)
    bad = spark.createDataFrame([("IIII",), ("VV",), ("IC",), ("",), (None,)], "r string").select(X.roman_to_int(F.col("r")).alias("b"))
    assert all(r.b is None for r in bad.collect())


def test_ids_versions_days_and_uuids(spark):
    row = spark.createDataFrame([("urn:lex:br:federal:lei:1990-09-11;8078!art6@3_inc2",)], "u string")
    u = F.col("u")
    got = row.select(X.without_versions(u).alias("w"), X.norm_of(u).alias("n"), X.urn_parts(u).alias("p"), X.uuid5(u).alias("id"), X.day_number(F.to_date(F.lit("1990-09-11"))).alias("d"), X.day_or_far(F.lit(None).cast("date")).alias("far")).first()
    assert got.w.endswith("!art6_inc2") and got.n.endswith(";8078")
    assert (got.p.type, str(got.p.date), got.p.number) == ("lei", "1990-09-11", "8078")
    assert got.id == str(uuid.uuid5(uuid.UUID(X.POINT_NAMESPACE), "urn:lex:br:federal:lei:1990-09-11;8078!art6@3_inc2"))
    import datetime

    assert got.d == datetime.date(1990, 9, 11).toordinal() and got.far == 3652059


def test_citations_lie_within(spark):
    rows = spark.createDataFrame([("n!art1_inc2", "n!art1", True), ("n!art10", "n!art1", False), ("n!art1", "n!art1_inc2", False), ("n!art6@3", "n!art6", True)], "c string, e string, ok boolean")
    assert all(r.got == r.ok for r in rows.withColumn("got", X.within(F.col("c"), F.col("e"))).collect())


def read_by_tokens(text):
    reader, out = L.Reader(list(L.scan(text))), []
    while (token := reader.peek()) is not None:
        reader.at += 1
        if token.kind != "word" or token.plain not in ("art", "arts", "artigo", "artigos"):
            continue
        reader.skip(frozenset("."))
        number = reader.take("number")
        if number is None:
            continue
        parts = [f"art{number.number}"]
        if (mark := reader.peek()) and (mark.raw in L.ORDINAL_SIGNS or mark.raw == "o"):
            reader.at += 1
        end, back = reader.end(), reader.at
        reader.take("sign", ",")
        if reader.take("sign", "§") and (paragraph := reader.take("number")):
            parts.append(f"par{paragraph.number}")
            end, back = paragraph.begin + len(paragraph.raw.rstrip(".")), reader.at
        reader.at = back
        reader.take("sign", ",")
        item = reader.take("word")
        if item is not None and len(item.raw) <= 8 and (value := L.roman(item.raw)) is not None:
            parts.append(f"inc{value}")
            end, back = item.end, reader.at
        reader.at = back
        out.append(("_".join(parts), " ".join(text[token.begin : end].split())))
    return out


def test_references_are_those_of_the_tokens(monkeypatch):
    rnd = random.Random(1)
    latin = ["art", "Arts", "artigo", "ÁRTIGOS", ".", "..", ",", "§", "º", "°", "o", "oo", "5", "12.", "1.234", "007", "²", "IV", "xii", "ÍV", "iiii", "lei", " ", "\xa0", "\n", "-", "µ", "ª", "_", "\x1c", "ß"] + ["art", "5", " ", ".", "§"] * 4
    other = [*latin, "artİgo", "art́", "٣", "–", "漢", "ſ", "Ⅳ", " ", "​", "𝐚"]
    texts = ["".join(rnd.choice(other if k % 2 else latin) for _ in range(rnd.randint(1, 14))) for k in range(20_000)]
    expected = [read_by_tokens(text) for text in texts]
    assert sum(map(bool, expected)) > 1000
    monkeypatch.setattr(L, "scan", None)  # no token is made of a text without need
    assert [L.references(text) for text in texts] == expected


def test_links_need_no_sorted_window(spark):
    rows = spark.createDataFrame([("a", "n", "art. 5 e art. 5"), ("a", "n", "art. 5"), (None, "n", "art. 5"), ("b", None, "art. 5"), ("c", "n", None), ("n!art5", "n", "art. 5")], "id string, norm_urn string, text string")
    found = parse.links(rows)
    assert [tuple(r) for r in found.collect()] == [("a", "n!art5", "art. 5")]
    assert "Window" not in found._jdf.queryExecution().toString()
