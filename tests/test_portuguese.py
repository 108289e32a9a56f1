"""The stemmer against published pairs, and its SQL form against the column form."""

import duckdb
from pyspark.sql import functions as F

from quarry.functions import portuguese

#: Words of the published sample vocabulary with their stems.
PAIRS = dict(
    p.split(":")
    for p in """boa:boa boainain:boainain boas:boas boataria:boat boate:boat boates:boat boatos:boat bob:bob boba:bob bobagem:bobag bobagens:bobagens
bobalhões:bobalhõ bobear:bob bobeira:bobeir bobinho:bobinh bobo:bob bobs:bobs boca:boc bocadas:boc bocadinho:bocadinh bocado:boc bocaiúva:bocaiúv
boçal:boçal bocarra:bocarr bocas:boc bode:bod bodoque:bodoqu body:body boeing:boeing boem:boem boemia:boem boêmio:boêmi
quilo:quil quilombo:quilomb quilométricas:quilométr quilométrico:quilométr quilômetro:quilômetr quilos:quil química:químic
químicos:químic quimioterapia:quimioterap quimioterápicos:quimioteráp quimono:quimon quincas:quinc quinhão:quinhã quinhentos:quinhent quinta:quint
quintal:quintal quintessência:quintessent quinto:quint quintuplicou:quintuplic quinze:quinz quinzena:quinzen quiosque:quiosqu""".split()
)


def test_published_pairs(spark):
    words = spark.createDataFrame([(w,) for w in PAIRS], "word string")
    assert {r.word: r.stem for r in words.select("word", portuguese.stem(F.col("word")).alias("stem")).collect()} == PAIRS


def test_forms_of_a_word_meet(spark):
    groups = [("prescritas", "prescrito"), ("contrato", "contratos"), ("consumidora", "consumidoras"), ("cláusula", "cláusulas"), ("informação", "informações"), ("abusiva", "abusivas", "abusivo")]
    words = spark.createDataFrame([(i, w) for i, g in enumerate(groups) for w in g], "g int, word string")
    assert [r.n for r in words.groupBy("g").agg(F.count_distinct(portuguese.stem(F.col("word"))).alias("n")).collect()] == [1] * len(groups)


def test_column_form_equals_sql(spark):
    suffixes = [*portuguese.DELETED, *portuguese.REPLACED, *portuguese.COMPOUND, *portuguese.AFTER_E, *portuguese.VERBS, *portuguese.RESIDUAL]
    heads = ["", "a", "e", "ba", "abe", "contrat", "negociat", "relativ", "nacionalig", "facil", "precios", "amável", "ci", "segu", "ôi", "operat", "e", "praç"]
    words = sorted({(h + s).replace("a~", "ã").replace("o~", "õ") for h in heads for s in [*suffixes, "", "e", "ê", "ç", "gue", "cie"]} - {""})
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    got = {r.word: r.stem for r in frame.select("word", portuguese.stem(F.col("word")).alias("stem")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE words (word VARCHAR)")
    con.executemany("INSERT INTO words VALUES (?)", [[w] for w in words])
    assert got == dict(con.execute(portuguese.stem_sql("words")).fetchall())


def test_analysis(spark):
    rows = [(1, "O consumidor, e os CONSUMIDORES da Lei nº 8.078/1990!"), (2, None), (3, ""), (4, "x" * 41 + " que de " + "y" * 40)]
    got = {r.i: r.w for r in spark.createDataFrame(rows, "i int, t string").select("i", portuguese.analysed(F.col("t")).alias("w")).collect()}
    assert got == {1: ["consumidor", "consumidor", "lei", "nº", "8", "078", "1990"], 2: [], 3: [], 4: ["y" * 40]}
    assert len(portuguese.stop_words()) > 200 and {"tivéssemos", "houvermos", "estivera", "fôssemos"} <= set(portuguese.stop_words())


def test_one_word_is_folded_like_a_column(spark):
    suffixes = [*portuguese.DELETED, *portuguese.REPLACED, *portuguese.COMPOUND, *portuguese.AFTER_E, *portuguese.VERBS, *portuguese.RESIDUAL]
    heads = ["", "a", "ba", "abe", "contrat", "negociat", "relativ", "nacionalig", "amável", "ci", "segu", "ôi", "operat", "𝒶b", "praç", "Ā_9", "on"]
    words = sorted({(h + s).replace("a~", "ã").replace("o~", "õ") for h in heads for s in [*suffixes, "", "e", "ê", "ç", "gue", "cie", "ativamente"]} | {*PAIRS})
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    assert {w: portuguese.stem_word(w) for w in words} == {r.word: r.stem for r in frame.select("word", portuguese.stem(F.col("word")).alias("stem")).collect()}
