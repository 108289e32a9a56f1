"""A service from settings: from raw documents to answers with named citations."""

import datetime

import pytest
from pyspark.sql import functions as F

from quarry import schema
from quarry.operators import expand, search
from quarry.plans import answer, service, stages
from quarry.sources.store import Store

D = datetime.date
CDC = schema.CATALOGUE[1][0]
PAGE = "<p><strike>Art. 1º Garantia de dez dias.</strike></p><p>Art. 1º Garantia de trinta dias. (Redação dada pela Lei nº 9, de 2000)</p><p>Art. 2º Aluguel de casas.</p>"


def test_dated_questions_get_cited_answers(spark, tmp_path):
    store, encode = Store(spark, f"file://{tmp_path}/s"), search.hashed_encoder(8)
    config = service.Config(f"file://{tmp_path}/s", "m", 8)
    with pytest.raises(schema.IncompatibleIndex, match="no index"):
        service.build(spark, config, encode)
    page = {schema.CATALOGUE[0][3]: "<p>Art. 1º Outro.</p>", schema.CATALOGUE[1][3]: PAGE}
    stages.run(spark, f"file://{tmp_path}/raw", store, lambda url: ("text/html", page[url].encode()), encode, "m", 8, limit=2)
    for wrong in (service.Config(config.store, "m", 16), service.Config(config.store, "n", 8)):
        with pytest.raises(schema.IncompatibleIndex, match="wanted"):
            service.build(spark, wrong, encode)
    with pytest.raises(ValueError, match="unknown backend"):
        service.build(spark, service.Config(config.store, "m", 8, backend="other"), encode)
    ask = service.build(spark, config, encode)
    asked = spark.createDataFrame([(1, "garantia de produtos, quantos dias", D(1995, 1, 1)), (2, "garantia de produtos, quantos dias", D(2015, 1, 1))], "query_id long, text string, date date")
    calls = answer.Calls()
    got = ask.ask(asked, f"file://{tmp_path}/one", calls=calls)
    cited = {(r.query_id, r.id, r.full_label) for r in got.citations.collect()}
    assert (1, f"{CDC}!art1@1") in {c[:2] for c in cited} and (2, f"{CDC}!art1") in {c[:2] for c in cited}
    assert not {(1, f"{CDC}!art1"), (2, f"{CDC}!art1@1")} & {c[:2] for c in cited} and all(label.startswith("Lei 8.078/1990") for *_, label in cited)
    assert calls.counts() == {"questions": 2, "no_candidates": 0, "stored": 0, "sent": 2, "failed": 0}
    texts = {r.query_id: r.text for r in got.passages.where("rank = 1").collect()}
    for r in service.lines_of(got.passages.where("rank = 1")).collect():
        assert texts[r.query_id][r.start : r.end] and "\n" not in texts[r.query_id][r.start : r.end]
    marked = spark.createDataFrame([(7, 2, f"Art. 1º um\n{expand.MARK}\nI - dois", ["a", "b"])], "query_id long, rank int, text string, provisions array<string>")
    at = len(f"Art. 1º um\n{expand.MARK}\n")
    assert [tuple(r) for r in service.lines_of(marked).orderBy("start").collect()] == [(7, "D2", "a", 0, 10), (7, "D2", "b", at, at + 8)]
    for bad in ((3, "ab", D(2015, 1, 1)), (3, None, D(2015, 1, 1)), (3, "abc", None)):
        with pytest.raises(Exception, match=": 3"):
            service.checked(spark.createDataFrame([bad], asked.schema)).collect()
    assert service.checked(asked.where(F.lit(False))).count() == 0
