"""Tables of the store, and the kinds of nodes that a norm's tree is made of."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Kind:
    name: str
    short: str
    level: int
    structural: bool


#: Node types, their abbreviations in ids, and their depth.
KINDS = (
    Kind("parte", "prt", 0, True),
    Kind("livro", "liv", 1, True),
    Kind("titulo", "tit", 2, True),
    Kind("capitulo", "cap", 3, True),
    Kind("secao", "sec", 4, True),
    Kind("subsecao", "sub", 5, True),
    Kind("artigo", "art", 6, False),
    Kind("caput", "cpt", 7, False),
    Kind("paragrafo", "par", 7, False),
    Kind("inciso", "inc", 8, False),
    Kind("alinea", "ali", 9, False),
    Kind("item", "ite", 10, False),
)
BY_NAME = {k.name: k for k in KINDS}
BY_SHORT = {k.short: k for k in KINDS}
STRUCTURAL = [k.name for k in KINDS if k.structural]
CITABLE = [k.name for k in KINDS if not k.structural]
#: The part of a norm that numbers its articles anew.
COMPONENT = "adct"
PATH, FRAGMENT, SEGMENT, VERSION = "/", "!", "_", "@"

_s, _d, _i = T.StringType(), T.DateType(), T.IntegerType()
_struct = lambda **fields: T.StructType([T.StructField(k, v) for k, v in fields.items()])

NORM = _struct(urn=_s, type=_s, number=_s, year=_i, published=_d, alias=_s, summary=_s, source_url=_s, source_sha256=_s)
PROVISION = _struct(id=_s, norm_urn=_s, parent_id=_s, type=_s, label=_s, ordinal=_i, path=_s, text=_s, valid_from=_d, revoked_on=_d, amendment_note=_s)
XREF = _struct(origin_id=_s, target_urn=_s, target_id=_s, original_text=_s, resolved=T.BooleanType())
INGEST_LOG = _struct(norm_urn=_s, source_sha256=_s, at=T.TimestampType())
CHUNK = _struct(chunk_id=_s, provision_id=_s, path=_s, type=_s, valid_from_day=_i, revoked_on_day=_i, text_sha256=_s, vector=T.ArrayType(T.FloatType()), build=_s, norm_urn=_s)
POSTING = _struct(id=T.LongType(), term=_s, tf=T.LongType(), length=T.LongType(), norm_urn=_s, bucket=_i)
INDEXED = _struct(documents=T.LongType(), norm_urn=_s)
BLOCK = _struct(pos=_i, text=_s, struck=T.BooleanType(), anchors=T.ArrayType(_s), note=_s, action=_s, year=_i)
GOLD = _struct(id=_s, mecanismo=_s, pergunta=_s, data_referencia=_d, dispositivos_esperados=T.ArrayType(_s), deve_abster=T.BooleanType(), notas=_s)

#: The catalogue of norms (urn, short name, label, address, other names in use).
CATALOGUE = (
    ("urn:lex:br:federal:constituicao:1988-10-05;1988", "CF/88", "Constituição Federal de 1988", "https://www.planalto.gov.br/ccivil_03/constituicao/constituicao.htm", ("cf/88", "cf88", "cf", "constituicao", "constituicao federal", "crfb")),
    ("urn:lex:br:federal:lei:1990-09-11;8078", "CDC", "Lei 8.078/1990", "https://www.planalto.gov.br/ccivil_03/leis/l8078.htm", ("cdc", "codigo de defesa do consumidor", "lei 8.078/1990", "lei 8078")),
    ("urn:lex:br:federal:lei:2002-01-10;10406", "CC", "Lei 10.406/2002", "https://www.planalto.gov.br/ccivil_03/leis/2002/l10406.htm", ("cc", "codigo civil", "lei 10.406/2002", "lei 10406")),
)


class QuarryError(Exception):
    """Base of all errors of this package."""


class DownloadFailed(QuarryError):
    """A raw document is missing, empty or not what its record says."""


class ParserUnavailable(QuarryError):
    """No parser takes a document."""


class IncompatibleIndex(QuarryError):
    """An index was built by another model or with another dimension."""


class Conflict(QuarryError):
    """Another commit was made since this one began."""


class UnknownNorm(QuarryError):
    """A norm is asked for that the store does not have."""


class GoldError(QuarryError):
    """A gold item contradicts itself or the corpus."""


class BackendFailed(QuarryError):
    """A generation backend gave no usable answer."""
