"""Analysis of Portuguese text for BM25: words, stop words and the published staged stemmer, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: vowels, suffixes of each stage, stop words, the longest word that is indexed

VOWELS = "aeiouáéíóúâêô"
#: Stage 1, deleted in the second region.
DELETED = """eza ezas ico ica icos icas ismo ismos ável ível ista istas oso osa osos osas amento amentos imento imentos
adora ador aça~o adoras adores aço~es ante antes ância""".split()
#: Stage 1, replaced in the second region.
REPLACED = {"logia": "log", "logias": "log", "uça~o": "u", "uço~es": "u", "ência": "ente", "ências": "ente"}
#: Stage 1, deleted with what may stand before them, each only in the second region (of amente: itself in the first).
COMPOUND = {
    "amente": ("ativ", "iv", "os", "ic", "ad"),
    "mente": ("ante", "avel", "ível"),
    "idade": ("abil", "ic", "iv"),
    "idades": ("abil", "ic", "iv"),
    "iva": ("at",),
    "ivo": ("at",),
    "ivas": ("at",),
    "ivos": ("at",),
}
#: Stage 1, replaced by ir in the verb region after an e.
AFTER_E = ("ira", "iras")
#: Stage 2, deleted in the verb region.
VERBS = """ada ida ia aria eria iria ará ara erá era irá ava asse esse isse aste este iste ei arei erei irei am iam ariam
eriam iriam aram eram iram avam em arem erem irem assem essem issem ado ido ando endo indo ara~o era~o ira~o ar er ir as
adas idas ias arias erias irias arás aras erás eras irás avas es ardes erdes irdes ares eres ires asses esses isses astes
estes istes is ais eis íeis aríeis eríeis iríeis áreis areis éreis ereis íreis ireis ásseis ésseis ísseis áveis ados idos
ámos amos íamos aríamos eríamos iríamos áramos éramos íramos ávamos emos aremos eremos iremos ássemos êssemos íssemos imos
armos ermos irmos eu iu ou ira iras""".split()
#: Stage 4, deleted in the verb region.
RESIDUAL = "os a i o á í ó".split()
MOST_LETTERS = 40

STOP = """a à ao aos aquela aquelas aquele aqueles aquilo as às até com como da das de dela delas dele deles depois do dos e é
ela elas ele eles em entre essa essas esse esses esta estas este estes eu isso isto já lhe lhes mais mas me mesmo meu meus
minha minhas muito na não nas nem no nos nós nossa nossas nosso nossos num numa o os ou para pela pelas pelo pelos por qual
quando que quem se sem seu seus só sua suas também te teu teus tu tua tuas um uma você vocês vos
era eram éramos está estamos estão estar estava estavam estávamos esteja estejam estejamos esteve estive estou
foi fomos fora foram fôramos fui há haja hajam hajamos hão havemos haver hei houve
são seja sejam sejamos ser será serão serei seremos seria seriam seríamos somos sou
tem tém temos tenha tenham tenhamos tenho terá terão terei teremos teria teriam teríamos teve tinha tinham tínhamos tive""".split()
#: The past forms of estar, haver and ter: each stem with each ending.
PAST_STEMS, PAST_ENDINGS = ("estiv", "houv", "tiv"), "emos er era eram éramos erem ermos esse essem éssemos".split()
#: Those of ser, and the future of haver.
OTHER_FORMS = "for forem formos fosse fossem fôssemos houverá houverão houverei houveremos houveria houveriam houveríamos".split()


def stop_words() -> list[str]:
    return sorted({*STOP, *OTHER_FORMS, *(s + e for s in PAST_STEMS for e in PAST_ENDINGS)})


# ---- the stemmer

_V, _C = f"[{VOWELS}]", f"[^{VOWELS}]"
FIRST_REGION = f"^.*?{_V}{_C}"
SECOND_REGION = f"^.*?{_V}{_C}.*?{_V}{_C}"
VERB_REGION = f"^(?:.{_C}.*?{_V}|{_V}{_V}.*?{_C}|{_C}{_V}.)"


def _longest(word: Column, suffixes) -> Column:
    """The longest of ``suffixes`` that the word ends with, empty if none: a lookup for each length, not a try of each suffix."""
    by_length: dict[int, list[str]] = {}
    for s in suffixes:
        by_length.setdefault(len(s), []).append(s)
    found = [F.when(F.right(word, F.lit(n)).isin(*by_length[n]), F.right(word, F.lit(n))) for n in sorted(by_length, reverse=True)]
    return F.coalesce(*found, F.lit(""))


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _cut(word: Column, suffix: Column) -> Column:
    return F.substring(word, F.lit(1), F.char_length(word) - F.char_length(suffix))


def _begins(word: Column, pattern: str) -> Column:
    """How many letters come before a region; all of them where there is none."""
    return F.coalesce(F.nullif(F.char_length(F.regexp_extract(word, pattern, 0)), F.lit(0)), F.char_length(word))


def _standard(word: Column, one: Column, two: Column, verb: Column) -> Column:
    """Stage 1: the longest suffix of all decides what is done; the word as it is if its region forbids it."""
    every = [*DELETED, *REPLACED, *COMPOUND, *AFTER_E]
    alike: dict[tuple[str, ...], list[str]] = {}
    for s, before in COMPOUND.items():
        alike.setdefault(before, []).append(s)

    def by(suffix: Column) -> Column:
        left = _cut(word, suffix)
        also = F.coalesce(*[F.when(suffix.isin(*same), _longest(left, before)) for before, same in alike.items()], F.lit(""))
        return _let(F.struct(suffix.alias("s"), left.alias("left"), also.alias("also")), decided)

    def decided(x: Column) -> Column:
        s, left, also = x["s"], x["left"], x["also"]
        n, region = F.char_length(left), F.when(s == "amente", one).when(s.isin(*AFTER_E), verb).otherwise(two)
        # at before iv goes only if it is in the region too; iv alone may go without it
        further = F.coalesce(*[F.when(n - k >= two, F.lit(k)) for k in (4, 2)], F.lit(0))
        more = F.when(also == "ativ", further).when(n - F.char_length(also) >= two, F.char_length(also)).otherwise(F.lit(0))
        new = F.coalesce(*[F.when(s.isin(*[k for k, v in REPLACED.items() if v == r]), F.lit(r)) for r in dict.fromkeys(REPLACED.values())], F.when(s.isin(*AFTER_E), F.lit("ir")), F.lit(""))
        kept = (s == "") | (n < region) | (s.isin(*AFTER_E) & ~left.endswith("e"))
        return F.when(kept, word).otherwise(F.concat(F.substring(left, F.lit(1), n - more), new))

    return _let(_longest(word, every), by)


def _within(word: Column, verb: Column, suffixes) -> Column:
    """The word without the longest of ``suffixes`` that lies in the verb region."""
    return _let(F.substring(word, verb + 1, F.char_length(word)), lambda region: _cut(word, _longest(region, suffixes)))


def stem(word: Column) -> Column:
    """The stem of a lower-case word, by the published algorithm for Portuguese."""

    def staged(w: Column) -> Column:
        regions = F.struct(_begins(w, FIRST_REGION).alias("one"), _begins(w, SECOND_REGION).alias("two"), _begins(w, VERB_REGION).alias("verb"))
        return _let(regions, lambda r: after_first(w, r))

    def after_first(w: Column, r: Column) -> Column:
        return _let(_standard(w, r["one"], r["two"], r["verb"]), lambda x: _let(F.when(x != w, x).otherwise(_within(w, r["verb"], VERBS)), lambda y: last(w, y, r["verb"])))

    def last(w: Column, y: Column, verb: Column) -> Column:
        ci = F.when(y.endswith("ci") & (F.char_length(y) > verb), _cut(y, F.lit("i"))).otherwise(y)
        return _let(F.when(y != w, ci).otherwise(_within(y, verb, RESIDUAL)), lambda z: final(z, verb))

    def final(z: Column, verb: Column) -> Column:
        n = F.char_length(z)
        short = F.substring(z, F.lit(1), n - 1)
        # the u of gu or the i of ci goes with the e, if it is in the region too
        shorter = F.when(short.rlike("(?:gu|ci)$") & (n - 2 >= verb), F.substring(z, F.lit(1), n - 2)).otherwise(short)
        plain = F.when(z.endswith("ç"), F.concat(short, F.lit("c"))).otherwise(z)
        return F.when(z.rlike("[eéê]$"), F.when(n - 1 >= verb, shorter).otherwise(z)).otherwise(plain)

    apart = F.replace(F.replace(word, F.lit("ã"), F.lit("a~")), F.lit("õ"), F.lit("o~"))
    return F.replace(F.replace(_let(apart, staged), F.lit("a~"), F.lit("ã")), F.lit("o~"), F.lit("õ"))


# ---- the same for one word: a task folds each distinct word of its texts once

_REGIONS = [re.compile(p) for p in (FIRST_REGION, SECOND_REGION, VERB_REGION)]


def _ends(suffixes) -> list[tuple[int, frozenset[str]]]:
    return [(n, frozenset(s for s in suffixes if len(s) == n)) for n in sorted({len(s) for s in suffixes}, reverse=True)]


_EVERY, _VERBS, _RESIDUAL = (_ends(x) for x in ([*DELETED, *REPLACED, *COMPOUND, *AFTER_E], VERBS, RESIDUAL))
_BEFORE = {s: _ends(before) for s, before in COMPOUND.items()}


def _ending_of(word: str, ends: list[tuple[int, frozenset[str]]]) -> str:
    return next((word[-n:] for n, suffixes in ends if word[-n:] in suffixes), "")


def _word_standard(word: str, one: int, two: int, verb: int) -> str:
    s = _ending_of(word, _EVERY)
    left = word[: len(word) - len(s)]
    n = len(left)
    if not s or n < (one if s == "amente" else verb if s in AFTER_E else two) or (s in AFTER_E and not left.endswith("e")):
        return word
    also = _ending_of(left, _BEFORE[s]) if s in _BEFORE else ""
    if also == "ativ":
        more = next((k for k in (4, 2) if n - k >= two), 0)
    else:
        more = len(also) if n - len(also) >= two else 0
    return left[: n - more] + REPLACED.get(s, "ir" if s in AFTER_E else "")


def _word_within(word: str, verb: int, ends: list[tuple[int, frozenset[str]]]) -> str:
    return word[: len(word) - len(_ending_of(word[verb:], ends))]


def stem_word(word: str) -> str:
    """What ``stem`` gives for one word."""
    w = word.replace("ã", "a~").replace("õ", "o~")
    one, two, verb = (len(m[0]) if (m := p.match(w)) else len(w) for p in _REGIONS)
    x = _word_standard(w, one, two, verb)
    y = x if x != w else _word_within(w, verb, _VERBS)
    if y == w:
        z = _word_within(y, verb, _RESIDUAL)
    else:
        z = y[:-1] if y.endswith("ci") and len(y) > verb else y
    n = len(z)
    if z.endswith(("e", "é", "ê")):
        if n - 1 >= verb:
            z = z[: n - 2] if z[:-1].endswith(("gu", "ci")) and n - 2 >= verb else z[:-1]
    elif z.endswith("ç"):
        z = z[:-1] + "c"
    return z.replace("a~", "ã").replace("o~", "õ")


def kept_words(text: Column) -> Column:
    """A text's words in order: runs of letters, digits and underscores in lower case, without stop words and those over ``MOST_LETTERS``; null has none."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+")
    return F.filter(words, lambda w: (w != "") & (F.char_length(w) <= MOST_LETTERS) & ~w.isin(*stop_words()))


def analysed(text: Column) -> Column:
    """The stems of a text's words."""
    return F.transform(kept_words(text), stem)


# ---- the same in SQL, stage by stage, for comparison


def ending(suffixes) -> str:
    """A pattern whose leftmost match is the longest of ``suffixes``."""
    return f"(?:{'|'.join(suffixes)})$"


def stem_sql(words: str) -> str:
    """A query (word, stem) over the column word of the table expression ``words``, in DuckDB's SQL."""
    found = lambda w, pattern: f"regexp_extract({w}, '{pattern}', 0)"
    begins = lambda pattern: f"CASE WHEN {found('w', pattern)} = '' THEN length(w) ELSE length({found('w', pattern)}) END"
    cut = lambda w, s: f"left({w}, length({w}) - length({s}))"
    every = [*DELETED, *REPLACED, *COMPOUND, *AFTER_E]
    also = "CASE s " + " ".join(f"WHEN '{s}' THEN {found('b', ending(before))}" for s, before in COMPOUND.items()) + " ELSE '' END"
    replaced = "CASE s " + " ".join(f"WHEN '{s}' THEN '{new}'" for s, new in REPLACED.items()) + " ELSE '' END"
    compound = ", ".join(f"'{s}'" for s in COMPOUND)
    return f"""WITH a0 AS (SELECT word, replace(replace(word, 'ã', 'a~'), 'õ', 'o~') AS w FROM {words}),
a1 AS (SELECT word, w, {begins(FIRST_REGION)} AS one, {begins(SECOND_REGION)} AS two, {begins(VERB_REGION)} AS verb, {found("w", ending(every))} AS s FROM a0),
a2 AS (SELECT *, {cut("w", "s")} AS b FROM a1),
a3 AS (SELECT *, {also} AS also FROM a2),
a4 AS (SELECT *, CASE WHEN s = '' THEN w
    WHEN s IN ({compound}) THEN CASE WHEN length(b) < CASE WHEN s = 'amente' THEN one ELSE two END THEN w
        WHEN also = 'ativ' AND length(b) - 4 >= two THEN left(b, length(b) - 4) WHEN also = 'ativ' AND length(b) - 2 >= two THEN left(b, length(b) - 2) WHEN also = 'ativ' THEN b
        WHEN also <> '' AND length(b) - length(also) >= two THEN {cut("b", "also")} ELSE b END
    WHEN s IN ('ira', 'iras') THEN CASE WHEN length(b) >= verb AND right(b, 1) = 'e' THEN b || 'ir' ELSE w END
    WHEN length(b) >= two THEN b || {replaced} ELSE w END AS x FROM a3),
a5 AS (SELECT *, CASE WHEN x <> w THEN x ELSE left(w, length(w) - length({found("substr(w, verb + 1)", ending(VERBS))})) END AS y FROM a4),
a6 AS (SELECT *, CASE WHEN y = w THEN left(y, length(y) - length({found("substr(y, verb + 1)", ending(RESIDUAL))})) WHEN right(y, 2) = 'ci' AND length(y) > verb THEN left(y, length(y) - 1) ELSE y END AS z FROM a5),
a7 AS (SELECT word, CASE WHEN regexp_matches(z, '[eéê]$') THEN CASE WHEN length(z) - 1 < verb THEN z WHEN regexp_matches(z, '(gu|ci).$') AND length(z) - 2 >= verb THEN left(z, length(z) - 2) ELSE left(z, length(z) - 1) END
    WHEN right(z, 1) = 'ç' THEN left(z, length(z) - 1) || 'c' ELSE z END AS stem FROM a6)
SELECT word, replace(replace(stem, 'a~', 'ã'), 'o~', 'õ') AS stem FROM a7"""
