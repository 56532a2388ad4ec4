"""Spanish word stems by the published Snowball rules, as Spark expressions.

Each step binds the state of the one before, so a stem is one expression of
modest size: no Python worker, no shuffle. The regions R1, R2 and RV are kept
as start positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.util import let

# ---- fixed values: begin (suffix classes of the published Spanish rules) ---
VOWELS = "aeiouáéíóúü"
PRONOUNS = "selas|selos|sela|selo|las|les|los|nos|me|se|la|le|lo"
PRONOUN_AFTER = "ando|ándo|ar|ár|er|ér|iendo|iéndo|ir|ír"
STANDARD = (
    "amientos|imientos|amiento|imiento|acion|aciones|uciones|adoras|adores|ancias|"
    "logías|encias|amente|idades|anzas|ismos|ables|ibles|istas|adora|ación|antes|"
    "ancia|logía|ución|encia|mente|anza|icos|icas|ismo|able|ible|ista|osos|osas|"
    "ador|ante|idad|ivas|ivos|ico|ica|oso|osa|iva|ivo"
)
ACTION = (
    "adora", "ador", "ación", "adoras", "adores", "acion", "aciones", "ante", "antes",
    "ancia", "ancias",
)
Y_VERBS = "yeron|yendo|yamos|yais|yan|yen|yas|yes|ya|ye|yo|yó"
VERBS = (
    "aríamos|eríamos|iríamos|iéramos|iésemos|aríais|aremos|eríais|eremos|iríais|"
    "iremos|ierais|ieseis|asteis|isteis|ábamos|áramos|ásemos|arían|arías|aréis|erían|"
    "erías|eréis|irían|irías|iréis|ieran|iesen|ieron|iendo|ieras|ieses|abais|arais|"
    "aseis|íamos|arán|arás|aría|erán|erás|ería|irán|irás|iría|iera|iese|aste|iste|"
    "aban|aran|asen|aron|ando|abas|adas|idas|aras|ases|íais|ados|idos|amos|imos|emos|"
    "ará|aré|erá|eré|irá|iré|aba|ada|ida|ara|ase|ían|ado|ido|ías|áis|éis|ía|ad|ed|id|"
    "an|ió|ar|er|ir|as|ís|en|es"
)
RESIDUAL = "os|a|e|o|á|é|í|ó"
# ---- fixed values: end -----------------------------------------------------

_V, _C = f"[{VOWELS}]", f"[^{VOWELS}]"
REGION_AFTER_VOWEL_CONSONANT = rf"(?s)^.*?{_V}{_C}(.*)\z"
REGION_RV = rf"(?s)^(?:.{_C}{_C}*{_V}|{_V}{_V}{_V}*{_C}|{_C}{_V}.)(.*)\z"


def _unaccent(word: Column) -> Column:
    return F.translate(word, "áéíóú", "aeiou")


def _end(text: Column, suffixes: str) -> Column:
    """Longest of the suffixes at the end of ``text``, '' when none."""
    return F.regexp_extract(text, rf"(?:{suffixes})\z", 0)


def _cut(word: Column, suffix: Column) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - F.length(suffix))


def _from(word: Column, start: Column) -> Column:
    return F.substring(word, start + 1, F.length(word))


def _state(word: Column, state: Column, done: Column | None = None) -> Column:
    """Next state: a new word, the same regions."""
    return F.struct(
        word.alias("w"), state["p1"].alias("p1"), state["p2"].alias("p2"),
        state["pv"].alias("pv"), (state["done"] if done is None else done).alias("done"),
    )


def _regions(word: Column) -> Column:
    """Start state: the word and where its regions begin."""
    r1 = F.regexp_extract(word, REGION_AFTER_VOWEL_CONSONANT, 1)
    r2 = F.regexp_extract(r1, REGION_AFTER_VOWEL_CONSONANT, 1)
    rv = F.regexp_extract(word, REGION_RV, 1)
    size = F.length(word)
    return F.struct(
        word.alias("w"), (size - F.length(r1)).alias("p1"), (size - F.length(r2)).alias("p2"),
        (size - F.length(rv)).alias("pv"), F.lit(False).alias("done"),
    )


def _attached_pronoun(x: Column) -> Column:
    suffix = _end(_from(x["w"], x["pv"]), PRONOUNS)

    def apply(y: Column) -> Column:
        base = _cut(x["w"], y)
        before = _from(base, x["pv"])
        attached = before.rlike(rf"(?:{PRONOUN_AFTER})\z") | (
            before.endswith("yendo") & base.endswith("uyendo")
        )
        return _state(F.when((y != "") & attached, _unaccent(base)).otherwise(x["w"]), x)

    return let(suffix, apply)


def _standard_suffix(x: Column) -> Column:
    def apply(y: Column) -> Column:
        base = _cut(x["w"], y)
        size = F.length(x["w"])
        done = (
            F.when(y == "amente", x["p1"] + 6 <= size)
            .when(y != "", x["p2"] + F.length(y) <= size)
            .otherwise(False)
        )
        rest = _from(base, x["p2"])
        further = (
            F.when(y == "amente", _end(rest, "ativ|iv|os|ic|ad"))
            .when(y.isin(*ACTION), _end(rest, "ic"))
            .when(y == "mente", _end(rest, "ante|able|ible"))
            .when(y.isin("idad", "idades"), _end(rest, "abil|ic|iv"))
            .when(y.isin("iva", "ivo", "ivas", "ivos"), _end(rest, "at"))
            .otherwise("")
        )
        short = (
            F.when(y.isin("logía", "logías"), F.concat(base, F.lit("log")))
            .when(y.isin("ución", "uciones"), F.concat(base, F.lit("u")))
            .when(y.isin("encia", "encias"), F.concat(base, F.lit("ente")))
            .otherwise(_cut(base, further))
        )
        return let(done, lambda d: _state(F.when(d, short).otherwise(x["w"]), x, d))

    return let(_end(x["w"], STANDARD), apply)


def _y_verb(x: Column) -> Column:
    def apply(y: Column) -> Column:
        inside = x["pv"] + F.length(y) <= F.length(x["w"])
        return _state(F.when(inside, _cut(x["w"], y)).otherwise(x["w"]), x)

    return F.when(x["done"], x).otherwise(
        let(F.regexp_extract(x["w"], rf"u({Y_VERBS})\z", 1), apply)
    )


def _verb(x: Column) -> Column:
    def apply(y: Column) -> Column:
        base = _cut(x["w"], y)
        soft = y.isin("en", "es", "éis", "emos") & base.endswith("gu")
        return _state(F.when(soft, _cut(base, F.lit("u"))).otherwise(base), x)

    return F.when(x["done"], x).otherwise(let(_end(_from(x["w"], x["pv"]), VERBS), apply))


def _residual(x: Column) -> Column:
    def apply(y: Column) -> Column:
        base = _cut(x["w"], y)
        soft = y.isin("e", "é") & base.endswith("gu") & (x["pv"] + 1 <= F.length(base))
        return _unaccent(F.when(soft, _cut(base, F.lit("u"))).otherwise(base))

    return let(_end(_from(x["w"], x["pv"]), RESIDUAL), apply)


def stem(word: Column) -> Column:
    """Spanish stem of a word."""
    state = let(F.lower(word), _regions)
    for step in (_attached_pronoun, _standard_suffix, _y_verb, _verb, _residual):
        state = let(state, step)
    return state


def with_stem(df: DataFrame, word: str, out: str) -> DataFrame:
    """Add the Spanish stem of column ``word`` as column ``out``."""
    return df.withColumn(out, stem(F.col(word)))
