"""Column functions that parse the texts of contest records."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed values: (needle, division for men, division for women), in the order of the rules.
DIVISION_RULES = (("strawweight", "strawweight", "w_strawweight"), ("flyweight", "flyweight", "w_flyweight"), ("bantamweight", "bantamweight", "w_bantamweight"), ("featherweight", "featherweight", "w_bantamweight"), ("lightweight", "lightweight", "lightweight"), ("welterweight", "welterweight", "welterweight"), ("middleweight", "middleweight", "middleweight"), ("light heavyweight", "light_heavyweight", "light_heavyweight"), ("heavyweight", "heavyweight", "heavyweight"))


def division(text: Column) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    women = t.contains("women")
    out = None
    for needle, men, her in DIVISION_RULES:
        value = F.lit(men) if men == her else F.when(women, her).otherwise(men)
        out = F.when(t.contains(needle), value) if out is None else out.when(t.contains(needle), value)
    return out.otherwise("unknown")


def method_class(method: Column) -> Column:
    """ko, sub or dec; other methods are null."""
    m = F.coalesce(method, F.lit(""))
    return F.when(m.isin("KO/TKO", "TKO - Doctor's Stoppage"), "ko").when(m == "Submission", "sub").when(m.startswith("Decision"), "dec")


def method_category(method: Column, finish_round: Column) -> Column:
    m = F.coalesce(method, F.lit(""))
    finish = m.contains("KO") | m.contains("Sub")
    return F.when(finish & (finish_round <= 2), "early_finish").when(finish, "late_finish").when(m.contains("Split"), "split").when(m.contains("Majority"), "majority").when(m.contains("Unanimous"), "ud").otherwise("decision")


def inches(height: Column) -> Column:
    """5' 11" as 71; null for other texts."""
    feet = F.regexp_extract(height, r"^(\d+)'\s*(\d+)", 1).try_cast("double")
    return feet * 12 + F.regexp_extract(height, r"^(\d+)'\s*(\d+)", 2).try_cast("double")


def first_number(text: Column) -> Column:
    return F.regexp_extract(text, r"(\d+\.?\d*)", 1).try_cast("double")


def seconds(clock: Column) -> Column:
    """m:ss as seconds; 0 for other texts."""
    part = lambda i: F.get(F.split(F.trim(clock), ":"), F.lit(i)).try_cast("int")
    return F.when(F.size(F.split(F.trim(clock), ":")) == 2, F.coalesce(part(0) * 60 + part(1), F.lit(0))).otherwise(0)


def clock(secs: Column) -> Column:
    return F.format_string("%d:%02d", F.floor(secs / 60), secs % 60)


def of_pair(text: Column, which: int) -> Column:
    """The first (1) or second (2) number of `a of b`; 0 for other texts."""
    return F.coalesce(F.regexp_extract(text, r"^\s*(\d+)\s+of\s+(\d+)\s*$", which).try_cast("int"), F.lit(0))


def rounds_before(rounds: Column, finish_round: Column) -> Column:
    """Seconds of the rounds before the last of a format such as 5-5-5."""
    each = F.filter(F.transform(F.split(rounds, "-"), lambda x: x.try_cast("int") * 60), lambda x: x.isNotNull())
    return F.aggregate(F.slice(each, F.lit(1), F.greatest(finish_round - 1, F.lit(0))), F.lit(0), lambda a, x: a + x)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def last_segment(url: Column) -> Column:
    return F.element_at(F.split(F.rtrim(url, F.lit("/")), "/"), -1)


def normal_name(name: Column) -> Column:
    return F.trim(F.translate(F.replace(F.lower(name), F.lit("-"), F.lit(" ")), ".'", ""))


def elapsed(rounds: Column, finish_round: Column, finish_clock: Column) -> Column:
    """Seconds fought: the rounds before the last, and the clock of the last."""
    return rounds_before(rounds, finish_round) + seconds(finish_clock)


def most_seconds(rounds: Column) -> Column:
    """Seconds of all rounds of a format such as 5-5-5."""
    each = F.filter(F.transform(F.split(rounds, "-"), lambda x: x.try_cast("int") * 60), lambda x: x.isNotNull())
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def scheduled_rounds(rounds: Column) -> Column:
    """Rounds of a format such as 5-5-5; null where there is none."""
    return F.when(F.trim(rounds) != "", F.size(F.split(rounds, "-")))


def is_long(rounds: Column) -> Column:
    """Whether a format has five rounds or more."""
    return F.coalesce(F.size(F.split(rounds, "-")) - 1 >= 4, F.lit(False))


def is_title(weight_class: Column) -> Column:
    return F.coalesce(F.lower(weight_class).contains("title"), F.lit(False))


#: Letters that decompose into a base letter and a mark, by base letter; the rest stays.
FOLDS = {"A": "ÀÁÂÃÄÅĀĂĄ", "C": "ÇĆĈĊČ", "D": "Ď", "E": "ÈÉÊËĒĔĖĘĚ", "G": "ĜĞĠĢ", "H": "Ĥ", "I": "ÌÍÎÏĨĪĬĮİ", "J": "Ĵ", "K": "Ķ", "L": "ĹĻĽ", "N": "ÑŃŅŇ", "O": "ÒÓÔÕÖŌŎŐ", "R": "ŔŖŘ", "S": "ŚŜŞŠȘ", "T": "ŢŤȚ", "U": "ÙÚÛÜŨŪŬŮŰŲ", "W": "Ŵ", "Y": "ÝŶŸ", "Z": "ŹŻŽ"}
_FROM = "".join(v + v.lower().replace("i̇", "") for v in FOLDS.values())
_TO = "".join(k * len(v) + (k.lower() * len(v.lower().replace("i̇", ""))) for k, v in FOLDS.items())


def folded(name: Column) -> Column:
    """Without accents, in lower case, trimmed. Marks that stand apart (U+0300 to U+036F) go too."""
    return F.trim(F.lower(F.regexp_replace(F.translate(name, _FROM, _TO), "[̀-ͯ]", "")))


#: What folded() takes to its base letter, or leaves, as compatibility decomposition does: ASCII, the table's letters, and marks that stand apart.
_FOLDED = f"^[\\x00-\\x7F{_FROM}\u0300-\u034e\u0350-\u036f]*\\z"
_WHITE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f"


def _decomposed(name: Column) -> Column:
    def run(names: pa.Array) -> pa.Array:
        plain = lambda x: "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)).lower().strip()
        return pa.array([None if x is None else plain(x) for x in names.to_pylist()], pa.string())

    return F.arrow_udf(run, StringType())(name)


def unaccented(name: Column) -> Column:
    """Compatibility decomposition without combining marks, in lower case, stripped, of any script. Texts of ASCII and the table's letters stay
    in the engine's own functions; only others reach the Arrow function, which gets nulls for the rest."""
    plain = name.rlike(_FOLDED)
    return F.when(plain, F.btrim(folded(name), F.lit(_WHITE))).otherwise(_decomposed(F.when(~plain, name)))


def slug(name: Column) -> Column:
    """Lower case without accents; what is neither letter, digit nor space goes; spaces become one hyphen."""
    return F.regexp_replace(F.trim(F.regexp_replace(folded(name), r"[^a-z0-9\s-]", "")), r"[\s-]+", "-")


def flag_country(flag: Column) -> Column:
    """The two letters of the first flag in a text of regional indicators; null without two."""
    letters = F.regexp_replace(flag, "[^\U0001f1e6-\U0001f1ff]", "")
    plain = F.translate(letters, "".join(chr(0x1F1E6 + i) for i in range(26)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return F.when(F.length(plain) >= 2, F.substring(plain, 1, 2))


def age(day: Column, born: Column) -> Column:
    """Years of 365.25 days."""
    return F.datediff(day, born) / F.lit(365.25)


def calendar_age(day: Column, born: Column) -> Column:
    early = (F.month(day) < F.month(born)) | ((F.month(day) == F.month(born)) & (F.dayofmonth(day) < F.dayofmonth(born)))
    return F.year(day) - F.year(born) - early.cast("int")


def names_loser_or_winner(description: Column, name: Column) -> Column:
    """Whether an outcome's text holds the last word of a name."""
    return F.lower(description).contains(F.element_at(F.split(F.lower(F.trim(name)), " +"), -1))


def by_orientation(red_is_home: Column, home: Column, away: Column) -> tuple[Column, Column]:
    """(red, blue) of a home and an away value."""
    return F.when(red_is_home, home).otherwise(away), F.when(red_is_home, away).otherwise(home)


def winner_of(red_mark: Column, blue_mark: Column, red: Column, blue: Column) -> Column:
    """The id of the side marked W; red first; null for neither."""
    return F.when(F.trim(red_mark) == "W", red).when(F.trim(blue_mark) == "W", blue)


def softmax(*scores: Column) -> list[Column]:
    """Shares of exponentials, from the greatest score down."""
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    e = [F.exp(s - top) for s in scores]
    total = e[0]
    for x in e[1:]:
        total = total + x
    return [x / total for x in e]


def argmax(names: tuple[str, ...], *scores: Column) -> Column:
    """The name of the largest score, the first of equals."""
    at = F.array(*scores)
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.array_position(at, F.array_max(at)).cast("int"))
