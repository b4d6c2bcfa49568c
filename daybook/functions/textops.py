"""Text: folding, words, stems."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say nothing in a question.
STOP_WORDS = """
а в во и к ко о об обо с со у на по за из от до для при про под над
не ни но же ли бы то что чем как где куда когда кто кого кому какой какая какие
какое каких какую сколько почему зачем это этот эта эти тот та те там тут здесь
я мне меня мной мы нас нам ты тебе тебя вы вам вас он она оно они его ее их
мой моя мои мое свой своей был была было были есть быть будет еще уже все всё всех
или если так также только очень может можно нужно надо день дня дне
расскажи скажи напомни покажи найди говорил говорила говорили сказал сказала обсуждали
the a an of to in on and or is was what when who did i my
""".split()
WORD = r"[\p{L}\d]+"


def trimmed(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def is_blank(text: Column) -> Column:
    return trimmed(text) == ""


def fold(text: Column) -> Column:
    return F.translate(F.lower(text), "ё", "е")


def words(text: Column) -> Column:
    """Letters and digits in a row, folded."""
    return F.regexp_extract_all(fold(text), F.lit(WORD), F.lit(0))


def spaced_words(text: Column) -> Column:
    """What stands between white space."""
    return F.array_remove(F.split(text, r"\s+"), "")


def has_digit(word: Column) -> Column:
    return word.rlike(r"\d")


def stem(word: Column) -> Column:
    """A crude stem, to be searched as a prefix: two letters less from six on, one less for four and five, words with a digit as they are."""
    n = F.char_length(word)
    cut = F.when(n >= 6, 2).when(n >= 4, 1).otherwise(0)
    return F.when(has_digit(word), word).otherwise(F.substring(word, F.lit(1), n - cut))


def stems(question: Column, leave_out: Column | None = None) -> Column:
    """Distinct stems of the meaningful words, in the order of their first place."""
    found = F.array_except(words(question), F.array(*map(F.lit, STOP_WORDS)))
    if leave_out is not None:
        found = F.array_except(found, F.coalesce(leave_out, F.array().cast("array<string>")))
    meaningful = F.filter(found, lambda w: (F.char_length(w) >= 3) | has_digit(w))
    return F.array_distinct(F.transform(meaningful, stem))


def without_times(text: Column) -> Column:
    """Lines without their leading [HH:mm]: what an embedder should see."""
    return F.regexp_replace(text, r"(?m)^\[\d{2}:\d{2}\] ", "")
