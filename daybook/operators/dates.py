"""Date phrases in questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.functions.textops import fold

#: The words of date phrases.
TODAY = "сегодня сегодняшний сегодняшнего сегодняшнем".split()
YESTERDAY = "вчера вчерашний вчерашнего вчерашнем".split()
RECENT = "недавно днях".split()
PAST = "прошлый прошлую прошлое прошлой прошлом прошлая прошлого".split()
THIS = "этот эту это этой этом эта этого текущей текущем".split()
WEEKEND = "выходные выходных".split()
NUMBERS = {"один": 1, "одну": 1, "два": 2, "две": 2, "три": 3, "четыре": 4, "пять": 5, "шесть": 6, "семь": 7, "восемь": 8, "девять": 9, "десять": 10}
DAY_FORMS = ["понедельник[аеу]?", "вторник[аеу]?", "сред[аеуы]", "четверг[аеу]?", "пятниц[аеуы]", "суббот[аеуы]", "воскресень[еяю]"]
MONTH_STEMS = ["январ", "феврал", "март", "апрел", "ма[яей]", "июн", "июл", "август", "сентябр", "октябр", "ноябр", "декабр"]


def _month(word: Column) -> Column:
    """1 to 12: a stem and two letters at most; May in three forms alone."""
    return F.coalesce(*[F.when(word.rlike(f"^{stem}$" if k == 5 else f"^{stem}.{{0,2}}$"), k) for k, stem in enumerate(MONTH_STEMS, 1)])


def _date(y: Column, m: Column, d: Column) -> Column:
    """The date, or null if there is no such day."""
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    return F.try_to_date(F.concat_ws("-", pad(y, 4), pad(m, 2), pad(d, 2)), "yyyy-MM-dd")


def _not_ahead(today: Column, m: Column, d: Column) -> Column:
    """That day of this year, or of the last one if it is still ahead; null if this year has no such day."""
    here = _date(F.year(today), m, d)
    return F.when(here > today, _date(F.year(today) - 1, m, d)).otherwise(here)


def resolve_date_hints(questions: DataFrame) -> DataFrame:
    """questions (qid, text, today) with from_day, to_day (the span of all phrases, null without any) and date_words, the words they take.

    Tokens see their neighbours by a window over the question; each rule gives a range or null, and the span is an aggregation.
    """
    raw = F.transform(F.regexp_extract_all(fold(F.col("text")), F.lit(r"[\p{L}\d.]+"), F.lit(0)), lambda w: F.regexp_replace(w, r"\.+$", ""))
    tokens = questions.select("qid", "today", F.posexplode(raw).alias("pos", "w"))
    order = Window.partitionBy("qid").orderBy("pos")
    tokens = tokens.select("*", F.lag("w", 1, "").over(order).alias("p"), F.lead("w", 1, "").over(order).alias("n"), F.lead("w", 2, "").over(order).alias("n2"))
    w, p, n, t = F.col("w"), F.col("p"), F.col("n"), F.col("today")
    # what several rules need becomes a column of its own, so that no expression is planned many times
    numbers = F.create_map(*[F.lit(x) for pair in NUMBERS.items() for x in pair])
    tokens = tokens.withColumns(
        {
            "weekday": F.coalesce(*[F.when(w.rlike(f"^{form}$"), k) for k, form in enumerate(DAY_FORMS)]),
            "month_word": F.when(n == "го", F.col("n2")).otherwise(n),
            "number": F.when(w.rlike(r"^\d{1,9}$"), w.try_cast("int")),
            "amount": F.coalesce(F.when(p.rlike(r"^\d{1,9}$"), p.try_cast("int")), F.try_element_at(numbers, p)),
            "monday": F.date_sub(t, F.weekday(t)),
            "month_start": F.trunc(t, "month"),
            "past": p.isin(PAST),
            "this": p.isin(THIS),
            "dmy": F.when(w.rlike(r"^\d{1,2}\.\d{1,2}(\.\d{2,4})?$"), F.transform(F.split(w, r"\."), lambda x: x.cast("int"))),
        }
    )
    weekday, number, amount = F.col("weekday"), F.col("number"), F.col("amount")
    monday, first, past, this, dmy = F.col("monday"), F.col("month_start"), F.col("past"), F.col("this"), F.col("dmy")
    year = F.get(dmy, F.lit(2))
    tokens = tokens.withColumn("month", F.when(number.between(1, 31), _month(F.col("month_word"))))
    tokens = tokens.withColumns(
        {
            "named": F.when(F.col("month").isNotNull(), _not_ahead(t, F.col("month"), number)),
            "dotted": F.when(year.isNotNull(), _date(F.when(year < 100, year + 2000).otherwise(year), F.get(dmy, F.lit(1)), F.get(dmy, F.lit(0)))).when(dmy.isNotNull(), _not_ahead(t, F.get(dmy, F.lit(1)), F.get(dmy, F.lit(0)))),
            "unit": F.when(n == "назад", F.regexp_extract(w, "^(ден|дн|недел|месяц)", 1)),
            "sunday": F.date_add(monday, F.when(F.weekday(t) < 5, -1).when(past, -1).otherwise(6)),
            "last": F.date_sub(t, F.pmod(F.weekday(t) - weekday - 1, F.lit(7)) + 1),
            "count": F.coalesce(amount, F.lit(1)),
        }
    )
    named, dotted, unit, sunday, last, count = (F.col(c) for c in ("named", "dotted", "unit", "sunday", "last", "count"))
    span = lambda a, b, *used: F.struct(a.alias("a"), b.alias("b"), F.array(*used).alias("used"))
    add, none = F.date_add, F.lit("")
    counted = F.when(amount.isNotNull(), p).otherwise(none)
    week_ago, month_ago = F.date_sub(t, count * 7), F.add_months(t, -count)
    rules = [
        F.when(w.isin(TODAY), span(t, t, w)),
        F.when(w.isin(YESTERDAY), span(add(t, -1), add(t, -1), w)),
        F.when(w == "позавчера", span(add(t, -2), add(t, -2), w)),
        F.when(w.isin(RECENT), span(add(t, -6), t, w)),
        F.when(w.startswith("недел") & past, span(add(monday, -7), add(monday, -1), w, p)).when(w.startswith("недел") & this, span(monday, t, w, p)),
        F.when(w.startswith("месяц") & past, span(F.add_months(first, -1), add(first, -1), w, p)).when(w.startswith("месяц") & this, span(first, t, w, p)),
        F.when(w.isin(WEEKEND), span(add(sunday, -1), F.least(sunday, t), w, F.when(past, p).otherwise(none))),
        F.when(unit == "недел", span(add(week_ago, -2), F.least(add(week_ago, 2), t), w, n, counted))
        .when(unit == "месяц", span(add(month_ago, -5), F.least(add(month_ago, 5), t), w, n, counted))
        .when(unit.isin("ден", "дн"), span(F.date_sub(t, count), F.date_sub(t, count), w, n, counted)),
        F.when(weekday.isNotNull() & past, span(add(monday, weekday - 7), add(monday, weekday - 7), w, p)).when(weekday.isNotNull(), span(last, F.when(F.weekday(t) == weekday, t).otherwise(last), w, F.when(this, p).otherwise(none))),
        F.when(named.isNotNull(), span(named, named, w, F.col("month_word"))),
        F.when(dotted.isNotNull(), span(dotted, dotted, w)),
    ]
    # outer: for a plain explode the optimizer would repeat all rules in a filter
    hints = tokens.select("qid", F.explode_outer(F.array(*rules)).alias("h")).filter("h IS NOT NULL")
    found = hints.groupBy("qid").agg(F.min("h.a").alias("from_day"), F.max("h.b").alias("to_day"), F.array_sort(F.array_remove(F.array_distinct(F.flatten(F.collect_list("h.used"))), "")).alias("date_words"))
    return questions.join(found, "qid", "left").withColumn("date_words", F.coalesce("date_words", F.array().cast("array<string>")))
