"""Digests: structured summaries that come as model output, often imperfect."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.functions.textops import is_blank, trimmed
from daybook.schemas import DIGEST

LISTS = ("events", "agreements", "tasks", "ideas")
#: Headings of a rendered digest.
HEADINGS = {"events": "События", "agreements": "Договорённости и обещания", "tasks": "Задачи", "ideas": "Идеи"}
_RAW = DIGEST + ", _corrupt_record STRING"


def _clean_list(items: Column) -> Column:
    kept = F.filter(F.transform(items, trimmed), lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(F.array_distinct(kept), F.array().cast("array<string>"))


def _clean(raw: Column) -> Column:
    text = lambda name: F.coalesce(trimmed(raw[name]), F.lit("")).alias(name)
    return F.struct(text("summary"), *[_clean_list(raw[n]).alias(n) for n in LISTS], text("mood"))


def empty_digest() -> Column:
    none = F.array().cast("array<string>")
    return F.struct(F.lit("").alias("summary"), *[none.alias(n) for n in LISTS], F.lit("").alias("mood"))


def is_empty(digest: Column) -> Column:
    """Without a summary and items; a mood alone is nothing."""
    found = is_blank(digest["summary"])
    for name in LISTS:
        found = found & (F.size(digest[name]) == 0)
    return found


def parse_digests(df: DataFrame, column: str = "json") -> DataFrame:
    """df with digest and parse_error: the object between the first { and the last }, strings trimmed, lists without blanks and repeats.

    What is missing is "" or []. digest is null where there is no object or it isn't complete; repair_digests mends the latter.
    """
    body = F.regexp_extract(F.col(column), r"(?s)\{.*\}", 0)
    raw = F.from_json(F.when(body != "", body), _RAW, {"columnNameOfCorruptRecord": "_corrupt_record", "mode": "PERMISSIVE"})
    ok = F.col("_raw").isNotNull() & F.col("_raw._corrupt_record").isNull()
    return df.withColumn("_raw", raw).withColumn("digest", F.when(ok, _clean(F.col("_raw")))).withColumn("parse_error", F.col("digest").isNull()).drop("_raw")


def completed_json(text: str) -> str | None:
    """The longest usable beginning of a cut object, closed: a cut string value ends in "…", a key without a value goes.

    Works outwards from the cut: the tail is shortened to the last place where a value ends, until the closed text parses.
    """
    text = text[text.find("{") :].rstrip() if "{" in text else ""
    depth: list[str] = []
    inside = escaped = False
    cuts: list[tuple[int, str]] = []
    for at, c in enumerate(text):
        if inside:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                inside = False
                cuts.append((at + 1, "".join(depth)))
        elif c == '"':
            inside = True
        elif c in "{[":
            depth.append("}" if c == "{" else "]")
            cuts.append((at + 1, "".join(depth)))
        elif c in "}]" and depth:
            depth.pop()
            cuts.append((at + 1, "".join(depth)))
            if not depth:
                return text[: at + 1]
    tries = []
    if inside:
        tries.append(text[: len(text) - escaped] + '…"' + "".join(reversed(depth)))
    tries += [text[:at] + open_[::-1] for at, open_ in reversed(cuts)]
    for candidate in tries:
        try:
            if isinstance(found := json.loads(candidate, strict=False), dict) and found:
                return candidate
        except ValueError:
            continue
    return None


def repair_digests(df: DataFrame, column: str = "json") -> DataFrame:
    """df of parse_digests with the digests of cut objects filled in. Only rows that failed go through Python."""

    @F.pandas_udf("string")
    def repair(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: completed_json(t) if t else None)

    failed = F.col("parse_error") & F.coalesce(F.col(column).contains("{"), F.lit(False))
    good = df.filter(~failed)
    mended = df.filter(failed).withColumn("_json", repair(F.col(column))).drop("digest", "parse_error")
    mended = parse_digests(mended, "_json").drop("_json").select(*df.columns)
    return good.unionByName(mended)


def digest_to_json(digest: Column) -> Column:
    return F.to_json(digest)


def render_digests(digest: Column, title: Column) -> Column:
    """Plain text for search: "title: summary" and a line for each list that has items; null for an empty digest."""
    rows = [F.concat(title, F.lit(": "), F.when(is_blank(digest["summary"]), "—").otherwise(digest["summary"]))]
    rows += [F.when(F.size(digest[n]) > 0, F.concat(F.lit(f"{HEADINGS[n]}: "), F.array_join(digest[n], "; "))) for n in LISTS]
    rows.append(F.when(~is_blank(digest["mood"]), F.concat(F.lit("Настроение: "), digest["mood"])))
    return F.when(digest.isNotNull() & ~is_empty(digest), F.concat_ws("\n", *rows))


def digest_items(df: DataFrame, *keys: str) -> DataFrame:
    """One row per item of a digest: the keys, kind, pos from 0, item."""
    lists = F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), F.col("digest")[n].alias("items")) for n in LISTS])).alias("l")
    return df.filter("digest IS NOT NULL").select(*keys, lists).select(*keys, "l.kind", F.posexplode("l.items").alias("pos", "item"))
