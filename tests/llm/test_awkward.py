"""Every corpus operator and every pipeline stage on rows with nulls, empty and long texts, ties, repeats, clashing column names, and on no rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from daybook.llm import exact_dedup, fingerprint, license_scan, line_dedup, lm_scoring, mixing, sentencepiece_sampling, simhash, token_counts, toxicity

#: Names that the operators use for columns of their own.
CLASHING = "row key whole gone first part edge top fold h members size token node n fp prefix p rate n_tokens logs e w site pos line score ids copies rare kept_id rejected_id gone_doc gone_pos copies__ rate_id__ copy__ component_id fingerprint salt n_lines n_removed domain bucket flagged edits label template run spans quality toxic fit_id labels".split()
SAID = "one two three four five six seven eight nine ten eleven twelve"
LONG = " ".join(f"word{k * 7919 % 5000}" for k in range(30_000)) + "\n" + "x" * 20_000

ROWS = [
    (0, None, "en", "a"),
    (1, "", None, None),
    (2, " \n\t ", "de", "b"),
    (3, SAID, "en", "a"),
    (4, SAID, "en", "b"),
    (4, SAID, "en", "b"),  # a row twice
    (5, "the MIT License of " + SAID, "fr", "c"),
    (5, "another text with the same number", "fr", "c"),  # an id twice
    (None, "apache license without a number " + SAID, "es", "d"),
    (None, None, None, None),
    (6, LONG, "en", "e"),
    (7, "日本語のテキスト 😀 ▁", "xx", "f"),
]
N, KNOWN, IDS = len(ROWS), 10, 8


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(k, t, lang, s, len(t) if t is not None else None) for k, t, lang, s in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING])


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(k, k % 2, (k // 2) % 2, ["en", "fr"][k % 2]) for k in range(8)] + [(None, 1, 1, "en"), (3, None, None, None), (99, 1, 1, "de")]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, domain string")


OPERATORS = {
    "op1": (lambda d, labels: mixing.soft_mix(d, labels, {"en": 0.5, "fr": 0.5}, total="cover", evidence=3, steps=12), IDS),
    "op2": (lambda d, labels: fingerprint.fingerprint(d), KNOWN),
    "op3": (lambda d, labels: token_counts.count_edited(d, F.array(F.struct(F.lit(2).cast("long").alias("start"), F.lit(3).cast("long").alias("length"), F.lit("new").alias("replacement")))), N),
    "op4": (lambda d, labels: toxicity.toxicity(d, labels), KNOWN),
    "op5": (lambda d, labels: line_dedup.line_dedup(d), N),
    "op6": (lambda d, labels: sentencepiece_sampling.sample_segmentations(d), None),
    "op7": (lambda d, labels: exact_dedup.exact_dedup(d), KNOWN),
    "op8": (lambda d, labels: license_scan.license_scan(d), N),
    "op9": (lambda d, labels: lm_scoring.lm_score(d, rounds=1), KNOWN),
    "op10": (lambda d, labels: simhash.simhash_groups(d), KNOWN),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_take_every_row(docs, labels, name):
    made, n = OPERATORS[name]
    rows = made(docs, labels).collect()
    ids = [r.doc_id for r in rows]
    if n is not None:
        assert len(rows) == n
    assert set(ids) - {None} == set(range(8))
    assert (None in ids) == (n == N)
    # rows that are alike come out alike
    same = [r for r in rows if r.doc_id == 4]
    assert name == "op1" or len({str(r.asDict()) for r in same}) == (2 if name == "op6" else 1)
    assert made(docs.limit(0), labels).count() == 0


def test_rows_that_share_an_id_are_told_apart(docs):
    by = {(r.doc_id, r.n_base): r for r in license_scan.license_scan(docs).collect()}
    assert by[(5, 1)].base_labels == "mit" and by[(5, 0)].labels == "" and by[(None, 1)].base_labels == "apache"
    line = "a line that stands on a great many sites"
    rows = [(k, f"text {k}\n{line}", f"s{k}") for k in range(6)] + [(3, f"{line}\nother", "s9"), (None, line, "s8")]
    df = docs.sparkSession.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.text for r in line_dedup.line_dedup(df).collect()}
    assert got == {f"text 0\n{line}", *(f"text {k}" for k in range(1, 6)), "other", line}


def test_no_letter_beyond_a_to_z_turns_into_one_of_a_template(spark):
    notice = "this work is licensed under the gnu general public license version 3"
    rows = [(1, notice), (2, notice.upper()), (3, "\u0130".join(notice.split("i", 1))), (4, "the M\u0130T license \u212a cc by"), (5, " ".join(w.replace("k", "\u212a") for w in ["mark", "by", "mit", "license"]))]
    got = {r.doc_id: r for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string"), notices={**license_scan.NOTICES, "book marks by mike": "k"}).collect()}
    assert got[1].labels == got[2].labels == "gpl,gpl-3.0" and got[4].base_labels == "cc-by" and got[5].base_labels == "mit"
    kelvin = spark.createDataFrame([(1, "boo\u212a mar\u212as by mi\u212ae"), (2, "Book MARKS by Mike")], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in license_scan.license_scan(kelvin, notices={"book marks by mike": "k"}).collect()}
    assert got == {1: "", 2: "k"}


def test_a_document_of_very_many_boilerplate_lines_takes_seconds(spark):
    lines = "\n".join(f"boilerplate line number {k} of many" for k in range(40_000))
    df = spark.createDataFrame([(k, lines, f"s{k}") for k in range(6)], "doc_id long, text string, source string")
    got = line_dedup.line_dedup(df).select("doc_id", "n_removed", F.char_length("text").alias("n")).collect()
    assert sorted((r.doc_id, r.n_removed, r.n) for r in got) == [(0, 0, len(lines))] + [(k, 40_000, 0) for k in range(1, 6)]


@pytest.mark.parametrize("name", dict(corpus_pipeline.STAGES))
def test_stages_take_every_row(spark, sf_dir, docs, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    made = stage(spark, docs, sf_dir)
    ids = [r.doc_id for r in made.collect()]
    assert None not in ids
    if name == "sentencepiece":
        assert set(ids) == set(range(8))
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
        return
    assert made.columns == docs.columns
    # clashing columns come through as they were
    assert made.select(*[F.col(c) for c in CLASHING]).distinct().collect() == [tuple(f"own {c}" for c in CLASHING)]
    if name == "simhash":
        assert sorted(ids) == [0, 3, 5, 5, 6, 7]
    else:
        assert set(ids) <= set(range(8)) and (name == "toxicity" or set(ids) == set(range(8)))
    assert stage(spark, docs.limit(0), sf_dir).count() == 0
