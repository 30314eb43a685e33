"""Licence scan by canonical digests, with DataFrame functions only.

A text is canonical after its copyright statements are removed, letters folded to lower case, everything but
letters and digits made a single space, and equivalent spellings made one. A copyright statement is a mark
(copyright, (c) or the sign), any further marks, a year or list or range of years, and the holder up to the
end of the sentence (a full stop before white space or the end), a paragraph break, or "all rights reserved";
a mark without a year after it is text like any other, and so is every line that merely begins with one.
"All rights reserved" on its own goes as well. Line breaks count as spaces, so re-wrapped texts agree.

A second form ends a statement at its line's end as well, for holder lines without a full stop that run
straight into the licence; a document's licence is that of its first form's digest, else that of its second.
The md5 digests are joined to those of the known licence texts in both forms: a hash join of entire texts,
never a comparison of parts. Each line is also looked up in the second form as a text of its own, so that a
notice inside a longer document is found. Digests of texts and lines are computed in one pass over the
documents and written once; the known digests are broadcast when their counted size allows it.

Defined cases: null and wordless texts have a null digest and no licence; a text of copyright statements only
is wordless; rows equal in id and text get equal results; of several licences with equal canonical texts the
first by name counts; an empty table gives no rows; the other columns of `docs` are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.licence_texts import SPELLINGS
from rankloom.llm.tables import stage
from rankloom.llm.text import text_key
from rankloom.plans.joins import broadcast_if_small

BROADCAST_BYTES = 16 * 1024 * 1024
_MARK = r"(?:copyright\b|\(c\)|©)"
_YEARS = r"\d{4}(?:\s*[-–,]\s*\d{4})*"
#: Fixed choices: copyright statements ending at their sentence, or also at their line.
STATEMENT = rf"(?i){_MARK}(?:[\s,]*{_MARK})*[\s,]*{_YEARS}[^.]*?(?:all rights reserved\.?|\.\s|\.\z|\n[ \t\r]*\n|\z)"
STATEMENT_LINE = rf"(?i){_MARK}(?:[ \t,]*{_MARK})*[ \t,]*{_YEARS}[^.\n]*?(?:all rights reserved\.?|\.\s|\.\z|\n|\z)"
RESERVED = r"(?i)\ball rights reserved\b\.?"


def folded(text: Column, statement: str = STATEMENT) -> Column:
    """Letters and digits in lower case, single spaces between, copyright statements gone."""
    kept = F.regexp_replace(F.regexp_replace(text, statement, " "), RESERVED, " ")
    return F.trim(F.regexp_replace(F.lower(kept), r"[^\p{L}\p{N}]+", " "))


def respelled(text: Column) -> Column:
    """Folded text with equivalent spellings made one; only texts that hold one of them are rewritten."""
    changed = text
    for given, usual in SPELLINGS:
        changed = F.regexp_replace(changed, rf"\b{given}\b", usual)
    any_of = "|".join(given for given, _ in SPELLINGS)
    return F.when(text.rlike(rf"\b({any_of})\b"), changed).otherwise(text)


def _digest(canonical_text: Column) -> Column:
    return F.when(canonical_text != "", F.md5(canonical_text.cast("binary")))


def digests(text: str = "text") -> tuple[Column, Column, Column]:
    """(digest of the text, digest of its line form, digests of its non-empty lines in line form)."""
    raw = F.coalesce(F.col(text), F.lit(""))
    lines = F.transform(F.split(raw, r"\r?\n|\r"), lambda line: respelled(folded(line, STATEMENT_LINE)))
    line_digests = F.transform(F.filter(lines, lambda line: line != ""), lambda line: F.md5(line.cast("binary")))
    return _digest(respelled(folded(raw))), _digest(respelled(folded(raw, STATEMENT_LINE))), line_digests


def known_digests(licences: DataFrame) -> DataFrame:
    """(digest, licence) of both forms of every known (licence, text)."""
    whole, line_form, _ = digests("text")
    forms = licences.select("licence", F.explode(F.array_distinct(F.array(whole, line_form))).alias("digest"))
    return forms.filter(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("licence").alias("licence"))


def scan_licences(docs: DataFrame, licences: DataFrame) -> DataFrame:
    """A row for each document: doc_id, digest, licence (of the entire text), notices (of its lines), found."""
    known = broadcast_if_small(stage(known_digests(licences), "licence_digests"), BROADCAST_BYTES)
    whole, line_form, lines = digests("text")
    hashed = stage(
        docs.select("doc_id", text_key().alias("text_key"), whole.alias("digest"), line_form.alias("line_form"), lines.alias("lines")),
        "licence_hashes",
    )
    units = hashed.select("doc_id", "text_key", F.explode("lines").alias("digest"))
    notices = stage(
        units.join(known, "digest").groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("licence")).alias("notices")),
        "licence_notices",
    ).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "notices")
    first = known.select("digest", F.col("licence").alias("first"))
    second = known.select(F.col("digest").alias("line_form"), F.col("licence").alias("second"))
    texts = hashed.join(first, "digest", "left").join(second, "line_form", "left")
    same = (F.col("text_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    out = texts.join(broadcast_if_small(notices, BROADCAST_BYTES), same, "left")
    none = F.array().cast("array<string>")
    licence = F.coalesce("first", "second")
    return out.select(
        "doc_id", "digest", licence.alias("licence"), F.coalesce("notices", none).alias("notices"),
        (licence.isNotNull() | F.col("notices").isNotNull()).alias("found"),
    )
