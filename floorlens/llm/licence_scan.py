"""Licence scans by canonical digests, in DataFrame operations only.

A text is brought to a canonical form: lower case, lines that claim copyright
and lines without words dropped, punctuation as blanks, equivalent spellings
as one. Its digest is joined with those of known licences, so a text matches
if the whole of it does. Every line is a text of its own as well: notices
stand on lines inside documents.

The known texts are a fixed list, so their side of the join is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .licence_texts import PROSE, SPELLINGS, TEXTS

def other_word(words, start=True) -> str:
    """A pattern for a word, or the rest of one, that is none of ``words``;
    without lookahead, so that Java and RE2 take it."""
    firsts = sorted({w[0] for w in words if w})
    rest = [rf"(?:[^\P{{L}}{''.join(firsts)}]|\p{{N}})[\p{{L}}\p{{N}}]*"]
    rest += [f + other_word([w[1:] for w in words if w[:1] == f], False) for f in firsts]
    return f"(?:{'|'.join(rest)})" + ("" if start or "" in words else "?")


#: A line that claims copyright: the word, then a year, a sign or a name but
#: no word of a licence's own sentences; ``(c)`` with a year after it or at
#: the line's end, as list items begin so too; or the sign.
YEAR = r"[^\p{L}\p{N}\n]*(?:19|20)\p{N}\p{N}\b"
CLAIM = (
    r"(?m)^[ \t]*(?:#|//|\*|--|;)*[ \t]*(?:©[^\n]*|\(c\)(?:[^\n]*" + YEAR + r"[^\p{L}\n]*|" + YEAR + r"[^\n]*|[ \t]*copyright\b[^\n]*)"
    r"|copyright[^\p{L}\p{N}\n]+(?:" + rf"{other_word(PROSE)}(?:[^\p{{L}}\p{{N}}\n][^\n]*)?"
    r"|the\b[^\n]*\b(?:authors|contributors|developers|foundation|project|team)\b[^\p{L}\n]*))$"
)
NOT_WORD = r"[^\p{L}\p{N}\n]+"


def lines(text: Column) -> Column:
    """The canonical lines of a text, without empty ones."""
    low = F.regexp_replace(F.lower(text), CLAIM, "")
    out = F.concat(F.lit(" "), F.regexp_replace(F.regexp_replace(low, NOT_WORD, " "), "\n", " \n "), F.lit(" "))
    for found, kept in SPELLINGS:
        out = F.replace(out, F.lit(f" {found} "), F.lit(f" {kept} "))
    return F.filter(F.transform(F.split(out, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def known(spark, texts=TEXTS) -> DataFrame:
    """(text_digest, licence) of the known texts; of equal digests the first
    licence in order."""
    given = spark.createDataFrame(list(texts), "licence string, text string")
    whole = digest(F.array_join(lines(F.col("text")), " ")).alias("text_digest")
    return given.select("licence", whole).groupBy("text_digest").agg(F.min("licence").alias("licence"))


def scan(docs: DataFrame, licences: DataFrame) -> DataFrame:
    """Adds ``text_digest`` of the canonical whole, the ``licence`` it is (null:
    none) and ``line_licences``, the distinct licences whose whole text is one
    of the lines, sorted.

    Null and empty texts have the digest of the empty string and no licence,
    unless that is known. Every row gives one row, repeated rows too; columns
    named like the new ones are replaced."""
    rows = docs.drop("text_digest", "licence", "line_licences", "_lines", "_known")
    rows = rows.withColumn("_lines", lines(F.coalesce("text", F.lit(""))))
    rows = rows.withColumn("text_digest", digest(F.array_join("_lines", " ")))
    rows = rows.join(F.broadcast(licences), "text_digest", "left")
    # the fixed list once more, as one map: a line is looked up without leaving its row
    table = licences.agg(F.map_from_entries(F.collect_list(F.struct("text_digest", "licence")))).first()[0]
    pairs = F.create_map(*[F.lit(x) for pair in sorted(table.items()) for x in pair])
    found = F.transform("_lines", lambda x: F.try_element_at(pairs, digest(x)))
    listed = F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull())))
    return rows.withColumn("line_licences", listed).drop("_lines")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, text_digest, licence and the comma-joined line licences."""
    done = scan(docs.select("doc_id", "text"), known(docs.sparkSession))
    return done.select("doc_id", "text_digest", "licence", F.array_join("line_licences", ",").alias("line_licences"))


def sql() -> str:
    """The report as DuckDB SQL over ``documents``."""

    def quoted(x):
        return "'" + x.replace("'", "''") + "'"

    def canonical(column):
        claim = CLAIM.replace("\\b", r"\b")
        low = f"regexp_replace(lower({column}), {quoted(claim)}, '', 'g')"
        out = f"' ' || replace(regexp_replace({low}, {quoted(NOT_WORD)}, ' ', 'g'), chr(10), ' ' || chr(10) || ' ') || ' '"
        for found, kept in SPELLINGS:
            out = f"replace({out}, {quoted(f' {found} ')}, {quoted(f' {kept} ')})"
        return f"list_filter(list_transform(string_split({out}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"

    values = ", ".join(f"({quoted(k)}, {quoted(t)})" for k, t in TEXTS)
    return f"""
WITH given(licence, text) AS (VALUES {values}),
known AS (SELECT sha256(array_to_string({canonical('text')}, ' ')) AS text_digest, min(licence) AS licence FROM given GROUP BY 1),
d AS (SELECT doc_id, {canonical("coalesce(text, '')")} AS lines FROM documents),
l AS (SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS line_licences
      FROM (SELECT doc_id, sha256(unnest(lines)) AS text_digest FROM d) JOIN known USING (text_digest) GROUP BY 1)
SELECT doc_id, sha256(array_to_string(lines, ' ')) AS text_digest, known.licence, coalesce(line_licences, '') AS line_licences
FROM d LEFT JOIN known ON known.text_digest = sha256(array_to_string(lines, ' ')) LEFT JOIN l USING (doc_id)
"""
