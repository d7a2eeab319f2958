"""Line deduplication with DataFrame functions only.

Lines are normalised, exploded with their positions and hashed to 128 bits; distinct documents are
counted per hash; lines of frequent hashes lose every copy but those in the largest document id; and
what is left is put together by position. Texts move once, in the join that brings each document its
dropped positions.

Null or empty text is one empty line. A document without id is kept as it is and counts for nothing.
Rows of one id count as one document; each row loses its own lines. An empty table gives an empty one.
Other columns pass through untouched, whatever their names; ``n_lines`` and ``n_dropped`` are added
only on request and then replace columns of these names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRIPPED = " \t\n\x0b\x0c\r"
MIN_CHARS = 20
MIN_DOCS = 3

# Names of the columns that exist only inside this operator.
ROW, TEXT, POS, H1, H2 = "_ld_id", "_ld_text", "_ld_pos", "_ld_h1", "_ld_h2"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and all else as it is; ``lower`` does it for text that is all ASCII."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(lines: Column) -> Column:
    """The normalised lines: stripped of white space at both ends, A-Z lower-cased."""
    stripped = F.transform(lines, lambda line: F.btrim(line, F.lit(STRIPPED)))
    return F.transform(stripped, ascii_lower)


def frequent_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> DataFrame:
    """Positions of the lines to drop, as one array for each (id, hash of the text)."""
    keyed = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias(ROW), F.xxhash64(text_col).alias(TEXT), line_keys(split_lines(F.col(text_col))).alias("keys"))
    lines = keyed.select(ROW, TEXT, F.posexplode("keys").alias(POS, "key")).where(F.char_length("key") >= min_chars)
    hashed = lines.select(ROW, TEXT, POS, F.xxhash64("key").alias(H1), F.xxhash64(F.lit(1), F.col("key")).alias(H2))
    # Counting distinct ids deals rows by (hash, id) first, so that a hot line is spread over tasks.
    frequent = (hashed.groupBy(H1, H2).agg(F.countDistinct(ROW).alias("holders"), F.max(ROW).alias("last"))
                .where(F.col("holders") >= min_docs).select(H1, H2, "last"))
    return (hashed.join(frequent, [H1, H2]).where(F.col(ROW) != F.col("last"))
            .groupBy(ROW, TEXT).agg(F.collect_set(POS).alias(POS)))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                min_docs: int = MIN_DOCS, report: bool = False) -> DataFrame:
    """Documents without the lines that at least ``min_docs`` documents share."""
    drops = frequent_lines(docs, id_col, text_col, min_chars, min_docs)
    columns = docs.columns
    joined = (docs.withColumns({ROW: F.col(id_col), TEXT: F.xxhash64(text_col)}).join(drops, [ROW, TEXT], "left")
              .withColumn("_ld_lines", split_lines(F.col(text_col))))
    n_lines = F.size("_ld_lines")
    every = F.sequence(F.lit(0), n_lines - 1)
    kept = F.transform(F.array_except(every, F.col(POS)), lambda i: F.get(F.col("_ld_lines"), i))
    counted = joined.withColumns({
        "_ld_kept": F.when(F.col(POS).isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(F.array_join(kept, "\n")),
        "_ld_n": n_lines.cast("bigint"),
        "_ld_dropped": F.coalesce(F.size(POS), F.lit(0)).cast("bigint")})
    text = F.col("_ld_kept") if report else F.when(F.col(POS).isNull(), F.col(text_col)).otherwise(F.col("_ld_kept"))
    outputs = [text.alias(c) if c == text_col else F.col(c) for c in columns if not (report and c in ("n_lines", "n_dropped"))]
    if report:
        outputs += [F.col("_ld_n").alias("n_lines"), F.col("_ld_dropped").alias("n_dropped")]
    return counted.select(*outputs)
