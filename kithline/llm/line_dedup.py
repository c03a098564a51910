"""Line dedup by content-defined chunks, in DataFrame functions only.

Each line of a text has a hash (32 bits of its MD5). A rolling hash over the
hashes of the line and the line before it decides where a chunk ends, so an
inserted or removed line moves the boundaries next to it and no others. Chunks of
at least two lines and ``MIN_CHARS`` characters are counted over all documents,
grouped by their whole text: rows of a group are equal byte by byte. A chunk that
occurs more than once stays where it first occurs, in the document with the
smallest id that has it, and is removed elsewhere, repeats in that document too.

Plan: a text is exploded into distinct chunks before the shuffle and groups are
summed on the map side, so a passage in a third of all rows is one row a task.
The narrow list of removals is grouped by document and joined back to the texts.

Edge cases: null text gives null text and no lines; empty text is one empty line;
texts of any length are chunked whole; rows that share an id count as one document
when the first one is chosen, and each keeps the chunk's first place; rows with a
null id lose whatever a document with an id keeps, and else keep theirs; an empty
table gives an empty result; columns of documents other than text stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A chunk ends on average after so many lines.
LINES_A_CHUNK = 3
MIN_LINES, MIN_CHARS = 2, 40
#: Weight of the line before in the rolling hash of two lines.
ROLL = 31
COUNTS = ["n_lines", "n_removed", "n_chunks_removed"]


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("bigint")


def with_chunks(docs: DataFrame, lines_a_chunk: int = LINES_A_CHUNK) -> DataFrame:
    """Adds kith_chunks: the chunks of the text in order, as text and number of lines."""
    lines = F.split(F.col("text"), "\n", -1)
    return (
        docs.withColumn("kith_lines", lines)
        .withColumn("kith_hash", F.transform("kith_lines", line_hash))
        .withColumn(
            "kith_ends",
            F.expr(f"""filter(sequence(1, size(kith_hash)), i -> i = size(kith_hash)
                       or pmod(kith_hash[i - 1] + {ROLL} * if(i > 1, kith_hash[i - 2], 0L), {lines_a_chunk}) = 0)"""),
        )
        .withColumn(
            "kith_chunks",
            F.expr("""transform(kith_ends, (e, k) -> struct(
                       array_join(slice(kith_lines, if(k > 0, kith_ends[k - 1], 0) + 1, e - if(k > 0, kith_ends[k - 1], 0)), '\n') as text,
                       e - if(k > 0, kith_ends[k - 1], 0) as n))"""),
        )
        .drop("kith_lines", "kith_hash", "kith_ends")
    )


def _counted(chunks: DataFrame, min_lines: int, min_chars: int) -> DataFrame:
    """A row for each document and distinct chunk that may be removed: doc_id, text, occurrences."""
    usable = F.expr(f"array_distinct(transform(filter(kith_chunks, c -> c.n >= {min_lines} and length(c.text) >= {min_chars}), c -> c.text))")
    return chunks.select("doc_id", F.col("kith_chunks"), F.explode(usable).alias("kith_text")).select(
        "doc_id", "kith_text", F.expr("size(filter(kith_chunks, c -> c.text = kith_text))").alias("kith_n")
    )


def repeated(docs: DataFrame, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS) -> DataFrame:
    """The chunks that occur more than once: text, occurrences and the first document."""
    return (
        _counted(with_chunks(docs.select("doc_id", "text")), min_lines, min_chars)
        .groupBy("kith_text").agg(F.sum("kith_n").alias("n"), F.min("doc_id").alias("first_doc"))
        .where("n > 1")
    )


def judge(docs: DataFrame, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS) -> DataFrame:
    """All columns of docs but those named like the counts, text cleaned, and n_lines, n_removed (lines), n_chunks_removed."""
    # removal lists by document and text hash: (chunk hash, stays once here)
    again = repeated(docs, min_lines, min_chars).select(F.xxhash64("kith_text").alias("kith_key"), F.sha2("kith_text", 256).alias("kith_sha"), "first_doc")
    own = (
        with_chunks(docs.select("doc_id", "text"))
        .select("doc_id", F.explode(F.expr(f"array_distinct(transform(filter(kith_chunks, c -> c.n >= {min_lines} and length(c.text) >= {min_chars}), c -> c.text))")).alias("kith_text"))
        .select("doc_id", F.xxhash64("kith_text").alias("kith_key"), F.sha2("kith_text", 256).alias("kith_sha"))
    )
    lists = (
        own.join(again, ["kith_key", "kith_sha"])
        .groupBy("doc_id").agg(F.collect_set(F.struct(F.col("kith_sha"), F.coalesce(F.col("doc_id") == F.col("first_doc"), F.col("first_doc").isNull()).alias("stays"))).alias("kith_again"))
        .withColumnRenamed("doc_id", "kith_doc")
    )
    base = docs.drop(*COUNTS)
    out = with_chunks(base.join(lists, F.col("doc_id").eqNullSafe(F.col("kith_doc")), "left").drop("kith_doc"))
    # 0: stays, 1: removed. A chunk that stays once stays at its first place in the text.
    marks = F.expr("""transform(kith_chunks, (c, k) -> if(kith_again is null, 0, case
                        when array_contains(kith_again, struct(sha2(c.text, 256) as kith_sha, false as stays)) then 1
                        when array_contains(kith_again, struct(sha2(c.text, 256) as kith_sha, true as stays)) and array_position(transform(kith_chunks, x -> x.text), c.text) <= k then 1
                        else 0 end))""")
    out = out.withColumn("kith_marks", marks)
    kept = F.expr("array_join(transform(filter(arrays_zip(kith_chunks, kith_marks), z -> z.kith_marks = 0), z -> z.kith_chunks.text), '\n')")
    total = lambda of: F.coalesce(F.expr(f"aggregate(arrays_zip(kith_chunks, kith_marks), 0L, (a, z) -> a + {of})"), F.lit(0))
    return out.select(
        *(kept.alias("text") if c == "text" else F.col(c) for c in base.columns),
        total("z.kith_chunks.n").alias("n_lines"), total("z.kith_marks * z.kith_chunks.n").alias("n_removed"), total("z.kith_marks").alias("n_chunks_removed"),
    )


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, and the SHA-256 of the text that stays."""
    return judge(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "n_chunks_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def clean(docs: DataFrame) -> DataFrame:
    """docs with repeated chunks removed from their texts; no other column changes, whatever it is called."""
    aside = {c: f"kith_own_{c}" for c in COUNTS if c in docs.columns}
    cleaned = judge(docs.withColumnsRenamed(aside)).drop(*COUNTS)
    return cleaned.withColumnsRenamed({v: k for k, v in aside.items()}).select(docs.columns)


ORACLE_SQL = rf"""
WITH l AS (
  SELECT doc_id, i, line, CAST(concat('0x', md5(line)[1:8]) AS BIGINT) AS h
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL)),
e AS (
  SELECT doc_id, i, line, (h + {ROLL} * lag(h, 1, 0) OVER (PARTITION BY doc_id ORDER BY i)) % {LINES_A_CHUNK} = 0 AS ends FROM l),
g AS (
  SELECT doc_id, i, line, coalesce(sum(CAST(ends AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM e),
c AS (SELECT doc_id, k, string_agg(line, chr(10) ORDER BY i) AS t, count(*) AS n FROM g GROUP BY doc_id, k),
r AS (SELECT t, min(doc_id) AS first_doc FROM c WHERE n >= {MIN_LINES} AND length(t) >= {MIN_CHARS} GROUP BY t HAVING count(*) > 1),
m AS (
  SELECT c.doc_id, c.k, c.t, c.n,
         CASE WHEN r.t IS NULL THEN 0 WHEN c.doc_id <> r.first_doc THEN 1
              WHEN row_number() OVER (PARTITION BY c.doc_id, c.t ORDER BY c.k) > 1 THEN 1 ELSE 0 END AS gone
  FROM c LEFT JOIN r ON c.t = r.t),
s AS (
  SELECT doc_id, sum(n) AS n_lines, sum(n * gone) AS n_removed, sum(gone) AS n_chunks_removed, string_agg(t, chr(10) ORDER BY k) FILTER (WHERE gone = 0) AS kept
  FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_chunks_removed, 0) AS BIGINT) AS n_chunks_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN s USING (doc_id)
"""
