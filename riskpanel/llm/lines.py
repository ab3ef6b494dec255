"""Line dedup: content-defined chunks of lines, of which globally repeated ones are removed. DataFrame functions only.

1. A text is split at ``\\n``. A line's hash is 31 bits of its MD5. The rolling hash at a line is a polynomial of the hashes of the last
   ``window`` lines; where it is divisible by ``divisor`` a chunk ends. Boundaries so depend on nearby lines only, and an inserted
   line shifts none beyond the window.
2. Hashes of all chunks with at least ``min_lines`` lines and ``min_chars`` characters are counted. Only chunks whose hash occurs twice are
   looked at again: grouping them by their text compares them byte by byte.
3. Of equal chunks the first stays, by (doc_id, hash of the text, position in it); the others are cut out, with one of their line breaks.

Counting and grouping are partial aggregates, so a chunk that half of all documents share costs a row per task. What is to be cut is joined
back by (doc_id, hash of the text).

Defined cases: NULL and empty texts have no chunks and stay as they are; a text of which all is cut becomes empty; rows with equal
doc_id and text are one document and get the same result; chunks of rows with a NULL doc_id count as occurrences after all others and are cut
like them. Only ``doc_id`` and ``text`` are looked at; further columns of any name are carried along by ``dedup``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskpanel.llm.common import unused
from riskpanel.session import materialize

PRIME = 2147483647
BASE = 1000003


@dataclass(frozen=True)
class LineParams:
    window: int = 2
    divisor: int = 4
    min_lines: int = 2
    min_chars: int = 40


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long") % PRIME


def chunk_starts(lines: Column, params: LineParams) -> Column:
    """Positions (from 0) of the first line of each chunk."""
    def ends(hashes: Column) -> Column:
        def boundary(i: Column) -> Column:
            total = F.lit(0).cast("long")
            for k in range(params.window):  # the oldest line of the window has the highest power
                total = F.when(i >= k, (total + F.get(hashes, i - k) * F.lit(pow(BASE, k, PRIME)).cast("long")) % PRIME).otherwise(total)
            return total % params.divisor == 0

        return F.filter(F.sequence(F.lit(0), F.size(hashes) - 2), boundary)

    # One evaluation of the hashes: a one-element array binds them for the inner function.
    bound = F.transform(F.array(F.transform(lines, line_hash)), lambda h: F.when(
        F.size(h) > 1, F.concat(F.array(F.lit(0)), F.transform(ends(h), lambda i: i + 1))).otherwise(F.array(F.lit(0))))
    return F.element_at(bound, 1)


def text_hash(text: Column) -> Column:
    """60 bits of the MD5 of a text."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def chunks(docs: DataFrame, params: LineParams) -> DataFrame:
    """``doc_id``, ``th`` (hash of the text), ``at`` (first line), ``n`` (lines), ``chunk`` of every chunk long enough to go."""
    split = docs.where("text <> ''").select("doc_id", text_hash(F.col("text")).alias("th"), F.split("text", "\n", -1).alias("lines"))
    split = split.withColumn("starts", chunk_starts(F.col("lines"), params))
    upto = F.concat(F.slice("starts", 2, F.size("starts")), F.array(F.size("lines")))
    pieces = F.zip_with("starts", upto, lambda a, e: F.when(e - a >= params.min_lines, F.struct(
        a.alias("at"), (e - a).alias("n"), F.array_join(F.slice("lines", a + 1, e - a), "\n").alias("chunk"))))
    long_enough = F.filter(pieces, lambda c: c.isNotNull() & (F.length(c["chunk"]) >= params.min_chars))
    return split.select("doc_id", "th", F.inline(long_enough))


def repeated(docs: DataFrame, params: LineParams = LineParams()) -> DataFrame:
    """``doc_id``, ``th``, ``cuts``: for each document that has any, the chunks to cut, as (at, n)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = chunks(rows, params).withColumn("hash", F.xxhash64("chunk"))
    place = F.xxhash64("doc_id", "th", "at")
    twice = (  # hashes met at two places or more
        found.select("hash", place.alias("place")).groupBy("hash").agg(F.min("place").alias("a"), F.max("place").alias("z"))
        .where("a <> z").select("hash")
    )
    again = materialize(found.join(twice, "hash", "left_semi").drop("hash"), "line_chunks")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th", "at")
    first = again.groupBy("chunk").agg(F.min(order).alias("first"))  # by the bytes
    cut = again.join(first, "chunk").where(~order.eqNullSafe(F.col("first"))).select("doc_id", "th", "at", "n")
    return cut.distinct().groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(F.struct("at", "n"))).alias("cuts"))


def remaining(text: Column, cuts: Column) -> Column:
    """The text without the lines of ``cuts``, which are sorted and do not overlap."""
    lines = F.split(text, "\n", -1)
    def segment(k: Column) -> Column:
        before = F.get(cuts, k - 1)
        start = F.when(k > 0, before["at"] + before["n"]).otherwise(0)
        end = F.coalesce(F.get(cuts, k)["at"], F.size(lines))
        return F.slice(lines, start + 1, end - start)

    return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(cuts)), segment)), "\n")


def marked(docs: DataFrame, params: LineParams = LineParams()) -> tuple[DataFrame, str, str]:
    """``docs`` with two columns more, and their names, which no other column has: what was cut (NULL if nothing) and the text that remains."""
    cut, left, own_id, th = (unused(c, docs) for c in ("_cuts", "_text", "_id", "_th"))
    cuts = repeated(docs, params).select(F.col("doc_id").alias(own_id), F.col("th").alias(th), F.col("cuts").alias(cut))
    own = docs["doc_id"].cast("long").eqNullSafe(F.col(own_id)) & (text_hash(docs["text"]) == F.col(th))
    out = docs.join(cuts, own, "left").drop(own_id, th)
    return out.withColumn(left, F.when(F.col(cut).isNull(), F.col("text")).otherwise(remaining(F.col("text"), F.col(cut)))), cut, left


def report(docs: DataFrame, params: LineParams = LineParams()) -> DataFrame:
    """``doc_id``, ``n_lines``, ``n_cut_chunks``, ``n_cut_lines``, ``text`` (what remains), one row per row of ``docs``."""
    out, _, _ = marked(docs.select("doc_id", "text"), params)
    cut_lines = F.aggregate("_cuts", F.lit(0), lambda a, c: a + c["n"])
    return out.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.when(F.coalesce(F.col("text"), F.lit("")) == "", 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long").alias("n_lines"),
        F.when(F.col("_cuts").isNull(), 0).otherwise(F.size("_cuts")).cast("long").alias("n_cut_chunks"),
        F.coalesce(cut_lines, F.lit(0)).cast("long").alias("n_cut_lines"), F.col("_text").alias("text"))


def dedup(docs: DataFrame, params: LineParams = LineParams()) -> DataFrame:
    """``docs`` with repeated chunks cut from ``text``: a stage of a pipeline. ``n_chars``, if there, follows the text."""
    kept = docs.columns
    out, cut, left = marked(docs, params)
    out = out.withColumn("text", F.col(left))
    if "n_chars" in kept:
        out = out.withColumn("n_chars", F.when(F.col(cut).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in kept])


def report_sql(params: LineParams = LineParams()) -> str:
    """The same as ``report`` in SQL."""
    total = " + ".join(f"CASE WHEN j > {k} THEN hs[j - {k}] * {pow(BASE, k, PRIME)} ELSE 0 END" for k in range(params.window))
    return f"""
WITH d AS (SELECT DISTINCT doc_id, text, string_split(text, chr(10)) AS lines FROM documents WHERE text <> ''),
h AS (SELECT *, list_transform(lines, lambda x: CAST('0x' || substr(md5(x), 1, 8) AS BIGINT) % {PRIME}) AS hs FROM d),
b AS (SELECT *, list_concat([0], list_filter(range(1, len(lines)), lambda j: ({total}) % {PRIME} % {params.divisor} = 0)) AS s FROM h),
c AS (SELECT doc_id, text, lines, unnest(s) AS pos, unnest(list_concat(s[2:], [len(lines)])) AS e FROM b),
k AS (SELECT doc_id, text, pos, e - pos AS n, array_to_string(lines[pos + 1:e], chr(10)) AS chunk FROM c WHERE e - pos >= {params.min_lines}),
r AS (SELECT *, row_number() OVER (PARTITION BY chunk
      ORDER BY doc_id NULLS LAST, CAST('0x' || substr(md5(text), 1, 15) AS BIGINT), pos) AS nth FROM k WHERE length(chunk) >= {params.min_chars}),
g AS (SELECT doc_id, text, count(*) AS chunks, sum(n) AS cut, flatten(list(range(pos + 1, pos + n + 1))) AS gone FROM r WHERE nth > 1 GROUP BY doc_id, text)
SELECT o.doc_id, CASE WHEN coalesce(o.text, '') = '' THEN 0 ELSE len(string_split(o.text, chr(10))) END AS n_lines,
  coalesce(g.chunks, 0) AS n_cut_chunks, CAST(coalesce(g.cut, 0) AS BIGINT) AS n_cut_lines,
  CASE WHEN g.gone IS NULL THEN o.text ELSE coalesce(array_to_string(list_transform(
    list_filter(range(1, len(string_split(o.text, chr(10))) + 1), lambda i: NOT list_contains(g.gone, i)),
    lambda i: string_split(o.text, chr(10))[i]), chr(10)), '') END AS text
FROM documents o LEFT JOIN g ON o.doc_id IS NOT DISTINCT FROM g.doc_id AND o.text = g.text
"""
