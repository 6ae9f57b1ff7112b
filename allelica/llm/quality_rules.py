"""Quality rules: document statistics and cross-document line frequency, in DataFrame functions only.

A line is normalised (lower case; white space, digits and ASCII punctuation become one space) and hashed.
The distinct documents that hold it are counted for each host and over all hosts. A line in more documents
than either limit is removed, and a document that loses most of its words is rejected as depleted. The
limits are numbers of documents, so the verdict on a line does not depend on the size of its host.

A line counts as frequent only if the documents that hold it have more than ``min_texts`` different texts:
a document copied as a whole a thousand times is no boilerplate and is left to deduplication. ``source``
serves as host; a null host is a host of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allelica.llm.common import ROW, SPACE, keyed, own_names, passing, words_of, written

WINDOW = 8
HOST_DOCS, ALL_DOCS, MIN_TEXTS, MAX_LOST = 10, 20, 5, 0.5
_HAS_WORD = r"[^\x20\x09-\x0D]"
_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def normalised(line: Column) -> Column:
    """A line as it is compared between documents: ASCII letters lower, gaps, digits and punctuation one space."""
    letters = F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(letters, r"[\x00-\x60\x7B-\x7F]+", " "))


def measured(docs: DataFrame, key: str) -> DataFrame:
    """The key, doc_id, host, copy (hash of the text), the base figures and lines (hash and characters in
    words of every line with a letter): one scan of the texts, one row for each row.

    A null text counts as an empty one: all figures 0, no lines, base_failed true.
    """
    rows = docs.select(key, "doc_id", F.col("source").alias("host"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    first = [key, "doc_id", "host"]
    rows = rows.select(
        *first,
        F.xxhash64("text").alias("copy"),
        F.length(F.regexp_replace("text", SPACE, "")).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]+", ""))).cast("bigint").alias("n_symbols"),
        F.split("text", "\n").alias("raw"),
        F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("words"),
    )
    first += ["copy", "word_chars", "n_symbols"]
    # One hash for each window; arrays that are used twice or more stay columns of their own.
    windows = F.when(
        F.size("words") >= WINDOW,
        F.transform(F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW))),
    ).otherwise(F.array().cast("array<bigint>"))
    norms = F.transform("raw", lambda x: F.struct(normalised(x).alias("norm"), x.alias("raw")))
    lines = F.transform(
        F.filter(norms, lambda x: x["norm"] != ""),
        lambda x: F.struct(F.xxhash64(x["norm"]).alias("line"), F.length(F.regexp_replace(x["raw"], SPACE, "")).cast("bigint").alias("chars")),
    )
    rows = rows.select(
        *first,
        F.size("words").cast("bigint").alias("n_words"),
        F.filter("raw", lambda x: x.rlike(_HAS_WORD)).alias("full"),
        windows.alias("windows"),
        lines.alias("lines"),
    )
    # Windows with their places, sorted only in documents where some window occurs twice.
    placed = F.when(
        F.size(F.array_distinct("windows")) < F.size("windows"),
        F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    )
    first += ["n_words", "lines"]
    rows = rows.select(*first, (F.size("full") - F.size(F.array_distinct("full"))).cast("bigint").alias("n_dup_lines"), placed.alias("placed"))
    twin = lambda k, other: F.coalesce(F.get("placed", k)["h"] == F.get("placed", other)["h"], F.lit(False))
    starts = F.sort_array(
        F.transform(
            F.filter(F.sequence(F.lit(0), F.size("placed") - 1), lambda k: twin(k, k - 1) | twin(k, k + 1)),
            lambda k: F.get("placed", k)["i"],
        )
    )
    rows = rows.withColumn("starts", F.when(F.col("placed").isNotNull(), starts)).drop("placed")
    covered = F.aggregate(
        "starts",
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("sum")),
        lambda a, x: F.struct(x.alias("last"), (a["sum"] + F.least(F.lit(WINDOW), x - a["last"])).alias("sum")),
        lambda a: a["sum"],
    )
    rows = rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("bigint")).drop("starts")
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    return rows.withColumn("base_failed", failed).select(key, "doc_id", "host", "copy", *_BASE, "lines")


def line_rows(found: DataFrame, key: str) -> DataFrame:
    """The key, host, copy, line, n (its places in the row) and chars (in all of them)."""
    per = found.select(key, "host", "copy", F.explode("lines").alias("at"))
    return per.groupBy(key, "host", "copy", F.col("at.line").alias("line")).agg(F.count("*").alias("n"), F.sum("at.chars").alias("chars"))


def frequent_lines(lines: DataFrame, host_docs: int = HOST_DOCS, all_docs: int = ALL_DOCS, min_texts: int = MIN_TEXTS) -> DataFrame:
    """host, line, n_docs (of the host), all_docs: the lines above a limit, for each host that holds them.

    Rows are first reduced by (host, line, copy), which spreads a hot line over all tasks, and then summed
    with map-side partial sums. The texts of all hosts are those of each host added up.
    """
    once = lines.groupBy("host", "line", "copy").agg(F.count("*").alias("rows"))
    per = written(once.groupBy("host", "line").agg(F.sum("rows").alias("n_docs"), F.count("*").alias("n_texts")))
    total = per.groupBy("line").agg(F.sum("n_docs").alias("all_docs"), F.sum("n_texts").alias("all_texts"))
    total = total.where((F.col("all_docs") > all_docs) & (F.col("all_texts") > min_texts))
    here = (F.col("n_docs") > host_docs) & (F.col("n_texts") > min_texts)
    rows = per.join(total, "line", "left").where(here | F.col("all_docs").isNotNull())
    return rows.select("host", "line", "n_docs", "all_docs")


def line_verdicts(found: DataFrame, key: str, max_lost: float = MAX_LOST, **limits) -> DataFrame:
    """The key, lost (characters of words in removed lines), n_removed, removed (their hashes), depleted, for
    rows of ``measured``. Only those that lose a line have a row."""
    lines = written(line_rows(found, key))
    a, b = lines.alias("a"), written(frequent_lines(lines, **limits)).alias("b")
    hits = a.join(b, (F.col("a.line") == F.col("b.line")) & F.col("a.host").eqNullSafe(F.col("b.host")))
    hits = hits.groupBy(F.col(f"a.{key}").alias(key)).agg(
        F.sum("a.chars").alias("lost"), F.sum("a.n").alias("n_removed"), F.collect_set("a.line").alias("removed")
    )
    whole = F.aggregate("lines", F.lit(0).cast("bigint"), lambda s, x: s + x["chars"])
    return hits.join(found.select(key, whole.alias("chars")), key).select(
        key, "lost", "n_removed", "removed", (F.col("lost") > F.col("chars") * max_lost).alias("depleted")
    )


def judge(docs: DataFrame, **limits) -> DataFrame:
    """doc_id and the base figures of every row with n_removed, depleted and kept.

    kept is false for base_failed and for depleted documents. Every row is judged by itself: a key of its
    own, given when the figures are written, tells rows of the same id apart. Null and empty texts fail the
    base rules; a null host is a host; an empty table gives an empty result; other columns are not read.
    """
    found = written(measured(docs.select("doc_id", "source", "text", F.monotonically_increasing_id().alias(ROW)), ROW))
    lines = line_verdicts(found, ROW, **limits).select(ROW, "n_removed", "depleted")
    rows = found.select(ROW, "doc_id", *_BASE).join(lines, ROW, "left")
    gone = F.coalesce(F.col("depleted"), F.lit(False))
    return rows.select(
        "doc_id", *_BASE, F.coalesce(F.col("n_removed"), F.lit(0)).alias("n_removed"), gone.alias("depleted"),
        (~F.col("base_failed") & ~gone).alias("kept"),
    )


@own_names(ROW)
def clean(docs: DataFrame, **limits) -> DataFrame:
    """The documents that are kept, without their removed lines; columns as before, n_chars counted anew.

    Every row is judged by itself, whatever its doc_id; null and empty texts go, repeated rows are treated
    alike, an empty table stays empty, and further columns are passed on.
    """
    rows = keyed(docs)
    with passing(docs.sparkSession):
        # Written first: a filter pushed below the array steps would repeat their expressions many times over.
        found = written(measured(rows, ROW))
        lines = line_verdicts(found, ROW, **limits).select(ROW, "removed", "depleted")
        verdict = found.select(ROW, "base_failed").join(lines, ROW, "left").where(~F.col("base_failed") & ~F.coalesce("depleted", F.lit(False)))
        verdict = written(verdict.select(ROW, "removed"), keep=True)
    # The same plan at every size: the verdicts grow with the documents, so neither side is broadcast.
    d, v = rows.hint("merge").alias("d"), verdict.alias("v")
    rows = d.join(v, F.col(f"d.{ROW}") == F.col(f"v.{ROW}"))
    left = F.array_join(
        F.filter(F.split("d.text", "\n"), lambda x: ~F.array_contains("v.removed", F.xxhash64(normalised(x)))), "\n"
    )
    text = F.when(F.col("v.removed").isNull(), F.col("d.text")).otherwise(left)
    out = rows.select(*[F.col(f"d.{c}") if c != "text" else text.alias("text") for c in docs.columns])
    return out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
