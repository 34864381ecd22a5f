"""Quality rules: word statistics of a document, and the frequency of its lines in other documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.store import bind, text_key, with_text, written

#: What separates words, and the characters that count as symbols.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"

MIN_WORDS = 50
MAX_REPEATED = 0.5  # of the words
#: A line goes if more distinct texts of a host have it than both of these.
MAX_DOCS = 20
MAX_SHARE = 0.1
#: A document goes if less than this share of its words is left.
MIN_LEFT = 0.5


def words(text: Column) -> Column:
    """Maximal runs of characters other than space, tab, line feed, vertical tab, form feed and return."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def has_word(text: Column) -> Column:
    return F.rlike(text, F.lit(r"[^\x20\x09-\x0D]"))


def _repeated(w: Column) -> Column:
    """Words in 3-word windows that come twice or more: windows are sorted, equal ones are then neighbours."""

    def count(windows: Column) -> Column:
        return bind(F.array_sort(F.transform(windows, lambda g, i: F.struct(g.alias("g"), i.alias("i")))), mark)

    def mark(s: Column) -> Column:
        same = F.zip_with(s, F.slice(s, 2, F.size(s)), lambda a, b: F.coalesce(a["g"] == b["g"], F.lit(False)))
        return bind(same, lambda e: starts(F.transform(s, lambda x, k: F.when(F.get(e, k) | F.coalesce(F.get(e, k - 1), F.lit(False)), x["i"]))))

    def starts(hits: Column) -> Column:
        return bind(F.array_sort(F.array_compact(hits)), covered)

    def covered(at: Column) -> Column:
        steps = F.zip_with(at, F.slice(at, 2, F.size(at)), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    def windows(w: Column) -> Column:
        n = F.size(w) - 2
        two = F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.zip_with(two, F.slice(w, 3, n), lambda a, b: F.concat(a, F.lit(" "), b))

    many = bind(windows(w), lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(count(g)))
    return F.when(F.size(w) > 3, many).otherwise(0).cast("long")


def statistics(text: Column) -> list[Column]:
    """``_words`` (``n_words, word_chars, n_repeat_words``), ``n_symbols, n_dup_lines`` of a text."""
    stats = bind(
        words(text),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeated(w).alias("n_repeat_words")),
    )
    symbols = F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))
    return [
        stats.alias("_words"),
        symbols.cast("long").alias("n_symbols"),
        bind(_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ]


def normalised(line: Column) -> Column:
    """A line for comparison: lower case, its words parted by single spaces, digits as 0."""
    single = F.trim(F.regexp_replace(line, r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " "))
    return F.regexp_replace(F.lower(single), "[1-9]", "0")


def line_hash(line: Column) -> Column:
    return F.xxhash64(normalised(line))


def _lines(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n"), has_word)


def _host(host: str) -> Column:
    return F.coalesce(F.col(host).cast("string"), F.lit(""))


def frequent_lines(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """``host, lines``: hashes of normalised lines that more texts of the host have than ``max_docs`` and than ``max_share`` of them.

    Equal texts of a host count as one document: (host, line, text) rows are made distinct first. Counts
    are map-side combined, so a line in a third of all documents costs one row for each task. A host's
    list holds at most the mean number of lines in a text over ``max_share``, however large the host is.
    """
    rows = docs.select(_host(host).alias("host"), *text_key(F.col("text")), F.array_distinct(F.transform(_lines(F.col("text")), line_hash)).alias("lines"))
    rows = written(rows.select("host", "key_a", "key_b", F.explode("lines").alias("line")).distinct(), "lines")
    texts = rows.select("host", "key_a", "key_b").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("texts"))
    counted = rows.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_docs)
    found = counted.join(texts, "host").where(F.col("n") > F.col("texts") * max_share)
    return found.groupBy("host").agg(F.collect_list("line").alias("lines"))


def _judged(docs: DataFrame, host: str, max_docs: int, max_share: float, min_left: float) -> DataFrame:
    """``_doc``: the row, ``_q``: its statistics and verdict, ``_lines``: the frequent lines of its host, or null."""
    frequent = written(frequent_lines(docs, host, max_docs, max_share), "frequent").select(F.col("host").alias("_host"), F.col("lines").alias("_lines"))
    rows = docs.select(F.struct("*").alias("_doc"), _host(host).alias("_host")).join(frequent, "_host", "left")
    text = F.coalesce(F.col("_doc.text").cast("string"), F.lit(""))
    gone = F.filter(_lines(text), lambda x: F.array_contains("_lines", line_hash(x)))
    removed = F.aggregate(gone, F.lit(0), lambda n, x: n + F.size(words(x)))
    own, symbols, dup = statistics(text)
    rows = rows.withColumn("_s", F.struct(own, symbols, dup, F.when(F.col("_lines").isNull(), 0).otherwise(removed).cast("long").alias("removed")))

    def verdict(s: Column) -> Column:
        n, repeated = s["_words"]["n_words"], s["_words"]["n_repeat_words"]
        failed = (n < MIN_WORDS) | (repeated * 100 > n * int(100 * MAX_REPEATED))
        return F.struct(
            n.alias("n_words"),
            s["_words"]["word_chars"].alias("word_chars"),
            s["n_symbols"].alias("n_symbols"),
            s["n_dup_lines"].alias("n_dup_lines"),
            repeated.alias("n_repeat_words"),
            failed.alias("base_failed"),
            (~failed & ((n - s["removed"]) >= n * min_left)).alias("kept"),
            s["removed"].alias("words_removed"),
        )

    return rows.select("_doc", "_lines", bind(F.col("_s"), verdict).alias("_q"))


def judge(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, words_removed``.

    ``docs`` needs ``doc_id, text`` and the ``host`` column; others are ignored. One row for each row of
    ``docs``, in which repeated rows and null ids may come; a null text has no words and fails; null hosts
    count as one host. ``kept``: not ``base_failed``, and at least ``min_left`` of the words are left when the
    host's frequent lines are gone. Texts never go through a shuffle, unless the hosts' lists are too large to be sent to all tasks.
    """
    own = docs.select(*dict.fromkeys(("doc_id", "text", host)))
    return _judged(own, host, max_docs, max_share, min_left).select("_doc.doc_id", "_q.*")


def filter_documents(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT) -> DataFrame:
    """Rows of ``docs`` that ``judge`` keeps, without their frequent lines; all columns stay, ``n_chars`` follows the text."""
    rows = _judged(docs, host, max_docs, max_share, min_left).where("_q.kept")
    left = F.filter(F.split("_doc.text", "\n"), lambda x: ~F.array_contains("_lines", line_hash(x)))
    text = F.when(F.col("_q.words_removed") == 0, F.col("_doc.text")).otherwise(F.array_join(left, "\n"))
    return with_text(rows.select("_doc", text.alias("_text")), docs.columns)
