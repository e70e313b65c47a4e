"""Quality rules with thresholds taken from the data instead of fixed cutoffs.

Each document gets counts of its words, symbols, repeated lines and repeated
windows of words. For every language and source a quantile sketch of each measure
is kept; thresholds are read off the sketches and joined back to the documents.

A sketch is a histogram whose bins are fixed in advance and bounded in number, so two sketches
merge by adding counts, exactly and in any order: a group's sketch is a plain
grouped count with a map-side part, and quantiles are off by at most one bin. Documents that fail the
base rules are in no sketch. A group of fewer than ``MIN_ROWS`` others takes the sketch of its language,
and a small language that of all documents.

Each measure has a quantile of the group that ordinary documents do not pass, and fails a document that
lies beyond it by more than ``spread`` times the distance of that quantile from the median. Groups
whose values are all alike have no spread; there a document may be ``SLACK`` bins off. Nothing else is
fixed: shares of repeated words and lines, which most documents do not have, are judged by the group's last
hundredth, the others by its quartiles.

Edge cases: a null text has no words; documents without words fail the base rules;
null languages and sources are groups of their own; repeated rows each count and each
get a row; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetlens.llm.common import map_batches, staged

WINDOW = 5
MIN_ROWS = 30
# Bins that a document may be off in a group without spread.
SLACK = 2
MIN_WORDS = 10
SYMBOLS = b"#*$%&|<>"
SPACES = " \t\n\v\f\r"

# Width of a bin and the last one, which takes all that is larger.
SHARE_BINS, LENGTH_BINS = (0.002, 500), (0.02, 5000)
# Measure: bins, whether high values fail, the group's quantile in hundredths, the spread beyond it.
MEASURES = {
    "symbol_share": (SHARE_BINS, True, 75, 6.0),
    "dup_line_share": (SHARE_BINS, True, 99, 1.0),
    "repeat_share": (SHARE_BINS, True, 99, 1.0),
    "long_words": (LENGTH_BINS, True, 75, 10.0),
    "short_words": (LENGTH_BINS, False, 25, 8.0),
}
QUANTILES = sorted({50, *(share for _, _, share, _ in MEASURES.values())})

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words found twice or more."""
    total = len(words) - window + 1
    if total < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    if len(known) == len(words):
        return 0
    # A window's name is made of its words' numbers; names are numbered again before
    # they could overflow, so they stay exact at any length of text.
    names, span = ids[:total], len(known)
    for step in range(1, window):
        if span * len(known) >= 1 << 62:
            found, names = np.unique(names, return_inverse=True)
            span = len(found)
        names, span = names * len(known) + ids[step : step + total], span * len(known)
    order = np.argsort(names, kind="stable")
    ranked = names[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(total, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def counts(text: str | None) -> tuple[int, ...]:
    """The numbers of ``STATS`` for one text."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    raw = text.encode()
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
    )


def with_counts(docs: DataFrame, text_col: str = "text", keep: dict[str, str] | None = None) -> DataFrame:
    """The counts of every whole text, beside the columns of ``keep`` (name: SQL type)."""
    keep = keep or {}

    def run(batch: pa.RecordBatch) -> dict:
        found = [counts(value.as_py()) for value in batch.column("_text")]
        columns = dict(zip((f.split()[0] for f in STATS.split(", ")), zip(*found)))
        return {name: batch.column(name) for name in keep} | columns

    rows = docs.select(*[F.col(c).cast(kind).alias(c) for c, kind in keep.items()], F.col(text_col).cast("string").alias("_text"))
    return map_batches(rows, run, ", ".join([*(f"`{c}` {kind}" for c, kind in keep.items()), STATS]))


def measures() -> dict[str, Column]:
    words, chars = F.col("n_words"), F.col("word_chars")
    mean = chars / F.nullif(words, F.lit(0))
    return {
        "symbol_share": F.col("n_symbols") / chars,
        "dup_line_share": F.col("n_dup_lines") / F.col("n_lines"),
        "repeat_share": F.col("n_repeat_words") / words,
        "long_words": mean,
        "short_words": mean,
    }


def bins(name: str, value: Column) -> Column:
    width, last = MEASURES[name][0]
    return F.least(F.floor(value / width), F.lit(last)).cast("long")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def sketches(stats: DataFrame) -> DataFrame:
    """Counts per (lang, source, measure, bin); adding rows merges sketches."""
    pairs = F.array(*[F.struct(F.lit(name).alias("measure"), bins(name, value).alias("bin")) for name, value in measures().items()])
    return (
        stats.where(~base_failed())
        .select("lang", "source", F.explode(pairs).alias("m"))
        .groupBy("lang", "source", "m.measure", "m.bin")
        .agg(F.count("*").alias("n"))
    )


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """The quantiles (in bins) of each sketch merged over ``keys`` and measure."""
    by = [*keys, "measure"]
    merged = sketch.groupBy(*by, "bin").agg(F.sum("n").alias("n"))
    # At most one row per bin in a window, whatever the number of documents.
    total = Window.partitionBy(*by)
    upto = total.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = merged.withColumn("total", F.sum("n").over(total)).withColumn("upto", F.sum("n").over(upto))
    at = lambda share: F.min(F.when(F.col("upto") * 100 >= F.col("total") * share, F.col("bin")))
    return ranked.groupBy(*by).agg(F.max("total").alias("rows"), *[at(share).alias(f"q{share}") for share in QUANTILES])


def thresholds(stats: DataFrame) -> DataFrame:
    """One row per (lang, source): a bound, in bins, for every measure, and whether its spread set it."""
    sketch = staged(sketches(stats), "quality-sketches")
    levels = [
        quantiles(sketch, ["lang", "source"]),
        quantiles(sketch, ["lang"]),
        quantiles(sketch, []),
    ]
    found = ["rows", *[f"q{share}" for share in QUANTILES]]
    own, lang, everything = (
        level.select(*keys, "measure", F.struct(*found).alias(name))
        for level, keys, name in zip(levels, (["lang", "source"], ["lang"], []), ("own", "by_lang", "by_all"))
    )
    lang = lang.withColumnsRenamed({"lang": "l_lang", "measure": "l_measure"})
    everything = everything.withColumnRenamed("measure", "a_measure")
    joined = own.join(lang, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("measure") == F.col("l_measure")))
    joined = joined.join(everything, F.col("measure") == F.col("a_measure"))
    use = F.when(F.col("own.rows") >= MIN_ROWS, F.col("own")).when(F.col("by_lang.rows") >= MIN_ROWS, F.col("by_lang")).otherwise(F.col("by_all"))
    joined = joined.withColumn("q", use)
    bound, spread = F.lit(None).cast("double"), F.lit(None).cast("double")
    for name, (_, high, share, times) in MEASURES.items():
        far = F.abs(F.col(f"q.q{share}") - F.col("q.q50")) * times
        reach = F.greatest(far, F.lit(float(SLACK)))
        value = F.col(f"q.q{share}") + reach if high else F.col(f"q.q{share}") - reach
        bound = F.when(F.col("measure") == name, value).otherwise(bound)
        spread = F.when(F.col("measure") == name, far).otherwise(spread)
    joined = joined.withColumn("bound", bound).withColumn("by_spread", spread >= F.lit(float(SLACK)))
    return joined.groupBy("lang", "source").agg(
        *[F.max(F.when(F.col("measure") == name, F.col("bound"))).alias(f"bound_{name}") for name in MEASURES],
        F.count_if("by_spread").alias("set_by_spread"),
    )


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, ``base_failed``, ``failed`` (the measures beyond their bounds) and ``kept``."""
    kinds = {id_col: "long", "lang": "string", "source": "string"}
    stats = staged(with_counts(docs, text_col, kinds), "quality-counts")
    # Read back from a file, its size is known: Spark broadcasts it if it is small, else
    # it shuffles both sides and can split a hot source.
    bounds = staged(thresholds(stats), "quality-bounds").drop("set_by_spread")
    bounds = bounds.withColumnsRenamed({"lang": "t_lang", "source": "t_source"})
    joined = stats.join(
        bounds, stats["lang"].eqNullSafe(bounds["t_lang"]) & stats["source"].eqNullSafe(bounds["t_source"]), "left"
    ).drop("t_lang", "t_source")
    tests = []
    for name, value in measures().items():
        high, limit = MEASURES[name][1], F.col(f"bound_{name}")
        at = bins(name, F.when(F.col("n_words") > 0, value))
        tests.append(F.when((at > limit) if high else (at < limit), F.lit(name)))
    failed = F.array_compact(F.array(*tests))
    return (
        joined.withColumn("base_failed", base_failed())
        .withColumn("failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
        .drop(*[f"bound_{name}" for name in MEASURES])
    )
