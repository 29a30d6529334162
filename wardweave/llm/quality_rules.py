"""Quality rules by distribution divergence, in DataFrame functions only.

Two histograms of a text are held against those of its language, summed over all documents
with that lang: its characters by class, and its words that are among the language's `COMMON`
most frequent ones (the rest being one more bin). Their Jensen-Shannon distances, between 0
and 1, must not exceed `MOST_CHARS` and `MOST_WORDS`; texts of fewer than `MIN_CHARS`
characters or `MIN_WORDS` words are too short to judge by them. A text without a language, or
with one that has no reference, is held against all languages at once. References are literals
up to MOST_LANGS languages and are joined by lang beyond.

Before that, base rules drop texts with fewer than 20 words or with more than 30 of 100 words
in 8-word windows that occur twice. Null texts are empty and fail; empty tables give no rows,
repeated rows are judged alike, and other columns are ignored (`keep` keeps them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, materialize, table, text_of

WINDOW, COMMON = 8, 16
MIN_CHARS, MIN_WORDS, MOST_CHARS, MOST_WORDS = 200, 50, 0.34, 0.42
#: Classes of characters, by members that do not overlap; anything else is one more class.
CLASSES = (r"a-z", r"A-Z", r"0-9", r"\x20\x09-\x0D", r"#*$%\x26|<>", r".,;:!?'\"()-")
ALL = "*"


def parts(text: Column) -> Column:
    """What single blanks part, empty strings included: one more than there are blanks. All
    blanks become spaces first, as parting at one plain character needs no pattern."""
    return F.split(F.regexp_replace(text, r"[\x09-\x0D]", " "), " ")


def rest(text: Column) -> Column:
    """text without small letters and blanks, which most characters are."""
    return F.regexp_replace(text, f"[{CLASSES[0]}{CLASSES[3]}]+", "")


def histogram(length: Column, blanks: Column, other: Column) -> Column:
    """Code points by class, an array of long; other is the text's `rest`."""
    count = lambda c: F.length(other) - F.length(F.regexp_replace(other, f"[{c}]+", ""))
    small = length - F.length(other) - blanks
    odd = F.length(F.regexp_replace(other, f"[{''.join(CLASSES)}]+", ""))
    return F.array(small, count(CLASSES[1]), count(CLASSES[2]), blanks, count(CLASSES[4]), count(CLASSES[5]), odd).cast("array<long>")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows that occur at least twice. Window hashes are sorted only if two of
    them agree; the places that do, in order, cover `window` words each, less their overlaps."""
    n = F.size(words)
    codes = F.transform(words, lambda w: F.xxhash64(w))

    # an array of one, so that what is made once is used several times
    def joined(step):
        def both(c):
            k = F.greatest(F.size(c) - step, F.lit(0))
            return F.zip_with(F.slice(c, F.lit(1), k), F.slice(c, F.lit(step + 1), k), lambda a, b: F.xxhash64(a, b))

        return both

    # hashes of one word, of two, of four, of eight: each from two of the ones before
    assert window & (window - 1) == 0
    step = 1
    while step < window:
        codes = F.get(F.transform(F.array(codes), joined(step)), 0)
        step *= 2

    def covered(hashes):
        pairs = F.sort_array(F.zip_with(hashes, F.sequence(F.lit(1), F.size(hashes)), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(p):
            same = lambda a, b: F.coalesce(F.get(p, a)["h"] == F.get(p, b)["h"], F.lit(False))
            at = F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: same(i, i + 1) | ((i > 0) & same(i, F.greatest(i - 1, F.lit(0)))))
            return F.sort_array(F.transform(at, lambda i: F.get(p, i)["i"]))

        found = F.get(F.transform(F.array(pairs), places), 0)
        total = F.aggregate(found, F.struct(F.lit(0).alias("sum"), F.lit(-window).alias("last")), lambda acc, i: F.struct((acc["sum"] + F.least(F.lit(window), i - acc["last"])).alias("sum"), i.alias("last")), lambda acc: acc["sum"])
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), total).otherwise(F.lit(0))

    some = F.get(F.transform(F.array(codes), covered), 0)
    return F.when(n > window, some).otherwise(F.lit(0)).cast("long")


def repeated_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return F.get(F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x))), 0).cast("long")


def distance(a: Column, b: Column) -> Column:
    """Jensen-Shannon distance of two arrays of counts: the root of the divergence in bits.
    0 if either is empty."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    part = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))
    both = F.struct(a.cast("array<double>").alias("a"), b.cast("array<double>").alias("b"))

    def shares(x):
        sa, sb = total(x["a"]), total(x["b"])
        return F.zip_with(x["a"], x["b"], lambda u, v: F.struct((u / F.greatest(sa, F.lit(1.0))).alias("p"), (v / F.greatest(sb, F.lit(1.0))).alias("q")))

    terms = F.transform(F.get(F.transform(F.array(both), shares), 0), lambda x: (part(x["p"], (x["p"] + x["q"]) / 2) + part(x["q"], (x["p"] + x["q"]) / 2)) / 2)
    ok = (total(a.cast("array<double>")) > 0) & (total(b.cast("array<double>")) > 0)
    return F.when(ok, F.sqrt(F.greatest(total(terms), F.lit(0.0)))).otherwise(F.lit(0.0))


def references(docs: DataFrame, common: int = COMMON) -> DataFrame:
    """(_lang, common, freq): for each lang, and for all together, the most frequent words and
    how often these and all others occur. One row a language."""
    # partial sums keep a popular word from being more than a row a task
    w = docs.select(F.coalesce("lang", F.lit(ALL)).alias("_lang"), F.explode(parts(F.lower(text_of()))).alias("w")).filter("w <> ''")
    w = w.groupBy("_lang", "w").agg(F.count("*").alias("n"))
    w = materialize(w, "words")  # distinct words only; they are read four times
    w = w.filter(F.col("_lang") != ALL).union(w.groupBy("w").agg(F.sum("n").alias("n")).select(F.lit(ALL).alias("_lang"), "w", "n"))
    top = w.withColumn("r", F.row_number().over(W.partitionBy("_lang").orderBy(F.desc("n"), "w"))).filter(F.col("r") <= common)
    top = top.groupBy("_lang").agg(F.array_sort(F.collect_list(F.struct("r", "w", "n"))).alias("top"))
    sums = w.groupBy("_lang").agg(F.sum("n").alias("total"))
    t = top.join(sums, "_lang").select("_lang", F.transform("top", lambda x: x["w"]).alias("common"), F.transform("top", lambda x: x["n"]).alias("f"), "total")
    return t.withColumn("freq", F.concat("f", F.array(F.col("total") - F.aggregate("f", F.lit(0).cast("long"), lambda s, v: s + v)))).select("_lang", "common", "freq")


def class_counts(measured: DataFrame) -> DataFrame:
    """(_lang, chars): characters by class of each lang, and of all together."""
    k = len(CLASSES) + 1
    h = measured.groupBy(F.coalesce("lang", F.lit(ALL)).alias("_lang")).agg(*[F.sum(F.col("_h")[i]).alias(f"c{i}") for i in range(k)])
    chars = F.array(*[f"c{i}" for i in range(k)]).alias("chars")
    every = h.agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(k)]).select(F.lit(ALL).alias("_lang"), chars)
    return h.filter(F.col("_lang") != ALL).select("_lang", chars).union(every)


def common_counts(words: Column, common: list[str] | Column) -> Column:
    """Occurrences of each common word, then of all others. Words are looked up in a set, or in an
    array if they come as a column."""
    known = (lambda w: F.array_contains(common, w)) if isinstance(common, Column) else (lambda w: w.isin(common))
    each_of = common if isinstance(common, Column) else F.array(*map(F.lit, common))
    found = F.filter(F.transform(words, F.lower), known)

    def count(x):
        return F.transform(each_of, lambda c: F.size(x) - F.size(F.array_remove(x, c)))

    each = F.get(F.transform(F.array(found), count), 0)
    return F.get(F.transform(F.array(each), lambda n: F.concat(n, F.array(F.size(words) - F.aggregate(n, F.lit(0), lambda s, v: s + v)))), 0).cast("array<long>")


def _by_lang(rows: dict, of) -> Column:
    """A literal for each lang; that of all for langs without one."""
    out = of(rows[ALL])
    for lang, r in sorted(rows.items()):
        if lang != ALL:
            out = F.when(F.col("lang") == lang, of(r)).otherwise(out)
    return out


def _few(refs: DataFrame) -> tuple[dict, DataFrame | None]:
    """Rows by language that become literals, and the other rows, to be joined. All are literals
    up to MOST_LANGS; of more, that of all and those of the HOT languages with most words."""
    rows = refs.limit(MOST_LANGS + 1).collect()
    if len(rows) <= MOST_LANGS:
        return {r["_lang"]: r for r in rows}, None
    refs = materialize(refs, "references")
    size = F.aggregate("freq", F.lit(0).cast("long"), lambda s, v: s + v)
    rows = refs.filter(F.col("_lang") == ALL).collect() + refs.filter(F.col("_lang") != ALL).orderBy(size.desc(), "_lang").limit(HOT).collect()
    rows = {r["_lang"]: r for r in rows}
    return rows, refs.filter(~F.col("_lang").isin(list(rows)))


def _with_rows(d: DataFrame, few: dict, rest: DataFrame) -> DataFrame:
    """d and the columns of rest, by lang; null where lang has a literal or no row. Hot languages
    take no part in the join."""
    cold = F.col("lang").isNotNull() & ~F.col("lang").isin(list(few))
    none = {f.name: F.lit(None).cast(f.dataType) for f in rest.schema if f.name != "_lang"}
    return d.filter(~cold).withColumns(none).unionByName(d.filter(cold).join(rest, F.col("lang") == F.col("_lang"), "left").drop("_lang"))


def judge(docs: DataFrame, refs: DataFrame, text: bool = True) -> DataFrame:
    """docs with _n_words, _word_chars, _n_symbols, _n_dup_lines, _n_repeat, _failed, _chars,
    _words (the distances) and _kept; without text if that is False. Texts are read twice, for
    the common words and for all counts; the latter are kept in a table, from which the
    languages' characters and the distances come."""
    common, others = _few(refs)
    longs = lambda xs: F.array(*[F.lit(int(x)).cast("long") for x in xs])
    t = text_of()
    if others is not None:
        docs = _with_rows(docs, common, others.withColumnsRenamed({"common": "_common", "freq": "_freq"}))
    d = docs.withColumns({"_p": parts(t), "_r": rest(t)}).withColumn("_w", F.array_remove("_p", ""))
    d = d.withColumns({"_h": histogram(F.length(t), F.size("_p") - 1, F.col("_r")), "_n_words": F.size("_w").cast("long"), "_n_chars": F.length(t), "_n_dup_lines": repeated_lines(t), "_n_repeat": repeated_words(F.col("_w"))})
    if ALL in common:
        counts = _by_lang(common, lambda r: common_counts(F.col("_w"), r["common"]))
        if others is not None:
            counts = F.when(F.col("_common").isNotNull(), common_counts(F.col("_w"), F.col("_common"))).otherwise(counts)
        d = d.withColumn("_cw", counts)
    d = materialize(d.drop("_p", "_r", "_w", *(() if text else ("text",))), "measured")
    d = d.withColumns({"_word_chars": F.col("_n_chars").cast("long") - F.col("_h")[3], "_n_symbols": F.col("_h")[4], "_failed": (F.col("_n_words") < 20) | (100 * F.col("_n_repeat") > 30 * F.col("_n_words"))})
    if ALL not in common:
        return d.withColumns({"_chars": F.lit(0.0), "_words": F.lit(0.0), "_kept": ~F.col("_failed")}).drop("_h", "_n_chars")
    sums = class_counts(d)
    chars = {r["_lang"]: r for r in sums.filter(F.col("_lang").isin(list(common))).collect()}
    own_chars, own_words = _by_lang(chars, lambda r: longs(r["chars"])), _by_lang(common, lambda r: longs(r["freq"]))
    if others is not None:
        d = _with_rows(d, common, sums.select("_lang", F.col("chars").alias("_sums")))
        known = F.col("_freq").isNotNull()
        own_chars, own_words = F.when(known, F.col("_sums")).otherwise(own_chars), F.when(known, F.col("_freq")).otherwise(own_words)
    d = d.withColumns({"_chars": distance(F.col("_h"), own_chars), "_words": distance(F.col("_cw"), own_words)})
    odd = (F.col("_n_chars") >= MIN_CHARS) & (F.col("_chars") > MOST_CHARS) | (F.col("_n_words") >= MIN_WORDS) & (F.col("_words") > MOST_WORDS)
    return d.withColumn("_kept", ~F.col("_failed") & ~odd).drop("_h", "_cw", "_n_chars", "_common", "_freq", "_sums")


MOST_LANGS, HOT = 512, 16


def keep(docs: DataFrame) -> DataFrame:
    whole = docs.select(F.struct("*").alias("_doc"), "text", "lang")
    return judge(whole, references(whole), text=False).filter("_kept").select("_doc.*")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return judge(docs, references(docs), text=False).select(
        "doc_id", F.col("_n_words").alias("n_words"), F.col("_word_chars").alias("word_chars"), F.col("_n_symbols").alias("n_symbols"), F.col("_n_dup_lines").alias("n_dup_lines"),
        F.col("_n_repeat").alias("n_repeat_words"), F.col("_failed").alias("base_failed"), F.col("_kept").alias("kept"), F.round("_chars", 9).alias("char_distance"), F.round("_words", 9).alias("word_distance"),
    )
