"""Secret scans: patterns and sliding-window Shannon entropy, in DataFrame functions only.

Every whole text is scanned (null: empty). A span is (kind, start, end) in code points, end
exclusive. Three kinds come from patterns; a fourth, `entropy`, is a candidate string in which
some window of `window` characters has at least the bits a character that its class asks for,
unless a pattern's span covers part of it. Allow-list entries suppress the windows that they
touch: the pieces between them are judged each by its own class. Window entropies are kept up by
adding the entering and taking away the leaving character's share, from counts packed eight to a
number. Nothing walks a text or a list of spans once for each of its places: running sums are
made in stretches, and text is cut through blocks, so time grows with the text's length (of
spans, with their number times a stretch).
Empty tables give empty results, repeated rows are scanned each on its own, other columns
are kept by `redact`, whatever their names, and ignored by `op8_secrets`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run that is long enough is matched whole, and a shorter one could never hold a match.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
#: Classes of candidates: all of the first pattern, some of each of the others; bits a character.
#: The first that fits counts, and one always does. Words and names pass fewer bits than keys do.
PLAIN, ANY = r"^[A-Za-z0-9]+$", r"^[A-Za-z0-9+/_=-]+$"
CLASSES = (
    (r"^[0-9a-fA-F-]+$", (r"[0-9]", r"[a-fA-F]"), 3.0),
    (PLAIN, (r"[0-9]", r"[A-Z]", r"[a-z]"), 3.6),
    (ANY, (r"[0-9]", r"[A-Z]", r"[a-z]"), 3.7),
    (PLAIN, (r"[0-9]", r"[A-Za-z]"), 3.5),
    (ANY, (r"[0-9]", r"[A-Za-z]"), 3.7),
    (PLAIN, (r"[A-Z]", r"[a-z]"), 3.85),
    (ANY, (r"[A-Z]", r"[a-z]"), 3.95),
    (PLAIN, (r"[A-Za-z]",), 3.85),
    (ANY, (r"[A-Za-z]",), 3.95),
    (PLAIN, (), 3.0),
    (ANY, (), 3.4),
)
#: Placeholders, paths, counting sequences: no window that touches one of these counts. The short
#: ones must stand alone, as three or four letters come up in long keys by chance.
ALLOW = r"(?i)example|sample|placeholder|changeme|dummy|xxxx|0123456|1234567|abcdefg|(?<![a-z0-9])(?:https?|www)(?![a-z0-9])|/usr/|/home/"
SPAN = "array<struct<start:int,ko:int,end:int>>"


STRETCH, TEXT_BLOCK = 256, 1024


def _let(value: Column, body) -> Column:
    """body of the value, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, op) -> Column:
    """Of an array of ints, for each place op (a sum or a maximum) of 0 and all before it: first
    within stretches, then over these, so that arrays that grow by one stay short."""

    def scan(items, of):
        kind = "int" if of is None else "array<int>"
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<struct<at:int,own:{kind}>>").alias("out"))

        def step(acc, x):
            value, own = (x, x) if of is None else (x["at"], x["own"])
            return F.struct(op(acc["at"], value).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), own.alias("own")))).alias("out"))

        return F.aggregate(items, start, step)

    def whole(v):
        stretches = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(v) - 1, F.lit(0)) / STRETCH).cast("int")), lambda j: F.slice(v, j * STRETCH + 1, F.lit(STRETCH)))
        local = F.transform(stretches, lambda c: _let(scan(c, None), lambda r: F.struct(r["at"].alias("at"), F.transform(r["out"], lambda x: x["at"]).alias("own"))))
        return F.flatten(F.transform(scan(local, "own")["out"], lambda x: F.transform(x["own"], lambda y: op(x["at"], y))))

    return _let(values, whole)


def _blocks(text: Column) -> Column:
    """The text in stretches of TEXT_BLOCK characters."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{TEXT_BLOCK}}}"), F.lit(0))


def _cut(blocks: Column, start: Column, end: Column) -> Column:
    """The text's characters from start to before end; only the blocks there are walked."""
    a, b = (F.floor(x / TEXT_BLOCK).cast("int") for x in (start, F.greatest(start, end - 1)))
    return F.when(end > start, F.substring(F.array_join(F.slice(blocks, a + 1, b - a + 1), ""), start % TEXT_BLOCK + 1, end - start)).otherwise(F.lit(""))


def _spans(text: Column, pattern: str, ko: int, keep_text: bool = False) -> Column:
    """The matches' places: the pieces between matches and the matches add up to the text."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    ok = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda g: F.length(g) >= 8) if ko == 0 else F.transform(found, lambda m: F.lit(True))
    between = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    zipped = F.filter(F.arrays_zip(between.alias("gap"), found.alias("m"), ok.alias("ok")), lambda z: z["m"].isNotNull())

    def place(zs):
        ends = running(F.transform(zs, lambda z: z["gap"] + F.length(z["m"])), lambda a, b: a + b)
        rows = F.filter(F.arrays_zip(ends.alias("before"), zs.alias("z")), lambda r: r["z"]["ok"])
        start = lambda r: r["before"] + r["z"]["gap"]
        more = lambda r: [r["z"]["m"].alias("text")] if keep_text else []
        return F.transform(rows, lambda r: F.struct(start(r).alias("start"), F.lit(ko).alias("ko"), (start(r) + F.length(r["z"]["m"])).alias("end"), *more(r)))

    none = F.array().cast(SPAN.replace(">>", ",text:string>>") if keep_text else SPAN)
    return F.when(text.rlike(pattern), _let(zipped, place)).otherwise(none)


def _log_share(c: Column) -> Column:
    """c * log2(c) of a count, 0 for 0."""
    return F.when(c > 1, c * F.log2(F.greatest(c, F.lit(1)).cast("double"))).otherwise(F.lit(0.0))


def window_entropy(text: Column, window: int) -> Column:
    """The largest entropy, in bits a character, of any window of the text (0 if shorter). Counts
    are bytes of long numbers, so a window has at most 127 characters."""
    codes = F.transform(F.split(text, "(?<=.)(?=.)"), lambda c: F.instr(F.lit(ALPHABET), c))
    pairs = _let(codes, lambda c: F.slice(F.arrays_zip(c.alias("new"), F.concat(F.array_repeat(F.lit(-1), window), c).alias("old")), F.lit(1), F.size(c)))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), len(ALPHABET) // 8 + 1).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("top"), F.lit(0).alias("i"))

    def step(acc, pair):
        new, old = pair["new"], pair["old"]
        byte = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), 8 * (k % 8))
        has = lambda k: F.call_function("shiftright", F.get(acc["n"], F.floor(k / 8).cast("int")), 8 * (k % 8)).bitwiseAND(F.lit(127)).cast("int")
        same, gone = new == old, old >= 0
        s = F.when(same, acc["s"]).otherwise(
            acc["s"] + _log_share(has(new) + 1) - _log_share(has(new)) + F.when(gone, _log_share(has(old) - 1) - _log_share(has(old))).otherwise(F.lit(0.0))
        )
        share = lambda k, j: F.when(F.floor(k / 8) == j, byte(k)).otherwise(F.lit(0).cast("long"))
        n = F.when(same, acc["n"]).otherwise(F.transform(acc["n"], lambda c, j: c + share(new, j) - F.when(gone, share(old, j)).otherwise(F.lit(0).cast("long"))))
        bits = F.lit(math.log2(window)) - s / F.lit(float(window))
        i = acc["i"] + 1
        return F.struct(n.alias("n"), s.alias("s"), F.when(i >= window, F.greatest(acc["top"], bits)).otherwise(acc["top"]).alias("top"), i.alias("i"))

    return F.aggregate(pairs, start, step, lambda acc: acc["top"])


def _entropy_spans(text: Column, base: Column, window: int) -> Column:
    # a candidate lies apart if no pattern's span that starts before its end goes beyond its start
    event = lambda key, kind, p, text: F.struct(key.alias("key"), F.lit(kind).alias("kind"), F.struct(p["start"].alias("start"), p["ko"].alias("ko"), p["end"].alias("end"), text.alias("text")).alias("p"))
    events = F.array_sort(F.concat(F.transform(_spans(text, CANDIDATE, 3, keep_text=True), lambda p: event(p["end"], 0, p, p["text"])), F.transform(base, lambda b: event(b["start"], 1, b, F.lit("")))))

    def alone(e):
        done = running(F.transform(e, lambda x: F.when(x["kind"] == 1, x["p"]["end"]).otherwise(F.lit(0))), F.greatest)
        return F.transform(F.filter(F.arrays_zip(done.alias("done"), e.alias("e")), lambda r: (r["e"]["kind"] == 0) & (r["done"] <= r["e"]["p"]["start"])), lambda r: r["e"]["p"])

    none = F.array().cast(SPAN.replace(">>", ",text:string>>"))
    apart = F.when(text.rlike(CANDIDATE), _let(events, alone)).otherwise(none)

    def dense(piece):
        bits = None
        for whole, parts, least in CLASSES:
            fits = piece.rlike(whole)
            for part in parts:
                fits = fits & piece.rlike(part)
            bits = F.when(fits, F.lit(least)) if bits is None else bits.when(fits, F.lit(least))
        return F.when(F.length(piece) >= window, window_entropy(piece, window) >= bits).otherwise(F.lit(False))

    # a window touches no allowed string if it lies in a piece between them
    secret = lambda p: F.exists(F.split(p["text"], ALLOW, -1), dense)
    kept = F.filter(apart, secret)
    return F.transform(kept, lambda p: F.struct(p["start"].alias("start"), p["ko"].alias("ko"), p["end"].alias("end")))


def with_spans(docs: DataFrame, text: str = "text", window: int = 20) -> DataFrame:
    """docs and arrays `_base` and `_spans` of (start, ko, end), sorted."""
    t = text_of(text)
    base = F.array_sort(F.concat(_spans(t, ASSIGN, 0), _spans(t, ACCESS, 1), _spans(t, HEX, 2)))
    out = docs.withColumn("_base", base)
    more = _entropy_spans(t, F.col("_base"), window)
    return out.withColumn("_spans", F.array_sort(F.concat(F.col("_base"), more)))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["ko"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """One row a document: counts of the pattern kinds, their hash, and all spans."""
    d = with_spans(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter("_base", lambda s: s["ko"] == k)).cast("long")
    return d.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_joined(F.col("_base")), 256).alias("base_sha256"), _joined(F.col("_spans")).alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with each stretch of overlapping spans replaced by `mark`; n_chars follows the text.
    Texts without a span, null ones too, stay as they are. Rows are wrapped, so no column of docs
    can clash with those used here."""
    d = with_spans(docs.select(docs["text"].alias("text"), F.struct(*[docs[c] for c in docs.columns]).alias("whole")))

    def clean(blocks):
        # each span with the end of what came before: a gap to copy and a mark, or more of the last stretch
        rows = F.arrays_zip(running(F.transform("_spans", lambda s: s["end"]), F.greatest).alias("done"), F.col("_spans").alias("s"))
        fresh = F.filter(rows, lambda r: (r["s"]["start"] >= r["done"]))
        last = F.array_max(F.transform("_spans", lambda s: s["end"]))
        return F.concat(F.array_join(F.transform(fresh, lambda r: F.concat(_cut(blocks, r["done"], r["s"]["start"]), F.lit(mark))), ""), _cut(blocks, last, F.length("text")))

    text = F.when(F.size("_spans") > 0, _let(_blocks(F.col("text")), clean)).otherwise(F.col("text"))
    whole = F.col("whole").withField("text", text)
    if "n_chars" in docs.columns:
        whole = whole.withField("n_chars", F.when(F.col("text").isNull(), F.col("whole.n_chars")).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType)))
    return d.select(whole.alias("whole")).select("whole.*")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
