"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

Numbers, units behind numbers and names become typed placeholders, so that a question asked again with
other values has the same template. Windows of the template are hash-joined with those of the
benchmark; matches of one item on one alignment are then compared word by word. Where the raw words alone
do not suffice, the names that stand in the placeholders must map to each other one to one (a question
about two people cannot match one that names a single person twice), but for ``slack`` of them; numbers
and units may take any values, equal ones too.

A document holds an item when at least ``share`` of the item's windows match on one alignment, or a run
of ``run`` words does, by the raw words or by templates whose names agree. A window needs ``literals`` words that are no placeholders,
so lists of names or numbers match nothing. Items shorter than a window are not looked for.

Nulls: null texts are empty and match nothing, rows with a null item id or null document id are kept and
matched like others. Documents that repeat a row are matched each; the result has a (document, item) pair
once. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logvigil.llm.common import checkpointed

# Units of measure, lower case.
UNITS = [
    "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "ft", "yard", "yards", "mile", "miles", "g", "kg", "mg", "gram", "grams",
    "kilogram", "kilograms", "pound", "pounds", "lb", "lbs", "ounce", "ounces", "oz", "ton", "tons", "ml", "l", "liter", "liters",
    "litre", "litres", "gallon", "gallons", "cup", "cups", "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days",
    "week", "weeks", "month", "months", "year", "years", "dollar", "dollars", "usd", "cent", "cents", "euro", "euros", "percent",
    "degree", "degrees", "celsius", "fahrenheit", "watt", "watts", "volt", "volts", "joule", "joules", "newton", "newtons", "mph", "kmh",
]
NUMBER, UNIT, NAME = "<n>", "<u>", "<p>"
_PIECES = r"\p{N}+(?:[.,:]\p{N}+)*|[\p{L}\p{M}\p{N}_]+|[.!?\n]"


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it inside a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words(text: Column) -> Column:
    """Array of (raw, template) of a text's words, without punctuation.

    A capital marks a name only inside a sentence: the first word of one is capital anyway.
    """
    pieces = F.regexp_extract_all(text, F.lit(_PIECES), F.lit(0))
    units = F.array(*[F.lit(u) for u in UNITS])

    def one(piece: Column, i: Column, all_pieces: Column) -> Column:
        before = F.when(i > 0, F.element_at(all_pieces, i))
        number = piece.rlike(r"^\p{N}")
        unit = F.coalesce(before.rlike(r"^\p{N}"), F.lit(False)) & F.array_contains(units, F.lower(piece))
        name = piece.rlike(r"^\p{Lu}") & F.coalesce(~before.isin(".", "!", "?", "\n"), F.lit(False))
        return F.struct(piece.alias("raw"), F.when(number, NUMBER).when(unit, UNIT).when(name, NAME).otherwise(F.lower(piece)).alias("tpl"))

    marked = _let(pieces, lambda ps: F.transform(ps, lambda p, i: one(p, i, ps)))
    return F.filter(marked, lambda w: ~w["raw"].isin(".", "!", "?", "\n"))


def _placeholder(word: Column) -> Column:
    return word.isin(NUMBER, UNIT, NAME)


def _windows(tpl: Column, n: int) -> Column:
    """64-bit hash of every run of n template words; none where the text is shorter."""
    def rolled(codes: Column) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.size(codes) - (n - 1)), lambda i: F.xxhash64(*[F.element_at(codes, i + j) for j in range(n)]))
        return F.when(F.size(codes) >= n, every).otherwise(F.array().cast("array<bigint>"))

    return _let(F.transform(tpl, lambda w: F.xxhash64(w)), rolled)


def _longest(at: Column) -> Column:
    """Longest run of consecutive windows, 0 of none: positions minus their rank are equal within a run."""
    return F.coalesce(_let(F.transform(at, lambda p, i: p - i), lambda ranks: F.array_max(
        F.transform(F.array_distinct(ranks), lambda r: F.size(F.filter(ranks, lambda x: x == r))))), F.lit(0))


def _agreeing(names: Column) -> Column:
    """How many of the (a, b) pairs belong to a one-to-one map that prefers the frequent ones."""
    counted = F.transform(F.array_distinct(names), lambda p: F.struct(F.size(F.filter(names, lambda q: q == p)).alias("n"), p.alias("p")))

    def kept(ps: Column) -> Column:
        rival = lambda p, q: ((q["p"]["a"] == p["p"]["a"]) != (q["p"]["b"] == p["p"]["b"])) & (
            (q["n"] > p["n"]) | ((q["n"] == p["n"]) & (q["p"] < p["p"])))
        return F.aggregate(F.filter(ps, lambda p: ~F.exists(ps, lambda q: rival(p, q))), F.lit(0), lambda total, p: total + p["n"])

    return _let(counted, kept)


def contaminated(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
                 window: int = 5, share: float = 0.8, run: int = 13, literals: int = 3, broadcast_rows: int = 100_000,
                 slack: float = 0.1) -> DataFrame:
    """Pairs ``doc_id, item_id`` with ``n_windows`` of the item that match, ``share`` of them, ``longest`` run in words and ``slots`` compared.

    Items shorter than ``window`` words cannot be told from ordinary speech and are not looked for.
    The likely alignments are written to the shared folder. Texts are read again only for those with
    slots; their keys (16 bytes) are broadcast if they are at most ``broadcast_rows``, else joined.
    """
    bench = items.select(F.col(item).alias("item_id"), words(F.coalesce(F.col(item_text), F.lit(""))).alias("iw"))
    bench = bench.withColumn("codes", _windows(F.col("iw.tpl"), window))
    spots = bench.select("item_id", F.posexplode("codes").alias("ipos", "code"), "iw").filter(
        F.size(F.filter(F.slice(F.col("iw.tpl"), F.col("ipos") + 1, window), lambda w: ~_placeholder(w))) >= literals
    ).drop("iw")
    sizes = spots.groupBy("item_id").agg(F.countDistinct("ipos").alias("of"))
    rows = docs.select(F.col(id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("row_key", F.xxhash64("text"))
    seen = rows.withColumn("dw", words(F.col("text"))).select("doc_id", "row_key", F.posexplode(_windows(F.col("dw.tpl"), window)).alias("dpos", "code"))
    hits = seen.join(spots, "code").groupBy("doc_id", "row_key", "item_id", (F.col("dpos") - F.col("ipos")).alias("shift")).agg(
        F.array_sort(F.collect_set("ipos")).alias("at")
    )
    hits = hits.join(sizes, hits["item_id"].eqNullSafe(sizes["item_id"])).drop(sizes["item_id"])
    hits = hits.withColumn("n_windows", F.size("at")).withColumn("longest", _longest(F.col("at")) + (window - 1))
    likely = hits.filter((F.col("n_windows") >= share * F.col("of")) | (F.col("longest") >= run))
    # Each alignment that is left is compared slot by slot.
    likely = likely.join(bench.select(F.col("item_id").alias("_item"), "iw"), F.col("item_id").eqNullSafe(F.col("_item"))).drop("_item")
    # Windows of few literals match nothing themselves, so the slots up to two windows around count as well.
    slots = F.filter(
        F.transform("iw", lambda w, i: F.struct(w["raw"].alias("a"), w["tpl"].alias("tpl"), i.alias("i"))),
        lambda w: _placeholder(w["tpl"]) & (w["i"] >= F.array_min("at") - window) & (w["i"] < F.array_max("at") + 2 * window),
    )
    likely = checkpointed(likely.withColumn("slots", slots).drop("iw"))
    plain, open_ = likely.filter(F.size("slots") == 0), likely.filter(F.size("slots") > 0)
    keys = open_.select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key")).distinct()
    if keys.count() <= broadcast_rows:
        keys = F.broadcast(keys)
    texts_again = rows.join(keys, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row_key") == F.col("_key"))).drop("doc_id", "row_key")
    filled = open_.join(texts_again, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row_key") == F.col("_key")))
    filled = filled.withColumn("dw", words(F.col("text")))

    def paired(dw: Column) -> Column:
        there = lambda s: F.get(dw, s["i"] + F.col("shift"))
        same = F.filter("slots", lambda s: F.coalesce(there(s)["tpl"] == s["tpl"], F.lit(False)))
        return F.transform(same, lambda s: F.struct(F.lower(s["a"]).alias("a"), F.lower(there(s)["raw"]).alias("b"), s["tpl"].alias("tpl"), s["i"].alias("i")))

    filled = filled.withColumn("pairs", _let(F.col("dw"), paired))
    other = F.transform(F.filter("pairs", lambda s: s["a"] != s["b"]), lambda s: s["i"])
    raw = _let(other, lambda bad: F.filter("at", lambda p: ~F.exists(bad, lambda b: (b >= p) & (b < p + window))))
    names = F.transform(F.filter("pairs", lambda s: s["tpl"] == NAME), lambda s: F.struct(s["a"], s["b"]))
    filled = filled.withColumn("raw", raw).withColumn("names", names).filter(
        (F.size("raw") >= share * F.col("of")) | (_longest(F.col("raw")) + (window - 1) >= run)
        | (_agreeing(F.col("names")) >= (1 - slack) * F.size("names"))
    )
    out = ["doc_id", "item_id", "n_windows", "of", "longest", F.size("slots").alias("n_slots")]
    found = plain.select(*out).union(filled.select(*out))
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_windows", "longest", "of", "n_slots")).alias("b"))
    return best.select(
        "doc_id", "item_id", F.col("b.n_windows").cast("bigint").alias("n_windows"), (F.col("b.n_windows") / F.col("b.of")).alias("share"),
        F.col("b.longest").cast("bigint").alias("longest"), F.col("b.n_slots").cast("bigint").alias("slots"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that hold no benchmark item, with the columns they came with."""
    bad = contaminated(docs, items, id, text, **options).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, F.col(id).eqNullSafe(F.col("_bad")), "left_anti")
