"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

Numbers, the units after them and names within sentences become typed placeholders; windows of template words are hashed
and joined with those of the benchmark. Windows that match along one alignment make a run; a run counts if the values
behind its placeholders go by one mapping from the item's to the document's, so that a question with other numbers or
names is caught and a chance match with mixed-up values is not. Windows off the mapping are left out, not their run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, need

#: Words of a window, and how many of them must not be placeholders.
WIDTH = 8
CONTENT = 5
#: The benchmark's windows are broadcast up to this many rows (about 40 bytes each); beyond it the join is a shuffled one.
BROADCAST_ROWS = 200_000
#: The items' words are broadcast up to this many (some 10 bytes each, with and without values).
BROADCAST_WORDS = 2_000_000
NUMBER, UNIT, NAME = "\ue000", "\ue001", "\ue002"
UNITS = "kilometers|kilometres|kilograms|centimeters|meters|metres|miles|inches|pounds|ounces|liters|litres|grams|gallons|dollars|euros|cents|hours|minutes|seconds|days|weeks|months|years|percent|degrees|feet|km|kg|cm|mm|mg|ml|lb|lbs|oz|ft|mph|kmh|hrs|min|sec|usd|eur|m|g|l|s|h"
NUMBERS = r"[0-9](?:[0-9.,:/]*[0-9])?"
AFTER_NUMBER = rf"({NUMBER}[ -]?)((?i:{UNITS}))(?![A-Za-z\x80-￿])"
NAMES = r"([a-z0-9,;\x80-￿] )([A-Z][a-z\x80-퟿]+)"
#: ASCII other than letters and digits parts template words.
GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _numbered(text: Column) -> Column:
    return F.regexp_replace(text, NUMBERS, NUMBER)


def _with_units(text: Column) -> Column:
    return F.regexp_replace(text, AFTER_NUMBER, f"$1 {UNIT} ")


def template_words(text: Column) -> Column:
    """Canonical words of a text, placeholders among them."""
    named = F.regexp_replace(_with_units(_numbered(text)), NAMES, f"$1 {NAME} ")
    apart = F.replace(named, F.lit(NUMBER), F.lit(f" {NUMBER} "))
    return F.filter(F.split(F.lower(apart), GAPS), lambda w: w != "")


def slot_values(text: Column) -> Column:
    """The values behind the placeholders, by type and in order: array of three arrays (numbers, units, names)."""
    numbered = _numbered(text)
    units = _with_units(numbered)
    return F.array(F.regexp_extract_all(text, F.lit(f"({NUMBERS})"), F.lit(1)), F.transform(F.regexp_extract_all(numbered, F.lit(AFTER_NUMBER), F.lit(2)), F.lower), F.regexp_extract_all(units, F.lit(NAMES), F.lit(2)))


def valued_words(words: Column, values: Column) -> Column:
    """template_words with the value written behind each placeholder, place by place."""
    line = F.array_join(words, " ")
    for k, mark in enumerate((NUMBER, UNIT, NAME)):
        own = F.transform(values[k], lambda v: F.concat(F.lit(mark), v))  # noqa: B023
        line = F.array_join(F.zip_with(F.split(line, mark), own, lambda part, v: F.concat(F.coalesce(part, F.lit("")), F.coalesce(v, F.lit("")))), "")
    return F.filter(F.split(line, " "), lambda w: w != "")


def _windows(words: Column, width: int) -> Column:
    return F.when(F.size(words) >= width, F.transform(F.sequence(F.lit(1), F.size(words) - width + 1), lambda i: F.xxhash64(F.slice(words, i, width))))


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once for a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _kept(windows: Column, shift: Column) -> Column:
    """Those of a run's windows whose slots all go by the run's mapping, or all hold the item's own values.

    The mapping gives each item value the document value it meets most often in the run, the item's own before others
    that are as frequent; without a most frequent one the value has none. Two item values may share a document value.
    """
    within = lambda p, w: (p >= w["at"]) & (p < w["at"] + w["span"])
    place = lambda p: F.get("item_words", p).isin(NUMBER, UNIT, NAME)

    def of(true):
        met = F.filter(F.sequence(F.lit(0), F.size("item_words") - 1), lambda p: place(p) & F.exists(true, lambda w: within(p, w)))
        pairs = F.transform(met, lambda p: F.struct(p.alias("p"), F.get("item_valued", p).alias("a"), F.get("doc_valued", p + shift).alias("b")))
        return _let(pairs, lambda own: _let(F.transform(own, lambda x: x.withField("n", F.size(F.filter(own, lambda y: (y["a"] == x["a"]) & (y["b"] == x["b"]))))), lambda own: chosen(true, own)))

    def chosen(true, own):
        rival = lambda x, y: (y["a"] == x["a"]) & (y["b"] != x["b"]) & ((y["n"] > x["n"]) | ((y["n"] == x["n"]) & (x["a"] != x["b"])))
        strays = F.filter(own, lambda x: F.exists(own, lambda y: rival(x, y)))
        others = F.filter(own, lambda x: x["a"] != x["b"])
        free = lambda bad, w: ~F.exists(bad, lambda x: within(x["p"], w))
        return _let(strays, lambda s: _let(others, lambda o: F.filter(true, lambda w: free(s, w) | free(o, w))))

    alike = lambda w, a, b: F.slice(a, w["at"] + shift + 1, w["span"]) == F.slice(b, w["at"] + 1, w["span"])
    true = lambda w: F.when(w["valued"], alike(w, F.col("doc_valued"), F.col("item_valued"))).otherwise(alike(w, F.col("doc_words"), F.col("item_words")))
    return _let(F.filter(windows, true), of)


def find_leaks(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, content: int = CONTENT) -> DataFrame:
    """documents(doc_id, text), benchmark(item_id, text) -> (doc_id, item_id, windows, words, slots, exact), one row per leaked item of a document.

    windows: matching windows that are consistent; words: of the longest run from the first to the last of them; slots:
    placeholders in it; exact: all its words and values are the same as the item's. Null and empty texts match nothing;
    items shorter than `width` words are matched as a whole, from 3 words on. A window with fewer than `content` words
    that aren't placeholders is matched with its values, and by the template of up to 2 * `width` words around it if
    those have enough. Repeated documents and items are each reported; a null id is kept as null and taken as one document. Other columns are ignored; either table
    may be empty.
    """
    need(docs, "doc_id", "text")
    need(benchmark, "item_id", "text")
    items = benchmark.select("item_id", F.col("text").alias("item_text")).where("text IS NOT NULL").distinct()
    items = items.select("item_id", template_words(F.col("item_text")).alias("item_words"), slot_values(F.col("item_text")).alias("v"))
    items = items.withColumn("item_valued", valued_words(F.col("item_words"), F.col("v"))).drop("v")
    size = F.least(F.lit(width), F.size("item_words"))
    placeholders = lambda w: F.size(F.filter(w, lambda x: x.isin(NUMBER, UNIT, NAME)))
    filled = lambda w: F.size(w) - placeholders(w)
    least = min(content, 3)
    spans = items.select("item_id", "item_words", "item_valued", size.alias("span"), F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("item_words") - width + 1))).alias("at")).where(F.col("span") >= least)
    spans = spans.withColumn("own", F.slice("item_words", F.col("at"), F.col("span")))
    spans = spans.withColumn("strong", (filled(F.col("own")) >= F.least(F.lit(content), F.col("span"))) & (filled(F.col("own")) >= least))
    target = lambda w, at, span, valued: [F.xxhash64(w).alias("hash"), "item_id", (at - 1).alias("item_at"), span.alias("span"), F.lit(valued).alias("valued")]
    strong = spans.where("strong").select(*target(F.col("own"), F.col("at"), F.col("span"), False))
    # too few words of their own: with their values, and as part of a longer template
    weak = spans.where("NOT strong")
    exact = weak.select(*target(F.slice("item_valued", F.col("at"), F.col("span")), F.col("at"), F.col("span"), True))
    weak = weak.where(F.size("item_words") > width).withColumn("long", F.least(F.size("item_words"), F.lit(2 * width))).withColumn("from", F.least(F.col("at"), F.size("item_words") - F.col("long") + 1))
    weak = weak.withColumn("around", F.slice("item_words", F.col("from"), F.col("long"))).where(filled(F.col("around")) >= content)
    longer = weak.select(*target(F.col("around"), F.col("from"), F.col("long"), False)).distinct()
    targets = cut(strong.unionByName(exact).unionByName(longer))
    kinds = sorted((r["span"], r["valued"]) for r in targets.select("span", "valued").distinct().collect())
    ready = docs.select("doc_id", template_words(F.coalesce("text", F.lit(""))).alias("words"), slot_values(F.coalesce("text", F.lit(""))).alias("v"))
    ready = ready.withColumn("valued", valued_words(F.col("words"), F.col("v")))
    if len(kinds) < 2:
        w, valued = (kinds or [(width, False)])[0]
        seen = ready.select("doc_id", F.posexplode(_windows(F.col("valued" if valued else "words"), w)).alias("at", "hash"))
    else:  # all kinds of windows in one pass over the texts
        placed = [F.coalesce(F.transform(_windows(F.col("valued" if v else "words"), w), lambda h, i: F.struct(i.alias("at"), h.alias("hash"))), F.array().cast("array<struct<at:int,hash:bigint>>")) for w, v in kinds]
        seen = ready.select("doc_id", F.explode(F.concat(*placed)).alias("h")).select("doc_id", "h.at", "h.hash")
    own = F.broadcast(targets) if targets.count() <= BROADCAST_ROWS else targets
    hits = seen.join(own, "hash").select("doc_id", "item_id", "at", "item_at", "span", "valued")
    runs = hits.groupBy("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).agg(
        F.collect_set(F.struct(F.col("item_at").alias("at"), "span", "valued")).alias("met")
    )
    runs = cut(runs)
    ids = runs.select("doc_id").distinct()
    few = ids.count() <= 1_000_000
    text = docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi").where("text IS NOT NULL").distinct()
    text = text.select(F.col("doc_id").alias("d"), template_words(F.col("text")).alias("doc_words"), slot_values(F.col("text")).alias("v")).withColumn("doc_valued", valued_words(F.col("doc_words"), F.col("v")))
    sides = items.select(F.col("item_id").alias("i"), "item_words", "item_valued")
    brief = (items.agg(F.sum(F.size("item_words"))).first()[0] or 0) <= BROADCAST_WORDS
    both = runs.join(text, runs["doc_id"].eqNullSafe(text["d"])).join(F.broadcast(sides) if brief else sides, runs["item_id"].eqNullSafe(sides["i"]))
    both = both.withColumn("kept", _kept(F.col("met"), F.col("shift"))).where(F.size("kept") > 0)
    both = both.withColumns({"lo": F.array_min(F.transform("kept", lambda w: w["at"])), "hi": F.array_max(F.transform("kept", lambda w: w["at"] + w["span"])), "windows": F.size(F.array_distinct(F.transform("kept", lambda w: w["at"])))})
    # between a run's windows words and values may differ
    own = lambda c, by=F.lit(0): F.slice(c, F.col("lo") + by + 1, F.col("hi") - F.col("lo"))
    judged = both.select("doc_id", "item_id", "windows", (F.col("hi") - F.col("lo")).alias("words"), placeholders(own("item_words")).alias("slots"), (own("doc_valued", F.col("shift")) == own("item_valued")).alias("exact"))
    best = judged.groupBy("doc_id", "item_id").agg(F.sum("windows").alias("windows"), F.max(F.struct("words", "slots", "exact")).alias("b"))
    return best.select("doc_id", "item_id", "windows", F.col("b.words").cast("long").alias("words"), F.col("b.slots").cast("long").alias("slots"), F.col("b.exact").alias("exact"))
