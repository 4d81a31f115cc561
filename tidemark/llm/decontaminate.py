"""Benchmark decontamination by template canonicalisation, in DataFrame expressions only.

Numbers, names and units are replaced by typed placeholders, which leaves the template of a text. Templates are cut into
windows of ``WORDS`` words, and the windows of the documents are hash-joined with those of the benchmark items. Windows
with the same words in any case match as well. Each matching window brings the values that stood in its placeholders on both sides; within an occurrence of an item these
must be consistent, one value of the item always meeting the same value of the document, so that a question with other
numbers or names is found and a chance meeting of templates isn't. A document leaks an item if in any occurrence the
windows that are consistent cover ``SIMILARITY`` of the item's words and are as large a share of the windows that match.
Occurrences are told apart by their shift, place in the document minus place in the item (see ``occurrences``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import RID, Workspace, with_rid

WORDS, SIMILARITY = 5, 0.8
#: A window needs so many words that are not placeholders, else its template says too little and only its words can match.
LITERAL = 2
#: Benchmark windows up to this number are broadcast (16 bytes each and their slots); more are joined by a shuffle.
BROADCAST_WINDOWS = 200_000
#: Words that count as units of measure.
UNITS = (
    "mm cm m km in ft yd mi mg g kg lb oz t ml cl l gal s sec min h hr day days week weeks month months year years hour hours minute minutes second seconds "
    "meter meters metre metres kilometer kilometers mile miles foot feet inch inches gram grams kilogram kilograms pound pounds liter liters litre litres "
    "dollar dollars cent cents euro euros percent degree degrees kmh mph hz khz mhz ghz kb mb gb tb v w kw kwh j kj"
).split()
_START, _SLOT, _NONE = "\x03", "\x01", "\x02"
_ROW = "__clean_row"
#: What tells the occurrences of an item in a document apart.
PLACE = ["rid", "item", "level", "shift"]


def words_of(text: Column) -> Column:
    """A text's words with a blank between them, without punctuation; the first of each sentence has the mark of a start before it."""
    text = F.translate(text, "\x01\x02\x03", "   ")
    marked = F.regexp_replace(F.concat(F.lit(_START), text), r"[.!?:]+(?:\s+|$)", f" {_START}")
    # Points and commas stay within numbers.
    return F.regexp_replace(marked, rf"(?<![0-9])[.,]|[.,](?![0-9])|[^\p{{L}}\p{{N}}{_START}.,]+", " ")


def _shape(words: Column) -> Column:
    """The same words as placeholders or in lower case; units are still words."""
    numbers = F.regexp_replace(words, rf"(?<![^ ]){_START}?[0-9][^ ]*", "<num>")
    names = F.regexp_replace(numbers, r"(?<![^ ])\p{Lu}[^ ]*", "<name>")
    return F.translate(F.lower(names), _START, "")


def _split(words: Column) -> Column:
    return F.filter(F.split(words, " "), lambda w: (w != "") & (w != _START))


def windows(texts: DataFrame, size: int = WORDS, short: tuple[int, ...] = ()) -> DataFrame:
    """(rid, n, pos, h, same, slots): for each window a hash of its template, the values in its placeholders, words of the text.

    A second row (same) has a hash of the window's words in lower case and no slots: copies meet there whatever their case and
    placeholders. Windows with fewer than ``LITERAL`` words that are not placeholders have only this row. A text with fewer
    words than ``size`` is one window; texts are also cut into windows of each length in ``short``.
    """
    words = texts.select("rid", words_of(F.col("text")).alias("words")).select("rid", "words", _split(_shape(F.col("words"))).alias("shape"))
    kind = lambda s: F.when(s.isin(UNITS), "<unit>").otherwise(s)
    lower = lambda w: F.lower(F.ltrim(w, F.lit(_START)))
    value = lambda w, s: F.when(kind(s).startswith("<"), F.concat(kind(s), lower(w)))
    parts = {"item": F.transform("shape", lambda s: F.xxhash64(kind(s))), "value": F.zip_with(_split(F.col("words")), "shape", value), "word": F.transform(_split(F.col("words")), lambda w: F.xxhash64(lower(w)))}
    ready = words.select("rid", F.size("shape").cast("long").alias("n"), *[c.alias(k) for k, c in parts.items()])
    # No filter on n: Catalyst would push it down and work the words out twice; an empty array has no rows anyway.
    # Each array beside itself moved on by one word, by two, and so on: a row for each place, with its window's parts as columns.
    moved = F.arrays_zip(*[F.slice(k, i + 1, F.greatest(F.lit(0), F.col("n").cast("int") - i)).alias(f"{k}{i}") for k in parts for i in range(size)])
    out = ready.select("rid", "n", F.posexplode(moved).alias("pos", "x")).withColumn("pos", F.col("pos").cast("long"))
    part = lambda k, m: [F.col("x")[f"{k}{i}"] for i in range(m)]
    rows = []
    for m in (size, *short):
        # A short length stands for itself only; the whole of a shorter text is its window of ``size``.
        wide = F.least(F.lit(size), F.col("n")) if m == size else F.lit(m)
        filled = sum((v.isNotNull().cast("int") for v in part("value", m)), F.lit(0))
        fits = F.col("pos") <= F.col("n") - wide
        slots = F.nullif(F.concat_ws(_SLOT, *part("value", m)), F.lit(""))
        rows.append(F.when(fits & (filled <= F.greatest(F.lit(0), wide - LITERAL)), F.struct(F.xxhash64(*part("item", m)).alias("h"), F.lit(False).alias("same"), slots.alias("slots"))))
        rows.append(F.when(fits, F.struct(F.xxhash64(F.lit(1), *part("word", m)).alias("h"), F.lit(True).alias("same"), F.lit(None).cast("string").alias("slots"))))
    return out.select("rid", "n", "pos", F.explode(F.array(*rows)).alias("w")).where("w is not null").select("rid", "n", "pos", "w.h", "w.same", "w.slots")


def cover(places: DataFrame, size: int, similarity: float, keys: list[str]) -> DataFrame:
    """(keys, covered, windows) of those ``keys`` whose windows (keys, at, words) cover ``similarity`` of the item's words."""
    # Each window adds the words that the one before doesn't have.
    after = Window.partitionBy(*keys).orderBy("at")
    wide = F.least(F.lit(size), F.col("words"))
    fresh = places.distinct().withColumn("fresh", F.least(wide, F.coalesce(F.col("at") - F.lag("at").over(after), wide)))
    return fresh.groupBy(*keys).agg((F.sum("fresh") / F.max("words")).alias("covered"), F.count(F.lit(1)).alias("windows")).where(F.col("covered") >= similarity)


def occurrences(met: DataFrame, similarity: float) -> DataFrame:
    """The matching windows ``met`` with the occurrence (level, shift) that each is judged in; a window can be in several.

    Level 0: windows of one shift, as in a copy or a version with other values. Level 1: windows around a shift that occurs,
    as far as the words that an item may lose, for words put in or left out. Level 2: all windows of the document, for an
    item in distant parts. Level 3: the same without windows that meet by their words only, which vote for no value.
    """
    met = met.withColumn("shift", F.col("pos") - F.col("at"))
    one = met.withColumn("level", F.lit(0))
    # Shifts that are at most ``reach`` apart are in one bucket or in neighbours, so a window meets only the shifts near its own.
    reach = F.ceil(F.col("words") * (1 - similarity)).cast("long")
    bucket = F.floor(F.col("shift") / F.greatest(reach, F.lit(1)))
    centres = met.select("rid", "item", F.col("shift").alias("centre"), bucket.alias("b")).distinct()
    centres = centres.select("rid", "item", "centre", F.explode(F.array(F.col("b") - 1, "b", F.col("b") + 1)).alias("bucket"))
    around = met.withColumn("bucket", bucket).join(centres, ["rid", "item", "bucket"]).where(F.abs(F.col("shift") - F.col("centre")) <= reach)
    around = around.withColumn("shift", F.col("centre")).drop("bucket", "centre").withColumn("level", F.lit(1))
    whole = met.withColumn("shift", F.lit(0).cast("long"))
    return one.unionByName(around).unionByName(whole.withColumn("level", F.lit(2))).unionByName(whole.where("not same").withColumn("level", F.lit(3)))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(id, item, covered, windows, slots) for each document that leaks an item.

    covered is the share of the item's words in consistent windows of the occurrence that covers most, windows their number,
    slots the number of different values of the item that were met. Null and empty texts, of documents or items, match nothing; items with a null or
    repeated id are items of their own, and so are documents. Other columns are not read. Empty tables give no rows.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "leaks")
    rows, is_id = with_rid(docs, id_col, ws, text_col)
    texts = rows.select(F.col(RID).alias("rid"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    items, _ = with_rid(benchmark, item_col, Workspace(spark, "items"), item_text_col)
    item_texts = items.select(F.col(RID).alias("rid"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("text"))
    theirs = windows(item_texts, size).select(F.col("rid").alias("item"), F.col("pos").alias("at"), F.col("n").alias("words"), "h", "same", F.col("slots").alias("item_slots"))
    theirs = ws.table(theirs, "items")
    side = F.broadcast(theirs) if theirs.count() <= BROADCAST_WINDOWS else theirs
    short = tuple(sorted(r.words for r in theirs.where(F.col("words") < size).select("words").distinct().collect()))
    met = windows(texts, size, short).join(side, ["h", "same"]).select("rid", "pos", "item", "at", "words", "same", F.coalesce("slots", F.lit("")).alias("slots"), F.coalesce("item_slots", F.lit("")).alias("item_slots"))
    met = ws.table(met.distinct(), "met")
    # Pairs that all their windows together don't cover can't be covered by some of them.
    may = cover(met.select("rid", "item", "at", "words"), size, similarity, ["rid", "item"]).select("rid", "item")
    met = ws.table(met.join(may, ["rid", "item"], "left_semi"), "may")
    placed = ws.table(occurrences(met, similarity), "placed")
    good = consistent(placed).unionByName(placed.where("item_slots = ''").select(*PLACE, "at", "words"))
    found = cover(good, size, similarity, PLACE)
    every = placed.groupBy(*PLACE).agg(F.countDistinct("at").alias("every"))
    found = found.join(every, PLACE).where(F.col("windows") >= similarity * F.col("every"))
    found = found.groupBy("rid", "item").agg(F.max(F.struct("covered", "windows")).alias("best")).select("rid", "item", "best.covered", "best.windows")
    pair = met.where("item_slots <> ''").select("rid", "item", F.explode(F.split("item_slots", _SLOT)).alias("v")).groupBy("rid", "item").agg(F.countDistinct("v").alias("slots"))
    found = found.join(pair, ["rid", "item"], "left").withColumn("slots", F.coalesce("slots", F.lit(0)).cast("long"))
    found = found.join(items.select(F.col(RID).alias("item"), F.col(item_col).alias("_item")), "item")
    if is_id:
        found = found.withColumn("_doc", F.col("rid"))
    else:
        found = found.join(rows.select(F.col(RID).alias("rid"), F.col(id_col).alias("_doc")), "rid")
    return found.select(F.col("_doc").alias(id_col), F.col("_item").alias(item_col), "covered", "windows", "slots")


def consistent(met: DataFrame) -> DataFrame:
    """Of matching windows with slots, those all of whose values agree with what most windows of the occurrence say.

    The value that an item's value meets most often (of equals, the first by order) is its value in that occurrence, and two
    values of the item can't have the same one.
    """
    filled = met.where("item_slots <> ''").withColumn("pairs", F.explode(F.arrays_zip(F.split("item_slots", _SLOT).alias("v"), F.split("slots", _SLOT).alias("d"))))
    filled = filled.select(*PLACE, "at", "pos", "words", "pairs.v", "pairs.d")
    votes = filled.groupBy(*PLACE, "v", "d").agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy(*PLACE, "v").agg(F.min(F.struct((-F.col("votes")).alias("m"), "d")).alias("b")).select(*PLACE, "v", F.col("b.d").alias("best"), F.col("b.m").alias("m"))
    # One-to-one: of the item's values that took the same value, the one with most votes keeps it.
    owner = best.groupBy(*PLACE, "best").agg(F.min(F.struct("m", "v")).alias("o")).select(*PLACE, "best", F.col("o.v").alias("owner"))
    rule = best.join(owner, [*PLACE, "best"]).where("v = owner").select(*PLACE, "v", "best")
    judged = filled.join(rule, [*PLACE, "v"], "left").groupBy(*PLACE, "at", "pos", "words")
    return judged.agg(F.min(F.coalesce(F.col("d") == F.col("best"), F.lit(False))).alias("all")).where("all").select(*PLACE, "at", "words")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents without those that leak an item, with all their columns; rows with a null or repeated id are told apart."""
    rows = with_rid(docs, id_col, Workspace(docs.sparkSession, "clean"), *docs.columns)[0].withColumnRenamed(RID, _ROW)
    return rows.join(leaks(rows, benchmark, _ROW, **options).select(_ROW).distinct(), _ROW, "left_anti").select(docs.columns)
