"""Secret scans by multipart credential linking, in DataFrame expressions only.

Three kinds of span are strong and always reported: assignments to a name that says secret, access identifiers and
long hexadecimal strings. Three kinds are weak: other identifiers, strings of 40 base-64 characters, and endpoints. The
parts of one credential stand close together, so the weak spans are interval-joined, within a scope of ``SCOPE``
characters, to the identifiers and secrets around them. A weak identifier needs a secret, a weak secret needs an
identifier, an endpoint needs both.

Positions of matches come from the lengths of what lies between them: the text split at the pattern.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import RID, Workspace, with_rid

SCOPE = 400


def either_case(words: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in words)


#: Kind -> pattern, least length, group whose length counts, string or pattern that a text must have for a match at all.
ASSIGN = rf"""({either_case("password|passwd|secret|token|api_?key")})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
STRONG = {"assign": (ASSIGN, 6, 2), "access": ("AKIA[A-Z0-9]+", 20, 0), "hex": ("[0-9a-f]{24,}", 24, 0)}
WEAK = {"ident": ("A(?:SIA|ROA|IDA)[A-Z0-9]+", 20, 0), "secret": ("[A-Za-z0-9/+]{40,}", 40, 0), "endpoint": (r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?", 11, 0)}
KINDS = [*STRONG, *WEAK]
#: What part of a credential a kind is.
IDENTIFIER, SECRET = ["access", "ident"], ["assign", "hex", "secret"]


def _matches(text: Column, kind: str, look: Column) -> Column:
    """Array of (kind, number, characters before since the last match, characters, characters that must be enough)."""
    pattern, _, group = (STRONG | WEAK)[kind]
    sizes = lambda g: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(g)), F.length)
    between = F.transform(F.split(text, pattern, -1), F.length)
    zipped = F.arrays_zip(between.alias("b"), sizes(0).alias("n"), sizes(group).alias("v"))
    rows = F.transform(zipped, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("number"), x["b"].alias("before"), x["n"].alias("size"), x["v"].alias("value")))
    return F.when(look, F.filter(rows, lambda x: x["size"].isNotNull())).otherwise(F.array().cast("array<struct<kind:string,number:int,before:int,size:int,value:int>>"))


def spans(texts: DataFrame) -> DataFrame:
    """(rid, kind, start, end) of every strong span, and of the weak ones in texts that have an identifier at all."""
    text = F.col("text")
    some_id = text.contains("AKIA") | text.rlike(WEAK["ident"][0])
    look = {"assign": text.rlike(ASSIGN), "access": text.contains("AKIA"), "hex": text.rlike("[0-9a-f]{24}"), "ident": some_id, "secret": some_id, "endpoint": some_id & text.contains("://")}
    found = texts.select("rid", F.explode(F.concat(*[_matches(text, k, look[k]) for k in KINDS])).alias("m")).select("rid", "m.*")
    # All matches count towards the places, also those that are then too short.
    w = Window.partitionBy("rid", "kind").orderBy("number")
    end = F.sum(F.col("before") + F.col("size")).over(w)
    placed = found.select("rid", "kind", "value", (end - F.col("size")).alias("start"), end.alias("end"))
    enough = F.lit(False)
    for kind, (_, least, _) in (STRONG | WEAK).items():
        enough = F.when(F.col("kind") == kind, F.col("value") == least if kind == "secret" else F.col("value") >= least).otherwise(enough)
    return placed.where(enough).drop("value")


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak spans of ``parts`` (rid, kind, start, end) whose complementary parts lie within the scope.

    An interval join on (rid, cell of ``scope`` characters): a weak span looks into the cells it reaches with the scope
    added on both sides. A span that overlaps a strong one says nothing new and is left out.
    """
    strong = F.col("kind").isin(list(STRONG))
    cell = lambda a, b: F.explode(F.sequence(F.floor(a / scope), F.floor(b / scope)))
    weak = parts.where(~strong).select("rid", F.col("kind").alias("k"), F.col("start").alias("s"), F.col("end").alias("e"))
    weak = weak.withColumn("cell", cell(F.greatest(F.lit(0), F.col("s") - scope), F.col("e") + scope))
    near = parts.where(F.col("kind") != "endpoint").withColumn("cell", cell(F.col("start"), F.col("end") - 1))
    within = (F.greatest("s", "start") - F.least("e", "end")) <= scope
    pairs = weak.join(near, ["rid", "cell"]).where(within & ~((F.col("k") == F.col("kind")) & (F.col("s") == F.col("start"))))
    over = strong & (F.col("start") < F.col("e")) & (F.col("s") < F.col("end"))
    seen = pairs.groupBy("rid", "k", "s", "e").agg(F.max(F.col("kind").isin(IDENTIFIER)).alias("id"), F.max(F.col("kind").isin(SECRET)).alias("secret"), F.max(over).alias("over"))
    needs = F.when(F.col("k") == "ident", F.col("secret")).when(F.col("k") == "secret", F.col("id")).otherwise(F.col("id") & F.col("secret"))
    return seen.where(~F.col("over") & needs).select("rid", F.col("k").alias("kind"), F.col("s").alias("start"), F.col("e").alias("end"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """A row per input row: the id, n_assign, n_access, n_hex, base_sha256, spans, n_linked (weak spans reported).

    Spans are kind:start:end in code points, by start, then kind in the order of ``KINDS``. A null or empty text has none.
    Rows with a repeated or null id are scanned as rows of their own. Other columns are not read.
    """
    ws = Workspace(docs.sparkSession, "secrets")
    rows, _ = with_rid(docs, id_col, ws, text_col)
    texts = rows.select(F.col(RID).alias("rid"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    parts = ws.table(spans(texts), "parts")
    every = parts.where(F.col("kind").isin(list(STRONG))).unionByName(linked(parts, scope))
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    item = F.struct("start", order.alias("order"), F.concat_ws(":", "kind", "start", "end").alias("said"))
    strong = F.col("kind").isin(list(STRONG))
    joined = lambda c: F.array_join(F.transform(F.sort_array(c), lambda x: x["said"]), ",")
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in STRONG]
    per = every.groupBy("rid").agg(*counts, joined(F.collect_list(F.when(strong, item))).alias("base"), joined(F.collect_list(item)).alias("spans"), F.count_if(~strong).alias("n_linked"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    out = rows.select(F.col(RID).alias("rid"), F.col(id_col)).join(per, "rid", "left")
    return out.select(id_col, *[zero(f"n_{k}") for k in STRONG], F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), zero("n_linked"))
