"""Fill-in-the-middle transformation: texts are cut at given units and their parts put in another order.

The cutting is relational. A text is matched into blocks of units, one row each; running sums of the blocks' lengths
give every block's place; cut requests find their block by unit ordinal; the units of that block are matched one by
one, and running sums of their lengths give the place of the cut. Only numbers are shuffled for this: the text itself
moves once, to meet its cuts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import Staging, packed, unpacked

#: What one unit of each kind matches. A kind must match a text from end to end, without gaps.
UNITS = {"char": r"(?s).", "word": r"\S+\s*|\s+", "line": r"[^\n]*\n|[^\n]+"}
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARK = "<[PSM]>"
BLOCK = 128


def matches(text: Column, unit: str, most: int = 1) -> Column:
    """A text's units in order, or its blocks of `most` units (the last may have fewer)."""
    return F.regexp_extract_all(text, F.lit(UNITS[unit] if most == 1 else f"(?:{UNITS[unit]}){{1,{most}}}+"), F.lit(0))


def unit_count(text: Column, unit: str) -> Column:
    return (F.length(text) if unit == "char" else F.regexp_count(text, F.lit(UNITS[unit]))).cast("long")


def cut_offsets(requests: DataFrame, unit: str = "char", block: int = BLOCK) -> DataFrame:
    """(k1, k2, offsets): for each text the code points before each cut, as a map from the cut's number.

    requests: k1, k2 (longs that name a text; rows that share them are repeats of one), text, cuts (array of longs: how
    many units stand before a cut, from 0 to the number of units). Rows without text or cuts give none. A text's blocks
    are summed in one task, its repeats are collapsed before that.
    """
    key = ["k1", "k2"]
    rows = requests.where("text is not null and cuts is not null")
    blocks = rows.select(*key, F.posexplode(matches(F.col("text"), unit, block)).alias("block", "piece"))
    blocks = blocks.select(*key, "block", F.length("piece").alias("chars"), unit_count(F.col("piece"), unit).alias("units")).groupBy(*key, "block").agg(F.max("chars").alias("chars"), F.max("units").alias("units"))
    before = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.select(*key, F.coalesce(F.sum("units").over(before), F.lit(0)).alias("first"), "units", F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("at"))
    # a cut lies behind its last unit; one before all units has none, and offset 0
    asked = rows.select(*key, F.posexplode("cuts").alias("cut", "n"), "text")
    asked = asked.select(*key, "cut", "n", (F.col("n") - 1).alias("last"), F.when(F.col("n") > 0, F.element_at(matches(F.col("text"), unit, block), F.expr(f"cast((n - 1) div {block} + 1 as int)"))).alias("piece"))
    asked = asked.distinct()
    # blocks are met by ordinal within their text; the join's keys alone are those of the sums, which need no new exchange
    met = asked.where("n > 0").join(placed, key).where("last >= first and last < first + units")
    single = met.select(*key, "cut", "at", (F.col("last") - F.col("first")).alias("nth"), F.posexplode(F.slice(matches(F.col("piece"), unit), F.lit(1), (F.col("last") - F.col("first") + 1).cast("int"))).alias("pos", "one"))
    upto = Window.partitionBy(*key, "cut").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    single = single.select(*key, "cut", "nth", "pos", (F.col("at") + F.sum(F.length("one")).over(upto)).alias("offset")).where("pos = nth").select(*key, "cut", "offset")
    both = single.union(asked.where("n = 0").select(*key, "cut", F.lit(0).cast("long").alias("offset")))
    return both.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("cut", "offset"))).alias("offsets"))


def draws(key: Column, seed: int, n: int) -> list[Column]:
    """n unsigned 32-bit numbers from the hex SHA-256 of `seed:key`."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long") for i in range(n)]


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made from. No part of a cut text holds a marker, so the markers part it again."""
    p = F.split(output, MARK, -1)
    return F.when(form == "psm", F.concat(p[1], p[3], p[2])).when(form == "spm", F.concat(p[2], p[3], p[1])).otherwise(output)


def fill_in_middle(docs: DataFrame, unit: str = "char", plain_from: int = 90, spm_below: int = 20, seed: int = 1, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n (units of the text), form, prefix_chars, middle_chars (code points, null if plain) and output.

    Four numbers drawn from the id decide: two cuts (h1 % (n + 1) and h2 % (n + 1) units), plain if h3 % 100 >=
    plain_from, and of the others spm if h4 % 100 < spm_below, else psm. Texts that are empty or hold a marker are plain.
    Outputs: the text; `<P>`prefix`<S>`suffix`<M>`middle (psm); `<S>`suffix`<P>`prefix`<M>`middle (spm). A null text
    counts as empty, and its output is empty; a null id draws as an empty one; rows with equal ids draw equal numbers, each for its own
    text; repeated rows are cut each; an empty table gives no row. Columns that bear a name of the result give way to it.
    """
    made = ("n", "form", "prefix_chars", "middle_chars", "output")
    columns = [c for c in docs.columns if c not in made]
    rest = [c for c in columns if c not in (id_col, text_col)]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    identity = F.col(f"`{id_col}`")
    h1, h2, h3, h4 = draws(identity, seed, 4)
    rows = packed(docs.select(*[F.col(f"`{c}`") for c in columns]), id_col, text_col).select(
        F.xxhash64(identity.cast("string")).alias("k1"), F.xxhash64(text, identity.isNull()).alias("k2"), identity.alias("_id"), F.col(f"`{text_col}`").alias("_text"), "rest", text.alias("text"),
        F.when((text == "") | F.rlike(text, F.lit(MARK)) | (h3 % 100 >= plain_from), "plain").when(h4 % 100 < spm_below, "spm").otherwise("psm").alias("form"), h1.alias("h1"), h2.alias("h2"), unit_count(text, unit).alias("n"),
    )
    a, b = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    wanted = rows.where("form <> 'plain'").select("k1", "k2", "text", F.array(F.least(a, b), F.greatest(a, b)).alias("cuts"))
    stage = Staging().__enter__()  # the result reads this table, so that it stays
    cuts = stage(cut_offsets(wanted, unit, block).select("k1", "k2", F.col("offsets")[0].cast("int").alias("lo"), F.col("offsets")[1].cast("int").alias("hi")))
    d = rows.drop("h1", "h2").join(cuts.hint("shuffle_hash"), ["k1", "k2"], "left")
    prefix, middle, suffix = F.substring("text", F.lit(1), F.col("lo")), F.substring("text", F.col("lo") + 1, F.col("hi") - F.col("lo")), F.substring("text", F.col("hi") + 1, F.length("text"))
    put = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    output = F.when(F.col("form") == "psm", put(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)).when(F.col("form") == "spm", put(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)).otherwise(F.col("text"))
    d = d.select(
        F.col("_id").alias(id_col), F.col("_text").alias(text_col), "rest", "n", "form", F.col("lo").cast("long").alias("prefix_chars"), (F.col("hi") - F.col("lo")).cast("long").alias("middle_chars"), output.alias("output"),
    )
    names = [c for c in columns if c in (id_col, text_col) or rest]
    return d.select(*unpacked(names, id_col, text_col), *made)
