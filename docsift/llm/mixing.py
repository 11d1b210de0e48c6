"""Mixing sources to target weights by Sainte-Lague apportionment.

The word budget is cut into blocks of equal size.  The blocks go to sources by
highest quotients (target / 1, / 3, / 5, ...), and the blocks of a source go in
the same way to its super-shards and from there to its shards, so that every
shard has an integer quota before any document is looked at.  In a shard the
documents stand in a seeded order; its quota takes whole passes over that
stream and then a run of blocks from a seeded block on, around the end.

A quota differs from the exact share by at most (share * parts / 2 + 1) seats,
so only the quotients around the exact share are listed: about four rows a part
instead of one a block.  Everything is DataFrame code; what is sorted in one
task is one shard of about ``shard_words`` words, one super-shard of
``SUPER`` shards, or one row per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsift.llm.common import WORD_PATTERN, materialise

SUPER = 1024
# The table of sources goes to every task up to so many rows, and by a shuffle beyond.
SMALL = 10_000
WEIGHTS = (3, 1, 2)


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def seeded(*parts: Column, seed: int) -> Column:
    """A number below 2**32 from the seed and some values."""
    text = F.concat_ws("/", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def sainte_lague(parts: DataFrame, group: list[str], order: list[str], weight: str, seats: str, out: str) -> DataFrame:
    """Apportion the ``seats`` of every group to its parts by highest
    quotients weight / (2 s + 1); ties go to the first in ``order``.  Parts
    without weight get none."""
    whole = Window.partitionBy(*group)
    w = F.col(weight).cast("double")
    share = F.when(F.sum(w).over(whole) > 0, w / F.sum(w).over(whole)).otherwise(0.0)
    slack = F.col("_share") * F.col("_parts") / 2 + 1
    listed = (parts.withColumn("_share", share).withColumn("_parts", F.sum(F.when(w > 0, 1).otherwise(0)).over(whole))
              .withColumn("_low", F.greatest(F.lit(0), F.floor(F.col(seats) * F.col("_share") - slack) - 1).cast("long"))
              .withColumn("_high", (F.ceil(F.col(seats) * F.col("_share") + slack) + 1).cast("long")))
    listed = listed.withColumn("_open", F.col(seats) - F.sum(F.when(w > 0, F.col("_low")).otherwise(0)).over(whole))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("_quotient"), *order))
    won = (listed.where(w > 0).select(*group, *order, "_low", "_open", F.explode(F.sequence("_low", "_high")).alias("_s"),
                                      w.alias("_w"))
           .withColumn("_quotient", F.col("_w") / (2 * F.col("_s") + 1)).withColumn("_rank", rank))
    quota = won.groupBy(*group, *order).agg(
        (F.max("_low") + F.sum(F.when(F.col("_rank") <= F.col("_open"), 1).otherwise(0))).cast("long").alias(out))
    return parts.join(quota, group + order, "left").withColumn(out, F.coalesce(out, F.lit(0).cast("long")))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sizes``: (source, source_size).  Adds ``source_no`` (code point order,
    null last) and ``target``: the budget ``share`` times all words, divided by
    weight (``weights`` in turn); a target stops at ``most`` times its source
    and the excess is shared again by weight until none is above."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    no = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    t = sizes.withColumn("source_no", no.cast("long")).withColumn("_weight", weight)
    t = t.withColumn("_cap", most * F.col("source_size"))
    # sources in the order in which they fill up; before a source fills, the
    # earlier ones hold their cap and the level of the others is _level
    fills = Window.orderBy(F.col("_cap") / F.col("_weight"), "source_no")
    before = fills.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = share * F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    level = left / (F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0)))
    t = t.withColumn("_level", level).withColumn("_open", F.col("_cap") > F.col("_weight") * F.col("_level"))
    t = t.withColumn("_final", F.min(F.when(F.col("_open"), F.struct(F.col("_cap") / F.col("_weight"), "source_no", "_level")))
                     .over(everything)["_level"])
    target = F.when(F.col("_final").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_weight") * F.col("_final")))
    return t.select("source", "source_size", "source_no", target.cast("double").alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights=WEIGHTS, share: float = 1.5, most: float = 2.0, block_words: int = 4,
                shard_words: int = 1 << 16, seed: int = 17, carry: bool = False) -> DataFrame:
    """One row per input row: ``doc_id``, ``size`` (words), ``source_size``,
    ``target`` (of its source), ``taken`` (words that the mix takes of it,
    repeats counted; at most ``most`` times ``size``), ``source_no``,
    ``shard``, and what is taken: ``passes`` over the whole document and
    ``runs``, spans of words [start, end) taken besides.  With ``carry`` the
    whole input row is in the struct ``row``.

    A null text has size 0; a null source is a source of its own, last in
    order; a null id is ordered by the empty text; repeated rows count each
    and may take different shares of their shard; an empty table or one
    without words takes nothing.  Other columns are not read."""
    kept = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"),
                       word_count(F.col(f"`{text_col}`")).alias("size"), *kept)
    base = materialise(rows.drop("row"))
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = source_targets(sizes, weights, share, most).withColumn("_all", F.lit(0)).withColumn(
        # the budget, which the targets share out, from whole numbers: sums of targets depend on their order
        "_seats", F.round(min(share, most) * F.sum("source_size").over(Window.partitionBy("_all")) / block_words).cast("long"))
    sources = sainte_lague(sources, ["_all"], ["source_no"], "target", "_seats", "_source_quota")
    sources = materialise(sources.select("source", "source_no", "source_size", "target", "_source_quota"))

    if sources.count() <= SMALL:
        sources = F.broadcast(sources)
    rows = rows if carry else base
    placed = rows.join(sources, rows["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long")
    place = seeded(F.col("doc_id"), seed=seed)
    placed = placed.withColumn("_place", place).withColumn("shard", F.col("_place") % shards)

    sized = placed.drop("row") if not carry else base.join(sources, base["source"].eqNullSafe(sources["source"])).withColumn(
        "shard", place % shards)
    shard = (sized.groupBy("source_no", "shard").agg(F.sum("size").alias("_words"), F.max("_source_quota").alias("_source_quota"))
             .withColumn("_super", F.floor(F.col("shard") / SUPER).cast("long")))
    shard = materialise(shard)
    supers = shard.groupBy("source_no", "_super").agg(F.sum("_words").alias("_super_words"),
                                                      F.max("_source_quota").alias("_source_quota"))
    supers = sainte_lague(supers, ["source_no"], ["_super"], "_super_words", "_source_quota", "_super_quota")
    shard = shard.join(supers.select("source_no", "_super", "_super_quota"), ["source_no", "_super"])
    shard = sainte_lague(shard, ["source_no", "_super"], ["shard"], "_words", "_super_quota", "quota")
    words, blocks = F.col("_words"), F.ceil(F.col("_words") / block_words).cast("long")
    take = F.least(F.col("quota") * block_words, F.floor(most * words).cast("long"))
    shard = shard.select("source_no", "shard", "_words", take.alias("_take"), F.when(
        words > 0, seeded(F.col("source_no"), F.col("shard"), seed=seed + 1) % blocks * block_words).otherwise(0).alias("_from"))
    shard = shard.withColumn("_passes", F.when(words > 0, F.floor(F.col("_take") / words)).otherwise(0).cast("long"))
    shard = shard.withColumn("_run", F.col("_take") - F.col("_passes") * words)

    stream = Window.partitionBy("source_no", "shard").orderBy("_place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    out = placed.join(shard, ["source_no", "shard"]).withColumn("_end", F.sum("size").over(stream))
    start, end = F.col("_end") - F.col("size"), F.col("_end")

    def overlap(a: Column, b: Column) -> Column:
        """Words of the document within [a, b) of its stream."""
        low, high = F.greatest(a, start), F.least(b, end)
        return F.when(low < high, F.struct((low - start).cast("long").alias("start"), (high - start).cast("long").alias("end")))

    stop = F.col("_from") + F.col("_run")
    runs = F.array_compact(F.array(overlap(F.col("_from"), F.least(stop, F.col("_words"))),
                                   overlap(F.lit(0).cast("long"), stop - F.col("_words"))))
    out = out.withColumn("runs", runs)
    taken = F.col("_passes") * F.col("size") + F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return out.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "source_no", "shard",
                      F.col("_passes").alias("passes"), "runs", *(["row"] if carry else []))


def mixed_documents(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", **options) -> DataFrame:
    """The mix as documents with the columns of ``docs``: a row for every pass
    over a document, and one for each run of its words taken besides (with the
    white space before them; ``length_col`` is their length in characters).
    Documents of which nothing is taken, such as those without words, go."""
    mixed = mix_sources(docs, text_col=text_col, carry=True, **options).where(F.col("taken") > 0)
    whole = F.when(F.col("passes") > 0, F.transform(F.sequence(F.lit(1).cast("long"), F.col("passes")), lambda _: F.struct(
        F.lit(0).cast("long").alias("start"), F.lit(-1).cast("long").alias("end")))).otherwise(F.slice("runs", 1, 0))
    parts = mixed.select("row", F.explode(F.concat(whole, F.col("runs"))).alias("part"))
    text = F.col(f"row.`{text_col}`")
    pieces = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD_PATTERN), F.lit(0))
    cut = F.when(F.col("part.end") < 0, text).otherwise(F.array_join(F.slice(
        pieces, (F.col("part.start") + 1).cast("int"), (F.col("part.end") - F.col("part.start")).cast("int")), ""))
    parts = parts.select("row", cut.alias("_text"))
    columns = []
    for c in docs.columns:
        if c == text_col:
            columns.append(F.col("_text").alias(c))
        elif c == length_col:
            columns.append(F.length("_text").cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col(f"row.`{c}`").alias(c))
    return parts.select(*columns)
