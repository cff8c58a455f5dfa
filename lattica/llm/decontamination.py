"""Benchmark decontamination: size-partitioned MinHash containment search. Built-in functions only."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import cut, heavy_join, pairs_of, quoted

SHINGLE, THRESHOLD = 5, 0.8

#: Sketch values of one item beyond what may be missing at the threshold; as many must be met.
SPARE = 3

#: Rows of the sketch, and bytes of the items' shingles, that are broadcast at most; beyond either that join is shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 32_000_000


def normal_words(text: str) -> Column:
    """Lower-case runs of letters and digits: case, punctuation and line breaks don't count."""
    return F.array_remove(F.split(F.lower(F.col(text)), "[^\\p{L}\\p{N}]+", -1), "")


def shingles(words: str, sizes: Iterable[int], hashed: bool) -> Column:
    """Shingles of the array column ``words`` of each of some sizes, as hashes or strings."""

    def of(k: int) -> str:
        one = f"slice({words}, i, {k})"
        return f"CASE WHEN size({words}) >= {k} THEN transform(sequence(1, size({words}) - {k - 1}), i -> {f'xxhash64({one})' if hashed else f'array_join({one}, chr(32))'}) ELSE array() END"

    made = [of(k) for k in sorted(sizes)]
    return F.expr(made[0] if len(made) == 1 else f"concat({', '.join(made)})")


def item_shingles(k: int, hashed: bool) -> Column:
    """Shingles of an item's ``_words``: of k words, or of all its words if they are fewer."""
    whole = "array(xxhash64(_words))" if hashed else "array(array_join(_words, chr(32)))"
    return F.when(F.size("_words") >= k, shingles("_words", [k], hashed)).when(F.size("_words") > 0, F.expr(whole)).otherwise(F.array())


def sketches(items: DataFrame, k: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """(_item, _need, _k): for each item the smallest hashes of its shingles (its MinHash values).

    Items are partitioned by size, a class for each power of two. All items of a class take as many
    values as its largest item may miss at the threshold, plus SPARE. Of them a document with
    containment >= threshold lacks floor((1 - threshold) * size) at most: ``need`` is the rest, so
    the search loses nothing. Containment is measured on the small side (Koslicki and Zabeti's
    containment MinHash): sketches of long documents would have to be as long as the documents.
    """
    sized = items.withColumn("_h", F.sort_array(F.array_distinct(item_shingles(k, hashed=True)))).filter(F.size("_h") > 0)
    miss = f"cast(floor(round((1 - {threshold}) * {{0}}, 6)) as int)"
    upper = "(cast(pow(2, floor(log2(size(_h))) + 1) as int) - 1)"
    taken = sized.withColumn("_m", F.expr(f"least(size(_h), {miss.format(upper)} + {SPARE})")).withColumn("_need", F.expr(f"greatest(1, _m - {miss.format('size(_h)')})"))
    return taken.select("_item", "_need", F.explode(F.slice("_h", 1, F.col("_m"))).alias("_k"))


def contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", k: int = SHINGLE, threshold: float = THRESHOLD
) -> DataFrame:
    """(id, item, n_shingles, n_found, containment) of all pairs with containment >= threshold.

    Containment: distinct k-word shingles of the item found in the whole document, however long, by the
    item's distinct shingles, verified on the shingles' text. An item of n < k words is one shingle of n words
    and is looked for among the documents' n-word shingles. Null or wordless texts and null ids match
    nothing; repeated rows of an id count once (the best of its texts, the longest of an item's); all items at
    the threshold or above are returned, so nothing is left to ties; other columns are ignored; an empty
    table gives no pairs.
    """
    bench = items.select(F.col(quoted(item_col)).cast("long").alias("_item"), F.col(quoted(item_text)).cast("string").alias("_text")).filter("_item IS NOT NULL AND _text IS NOT NULL").dropDuplicates()
    bench = cut(bench.withColumn("_words", normal_words("_text")).select("_item", "_words").filter("size(_words) > 0"), "bench")
    sketch = cut(sketches(bench, k, threshold), "sketch")
    near = F.broadcast(sketch) if sketch.count() <= BROADCAST_ROWS else sketch
    # the k lengths at most that items' shingles have; one, unless items are shorter than a shingle
    sizes = [r[0] for r in bench.select(F.least(F.size("_words"), F.lit(k))).distinct().collect()] or [k]
    whole = pairs_of(docs, id_col, text_col).filter("_id IS NOT NULL AND _text IS NOT NULL")
    hashes = whole.select("_id", normal_words("_text").alias("_words")).select("_id", F.explode(shingles("_words", sizes, hashed=True)).alias("_k"))
    met = hashes.join(near, "_k").groupBy("_id", "_item").agg(F.count_distinct("_k").alias("_met"), F.max("_need").alias("_need")).filter("_met >= _need")
    pairs = cut(met.select("_id", "_item"), "pairs")
    item_sets = cut(bench.select("_item", F.array_distinct(item_shingles(k, hashed=False)).alias("_q")), "items")
    sets = whole.join(pairs.select("_id").distinct(), "_id", "left_semi").select("_id", normal_words("_text").alias("_words")).select("_id", shingles("_words", sizes, hashed=False).alias("_d"))
    size = item_sets.agg(F.sum(F.octet_length(F.array_join("_q", "")) + 16 * F.size("_q"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        asked = pairs.join(F.broadcast(item_sets), "_item")
    else:
        # a passage that a third of all documents hold is a heavy key
        uses = cut(item_sets.join(pairs.groupBy("_item").agg(F.count("*").alias("_uses")), "_item"), "uses")
        asked = heavy_join(pairs, uses, "_item", "_uses", pairs.count()).drop("_uses")
    found = asked.join(sets, "_id").select("_id", "_item", F.size("_q").cast("long").alias("n_shingles"), F.size(F.array_intersect("_q", "_d")).cast("long").alias("n_found"))
    best = found.groupBy("_id", "_item").agg(F.max(F.struct(F.col("n_found") / F.col("n_shingles"), "n_shingles", "n_found")).alias("_b")).select("_id", "_item", "_b.n_shingles", "_b.n_found")
    exact = best.filter(F.expr(f"n_found >= n_shingles * {threshold} - 1e-9"))
    return exact.select(F.col("_id").alias(id_col), F.col("_item").alias(item_col), "n_shingles", "n_found", (F.col("n_found") / F.col("n_shingles")).alias("containment"))
